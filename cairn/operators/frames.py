"""Tables of animation frames: ramps, holds and tie breaking, all in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T

TINY = 1e-6


def tie_jitter(v: Column, keys: list[str], tie: str) -> Column:
    """Equal values move up by a millionth for each that stands before."""
    return v + TINY * (F.row_number().over(Window.partitionBy(*keys, v).orderBy(tie)) - 1)


def monotone_jitter(frame: DataFrame, value: str, keys: list[str], tie: str, out: str = "jittered") -> DataFrame:
    """Ascending values, each at least a millionth above the one before, as a running maximum."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    placed = frame.withColumn("_i", F.row_number().over(w))
    lifted = F.max(F.col(value) - F.col("_i") * TINY).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(out, lifted + F.col("_i") * TINY).drop("_i")


def ramp(labels: DataFrame, total: int, steps: int) -> DataFrame:
    """``label``, ``value``, ``start`` to one row a step: 0, then a linear rise, then held."""
    grid = labels.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("step") - F.col("start") + 1) / F.lit(float(steps))))
    return grid.select("step", "label", (F.col("value") * share).alias("value"))


def hold(frames: DataFrame, last: int, times: int) -> DataFrame:
    """The frame of step ``last`` once more for each of ``times`` further steps."""
    tail = frames.where(F.col("step") == last).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return frames.unionByName(tail.select((F.col("step") + F.col("k")).cast("int").alias("step"), "label", "value"))


def place_label(name: Column, value: Column, keys: list[str]) -> Column:
    """The name with its place from the top counted from 0; equal values share the least place."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value))) - 1
    return F.concat(name, F.lit(" ("), place.cast("string"), F.lit(")"))


def sequence(labels: DataFrame, steps: int, first: int = 0, top: bool = False) -> DataFrame:
    """Labels with the step at which each begins to rise: one after the other from the lowest value up.

    ``steps``: how many steps a label has to itself. ``top``: the highest begins. Ties by label.
    """
    order = F.desc("value") if top else F.asc("value")
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "label")) - 1  # labels are what one picture shows
    return labels.withColumn("start", (F.lit(first) + turn * steps).cast("int"))


def rising(labels: DataFrame, total: int, steps: int, shown: bool = False, least: float = 1e-9) -> DataFrame:
    """As ``ramp``, but a label has no value (null) before its start, nor while its value is below ``least``.

    ``shown``: labels that haven't begun are at zero instead, so that they appear from the first step.
    """
    grid = ramp(labels, total, steps).join(labels.select("label", "start"), "label")
    before = F.lit(0.0) if shown else F.lit(None).cast("double")
    value = F.when(F.col("step") < F.col("start"), before).when(F.col("value") < least, before).otherwise(F.col("value"))
    return grid.select("step", "label", value.alias("value"))


def jumping(labels: DataFrame, total: int) -> DataFrame:
    """Labels that take their whole value at their start and have none before."""
    return rising(labels, total, 1)


def clipped(frames: DataFrame, share: float = 1.0) -> DataFrame:
    """Values cut at a share of the largest value of all frames."""
    most = frames.agg((F.max("value") * share).alias("_most"))
    return frames.join(F.broadcast(most), F.lit(True)).select("step", "label", F.least("value", "_most").alias("value"))  # one row


def duration(frames: DataFrame, period_ms: float, steps_per_period: int = 1) -> DataFrame:
    """How many steps and pictures the frames make, and how many seconds they take."""
    n = F.countDistinct("step")
    return frames.agg(n.alias("steps"), (n * steps_per_period).alias("pictures"), (n * period_ms / 1000.0).alias("seconds"))


def named_steps(frames: DataFrame, first: int = 1) -> DataFrame:
    return frames.select(T.step_label(F.col("step") + first).alias("period"), "step", "label", "value")
