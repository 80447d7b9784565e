"""Means, scales, ranks and entropies, as Column expressions and small aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Between the bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def number(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b within 0..1, or ``default`` where b is nearly zero."""
    return F.when(b > 1e-12, clip(a / b)).otherwise(F.lit(default))


def log_saturation(v: Column, target: float) -> Column:
    return F.when(v <= 0, F.lit(0.0)).otherwise(F.least(F.log1p(v) / F.log1p(F.lit(float(target))), F.lit(1.0)))


def linear_breadth(v: Column, target: float) -> Column:
    """0 at one effective category, 1 at ``target`` of them."""
    return F.when(v <= 1, F.lit(0.0)).otherwise(F.least((v - 1) / F.lit(target - 1.0), F.lit(1.0)))


def weighted_mean(v: Column, w: Column) -> Column:
    """Aggregate: mean by weight over rows with a positive weight, null without any."""
    used = (w > 0) & v.isNotNull()
    return F.try_divide(F.sum(F.when(used, v * w)), F.sum(F.when(used, w)))


def z_scale(v: Column, keys: Sequence[str], centre: float = 100.0, spread: float = 10.0) -> Column:
    """Standard score within ``keys`` by the population deviation; a constant group is the centre."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(v).over(w)
    return F.when(sd > 1e-12, centre + spread * (v - F.avg(v).over(w)) / sd).otherwise(F.lit(centre))


def recentre(v: Column, keys: Sequence[str], centre: float = 100.0) -> Column:
    return v + centre - F.avg(v).over(Window.partitionBy(*keys))


def percentile_of_rank(rank: Column, n: Column) -> Column:
    return F.when(n <= 1, F.lit(100.0)).otherwise(100.0 * (n - rank) / (n - 1))


def average_rank(v: Column, keys: Sequence[str]) -> Column:
    """Ascending rank with ties at their mean place."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(v)) + (F.count("*").over(Window.partitionBy(*keys, v)) - 1) / 2


def effective_count(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """exp(entropy) of each key's category counts, with the number of categories and the total."""
    c = F.col(n).cast("double")
    positive = counts.where(F.col(n) > 0)
    return positive.groupBy(*keys).agg(
        F.exp(F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)).alias("effective"),
        F.count("*").alias("distinct"),
        F.sum(F.col(n)).alias("total"),
    )


def top_text(counts: DataFrame, keys: Sequence[str], category: str, k: int, n: str = "n") -> DataFrame:
    """'a:3 | b:1': the k most frequent categories, ties by name."""
    w = Window.partitionBy(*keys).orderBy(F.desc(n), F.asc(category))
    best = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    item = F.struct(F.col("_r"), F.concat_ws(":", F.col(category), F.col(n).cast("string")).alias("t"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " | ").alias("top"))


def mode_share(counts: DataFrame, keys: Sequence[str], category: str, n: str = "n") -> DataFrame:
    """Most frequent category of each key (ties by name) and its share."""
    w = Window.partitionBy(*keys).orderBy(F.desc(n), F.asc(category))
    total = F.sum(n).over(Window.partitionBy(*keys))
    return counts.withColumn("_r", F.row_number().over(w)).withColumn("share", F.col(n) / total).where("_r = 1").select(*keys, F.col(category).alias("dominant"), "share")


def pearson(x: Column, y: Column, least: int) -> Column:
    """Aggregate: correlation by sums, null below ``least`` pairs or without spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    sx, sy = F.sum(a), F.sum(b)
    vx, vy = F.sum(a * a) - sx * sx / n, F.sum(b * b) - sy * sy / n
    return F.when((n >= least) & (vx > 1e-9) & (vy > 1e-9), (F.sum(a * b) - sx * sy / n) / F.sqrt(vx * vy))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation within ``keys`` over rows with both values, at least three of them."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumn("_rx", average_rank(F.col(x), keys)).withColumn("_ry", average_rank(F.col(y), keys))
    return ranked.groupBy(*keys).agg(F.count("*").alias("pairs"), pearson(F.col("_rx"), F.col("_ry"), 3).alias("rho"))
