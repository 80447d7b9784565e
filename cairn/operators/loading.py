"""Cleaning, upserts, schema union and resuming."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_or_null(x: Column, digits: int = 4) -> Column:
    """Half-even rounding; NaN, infinities and values beyond 1e308 are null."""
    return F.when(~F.isnan(x) & (F.abs(x) <= 1e308), F.bround(x, digits))


def last_wins(rows: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Upsert by key: the row with the largest ordinal stays; blank keys go."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    w = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return rows.where(known).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in the order first seen, null where a frame lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def still_to_do(groups: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return groups.join(done.select(*keys), list(keys), "left_anti")


def as_json(frame: DataFrame, label: str) -> DataFrame:
    """One JSON document a row, keyed by the label column."""
    return frame.select(F.col(label).alias("label"), F.to_json(F.struct(*(c for c in frame.columns if c != label))).alias("doc"))


def unpivot(frame: DataFrame, label: str) -> DataFrame:
    """A wide matrix as (label, name, value); transposing it is swapping the first two."""
    return frame.unpivot([label], [c for c in frame.columns if c != label], "name", "value")


def yearly_ratings(rows: DataFrame) -> DataFrame:
    """Yearly ratings ready to load: rows without a key, a year or a rating are left out, the last of each key and year stays.

    ``rows``: pk, year and rating as read, and ``ordinal``.
    """
    typed = rows.withColumn("pk", F.when(F.trim(F.col("pk")) != "", F.trim(F.col("pk")))).withColumn("year", F.trim(F.col("year").cast("string")).try_cast("double").cast("int"))
    typed = typed.withColumn("rating", round_or_null(F.trim(F.col("rating").cast("string")).try_cast("double"), 6))
    return last_wins(typed.where("rating IS NOT NULL"), ["pk", "year"], "ordinal")


def split_years(rows: DataFrame, year: str, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Rows within the years, and how many were dropped by year (null ones too)."""
    keep = F.coalesce(F.col(year).between(first, last), F.lit(False))
    return rows.where(keep), rows.where(~keep).groupBy(year).agg(F.count("*").alias("dropped"))


def positive_scores(rows: DataFrame, score: str) -> DataFrame:
    """Rows whose score is a number above zero."""
    value = F.trim(F.col(score).cast("string")).try_cast("double")
    return rows.withColumn(score, value).where(F.col(score) > 0)


def parse_json(frame: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of one JSON column beside the other columns; what isn't JSON of this schema is null."""
    return frame.withColumn(column, F.from_json(column, schema)).select(*(c for c in frame.columns if c != column), f"{column}.*")
