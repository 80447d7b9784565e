"""Races: entries, comparisons, pair counts, placing counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T

GROUP = ("year", "race_type", "surface_family")


def normalise_races(wide: DataFrame) -> DataFrame:
    """From one row a race (three name/key pairs) to one row an entry, cleaned.

    Placeholder keys go, a key placed twice keeps its better place, and ``n_valid`` says how many
    entries the race keeps; ``repeated`` marks races in which a key stood twice.
    """
    three = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("placing"), T.key(F.col(f"{p}_pk")).alias("pk"), T.clean(F.col(f"{p}_name")).alias("name"))
                for i, p in enumerate(("winner", "second", "third"), 1)
            )
        )
    )
    base = wide.select(
        "race_id",
        T.whole_year(F.col("year")).alias("year"),
        T.race_type(F.col("race_name"), F.col("comment"), F.col("condition")).alias("race_type"),
        T.surface_family(F.col("surface")).alias("surface_family"),
        T.country(F.col("country")).alias("country"),
        T.track(F.col("track")).alias("track"),
        T.clean(F.col("surface")).alias("surface_raw"),
        T.stable_fold(F.col("race_id")).alias("fold"),
        *([F.col("ordinal")] if "ordinal" in wide.columns else []),
        three.alias("e"),
    ).where(F.col("year").isNotNull())
    entries = base.select(*(c for c in base.columns if c != "e"), "e.*").where(T.valid_key(F.col("pk")))
    return mark_repeats(entries)


def mark_repeats(entries: DataFrame) -> DataFrame:
    """First placing of each key in a race, with ``n_valid`` and ``repeated`` of its race."""
    once = Window.partitionBy("race_id", "pk").orderBy("placing")
    race = Window.partitionBy("race_id")
    seen = entries.withColumn("_r", F.row_number().over(once))
    marked = seen.withColumn("repeated", F.max((F.col("_r") > 1).cast("int")).over(race))
    kept = marked.where("_r = 1").drop("_r")
    return kept.withColumn("n_valid", F.count("*").over(race))


def comparisons(entries: DataFrame, carry: Sequence[str] = (*GROUP, "race_id")) -> DataFrame:
    """Ordered (winner, loser) pairs within each race: the better placed beats the rest.

    A race has few entries, so they meet as an array in one row instead of a self-join. It is of
    one group, so with ``race_id`` among ``carry`` the rest of them are its first entry's, and
    entries that stand by race already don't move.
    """
    e = F.struct("placing", "pk")
    by = ["race_id"] if "race_id" in carry else list(carry)
    races = entries.groupBy(*by).agg(F.array_sort(F.collect_list(e)).alias("es"), *(F.first(c).alias(c) for c in carry if c not in by))
    pairs = F.flatten(F.transform("es", lambda x, i: F.transform(F.slice("es", i + 2, F.greatest(F.size("es") - i - 1, F.lit(0))), lambda y: F.struct(x["pk"].alias("winner"), y["pk"].alias("loser")))))
    return races.where(F.size("es") >= 2).select(*carry, F.explode(pairs).alias("p")).select(*carry, "p.*")


def pair_counts(pairs: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Meetings of each unordered pair, and the edge weight log(1 + n)."""
    out = pairs.groupBy(*keys, F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")).agg(F.count("*").alias("n"))
    return out.withColumn("w", F.log1p(F.col("n")))


def evidence(pairs: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Comparisons that each competitor took part in, won or lost."""
    both = pairs.select(*keys, F.explode(F.array("winner", "loser")).alias("pk"))
    return both.groupBy(*keys, "pk").agg(F.count("*").alias("evidence"))


def placing_counts(entries: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    one = lambda p: F.count(F.when(F.col("placing") == p, 1))
    return entries.groupBy(*keys, "pk").agg(F.count("*").alias("top3"), one(1).alias("wins"), one(2).alias("seconds"), one(3).alias("thirds"))
