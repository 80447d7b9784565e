"""Parent and child queries over a table of individuals (pk, name, birth_year, sire_pk, dam_pk, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import stats as S
from cairn.functions import text as T

PAGE = 30


def children(people: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of each parent through either side: two equi-joins, so neither side is scanned by OR."""
    p = parents.select(F.col("pk").alias("parent"))
    sides = [people.join(p, F.col(f"{s}_pk") == F.col("parent")) for s in ("sire", "dam")]
    return sides[0].unionByName(sides[1].where(~F.col("sire_pk").eqNullSafe(F.col("dam_pk"))))


def progeny_summary(kids: DataFrame) -> DataFrame:
    r = F.col("rating")
    base = kids.groupBy("parent").agg(
        F.count("*").alias("n"), F.count(r).alias("rated"), F.avg(r).alias("mean_rating"), F.median(r).alias("median_rating"),
        *(f(f"{share}_pct").alias(f"{name}_{share}") for share in ("old", "dn") for name, f in (("mean", F.avg), ("median", F.median))),
        *(F.count(F.when(r >= t, 1)).alias(f"n{t}") for t in (105, 110, 115, 120)),
    )
    for share in ("old", "dn"):
        rho = S.spearman(kids.where(r.isNotNull() & F.col(f"{share}_pct").isNotNull()), ["parent"], f"{share}_pct", "rating")
        base = base.join(rho.select("parent", F.col("rho").alias(f"{share}_rho")), "parent", "left")
    return base


def share_band(x: Column) -> Column:
    return F.when(x < 0.40, "LOW").when(x < 0.75, "MID").when(x.isNotNull(), "HIGH")


def bands(kids: DataFrame, band: Column, name: str) -> DataFrame:
    r = F.col("rating")
    return kids.withColumn(name, band).where(F.col(name).isNotNull()).groupBy("parent", name).agg(F.count("*").alias("n"), F.count(r).alias("rated"), F.avg(r).alias("mean_rating"), F.count(F.when(r >= 110, 1)).alias("n110"), F.avg("old_pct").alias("mean_old"), F.avg("dn_pct").alias("mean_dn"))


def representatives(kids: DataFrame, k: int = 20, low_share: float | None = None) -> DataFrame:
    """The best rated children; with ``low_share`` of those whose share is known and below it."""
    kids = kids.where("rating IS NOT NULL")
    if low_share is not None:
        kids = kids.where(F.col("dn_pct") < low_share)
    w = Window.partitionBy("parent").orderBy(F.desc_nulls_last("rating"), "pk")
    return kids.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mates(kids: DataFrame, people: DataFrame, k: int = 60) -> DataFrame:
    """The other parent of each child, with its name, counted; the most frequent first."""
    mate = F.when(F.col("sire_pk") == F.col("parent"), F.col("dam_pk")).otherwise(F.col("sire_pk"))
    counted = kids.withColumn("mate", mate).where("mate IS NOT NULL").groupBy("parent", "mate").agg(F.count("*").alias("n"))
    named = counted.join(people.select(F.col("pk").alias("mate"), F.col("name").alias("mate_name")), "mate", "left")
    w = Window.partitionBy("parent").orderBy(F.desc("n"), "mate")
    return named.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def search(people: DataFrame, text: str, k: int = 50) -> DataFrame:
    """The one whose key is the text, if any; else names and keys that contain it.

    Exact names first, then by birth year (unknown ones first) and name. Names are compared in
    the search form, keys in lower case.
    """
    key, wanted = F.lower(F.col("pk").cast("string")), F.lit(text.strip().lower())
    name, form = T.search_key(F.col("name")), T.search_key(F.lit(text))
    found = people.where((key == wanted) | F.when(form != "", name.contains(form)).otherwise(False) | key.contains(wanted))
    exact = found.agg(F.max((key == wanted).cast("int")).alias("_any"))  # one row
    hit = found.join(F.broadcast(exact), F.lit(True)).where((F.col("_any") == 0) | (key == wanted))
    return hit.orderBy(F.when(name == form, 0).otherwise(1), F.asc_nulls_first("birth_year"), "name", "pk").limit(k).drop("_any")


#: The five orders of a list of children, each ended by the key.
ORDERS = {
    1: lambda: [F.desc_nulls_last("rating")], 2: lambda: [F.desc_nulls_last("dn_pct")], 3: lambda: [F.desc_nulls_last("old_pct")],
    4: lambda: [F.asc_nulls_last("dn_pct")], 5: lambda: [F.asc_nulls_last("birth_year"), F.coalesce("name", F.lit(""))],
}


def page(kids: DataFrame, number: int, size: int = PAGE, order: int = 1) -> DataFrame:
    return kids.orderBy(*ORDERS[order](), "pk").offset(number * size).limit(size)


def listing(kids: DataFrame) -> DataFrame:
    """The columns of a child list as padded texts: name, birth year, shares, rating."""
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("pk").cast("string"))
    return kids.select(
        "parent", "pk", T.padded(name, 28).alias("name"), T.padded(T.count_text(F.col("birth_year")), 5, True).alias("born"), T.padded(T.percent_text(F.col("old_pct")), 8, True).alias("old"),
        T.padded(T.percent_text(F.col("dn_pct")), 8, True).alias("dn"), T.padded(T.number_text(F.col("rating")), 9, True).alias("rating"),
    )


def profile(people: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted individual with its parents' names (the key where unknown, a dash where there is none) and its number of children."""
    own = people.join(wanted.select("pk"), "pk", "left_semi")
    for side in ("sire", "dam"):
        parent = people.select(F.col("pk").alias(f"{side}_pk"), F.col("name").alias(f"{side}_name"))
        own = own.join(parent, f"{side}_pk", "left").withColumn(f"{side}_name", F.coalesce(F.when(F.col(f"{side}_name") != "", F.col(f"{side}_name")), F.col(f"{side}_pk").cast("string"), F.lit("-")))
    n = children(people, wanted).groupBy(F.col("parent").alias("pk")).agg(F.count("*").alias("children"))
    return own.join(n, "pk", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def history(ratings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Yearly ratings of the wanted individuals in order of year."""
    return ratings.join(wanted.select("pk"), "pk", "left_semi").orderBy("pk", "year", "surface_family")


def trend(kids: DataFrame) -> DataFrame:
    """Rank correlations of both shares with the rating, and the children by band of share, one row a parent and band.

    All three bands appear for every parent with a child, empty ones too.
    """
    every = kids.select("parent").distinct().withColumn("band", F.explode(F.array(*map(F.lit, ("LOW", "MID", "HIGH")))))
    found = bands(kids, share_band(F.col("dn_pct")), "band").select("parent", "band", "n", "rated", "mean_rating", "n110")
    out = every.join(found, ["parent", "band"], "left").na.fill(0, ["n", "rated", "n110"])
    return out.join(progeny_summary(kids).select("parent", "old_rho", "dn_rho"), "parent")


def bearing(kids: DataFrame, people: DataFrame, k: int = 60) -> DataFrame:
    """The best rated children of each parent with the other parent's key and name (the key where unknown)."""
    mate = F.when(F.col("sire_pk") == F.col("parent"), F.col("dam_pk")).otherwise(F.col("sire_pk"))
    w = Window.partitionBy("parent").orderBy(F.desc_nulls_last("rating"), "pk")
    best = kids.withColumn("mate", mate).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    named = best.join(people.select(F.col("pk").alias("mate"), F.col("name").alias("mate_name")), "mate", "left")
    return named.withColumn("mate_name", F.coalesce(F.when(F.col("mate_name") != "", F.col("mate_name")), F.col("mate").cast("string"), F.lit("-")))
