"""Views of the TPC-H-like tables as races, ratings, people and reconstruction paths.

Each has a Spark form and, for checking, the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import select as sel
from cairn.sources.ship import ensure_package


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ensure_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


LABELS = {0: "JPN", 1: "USA", 2: "GB", 3: "IRE", 4: "FR"}


def raw_races(spark: SparkSession, sf: str) -> DataFrame:
    """One order as a race with raw labels: race_id, year text, name, country, track, surface."""
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    label = F.col("n_name")
    for k, v in LABELS.items():
        label = F.when(F.col("n_nationkey") == k, v).otherwise(label)
    surface = F.when(F.col("o_orderstatus") == "F", "Turf").when(F.col("o_orderstatus") == "O", " Dirt").otherwise("All-Weather")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("race_id"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Big Hurdle").otherwise("Plain").alias("race_name"),
        label.alias("country"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Tokyo ,  Fuchu").otherwise(F.col("c_mktsegment")).alias("track"),
        surface.alias("surface"),
    )


def races(spark: SparkSession, sf: str) -> DataFrame:
    r = raw_races(spark, sf)
    return r.select(
        "race_id", "year", T.race_type(F.col("race_name")).alias("race_type"), T.surface_family(F.col("surface")).alias("surface_family"),
        T.country(F.col("country")).alias("country"), T.track(F.col("track")).alias("track"),
    )


def entries(spark: SparkSession, sf: str, competitor: str = "l_suppkey") -> DataFrame:
    """The three dearest lines of an order, by distinct competitor, as its placed entries."""
    # one exchange by race serves the three windows and the join
    line = table(spark, sf, "lineitem").select("l_orderkey", F.col(competitor).alias("pk"), "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    order = [F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"]
    best = line.withColumn("_r", F.row_number().over(Window.partitionBy("l_orderkey", "pk").orderBy(*order))).where("_r = 1")
    placed = best.withColumn("placing", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))).where("placing <= 3")
    e = placed.select(F.col("l_orderkey").alias("race_id"), "placing", "pk").join(races(spark, sf), "race_id")
    return e.withColumn("n_valid", F.count("*").over(Window.partitionBy("race_id"))).where("n_valid >= 2").drop("n_valid")


def wide_races(spark: SparkSession, sf: str) -> DataFrame:
    """One order as a wide race row of strings, its three dearest lines as placed entries.

    Some keys are placeholders and some stand twice, so that the cleaning has work to do.
    """
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_linenumber", "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")
    placed = line.withColumn("r", F.row_number().over(order)).where("r <= 3")
    key = F.when(F.col("l_partkey") % 97 == 0, "need winners name").otherwise(F.concat(F.lit(" S"), F.col("l_suppkey").cast("string"), F.lit(" ")))
    three = []
    for i, p in enumerate(("winner", "second", "third"), 1):
        three += [F.max(F.when(F.col("r") == i, key)).alias(f"{p}_pk"), F.max(F.when(F.col("r") == i, F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")))).alias(f"{p}_name")]
    own = placed.groupBy(F.col("l_orderkey").alias("race_id")).agg(*three)
    raw = raw_races(spark, sf).select("race_id", F.col("race_id").alias("ordinal"), F.concat(F.col("year").cast("string"), F.lit(".0")).alias("year"), "race_name", F.lit(None).cast("string").alias("comment"), F.lit("").alias("condition"), "country", "track", "surface")
    return raw.join(own, "race_id")


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Plain stand-in ratings of each year, surface and competitor, exact in any engine."""
    e = entries(spark, sf)
    one = lambda p: F.count(F.when(F.col("placing") == p, 1))
    r = e.groupBy("year", "surface_family", "pk").agg(F.count("*").alias("top3"), one(1).alias("wins"), one(2).alias("seconds"), one(3).alias("thirds"), F.count(F.when(F.col("country") == "JAPAN", 1)).alias("japan"))
    return r.select("*", (2 * F.col("top3")).alias("evidence"), (90.0 + 30.0 * F.col("wins") / F.col("top3") + F.col("pk") % 13).alias("rating"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("pk"), F.col("c_name").alias("name"), F.when(k % 11 != 0, 1990 + k % 30).alias("birth_year"), F.when(k > 0, F.floor(k / 10)).alias("sire_pk"), (F.floor(k / 10) + 1).alias("dam_pk"),
        F.when(k % 5 != 0, 95.0 + F.floor(F.abs("c_acctbal")) % 30).alias("rating"), F.when(k % 7 != 0, (k % 100) / 100.0).alias("dn_pct"), F.when(k % 6 != 0, (k * 7 % 100) / 100.0).alias("old_pct"),
    )


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """A reconstruction path for each brand: a step for each size, with an @-weighted text."""
    p = table(spark, sf, "part")
    first = p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("t"), F.max("p_type").alias("u"), F.min("p_name").alias("m"))
    step = F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")) - 1
    x = first.withColumn("step", step).withColumn("similarity", 0.70 + (F.col("k") % 31) / 100.0)
    text = F.concat("t", F.lit("@0.5|"), "u", F.lit(" x@0.25|"), F.regexp_replace("m", " ", "_"), F.lit("@0."), (F.col("k") % 9 + 1).cast("string"))
    x = x.withColumn("representation", text).withColumn("effective", sel.effective_leaves(sel.at_leaves(F.col("representation"))))
    return x.select(
        F.col("p_brand").alias("source"), "step", F.when(F.col("step") == 0, "SOURCE").when(F.col("k") % 17 == 0, "BREAK_CANDIDATE").otherwise("REPRODUCED").alias("state"), "representation", "similarity",
        F.when(F.col("k") % 4 != 0, 0.60 + (F.col("k") % 41) / 100.0).alias("high_jaccard"), (0.65 + (F.col("k") % 36) / 100.0).alias("carrier_recall"), F.round("effective", 9).alias("effective"),
    )


_CASE = "CASE n_nationkey " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in {0: "JAPAN", 1: "UNITED STATES", 2: "GREAT BRITAIN", 3: "IRELAND", 4: "FRANCE"}.items()) + " ELSE n_name END"
RACES_SQL = f"""races AS (
  SELECT o_orderkey AS race_id, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderpriority = '1-URGENT' THEN 'JUMP' ELSE 'FLAT' END AS race_type,
    CASE o_orderstatus WHEN 'F' THEN 'TURF' WHEN 'O' THEN 'DIRT' ELSE 'SYNTHETIC' END AS surface_family, {_CASE} AS country,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'TOKYO' ELSE c_mktsegment END AS track
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def entries_sql(competitor: str = "l_suppkey") -> str:
    order = "l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey"
    return f"""{RACES_SQL}, best AS (
  SELECT * FROM (SELECT *, {competitor} AS pk, row_number() OVER (PARTITION BY l_orderkey, {competitor} ORDER BY {order}) AS r FROM lineitem) WHERE r = 1
), placed AS (
  SELECT l_orderkey AS race_id, pk, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS INTEGER) AS placing FROM best
), entries AS (
  SELECT * FROM (SELECT p.*, r.* EXCLUDE (race_id), count(*) OVER (PARTITION BY p.race_id) AS n_valid FROM placed p JOIN races r USING (race_id) WHERE placing <= 3) WHERE n_valid >= 2
)"""


RATINGS_SQL = entries_sql() + """, ratings AS (
  SELECT year, surface_family, pk, count(*) AS top3, count(*) FILTER (placing = 1) AS wins, count(*) FILTER (placing = 2) AS seconds, count(*) FILTER (placing = 3) AS thirds,
    count(*) FILTER (country = 'JAPAN') AS japan, 2 * count(*) AS evidence, 90.0::DOUBLE + 30.0::DOUBLE * count(*) FILTER (placing = 1) / count(*) + pk % 13 AS rating
  FROM entries GROUP BY year, surface_family, pk)"""
PEOPLE_SQL = """people AS (
  SELECT c_custkey AS pk, c_name AS name, CASE WHEN c_custkey % 11 <> 0 THEN 1990 + c_custkey % 30 END AS birth_year, CASE WHEN c_custkey > 0 THEN c_custkey // 10 END AS sire_pk, c_custkey // 10 + 1 AS dam_pk,
    CASE WHEN c_custkey % 5 <> 0 THEN 95.0::DOUBLE + CAST(floor(abs(c_acctbal)) AS BIGINT) % 30 END AS rating, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 100) / 100.0::DOUBLE END AS dn_pct,
    CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey * 7 % 100) / 100.0::DOUBLE END AS old_pct
  FROM customer), kids AS (
  SELECT p.pk AS parent, c.* FROM people c JOIN people p ON c.sire_pk = p.pk OR c.dam_pk = p.pk)"""
PATHS_SQL = """first AS (
  SELECT p_brand, p_size, min(p_partkey) AS k, min(p_type) AS t, max(p_type) AS u, min(p_name) AS m FROM part GROUP BY ALL
), paths0 AS (
  SELECT p_brand AS source, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS INTEGER) AS step, k, t, u, m, 0.70::DOUBLE + (k % 31) / 100.0::DOUBLE AS similarity,
    CASE WHEN k % 4 <> 0 THEN 0.60::DOUBLE + (k % 41) / 100.0::DOUBLE END AS high_jaccard, 0.65::DOUBLE + (k % 36) / 100.0::DOUBLE AS carrier_recall,
    [0.5::DOUBLE, 0.25::DOUBLE, (k % 9 + 1) / 10.0::DOUBLE] AS ws FROM first
), paths AS (
  SELECT *, CASE WHEN step = 0 THEN 'SOURCE' WHEN k % 17 = 0 THEN 'BREAK_CANDIDATE' ELSE 'REPRODUCED' END AS state,
    round(exp(-list_sum(list_transform(ws, lambda w: w / list_sum(ws) * ln(w / list_sum(ws))))), 9) AS effective FROM paths0
), post AS (
  SELECT *, similarity >= 0.95 AND (high_jaccard IS NULL OR high_jaccard >= 0.85) AND carrier_recall >= 0.95 AS strict,
    similarity >= 0.80 AND (high_jaccard IS NULL OR high_jaccard >= 0.65) AND carrier_recall >= 0.70 AS fallback FROM paths WHERE state = 'REPRODUCED')"""
#: The wide races cleaned to entries, in SQL.
NORMAL_SQL = f"""{RACES_SQL}, three AS (
  SELECT l_orderkey AS race_id, l_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS placing FROM lineitem
), valid AS (
  SELECT race_id, 's' || l_suppkey AS pk, 'Supplier ' || l_suppkey AS name, placing FROM three WHERE placing <= 3 AND l_partkey % 97 <> 0
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY race_id, pk ORDER BY placing) AS r, max(k) OVER (PARTITION BY race_id) AS repeated FROM (SELECT *, CAST(row_number() OVER (PARTITION BY race_id, pk ORDER BY placing) > 1 AS INTEGER) AS k FROM valid)
), normal AS (
  SELECT race_id, pk, name, placing, repeated, count(*) OVER (PARTITION BY race_id) AS n_valid FROM marked WHERE r = 1)"""
