"""One query for each operator family, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import stats as S
from cairn.functions import text as T
from cairn.operators import bradley_terry, breadth, calibrate, frames, lineage, loading, network, races, select, summary

from cairn.sources import output

from . import adapters as A
from .adapters import NORMAL_SQL, PATHS_SQL, PEOPLE_SQL, RACES_SQL, RATINGS_SQL, entries_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
GROUP = list(races.GROUP)
YS = ["year", "surface_family"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = re.sub(r"\bplacing\b", '"placing"', sql)  # a reserved word there
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- scans, cleaning, classification ---------------------------------------------------------

@query("SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 40")
def scan_project(spark, sf):
    return table(spark, sf, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AND l_quantity > 40").select("l_orderkey", "l_partkey", "l_extendedprice")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderkey % 10 NOT IN (3, 4) AND year(o_orderdate) BETWEEN 1996 AND 1999")
def year_coerce_filter(spark, sf):
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 10 == 3, "abc").when(F.col("o_orderkey") % 10 == 4, "").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit(".7")))
    return o.select("o_orderkey", T.whole_year(raw).alias("year")).where("year BETWEEN 1996 AND 1999")


_RAW_YEAR = "CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END"


def _raw_years(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.whole_year(F.when(F.col("o_orderkey") % 10 == 3, "abc").otherwise(F.year("o_orderdate").cast("string"))).alias("year"))


@query(f"SELECT year, count(*) AS dropped FROM (SELECT {_RAW_YEAR} AS year FROM orders) WHERE year IS NULL OR year NOT BETWEEN 1996 AND 1999 GROUP BY ALL")
def years_dropped(spark, sf):
    return loading.split_years(_raw_years(spark, sf), "year", 1996, 1999)[1]


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) IN (1995, 1998) UNION ALL SELECT -o_orderkey, CAST(year(o_orderdate) AS INTEGER) FROM orders WHERE year(o_orderdate) >= 1998")
def year_choice(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    listed = o.where(T.in_years(F.col("year"), T.parse_years("1998, 1995,,"), first=1997))
    return listed.unionByName(o.where(T.in_years(F.col("year"), None, 1998)).select((-F.col("o_orderkey")).alias("o_orderkey"), "year"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST(year(o_orderdate) AS INTEGER) IN (SELECT 1992 + s_nationkey % 7 FROM supplier WHERE s_acctbal > 9000)")
def semi_years(spark, sf):
    years = table(spark, sf, "supplier").where("s_acctbal > 9000").select((1992 + F.col("s_nationkey") % 7).cast("int").alias("wanted"))
    return table(spark, sf, "orders").join(years, F.year("o_orderdate") == F.col("wanted"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_acctbal AS score FROM customer WHERE c_acctbal > 0 AND c_custkey % 7 <> 0")
def positive_scores(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("score"))
    return loading.positive_scores(c, "score")


@query("""SELECT c_custkey, printf('%.2f', c_acctbal) AS number, format('{:,}', CAST(c_acctbal * 100 AS BIGINT)) AS whole, CASE WHEN c_custkey % 7 = 0 THEN '-' WHEN c_custkey % 2 = 0 THEN printf('%.1f%%', 100.0 * (c_custkey % 100) / 100.0) ELSE printf('%.1f%%', 2.0 + c_custkey % 50) END AS share,
printf('%.6f', c_acctbal / 3) AS six, rpad(left(c_name, 12), 14, ' ') AS name, 'Step ' || c_custkey AS step, c_nationkey AS whole_number FROM customer""")
def number_texts(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    share = F.when(k % 7 != 0, F.when(k % 2 == 0, (k % 100) / 100.0).otherwise(2.0 + k % 50))
    return c.select(
        "c_custkey", T.number_text(F.col("c_acctbal")).alias("number"), T.count_text((F.round(F.col("c_acctbal") * 100)).cast("long")).alias("whole"), T.percent_text(share).alias("share"), T.plain_text(F.col("c_acctbal") / 3, "double").alias("six"),
        F.rpad(T.padded(F.col("c_name"), 12), 14, " ").alias("name"), T.step_label(k).alias("step"), T.to_int(F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(".9 "))).alias("whole_number"),
    )


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 NOT IN (1, 2, 3)")
def valid_pk_filter(spark, sf):
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 1, " XX ").when(k == 2, "Need  Winner-Name").when(k == 3, "n/a").otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").where(T.valid_key(raw)).select("s_suppkey")


@query(f"WITH {RACES_SQL} SELECT country, count(*) AS n FROM races GROUP BY country")
def country_norm(spark, sf):
    return A.raw_races(spark, sf).groupBy(T.country(F.col("country")).alias("country")).agg(F.count("*").alias("n"))


@query(f"WITH {RACES_SQL} SELECT surface_family, count(*) AS n FROM races GROUP BY ALL")
def surface_family(spark, sf):
    return A.raw_races(spark, sf).groupBy(T.surface_family(F.col("surface")).alias("surface_family")).agg(F.count("*").alias("n"))


@query(f"WITH {RACES_SQL} SELECT race_type, year, count(*) AS n FROM races GROUP BY ALL")
def race_type(spark, sf):
    return A.raw_races(spark, sf).groupBy(T.race_type(F.col("race_name")).alias("race_type"), "year").agg(F.count("*").alias("n"))


@query(f"WITH {RACES_SQL} SELECT concat_ws('::', country, track) AS domain, count(*) AS n FROM races GROUP BY ALL")
def track_norm(spark, sf):
    r = A.raw_races(spark, sf)
    return r.groupBy(T.domain(T.country(F.col("country")), T.track(F.col("track"))).alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || '+' || p_type), '[^0-9a-z]+', '', 'g') AS key FROM part")
def search_norm(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.search_key(F.concat("p_name", F.lit("+"), "p_type")).alias("key"))


@query("SELECT s_suppkey AS label, '{\"s_name\":\"' || s_name || '\",\"s_nationkey\":' || s_nationkey || '}' AS doc FROM supplier")
def json_encode(spark, sf):
    return loading.as_json(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")


@query()
def stable_fold(spark, sf):
    return table(spark, sf, "orders").groupBy(T.stable_fold(F.col("o_orderkey")).alias("fold")).agg(F.count("*").alias("n"))


# ---- races and comparisons -------------------------------------------------------------------

@query(f"WITH {NORMAL_SQL} SELECT race_id, pk, name, placing, repeated, n_valid, year, race_type, surface_family, country, track FROM normal JOIN races USING (race_id)")
def normalise_races(spark, sf):
    return races.normalise_races(A.wide_races(spark, sf)).select("race_id", "pk", "name", "placing", "repeated", "n_valid", *GROUP, "country", "track")


@query(f"WITH {entries_sql()} SELECT race_id, pk, placing, year, race_type, surface_family FROM entries")
def race_dedup(spark, sf):
    return A.entries(spark, sf).select("race_id", "pk", "placing", *GROUP)


@query(f"WITH {entries_sql()} SELECT year, race_type, surface_family, pk, count(*) AS top3, count(*) FILTER (placing = 1) AS wins, count(*) FILTER (placing = 2) AS seconds, count(*) FILTER (placing = 3) AS thirds FROM entries GROUP BY ALL")
def placing_counts(spark, sf):
    return races.placing_counts(A.entries(spark, sf))


PAIRS_SQL = entries_sql() + ", pairs AS (SELECT a.year, a.race_type, a.surface_family, a.race_id, a.pk AS winner, b.pk AS loser FROM entries a JOIN entries b ON a.race_id = b.race_id AND a.placing < b.placing)"


@query(f"WITH {PAIRS_SQL} SELECT race_id, winner, loser FROM pairs")
def comparisons(spark, sf):
    return races.comparisons(A.entries(spark, sf)).select("race_id", "winner", "loser")


@query(f"WITH {PAIRS_SQL} SELECT year, race_type, surface_family, least(winner, loser) AS a, greatest(winner, loser) AS b, count(*) AS n, round(ln(1 + count(*)), 6) AS w FROM pairs GROUP BY ALL")
def pair_counts(spark, sf):
    return races.pair_counts(races.comparisons(A.entries(spark, sf))).withColumn("w", F.round("w", 6))


@query(f"WITH {PAIRS_SQL} SELECT year, race_type, surface_family, pk, count(*) AS evidence FROM (SELECT *, winner AS pk FROM pairs UNION ALL SELECT *, loser FROM pairs) GROUP BY ALL")
def evidence(spark, sf):
    return races.evidence(races.comparisons(A.entries(spark, sf)))


# ---- aggregates, scales and ranks ------------------------------------------------------------

@query("SELECT l_suppkey, round(sum(l_extendedprice * (l_quantity - 10)) FILTER (l_quantity > 10) / sum(l_quantity - 10) FILTER (l_quantity > 10), 4) AS mean FROM lineitem GROUP BY ALL")
def weighted_mean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(S.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity") - 10), 4).alias("mean"))


@query(f"WITH {RATINGS_SQL} SELECT year, surface_family, pk, round(CASE WHEN stddev_pop(rating) OVER w > 1e-12 THEN 100 + 10 * (rating - avg(rating) OVER w) / stddev_pop(rating) OVER w ELSE 100 END, 6) AS z, round(rating + 100 - avg(rating) OVER w, 6) AS c FROM ratings WINDOW w AS (PARTITION BY year, surface_family)")
def zscale(spark, sf):
    return A.ratings(spark, sf).select(*YS, "pk", F.round(S.z_scale(F.col("rating"), YS), 6).alias("z"), F.round(S.recentre(F.col("rating"), YS), 6).alias("c"))


@query("SELECT l_orderkey, round(0.7 * avg(l_extendedprice) FILTER (r <= 3) + 0.3 * avg(l_extendedprice), 6) AS mix FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) GROUP BY ALL")
def topk_context_mix(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"))
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice").withColumn("r", F.row_number().over(w))
    return x.groupBy("l_orderkey").agg(F.round(0.7 * F.avg(F.when(F.col("r") <= 3, F.col("l_extendedprice"))) + 0.3 * F.avg("l_extendedprice"), 6).alias("mix"))


COUNTS_SQL = entries_sql() + ", counts AS (SELECT pk, country, count(*) AS n FROM entries GROUP BY ALL)"


def _counts(spark, sf):
    return A.entries(spark, sf).groupBy("pk", "country").agg(F.count("*").alias("n"))


@query(f"WITH {COUNTS_SQL} SELECT pk, round(exp(-sum(n / t * ln(n / t))), 6) AS effective, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY pk) AS t FROM counts) GROUP BY pk")
def effective_count(spark, sf):
    return S.effective_count(_counts(spark, sf), ["pk"]).select("pk", *r6("effective"), F.col("distinct").alias("n_distinct"), "total")


@query(f"WITH {entries_sql()} SELECT year, count(DISTINCT pk) AS competitors, count(DISTINCT race_id) AS races FROM entries GROUP BY ALL")
def distinct_count(spark, sf):
    return A.entries(spark, sf).groupBy("year").agg(F.countDistinct("pk").alias("competitors"), F.countDistinct("race_id").alias("races"))


@query(f"WITH {COUNTS_SQL} SELECT pk, string_agg(country || ':' || n, ' | ' ORDER BY n DESC, country) AS top FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY n DESC, country) AS r FROM counts) WHERE r <= 5 GROUP BY pk")
def topk_category_text(spark, sf):
    return S.top_text(_counts(spark, sf), ["pk"], "country", 5)


@query(f"WITH {COUNTS_SQL} SELECT pk, country AS dominant, round(n / t, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY pk) AS t, row_number() OVER (PARTITION BY pk ORDER BY n DESC, country) AS r FROM counts) WHERE r = 1")
def mode_share(spark, sf):
    return S.mode_share(_counts(spark, sf), ["pk"], "country").select("pk", "dominant", *r6("share"))


@query(f"WITH {RATINGS_SQL} SELECT year, surface_family, pk, CAST(rank() OVER w AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY year, surface_family ORDER BY rating DESC, pk) AS INTEGER) AS place, round(CASE WHEN count(*) OVER g <= 1 THEN 100 ELSE 100.0 * (count(*) OVER g - rank() OVER w) / (count(*) OVER g - 1) END, 6) AS percentile, round(rank() OVER (PARTITION BY year, surface_family ORDER BY rating) + (count(*) OVER (PARTITION BY year, surface_family, rating) - 1) / 2, 6) AS mean_rank FROM ratings WINDOW w AS (PARTITION BY year, surface_family ORDER BY rating DESC), g AS (PARTITION BY year, surface_family)")
def ranks(spark, sf):
    w = Window.partitionBy(*YS)
    by = w.orderBy(F.desc("rating"))
    r = A.ratings(spark, sf).withColumn("rank", F.rank().over(by)).withColumn("n", F.count("*").over(w))
    return r.select(*YS, "pk", "rank", F.row_number().over(w.orderBy(F.desc("rating"), "pk")).alias("place"), F.round(S.percentile_of_rank(F.col("rank"), F.col("n")), 6).alias("percentile"), F.round(S.average_rank(F.col("rating"), YS).cast("double"), 6).alias("mean_rank"))


@query(f"WITH {RATINGS_SQL}, k AS (SELECT year, surface_family, rank() OVER (PARTITION BY year, surface_family ORDER BY top3) + (count(*) OVER (PARTITION BY year, surface_family, top3) - 1) / 2.0 AS x, rank() OVER (PARTITION BY year, surface_family ORDER BY rating) + (count(*) OVER (PARTITION BY year, surface_family, rating) - 1) / 2.0 AS y FROM ratings) SELECT year, surface_family, count(*) AS pairs, round(corr(x, y), 6) AS rho FROM k GROUP BY ALL")
def spearman(spark, sf):
    return S.spearman(A.ratings(spark, sf), YS, "top3", "rating").select(*YS, "pairs", *r6("rho"))


@query("SELECT l_returnflag, l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL")
def pearson(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(S.pearson(F.col("l_quantity"), F.col("l_extendedprice"), 3), 6).alias("r"))


@query("SELECT CAST(floor(l_quantity / 5) * 5 AS BIGINT) AS band, count(*) AS n, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY ALL")
def median_band(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.floor(F.col("l_quantity") / 5) * 5).alias("band")).agg(F.count("*").alias("n"), F.round(F.median("l_extendedprice"), 4).alias("median"))


# ---- summaries -------------------------------------------------------------------------------

_WIDE = ", ".join(f"max(rating) FILTER (surface_family = '{f}') AS {f.lower()}_rating, CAST(coalesce(max(top3) FILTER (surface_family = '{f}'), 0) AS BIGINT) AS {f.lower()}_top3" for f in T.FAMILIES)


@query(f"""WITH {RATINGS_SQL}, r AS (SELECT *, evidence >= 4 AND top3 >= 2 AS ok FROM ratings), p AS (SELECT *, row_number() OVER (PARTITION BY year, pk ORDER BY ok DESC, rating DESC, surface_family) AS place, sum(top3) OVER (PARTITION BY year, pk) AS t FROM r)
SELECT *, round(primary_rating - floor_rating, 6) AS primary_minus_floor FROM (SELECT year, pk, count(*) AS surfaces, count(*) FILTER (ok) AS reliable_surfaces, CAST(sum(top3) AS BIGINT) AS total_top3, max(surface_family) FILTER (place = 1) AS primary_surface, max(rating) FILTER (place = 1) AS primary_rating,
  CASE WHEN count(*) FILTER (ok) >= 2 THEN min(rating) FILTER (ok) END AS floor_rating, CAST(count(*) FILTER (ok) >= 2 AS INTEGER) AS verified, round(exp(-sum(top3 / t * ln(top3 / t))), 6) AS effective_surfaces, {_WIDE} FROM p GROUP BY year, pk)""")
def multisurface_summary(spark, sf):
    return summary.multi_surface(A.ratings(spark, sf)).withColumn("effective_surfaces", F.round("effective_surfaces", 6)).withColumn("primary_minus_floor", F.round("primary_minus_floor", 6))


@query(f"""WITH {RATINGS_SQL}, j AS (SELECT a.surface_family AS a, b.surface_family AS b, a.rating AS x, b.rating AS y FROM ratings a JOIN ratings b ON a.year = b.year AND a.pk = b.pk AND a.surface_family < b.surface_family)
SELECT a, b, count(*) AS n, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b, round(avg(abs(x - y)), 6) AS mean_gap, round(corr(x, y), 6) AS correlation, round(avg(CAST(x >= 110 AND y >= 110 AS DOUBLE)), 6) AS share_110, round(avg(CAST(x >= 115 AND y >= 115 AS DOUBLE)), 6) AS share_115 FROM j GROUP BY ALL""")
def overlap_matrix(spark, sf):
    out = summary.overlap(summary.overlap_sums(A.ratings(spark, sf)))
    return out.select("a", "b", "n", *r6("mean_a", "mean_b", "mean_gap", "correlation", "share_110", "share_115"))


@query(f"""WITH {RATINGS_SQL} SELECT year, surface_family, pk, rating, CAST(rank() OVER w AS INTEGER) AS host_rank, count(*) OVER g AS host_n, round(CASE WHEN count(*) OVER g <= 1 THEN 100 ELSE 100.0 * (count(*) OVER g - rank() OVER w) / (count(*) OVER g - 1) END, 6) AS host_percentile FROM ratings WHERE japan > 0 WINDOW w AS (PARTITION BY year, surface_family ORDER BY rating DESC), g AS (PARTITION BY year, surface_family)""")
def host_ranking(spark, sf):
    return summary.host_ranking(A.ratings(spark, sf), YS, "japan").select(*YS, "pk", "rating", "host_rank", "host_n", *r6("host_percentile"))


# ---- ratings and networks --------------------------------------------------------------------

@query()
def bt_rating(spark, sf):
    e = A.entries(spark, sf).withColumn("fold", T.stable_fold(F.col("race_id")))
    return bradley_terry.adjust(bradley_terry.fit_groups(e))


@query()
def network_partition(spark, sf):
    return network.networks(races.pair_counts(races.comparisons(A.entries(spark, sf, "l_partkey"))))


NODES_SQL = PAIRS_SQL + """, edges AS (SELECT year, race_type, surface_family, least(winner, loser) AS a, greatest(winner, loser) AS b, count(*) AS n, ln(1 + count(*)) AS w FROM pairs GROUP BY ALL),
sides AS (SELECT year, race_type, surface_family, n, w, a % 7 = b % 7 AS same, a % 7 AS network_id, a AS pk FROM edges UNION ALL SELECT year, race_type, surface_family, n, w, false, b % 7, b FROM edges WHERE a % 7 <> b % 7),
nodes AS (SELECT DISTINCT year, race_type, surface_family, pk, pk % 7 AS network_id FROM (SELECT year, race_type, surface_family, a AS pk FROM edges UNION ALL SELECT year, race_type, surface_family, b FROM edges))"""


def _mapped(spark, sf):
    edges = output.Store(spark, "edges").save("edges", races.pair_counts(races.comparisons(A.entries(spark, sf))))
    nodes = edges.select(*GROUP, F.explode(F.array("a", "b")).alias("pk")).distinct().withColumn("network_id", F.col("pk") % 7)
    return edges, nodes


@query(f"""WITH {NODES_SQL}, s AS (SELECT year, race_type, surface_family, network_id, count(*) FILTER (same) AS internal_edges, CAST(coalesce(sum(n) FILTER (same), 0) AS BIGINT) AS internal_comparisons, count(*) FILTER (NOT same) AS external_edges, CAST(coalesce(sum(n) FILTER (NOT same), 0) AS BIGINT) AS external_comparisons, count(DISTINCT pk) FILTER (NOT same) AS bridge_competitors, coalesce(sum(w) FILTER (same), 0) AS i, coalesce(sum(w) FILTER (NOT same), 0) AS cut FROM sides GROUP BY ALL),
t AS (SELECT year, race_type, surface_family, 2 * sum(w) AS m FROM edges GROUP BY ALL), h AS (SELECT year, race_type, surface_family, network_id, count(*) AS competitors FROM nodes GROUP BY ALL)
SELECT year, race_type, surface_family, network_id, competitors, internal_edges, internal_comparisons, external_edges, external_comparisons, bridge_competitors, round(external_comparisons / (2 * internal_comparisons + external_comparisons), 6) AS bridge_share, round(CASE WHEN least(2 * i + cut, m - 2 * i - cut) > 1e-12 THEN cut / least(2 * i + cut, m - 2 * i - cut) ELSE 0 END, 6) AS conductance
FROM h JOIN s USING (year, race_type, surface_family, network_id) JOIN t USING (year, race_type, surface_family)""")
def network_metrics(spark, sf):
    return network.network_measures(*_mapped(spark, sf)).withColumn("bridge_share", F.round("bridge_share", 6)).withColumn("conductance", F.round("conductance", 6))


@query(f"""WITH {NODES_SQL}, v AS (SELECT year, race_type, surface_family, network_id, sum(CASE WHEN same THEN 2 * w ELSE w END) AS vol, sum(CASE WHEN same THEN 2 * w ELSE 0 END) AS i FROM sides GROUP BY ALL)
SELECT year, race_type, surface_family, round(sum(i / m - (vol / m) * (vol / m)), 6) AS modularity FROM (SELECT *, sum(vol) OVER (PARTITION BY year, race_type, surface_family) AS m FROM v) GROUP BY ALL""")
def modularity(spark, sf):
    return network.modularity(*_mapped(spark, sf)).select(*GROUP, *r6("modularity"))


# ---- breadth and retention -------------------------------------------------------------------

def _spread_sql(name: str, frame: str, keys: str, category: str) -> str:
    return f"{name} AS (SELECT {keys}, exp(-sum(n / t * ln(n / t))) AS e, count(*) AS c, CAST(sum(n) AS BIGINT) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS t FROM (SELECT {keys}, {category}, count(*) AS n FROM {frame} GROUP BY ALL)) GROUP BY ALL)"


_PARTS = (("top3_domains", "domain"), ("win_domains", "domain"), ("top3_countries", "country"), ("win_countries", "country"), ("opponent_networks", "other"))


def _breadth_sql(keys: str, frames_: tuple[str, ...], base: str) -> str:
    ctes = ", ".join(_spread_sql(p, f, keys, c) for (p, c), f in zip(_PARTS, frames_, strict=True))
    cols = ", ".join(f"coalesce({p}.e, 0) AS effective_{p}, coalesce({p}.c, 0) AS {p}_count, coalesce({p}.s, 0) AS {p}_total" for p, _ in _PARTS)
    joins = " ".join(f"LEFT JOIN {p} USING ({keys})" for p, _ in _PARTS)
    return f"{ctes}, {base}_b AS (SELECT {keys}, {cols} FROM (SELECT DISTINCT {keys} FROM {base}) {joins})"


MET_SQL = entries_sql() + """, e AS (SELECT *, pk % 7 AS network_id, country || '::' || track AS domain FROM entries), present AS (SELECT DISTINCT year, race_type, surface_family, race_id, network_id, domain, country FROM e), won AS (SELECT * FROM e WHERE placing = 1),
met AS (SELECT a.*, b.network_id AS other FROM present a JOIN present b ON a.race_id = b.race_id AND a.network_id <> b.network_id), hmet AS (SELECT a.*, b.network_id AS other FROM e a JOIN present b ON a.race_id = b.race_id AND a.network_id <> b.network_id)"""
NET_SQL = MET_SQL + ", " + _breadth_sql("year, race_type, surface_family, network_id", ("present", "won", "present", "won", "met"), "present")
COMPETITOR_SQL = MET_SQL + ", " + _breadth_sql("year, race_type, surface_family, pk", ("e", "won", "e", "won", "hmet"), "e")
_COLS = [f"{a}{p}{b}" for p, _ in _PARTS for a, b in (("effective_", ""), ("", "_count"), ("", "_total"))]
_SQL_COLS = ", ".join(f"round({c}, 6) AS {c}" if c.startswith("effective") else f"CAST({c} AS BIGINT) AS {c}" for c in _COLS)


def _breadth(spark, sf):
    return breadth.breadth(A.entries(spark, sf).withColumn("network_id", F.col("pk") % 7), GROUP)


def _shown(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.select(*keys, *(F.round(c, 6).alias(c) if c.startswith("effective") else F.col(c).cast("long").alias(c) for c in _COLS))


@query(f"WITH {NET_SQL} SELECT year, race_type, surface_family, network_id, {_SQL_COLS} FROM present_b")
def breadth_network(spark, sf):
    return _shown(_breadth(spark, sf)[0], [*GROUP, "network_id"])


@query(f"WITH {COMPETITOR_SQL} SELECT year, race_type, surface_family, pk, {_SQL_COLS} FROM e_b")
def breadth_competitor(spark, sf):
    return _shown(_breadth(spark, sf)[1], [*GROUP, "pk"])


def _sat(v: str, t: int) -> str:
    return f"CASE WHEN {v} <= 0 THEN 0 ELSE least(ln(1 + {v}) / ln(1 + {t}), 1) END"


def _lin(v: str, t: int) -> str:
    return f"CASE WHEN {v} <= 1 THEN 0 ELSE least(({v} - 1) / ({t} - 1), 1) END"


def _conf_sql(top: tuple[int, int, int, int]) -> tuple[str, str, str]:
    venue = f"(0.65::DOUBLE * {_lin('effective_top3_domains', top[0])} + 0.35::DOUBLE * {_lin('effective_win_domains', top[1])})"
    opponent = f"(0.60::DOUBLE * {_lin('effective_opponent_networks', top[2])} + 0.40::DOUBLE * {_sat('opponent_networks_total', top[3])})"
    abroad = "(0.60::DOUBLE * least(greatest(top3_countries_count - 1, 0) / 3, 1) + 0.40::DOUBLE * least(greatest(win_countries_count - 1, 0) / 2, 1))"
    return venue, opponent, abroad


_NV, _NO, _NA = _conf_sql((6, 5, 4, 20))
_HV, _HO, _HA = _conf_sql((4, 3, 3, 8))
_INTERNAL = f"(0.45::DOUBLE * {_sat('competitors', 150)} + 0.30::DOUBLE * {_sat('races', 100)} + 0.25::DOUBLE * {_sat('compared', 300)})"
SIZE_SQL = ", sizes AS (SELECT year, race_type, surface_family, network_id, count(DISTINCT pk) AS competitors, count(DISTINCT race_id) AS races, 2 * count(*) AS compared FROM e GROUP BY ALL)"
NETC_SQL = NET_SQL + SIZE_SQL + f", netc AS (SELECT *, {_INTERNAL} AS internal, {_NV} AS venue, {_NO} AS opponent, {_NA} AS international, 0.55::DOUBLE * {_NV} + 0.30::DOUBLE * {_NO} + 0.15::DOUBLE * {_NA} AS external FROM present_b JOIN sizes USING (year, race_type, surface_family, network_id))"


def _net_confidence(spark, sf):
    e = A.entries(spark, sf).withColumn("network_id", F.col("pk") % 7)
    net = breadth.breadth(e, GROUP)[0]
    sizes = e.groupBy(*GROUP, "network_id").agg(F.countDistinct("pk").alias("competitors"), F.countDistinct("race_id").alias("races"), (2 * F.count("*")).alias("compared"))
    both = net.join(sizes, [*GROUP, "network_id"])
    return both.select(*GROUP, "network_id", *_COLS, *(c.alias(k) for k, c in breadth.network_confidence(F.col("competitors"), F.col("races"), F.col("compared")).items()))


@query(f"WITH {NETC_SQL} SELECT year, race_type, surface_family, network_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("internal", "venue", "opponent", "international", "external")) + " FROM netc")
def network_confidence(spark, sf):
    return _net_confidence(spark, sf).select(*GROUP, "network_id", *r6("internal", "venue", "opponent", "international", "external"))


@query(f"WITH {COMPETITOR_SQL} SELECT year, race_type, surface_family, pk, round({_HV}, 6) AS own_venue, round({_HO}, 6) AS bridge, round({_HA}, 6) AS own_international FROM e_b")
def competitor_confidence(spark, sf):
    h = _breadth(spark, sf)[1]
    return h.select(*GROUP, "pk", *(F.round(c, 6).alias(k) for k, c in breadth.competitor_confidence().items()))


_RATIO = "CASE WHEN {1} > 1e-12 THEN least(greatest({0} / {1}, 0), 1) ELSE 0 END"
_H = ", ".join(f"{c} AS h_{c}" for c in _COLS)
RET_SQL = NETC_SQL + ", " + _breadth_sql("year, race_type, surface_family, pk", ("e", "won", "e", "won", "hmet"), "e").replace("top3_domains AS (", "ct3d AS (").replace("win_domains AS (", "cwd AS (").replace("top3_countries AS (", "ct3c AS (").replace("win_countries AS (", "cwc AS (").replace("opponent_networks AS (", "con AS (").replace("LEFT JOIN top3_domains", "LEFT JOIN ct3d AS top3_domains").replace("LEFT JOIN win_domains", "LEFT JOIN cwd AS win_domains").replace("LEFT JOIN top3_countries", "LEFT JOIN ct3c AS top3_countries").replace("LEFT JOIN win_countries", "LEFT JOIN cwc AS win_countries").replace("LEFT JOIN opponent_networks", "LEFT JOIN con AS opponent_networks") + f""",
own AS (SELECT year, race_type, surface_family, pk, {_H}, {_HV} AS venue_c, {_HO} AS bridge_c, {_HA} AS abroad_c FROM e_b),
rated AS (SELECT year, race_type, surface_family, pk, pk % 7 AS network_id, 90.0::DOUBLE + 30.0::DOUBLE * count(*) FILTER (placing = 1) / count(*) + pk % 13 AS rating FROM entries GROUP BY year, race_type, surface_family, pk),
joined AS (SELECT * FROM rated LEFT JOIN netc USING (year, race_type, surface_family, network_id) LEFT JOIN own USING (year, race_type, surface_family, pk)),
used0 AS (SELECT *, {_RATIO.format('h_effective_top3_domains', 'effective_top3_domains')} AS p FROM joined),
used AS (SELECT *, CASE WHEN effective_win_domains <= 1e-12 THEN p ELSE {_RATIO.format('h_effective_win_domains', 'effective_win_domains')} END AS w, {_RATIO.format('h_effective_opponent_networks', 'effective_opponent_networks')} AS o, CASE WHEN effective_opponent_networks <= 1e-12 THEN 0 ELSE {_RATIO.format('h_opponent_networks_total', 'opponent_networks_total')} END AS m FROM used0),
use_ AS (SELECT *, 0.65::DOUBLE * (0.65::DOUBLE * p + 0.35::DOUBLE * w) + 0.35::DOUBLE * (0.70::DOUBLE * o + 0.30::DOUBLE * m) AS used FROM used),
kept AS (SELECT *, least(0.25::DOUBLE + 0.35::DOUBLE * internal + 0.15::DOUBLE * external * (0.25::DOUBLE + 0.75::DOUBLE * used) + 0.15::DOUBLE * venue_c + 0.20::DOUBLE * bridge_c + 0.05::DOUBLE * abroad_c, 1) AS retention,
  least(0.25::DOUBLE + 0.40::DOUBLE * internal + 0.30::DOUBLE * external + 0.05::DOUBLE * venue_c + 0.10::DOUBLE * bridge_c + 0.05::DOUBLE * abroad_c, 1) AS basic FROM use_)"""


@query(f"""WITH {RET_SQL} SELECT year, race_type, surface_family, pk, network_id, rating, round(used, 6) AS network_use, round(basic, 6) AS basic, round(retention, 6) AS retention, round(100 + retention * (rating - 100), 6) AS calibrated,
round(CASE WHEN rating > 100 THEN 100 + retention * (rating - 100) ELSE rating END, 6) AS ceiling, round(CASE WHEN rating > 100 THEN retention * (rating - 100) + 100 - rating ELSE 0 END, 6) AS change FROM kept""")
def retention_realized(spark, sf):
    """Retention of the stand-in ratings: two left joins, then arithmetic."""
    e = A.entries(spark, sf).withColumn("network_id", F.col("pk") % 7)
    net, own = breadth.breadth(e, GROUP)
    sizes = e.groupBy(*GROUP, "network_id").agg(F.countDistinct("pk").alias("competitors"), F.countDistinct("race_id").alias("races"), (2 * F.count("*")).alias("compared"))
    rated = races.placing_counts(e).select(*GROUP, F.col("pk").cast("string").alias("pk"), (F.col("pk") % 7).alias("network_id"), (90.0 + 30.0 * F.col("wins") / F.col("top3") + F.col("pk") % 13).alias("rating"))
    out = calibrate.calibrate(rated, net, own, sizes)
    return out.select(*GROUP, F.col("pk").cast("long").alias("pk"), "network_id", "rating", *r6("network_use"), F.round("basic_retention", 6).alias("basic"), *r6("retention", "calibrated", "ceiling", "change"))


# ---- both stages from wide races ----------------------------------------------------------------

def _stages(spark, sf) -> calibrate.Stages:
    return calibrate.Stages(races.normalise_races(A.wide_races(spark, sf)), output.Store(spark, "stages").save)


FULL_SQL = f"""{NORMAL_SQL}, full_entries AS (SELECT * FROM normal JOIN races USING (race_id) WHERE n_valid >= 2),
full_pairs AS (SELECT a.year, a.race_type, a.surface_family, a.pk AS winner, b.pk AS loser FROM full_entries a JOIN full_entries b ON a.race_id = b.race_id AND a.placing < b.placing)"""


@query(f"WITH {FULL_SQL} SELECT year, race_type, surface_family, count(*) AS comparisons, 1 AS fitted, (SELECT count(DISTINCT k) FROM (SELECT winner AS k, year, race_type, surface_family FROM full_pairs UNION ALL SELECT loser, year, race_type, surface_family FROM full_pairs) q WHERE q.year = p.year AND q.race_type = p.race_type AND q.surface_family = p.surface_family) AS competitors, 0.0 AS largest_gradient FROM full_pairs p GROUP BY ALL")
def bt_gradient(spark, sf):
    """The fit's own condition: at the optimum no competitor's gradient differs from zero."""
    entries = races.normalise_races(A.wide_races(spark, sf)).where("n_valid >= 2")
    pairs = races.comparisons(entries)
    fitted = bradley_terry.fit_groups(entries)
    return bradley_terry.gradient_check(fitted, pairs).select(*GROUP, "comparisons", "fitted", "competitors", F.round("largest_gradient", 6).alias("largest_gradient"))


@query(f"WITH {FULL_SQL} SELECT year, race_type, surface_family, count(DISTINCT pk) AS rated, CAST(100.0 AS DOUBLE) AS mean_rating FROM full_entries WHERE pk IN (SELECT winner FROM full_pairs UNION SELECT loser FROM full_pairs) GROUP BY ALL")
def stage_ratings(spark, sf):
    """Stage A's ratings, as many as SQL finds competitors, and centred in every group."""
    return _stages(spark, sf).ratings.groupBy(*GROUP).agg(F.count("*").alias("rated"), F.round(F.avg("rating"), 6).alias("mean_rating"))


# The rows of networks and competitors over a mapping that SQL knows: network pk % 7, its parent pk % 7 // 4, plain ratings.

GRP = "year, race_type, surface_family"


def _top_sql(name: str, keys: str, column: str) -> str:
    return f"{name} AS (SELECT {keys}, string_agg({column} || ':' || n, ' | ' ORDER BY n DESC, {column}) FILTER (r <= 5) AS top, max({column}) FILTER (r = 1) AS first, max(n) FILTER (r = 1) / sum(n) AS share FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {column}) AS r FROM (SELECT {keys}, {column}, count(*) AS n FROM placed_rows GROUP BY ALL)) GROUP BY ALL)"


NETWORK_SQL = NODES_SQL + f""", raw_surface AS (SELECT o_orderkey AS race_id, CASE o_orderstatus WHEN 'F' THEN 'Turf' WHEN 'O' THEN '<blank>' ELSE 'All-Weather' END AS surface_raw FROM orders),
placed_rows AS (SELECT e.*, surface_raw, pk % 7 AS network_id FROM entries e JOIN raw_surface USING (race_id)),
rated AS (SELECT {GRP}, pk, pk % 7 AS network_id, 'Supplier ' || pk AS name, 90.0::DOUBLE + 30.0::DOUBLE * count(*) FILTER (placing = 1) / count(*) + pk % 13 AS rating FROM entries GROUP BY {GRP}, pk),
strongest AS (SELECT {GRP}, network_id, avg(rating) AS rating_mean, max(rating) AS rating_max, arg_max(pk, (rating, CAST(pk AS VARCHAR))) AS top_pk FROM rated GROUP BY {GRP}, network_id),
sums AS (SELECT {GRP}, network_id, count(*) FILTER (same) AS internal_edges, CAST(coalesce(sum(n) FILTER (same), 0) AS BIGINT) AS internal_comparisons, count(*) FILTER (NOT same) AS external_edges, CAST(coalesce(sum(n) FILTER (NOT same), 0) AS BIGINT) AS external_comparisons, count(DISTINCT pk) FILTER (NOT same) AS bridge_competitors, coalesce(sum(w) FILTER (same), 0) AS i, coalesce(sum(w) FILTER (NOT same), 0) AS cut FROM sides GROUP BY ALL),
whole AS (SELECT {GRP}, 2 * sum(w) AS m FROM edges GROUP BY ALL), heads AS (SELECT {GRP}, network_id, count(*) AS network_competitors FROM nodes GROUP BY ALL), met_races AS (SELECT {GRP}, network_id, count(DISTINCT race_id) AS network_races FROM placed_rows GROUP BY ALL),
vol AS (SELECT {GRP}, network_id, 2 * i + cut AS v, 2 * i AS inner_w FROM sums), mod AS (SELECT {GRP}, sum(inner_w / m - (v / m) * (v / m)) AS modularity FROM vol JOIN whole USING ({GRP}) GROUP BY {GRP}),
{_top_sql('lands', GRP + ', network_id', 'country')}, {_top_sql('courses', GRP + ', network_id', 'track')}, {_top_sql('grounds', GRP + ', network_id', 'surface_raw')},
summary AS (SELECT {GRP}, network_id, network_competitors, CAST(network_competitors = max(network_competitors) OVER (PARTITION BY {GRP}) AS INTEGER) AS is_largest, network_id // 4 AS parent_component_id, 1000 AS parent_component_competitors, network_races,
  internal_edges, internal_comparisons, external_edges, external_comparisons, bridge_competitors, external_comparisons / (2 * internal_comparisons + external_comparisons) AS bridge_share, CASE WHEN least(2 * i + cut, m - 2 * i - cut) > 1e-12 THEN cut / least(2 * i + cut, m - 2 * i - cut) ELSE 0 END AS conductance, modularity,
  lands.first AS dominant_country, lands.share AS dominant_country_share, grounds.first AS dominant_raw_surface, lands.top AS top_countries, courses.top AS top_tracks, grounds.top AS top_raw_surfaces, rating_mean, rating_max, CAST(top_pk AS VARCHAR) AS top_pk, 'Supplier ' || top_pk AS top_name
  FROM heads JOIN sums USING ({GRP}, network_id) JOIN whole USING ({GRP}) JOIN mod USING ({GRP}) JOIN met_races USING ({GRP}, network_id) JOIN strongest USING ({GRP}, network_id) JOIN lands USING ({GRP}, network_id) JOIN courses USING ({GRP}, network_id) JOIN grounds USING ({GRP}, network_id))"""
_NUMBERS = ("bridge_share", "conductance", "modularity", "dominant_country_share", "rating_mean", "rating_max")


def _network_tables(spark, sf):
    edges, nodes = _mapped(spark, sf)
    raw = A.raw_races(spark, sf).select("race_id", F.when(F.col("surface") == " Dirt", "").otherwise(F.col("surface")).alias("surface_raw"))
    entries = A.entries(spark, sf).join(raw, "race_id")
    parts = nodes.select(*GROUP, F.col("pk").cast("string").alias("pk"), F.col("network_id").cast("int").alias("network_id"), F.floor(F.col("network_id") / 4).cast("int").alias("parent_id"), F.lit(1000).alias("parent_size"))
    rated = races.placing_counts(A.entries(spark, sf)).select(*GROUP, "pk", F.concat(F.lit("Supplier "), F.col("pk").cast("string")).alias("name"), (90.0 + 30.0 * F.col("wins") / F.col("top3") + F.col("pk") % 13).alias("rating"))
    return network.network_tables(entries, edges, parts, rated)


@query(f"WITH {NETWORK_SQL} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _NUMBERS)}) FROM summary")
def network_summary(spark, sf):
    out = _network_tables(spark, sf)[0]
    return out.withColumns({c: F.round(c, 6) for c in _NUMBERS})


@query(f"""WITH {NETWORK_SQL}, ends AS (SELECT {GRP}, a AS pk, b AS o, n FROM edges UNION ALL SELECT {GRP}, b, a, n FROM edges), bridged AS (SELECT {GRP}, pk, count(*) FILTER (pk % 7 <> o % 7) AS bridge_neighbours, CAST(coalesce(sum(n) FILTER (pk % 7 <> o % 7), 0) AS BIGINT) AS bridge_comparisons, sum(n) AS whole_n FROM ends GROUP BY ALL),
home AS (SELECT {GRP}, pk, count(*) FILTER (country = 'JAPAN') AS japan_top3 FROM placed_rows GROUP BY ALL), {_top_sql('own_lands', GRP + ', pk', 'country')}, {_top_sql('own_courses', GRP + ', pk', 'track')}, {_top_sql('own_grounds', GRP + ', pk', 'surface_raw')},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {GRP}, network_id ORDER BY rating DESC, CAST(pk AS VARCHAR)) AS INTEGER) AS network_rank, count(*) OVER (PARTITION BY {GRP}, network_id) AS n FROM rated)
SELECT {GRP}, CAST(pk AS VARCHAR) AS pk, name, round(rating, 6) AS rating, network_id, network_rank, round(CASE WHEN n <= 1 THEN 100 ELSE 100.0 * (n - network_rank) / (n - 1) END, 6) AS network_percentile, bridge_neighbours, bridge_comparisons, japan_top3, own_lands.top AS own_top_countries, own_courses.top AS own_top_tracks, own_grounds.top AS own_top_raw_surfaces,
  round(bridge_comparisons / whole_n, 6) AS bridge_comparison_share, network_competitors, network_races, parent_component_id, parent_component_competitors, is_largest, round(bridge_share, 6) AS network_bridge_share, round(conductance, 6) AS conductance, round(modularity, 6) AS modularity, dominant_country, round(dominant_country_share, 6) AS dominant_country_share, top_countries, top_tracks
FROM ranked JOIN bridged USING ({GRP}, pk) JOIN home USING ({GRP}, pk) JOIN own_lands USING ({GRP}, pk) JOIN own_courses USING ({GRP}, pk) JOIN own_grounds USING ({GRP}, pk) JOIN summary USING ({GRP}, network_id)""")
def network_rows(spark, sf):
    out = _network_tables(spark, sf)[1]
    return out.withColumns({c: F.round(c, 6) for c in ("rating", "network_percentile", "bridge_comparison_share", "network_bridge_share", "conductance", "modularity", "dominant_country_share")})


@query()
def calibrated_ratings(spark, sf):
    """Stage A to B in one: ratings, networks, breadth, retention, ceiling and ranks."""
    return _stages(spark, sf).calibrated


# ---- representations -------------------------------------------------------------------------

@query(f"WITH {PATHS_SQL} SELECT source, step, effective, similarity, state FROM paths")
def leaf_effective(spark, sf):
    return A.paths(spark, sf).select("source", "step", "effective", "similarity", "state")


@query(f"""WITH {PATHS_SQL}, raw AS (SELECT source, step, unnest([t, u || ' x', replace(m, ' ', '_')]) AS name, unnest(ws) AS w FROM paths) SELECT source, step, name, sum(w) AS weight FROM raw GROUP BY ALL""")
def leaf_parse(spark, sf):
    return A.paths(spark, sf).select("source", "step", F.explode(select.leaves(F.col("representation"))).alias("l")).select("source", "step", "l.name", "l.weight")


@query(f"WITH {PATHS_SQL} SELECT source, step, similarity, effective FROM post a WHERE fallback AND NOT EXISTS (SELECT 1 FROM post b WHERE b.fallback AND b.source = a.source AND b.step >= a.step AND b.similarity >= a.similarity AND b.effective <= a.effective AND (b.step > a.step OR b.similarity > a.similarity OR b.effective < a.effective))")
def pareto_frontier(spark, sf):
    return select.frontier(A.paths(spark, sf)).select("source", "step", "similarity", "effective")


FRONT_SQL = PATHS_SQL + """, front AS (SELECT source, step, similarity, effective FROM post a WHERE fallback AND NOT EXISTS (SELECT 1 FROM post b WHERE b.fallback AND b.source = a.source AND b.step >= a.step AND b.similarity >= a.similarity AND b.effective <= a.effective AND (b.step > a.step OR b.similarity > a.similarity OR b.effective < a.effective)))"""
_UNIT = "CASE WHEN max({0}) OVER w > min({0}) OVER w THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE 0.5 END"
KNEE_SQL = f"""{FRONT_SQL}, axes AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY source ORDER BY step, effective, similarity) AS i, {_UNIT.format('CAST(step AS DOUBLE)')} AS x, {_UNIT.format('similarity')} AS y, 1 - {_UNIT.format('effective')} AS z FROM front WINDOW w AS (PARTITION BY source)),
ends AS (SELECT *, {', '.join(f"max({c}) FILTER (i = 1) OVER w AS {c}0, max({c}) FILTER (i = n) OVER w - max({c}) FILTER (i = 1) OVER w AS v{c}" for c in 'xyz')} FROM axes WINDOW w AS (PARTITION BY source)),
along AS (SELECT *, CASE WHEN vx * vx + vy * vy + vz * vz > 1e-15 THEN ((x - x0) * vx + (y - y0) * vy + (z - z0) * vz) / (vx * vx + vy * vy + vz * vz) ELSE 0 END AS t FROM ends),
far AS (SELECT *, sqrt((x - x0 - t * vx) ** 2 + (y - y0 - t * vy) ** 2 + (z - z0 - t * vz) ** 2) AS distance, i > 1 AND i < n AS inner_row FROM along),
bent AS (SELECT *, max(distance) FILTER (inner_row) OVER (PARTITION BY source) AS bend FROM far),
picked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
  CASE WHEN n <= 2 THEN -step WHEN bend > 1e-12 AND inner_row THEN 0 WHEN bend > 1e-12 THEN 1 ELSE sqrt((1 - x) ** 2 + (1 - y) ** 2 + (1 - z) ** 2) END,
  CASE WHEN n <= 2 THEN -similarity WHEN bend > 1e-12 THEN -distance ELSE 0 END, CASE WHEN n > 2 AND bend > 1e-12 THEN -(x + y + z) ELSE 0 END, i) AS r FROM bent)"""


@query(f"WITH {KNEE_SQL} SELECT source, step, similarity, effective, round(CASE WHEN n > 2 THEN distance END, 6) AS knee_distance FROM picked WHERE r = 1")
def knee_point(spark, sf):
    return select.knee(select.frontier(A.paths(spark, sf))).withColumn("knee_distance", F.round("knee_distance", 6))


@query(f"""WITH {KNEE_SQL}, l AS (SELECT *, CASE WHEN strict THEN 0 WHEN fallback THEN 1 ELSE 2 END AS level FROM post), m AS (SELECT *, min(level) OVER (PARTITION BY source) AS best FROM l), c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY effective, step DESC, similarity DESC) AS r FROM m WHERE level = best),
labels AS (SELECT DISTINCT source, unnest(['DEEPEST_REPRODUCIBLE', 'MINIMUM_SUFFICIENT', 'PRACTICAL_KNEE', 'FIRST_BREAK']) AS label FROM paths),
chosen AS (SELECT source, 'DEEPEST_REPRODUCIBLE' AS label, max(step) AS step FROM paths WHERE state <> 'BREAK_CANDIDATE' GROUP BY source UNION ALL SELECT source, 'FIRST_BREAK', min(step) FROM paths WHERE state = 'BREAK_CANDIDATE' GROUP BY source
  UNION ALL SELECT source, 'MINIMUM_SUFFICIENT', step FROM c WHERE r = 1 UNION ALL SELECT source, 'PRACTICAL_KNEE', step FROM picked WHERE r = 1)
SELECT source, label, step, CASE WHEN step IS NULL THEN 'NOT_AVAILABLE' ELSE 'OK' END AS status FROM labels LEFT JOIN chosen USING (source, label)""")
def selections(spark, sf):
    return select.selections(A.paths(spark, sf)).select("source", "label", "step", "status")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN trim(p_name) WHEN p_partkey % 3 = 1 THEN 'SOURCE_RANK_' || p_size WHEN p_partkey % 2 = 0 THEN 'SOURCE_REP_' || p_type ELSE 'UNKNOWN_SOURCE' END AS source FROM part""")
def source_keys(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise(F.lit(" "))
    rank = F.when(k % 3 == 1, F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", select.source_key(name, rank, F.when(k % 2 == 0, "0.0").otherwise("2"), F.col("p_type")).alias("source"))


@query(f"""WITH {PATHS_SQL}, l AS (SELECT *, CASE WHEN strict THEN 0 WHEN fallback THEN 1 ELSE 2 END AS level FROM post), m AS (SELECT *, min(level) OVER (PARTITION BY source) AS best FROM l), c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY effective, step DESC, similarity DESC) AS r FROM m WHERE level = best)
SELECT source, step, similarity, effective, ['STRICT', 'FALLBACK_REPRODUCIBLE', 'BEST_AVAILABLE'][best + 1] AS policy FROM c WHERE r = 1""")
def select_minimum(spark, sf):
    return select.minimum(A.paths(spark, sf))


@query(f"WITH {PATHS_SQL} SELECT source, max(step) AS deepest FROM paths WHERE state <> 'BREAK_CANDIDATE' GROUP BY ALL")
def select_deepest(spark, sf):
    return select.deepest(A.paths(spark, sf))


@query(f"WITH {PATHS_SQL} SELECT source, min(step) AS first_break FROM paths WHERE state = 'BREAK_CANDIDATE' GROUP BY ALL")
def first_break(spark, sf):
    return select.first_break(A.paths(spark, sf))


LEAF_SQL = "w AS (SELECT l_suppkey AS k, l_linestatus || l_returnflag || CAST(l_quantity AS BIGINT) AS name, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), leaf AS (SELECT k, name, n / sum(n) OVER (PARTITION BY k) AS weight FROM w)"


def _leaf_rows(line):
    w = line.groupBy(F.col("l_suppkey").alias("k"), F.concat("l_linestatus", "l_returnflag", F.col("l_quantity").cast("long").cast("string")).alias("name")).agg(F.count("*").cast("double").alias("n"))
    return w.select("k", "name", (F.col("n") / F.sum("n").over(Window.partitionBy("k"))).alias("weight"))


PAIR_SQL = """z AS (SELECT k, count(*) AS c FROM leaf GROUP BY k), j AS (SELECT a.k AS a, b.k AS b, sum(least(a.weight, b.weight)) AS low, count(*) AS c FROM leaf a JOIN leaf b ON a.name = b.name AND a.k < b.k GROUP BY ALL),
alike AS (SELECT a, b, low / (2 - low) AS weighted_jaccard, j.c / (x.c + y.c - j.c) AS plain_jaccard FROM j JOIN z x ON x.k = a JOIN z y ON y.k = b)"""


@query(f"WITH {LEAF_SQL}, {PAIR_SQL} SELECT a, b, round(weighted_jaccard, 6) AS weighted_jaccard, round(plain_jaccard, 6) AS plain_jaccard FROM alike WHERE weighted_jaccard >= 0.45")
def leaf_jaccard(spark, sf):
    return select.leaf_similarity(_leaf_rows(table(spark, sf, "lineitem")), "k", 0.45).select("a", "b", *r6("weighted_jaccard", "plain_jaccard"))


MEDOID_SQL = f"""{PATHS_SQL}, raw AS (SELECT source || '#' || step AS k, unnest([t, u || ' x', replace(m, ' ', '_')]) AS leaf, unnest(ws) AS w FROM paths WHERE state = 'REPRODUCED'),
folded AS (SELECT k, regexp_replace(lower(leaf), '[^a-z0-9]', '', 'g') AS name, sum(w) AS w FROM raw GROUP BY ALL), leaf AS (SELECT k, name, w / sum(w) OVER (PARTITION BY k) AS weight FROM folded), {PAIR_SQL},
edges AS (SELECT a, b FROM alike WHERE weighted_jaccard >= 0.72 OR (weighted_jaccard >= 0.55 AND plain_jaccard >= 0.65)), links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(k, c) AS (SELECT DISTINCT k, k FROM leaf UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.k), label AS (SELECT k, min(c) AS cluster FROM reach GROUP BY k),
near AS (SELECT p.k, round(sum(s.weighted_jaccard), 9) AS s FROM (SELECT a AS k, b AS o, weighted_jaccard FROM alike UNION ALL SELECT b, a, weighted_jaccard FROM alike) s JOIN label p ON p.k = s.k JOIN label q ON q.k = s.o AND q.cluster = p.cluster GROUP BY p.k)
SELECT k AS id, cluster, count(*) OVER (PARTITION BY cluster) AS size, CAST(row_number() OVER (PARTITION BY cluster ORDER BY coalesce(s, 0) DESC, k) = 1 AS INTEGER) AS is_medoid FROM label LEFT JOIN near USING (k)"""


@query(f"WITH RECURSIVE {MEDOID_SQL}")
def cluster_medoid(spark, sf):
    p = A.paths(spark, sf).where("state = 'REPRODUCED'")
    rows = select.leaf_rows(p.select(F.concat_ws("#", "source", "step").alias("id"), select.leaves(F.col("representation")).alias("leaves")), "id", "leaves")
    return select.clusters(rows, "id")


# ---- lineage ---------------------------------------------------------------------------------

def _rho_sql(share: str) -> str:
    place = lambda c: f"rank() OVER (PARTITION BY parent ORDER BY {c}) + (count(*) OVER (PARTITION BY parent, {c}) - 1) / 2.0"
    return f"s{share[0]} AS (SELECT parent, CASE WHEN count(*) >= 3 AND var_pop(x) > 1e-9 AND var_pop(y) > 1e-9 THEN round(corr(x, y), 6) END AS {share}_rho FROM (SELECT parent, {place(f'{share}_pct')} AS x, {place('rating')} AS y FROM kids WHERE rating IS NOT NULL AND {share}_pct IS NOT NULL) GROUP BY parent)"


RHO_SQL = f"{_rho_sql('old')}, {_rho_sql('dn')}"

def _kids(spark, sf):
    p = A.people(spark, sf)
    return lineage.children(p, p)


@query(f"WITH {PEOPLE_SQL} SELECT parent, pk, name, rating FROM kids")
def children(spark, sf):
    return _kids(spark, sf).select("parent", "pk", "name", "rating")


@query(f"""WITH {PEOPLE_SQL}, g AS (SELECT parent, count(*) AS n, count(rating) AS rated, round(avg(rating), 6) AS mean_rating, median(rating) AS median_rating, count(*) FILTER (rating >= 105) AS n105, count(*) FILTER (rating >= 110) AS n110, count(*) FILTER (rating >= 115) AS n115, count(*) FILTER (rating >= 120) AS n120,
round(avg(old_pct), 6) AS mean_old, round(median(old_pct), 6) AS median_old, round(avg(dn_pct), 6) AS mean_dn, round(median(dn_pct), 6) AS median_dn FROM kids GROUP BY ALL), {RHO_SQL} SELECT g.*, old_rho, dn_rho FROM g LEFT JOIN so USING (parent) LEFT JOIN sd USING (parent)""")
def progeny_summary(spark, sf):
    out = lineage.progeny_summary(_kids(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_rating", "mean_old", "median_old", "mean_dn", "median_dn", "old_rho", "dn_rho")})


@query(f"""WITH {PEOPLE_SQL}, {RHO_SQL}, every AS (SELECT DISTINCT parent, unnest(['LOW', 'MID', 'HIGH']) AS band FROM kids), b AS (SELECT parent, CASE WHEN dn_pct < 0.4 THEN 'LOW' WHEN dn_pct < 0.75 THEN 'MID' ELSE 'HIGH' END AS band, count(*) AS n, count(rating) AS rated, round(avg(rating), 6) AS mean_rating, count(*) FILTER (rating >= 110) AS n110 FROM kids WHERE dn_pct IS NOT NULL GROUP BY ALL)
SELECT parent, band, coalesce(n, 0) AS n, coalesce(rated, 0) AS rated, mean_rating, coalesce(n110, 0) AS n110, old_rho, dn_rho FROM every LEFT JOIN b USING (parent, band) LEFT JOIN so USING (parent) LEFT JOIN sd USING (parent)""")
def trend(spark, sf):
    return lineage.trend(_kids(spark, sf)).withColumns({c: F.round(c, 6) for c in ("mean_rating", "old_rho", "dn_rho")})


@query(f"""WITH {PEOPLE_SQL}, n AS (SELECT parent AS pk, count(*) AS children FROM kids GROUP BY ALL) SELECT p.pk, p.name, coalesce(s.name, CAST(p.sire_pk AS VARCHAR), '-') AS sire_name, coalesce(d.name, CAST(p.dam_pk AS VARCHAR), '-') AS dam_name, coalesce(children, 0) AS children
FROM people p LEFT JOIN people s ON s.pk = p.sire_pk LEFT JOIN people d ON d.pk = p.dam_pk LEFT JOIN n ON n.pk = p.pk WHERE p.pk % 3 = 0""")
def profile(spark, sf):
    p = A.people(spark, sf)
    return lineage.profile(p, p.where("pk % 3 = 0")).select("pk", "name", "sire_name", "dam_name", "children")


@query(f"""WITH {PEOPLE_SQL}, o AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS mode FROM kids WHERE parent = 2), r AS (SELECT mode, parent, pk, CAST(row_number() OVER (PARTITION BY mode ORDER BY
  CASE WHEN mode = 1 THEN -rating WHEN mode = 2 THEN -dn_pct WHEN mode = 3 THEN -old_pct WHEN mode = 4 THEN dn_pct ELSE birth_year END NULLS LAST, CASE WHEN mode = 5 THEN name ELSE '' END, pk) AS INTEGER) AS place FROM o) SELECT mode, parent, pk FROM r WHERE place BETWEEN 4 AND 6""")
def child_orders(spark, sf):
    kids = _kids(spark, sf).where("parent = 2")
    pages = [lineage.page(kids, 1, 3, mode).select(F.lit(mode).alias("mode"), "parent", "pk") for mode in lineage.ORDERS]
    return reduce(lambda a, b: a.unionByName(b), pages)


@query(f"""WITH {PEOPLE_SQL} SELECT parent, pk, rpad(left(name, 28), 28, ' ') AS name, lpad(CASE WHEN birth_year IS NULL THEN '-' ELSE format('{{:,}}', birth_year) END, 5, ' ') AS born, lpad(CASE WHEN old_pct IS NULL THEN '-' ELSE printf('%.1f%%', old_pct * 100) END, 8, ' ') AS old,
lpad(CASE WHEN dn_pct IS NULL THEN '-' ELSE printf('%.1f%%', dn_pct * 100) END, 8, ' ') AS dn, lpad(CASE WHEN rating IS NULL THEN '-' ELSE printf('%.2f', rating) END, 9, ' ') AS rating FROM kids""")
def child_listing(spark, sf):
    return lineage.listing(_kids(spark, sf))


@query(f"WITH {RATINGS_SQL} SELECT pk, year, surface_family, rating FROM ratings WHERE pk % 50 = 1 ORDER BY pk, year, surface_family")
def rating_history(spark, sf):
    r = A.ratings(spark, sf)
    return lineage.history(r, r.where("pk % 50 = 1").select("pk").distinct()).select("pk", "year", "surface_family", "rating")


@query(f"WITH {PEOPLE_SQL}, m AS (SELECT *, CASE WHEN sire_pk = parent THEN dam_pk ELSE sire_pk END AS mate, CAST(row_number() OVER (PARTITION BY parent ORDER BY rating DESC NULLS LAST, pk) AS INTEGER) AS place FROM kids) SELECT m.parent, m.pk, m.place, m.mate, coalesce(p.name, CAST(m.mate AS VARCHAR), '-') AS mate_name FROM m LEFT JOIN people p ON p.pk = m.mate WHERE place <= 4")
def bearing(spark, sf):
    return lineage.bearing(_kids(spark, sf), A.people(spark, sf), 4).select("parent", "pk", "place", "mate", "mate_name")


@query(f"WITH {PEOPLE_SQL} SELECT parent, CASE WHEN dn_pct < 0.4 THEN 'LOW' WHEN dn_pct < 0.75 THEN 'MID' ELSE 'HIGH' END AS band, count(*) AS n, count(rating) AS rated, round(avg(rating), 6) AS mean_rating, count(*) FILTER (rating >= 110) AS n110, round(avg(old_pct), 6) AS mean_old, round(avg(dn_pct), 6) AS mean_dn FROM kids WHERE dn_pct IS NOT NULL GROUP BY ALL")
def dn_bands(spark, sf):
    return lineage.bands(_kids(spark, sf), lineage.share_band(F.col("dn_pct")), "band").withColumns({c: F.round(c, 6) for c in ("mean_rating", "mean_old", "mean_dn")})


@query(f"WITH {PEOPLE_SQL} SELECT parent, birth_year // 5 * 5 AS band, count(*) AS n, count(rating) AS rated, round(avg(rating), 6) AS mean_rating, count(*) FILTER (rating >= 110) AS n110, round(avg(old_pct), 6) AS mean_old, round(avg(dn_pct), 6) AS mean_dn FROM kids WHERE birth_year IS NOT NULL GROUP BY ALL")
def birth_bands(spark, sf):
    return lineage.bands(_kids(spark, sf), F.floor(F.col("birth_year") / 5) * 5, "band").withColumns({c: F.round(c, 6) for c in ("mean_rating", "mean_old", "mean_dn")})


@query(f"WITH {PEOPLE_SQL} SELECT parent, pk, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY parent ORDER BY rating DESC, pk) AS INTEGER) AS place FROM kids WHERE rating IS NOT NULL) WHERE place <= 5")
def representatives(spark, sf):
    return lineage.representatives(_kids(spark, sf), 5).select("parent", "pk", "place")


@query(f"WITH {PEOPLE_SQL} SELECT parent, pk, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY parent ORDER BY rating DESC, pk) AS INTEGER) AS place FROM kids WHERE rating IS NOT NULL AND dn_pct < 0.4) WHERE place <= 20")
def representatives_low(spark, sf):
    return lineage.representatives(_kids(spark, sf), 20, 0.40).select("parent", "pk", "place")


@query(f"WITH {PEOPLE_SQL}, m AS (SELECT parent, CASE WHEN sire_pk = parent THEN dam_pk ELSE sire_pk END AS mate FROM kids), c AS (SELECT parent, mate, count(*) AS n FROM m WHERE mate IS NOT NULL GROUP BY ALL), r AS (SELECT c.*, name AS mate_name, CAST(row_number() OVER (PARTITION BY parent ORDER BY n DESC, mate) AS INTEGER) AS place FROM c LEFT JOIN people ON pk = mate) SELECT * FROM r WHERE place <= 60")
def mates(spark, sf):
    return lineage.mates(_kids(spark, sf), A.people(spark, sf)).select("parent", "mate", "n", "mate_name", "place")


@query(f"WITH {PEOPLE_SQL} SELECT pk, name, birth_year FROM people WHERE contains(regexp_replace(lower(name), '[^0-9a-z]', '', 'g'), '00012') OR contains(CAST(pk AS VARCHAR), '00012') ORDER BY birth_year NULLS FIRST, name, pk LIMIT 50")
def name_search(spark, sf):
    return lineage.search(A.people(spark, sf), " 00012").select("pk", "name", "birth_year")


@query(f"WITH {PEOPLE_SQL} SELECT pk, name, birth_year FROM people WHERE pk = 12")
def key_search(spark, sf):
    """A key finds its own individual only, though names hold the same digits."""
    return lineage.search(A.people(spark, sf), "12").select("pk", "name", "birth_year")


@query(f"WITH {PEOPLE_SQL} SELECT parent, pk, rating FROM kids ORDER BY rating DESC NULLS LAST, pk, parent LIMIT 30 OFFSET 60")
def child_page(spark, sf):
    return _kids(spark, sf).orderBy(F.desc_nulls_last("rating"), "pk", "parent").offset(60).limit(30).select("parent", "pk", "rating")


@query(f"WITH {RATINGS_SQL} SELECT pk, year, max(rating) AS best, CAST(sum(top3) AS BIGINT) AS top3 FROM ratings GROUP BY ALL")
def history(spark, sf):
    return A.ratings(spark, sf).groupBy("pk", "year").agg(F.max("rating").alias("best"), F.sum("top3").alias("top3"))


# ---- frames and loading ----------------------------------------------------------------------

@query("SELECT p_partkey, round(p_size + 1e-6 * (row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1), 9) AS v FROM part")
def tie_jitter(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(frames.tie_jitter(F.col("p_size"), ["p_brand"], "p_partkey"), 9).alias("v"))


@query("SELECT p_partkey, round(max(p_size - i * 1e-6) OVER (PARTITION BY p_brand ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 1e-6, 9) AS v FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS i FROM part)")
def monotone_jitter(spark, sf):
    return frames.monotone_jitter(table(spark, sf, "part"), "p_size", ["p_brand"], "p_partkey", "v").select("p_partkey", F.round("v", 9).alias("v"))


TOP_SQL = "top AS (SELECT p_name || ' [' || p_partkey || ']' AS label, p_retailprice AS value, CAST(5 + 10 * (row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) AS INTEGER) AS start FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20)), frames AS (SELECT CAST(step AS INTEGER) AS step, label, value * least(1, greatest(0, (step - start + 1) / 10)) AS value FROM top, range(205) t(step))"


def _labels(spark, sf):
    top = table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)
    w = Window.orderBy("p_retailprice", "p_partkey")  # twenty rows
    return top.select(F.concat("p_name", F.lit(" ["), F.col("p_partkey").cast("string"), F.lit("]")).alias("label"), F.col("p_retailprice").alias("value"), (5 + 10 * (F.row_number().over(w) - 1)).alias("start"))


def _ramp(spark, sf):
    return frames.ramp(_labels(spark, sf), 205, 10)


@query(f"WITH {TOP_SQL} SELECT step, label, round(value, 6) AS value FROM frames")
def ramp_frames(spark, sf):
    return _ramp(spark, sf).withColumn("value", F.round("value", 6))


@query(f"WITH {TOP_SQL} SELECT step, label, round(value, 6) AS value FROM frames UNION ALL SELECT CAST(204 + k AS INTEGER), label, round(value, 6) FROM frames, range(1, 31) t(k) WHERE step = 204")
def hold_frames(spark, sf):
    return frames.hold(_ramp(spark, sf), 204, 30).withColumn("value", F.round("value", 6))


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS part FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT p_partkey, NULL, NULL, p_type FROM part")
def union_schema(spark, sf):
    c, s, p = (table(spark, sf, t) for t in ("customer", "supplier", "part"))
    return loading.union_all([c.selectExpr("c_custkey AS k", "c_name AS name", "c_acctbal AS bal"), s.selectExpr("s_suppkey AS k", "s_name AS name", "s_acctbal AS bal"), p.selectExpr("p_partkey AS k", "p_type AS part")])


@query(f"WITH {RACES_SQL} SELECT DISTINCT year, race_type, surface_family FROM races WHERE NOT (year < 1998 AND race_type = 'FLAT')")
def left_anti_resume(spark, sf):
    groups = A.races(spark, sf).select(*GROUP).distinct()
    return loading.still_to_do(groups, groups.where("year < 1998 AND race_type = 'FLAT'"), GROUP)


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_wins(spark, sf):
    return loading.last_wins(table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN round(value * 1.5, 4) END AS v FROM events")
def round_null_clean(spark, sf):
    raw = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value") * 1.5)
    return table(spark, sf, "events").select("event_id", loading.round_or_null(raw).alias("v"))


@query("SELECT s_suppkey, name, value FROM (SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS s_nationkey FROM supplier) UNPIVOT (value FOR name IN (s_acctbal, s_nationkey))")
def unpivot_matrix(spark, sf):
    return loading.unpivot(table(spark, sf, "supplier").selectExpr("s_suppkey", "s_acctbal", "CAST(s_nationkey AS DOUBLE) AS s_nationkey"), "s_suppkey")


@query(f"WITH {TOP_SQL} SELECT step, label, CASE WHEN step < start OR value * least(1, greatest(0, (step - start + 1) / 10)) < 1e-9 THEN NULL ELSE round(value * least(1, greatest(0, (step - start + 1) / 10)), 6) END AS value FROM (SELECT CAST(step AS INTEGER) AS step, label, value, start FROM top, range(205) t(step))")
def rising_frames(spark, sf):
    return frames.rising(_labels(spark, sf), 205, 10).withColumn("value", F.round("value", 6))


@query(f"WITH {TOP_SQL} SELECT 'Step ' || (step + 1) AS period, CAST(step AS INTEGER) AS step, label, least(CASE WHEN step < start THEN 0.0 ELSE value END, round(0.9 * (SELECT max(value) FROM top), 9)) AS value FROM top, range(205) t(step)")
def jumping_frames(spark, sf):
    shown = frames.rising(_labels(spark, sf), 205, 1, shown=True)
    return frames.named_steps(frames.clipped(shown, 0.9).withColumn("value", F.round("value", 9)))


@query("SELECT 205 AS steps, 1025 AS pictures, 82.0 AS seconds")
def frame_duration(spark, sf):
    return frames.duration(_ramp(spark, sf), 400.0, 5)


@query("SELECT p_brand, p_partkey, p_name || ' (' || (rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) - 1) || ')' AS label FROM part")
def place_labels(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_partkey", frames.place_label(F.col("p_name"), F.col("p_size"), ["p_brand"]).alias("label"))


@query("SELECT CAST(user_id AS VARCHAR) AS pk, 2000 + CAST(event_id % 5 AS INTEGER) AS year, round(arg_max(value, event_id), 6) AS rating FROM events WHERE event_id % 11 <> 0 AND user_id % 13 <> 0 GROUP BY ALL")
def yearly_ratings(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select(F.when(F.col("user_id") % 13 == 0, " ").otherwise(F.concat(F.col("user_id").cast("string"), F.lit(" "))).alias("pk"), F.concat((2000 + F.col("event_id") % 5).cast("string"), F.lit(".0")).alias("year"), F.when(F.col("event_id") % 11 == 0, "nan").otherwise(F.col("value").cast("string")).alias("rating"), F.col("event_id").alias("ordinal"))
    return loading.yearly_ratings(raw).select("pk", "year", "rating")


@query("SELECT c_custkey, c_acctbal > 0 AS kept FROM customer")
def dead_letters(spark, sf):
    kept, lost = output.dead_letters(table(spark, sf, "customer"), F.when(F.col("c_acctbal") > 0, True))
    return kept.select("c_custkey", F.lit(True).alias("kept")).unionByName(lost.select("c_custkey", F.lit(False).alias("kept")))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, printf('%.6f', s_acctbal) AS amount, '' AS name FROM supplier UNION ALL SELECT CAST(n_nationkey AS VARCHAR), '', n_name FROM nation")
def export_rows(spark, sf):
    return output.export_rows([table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_acctbal AS amount"), table(spark, sf, "nation").selectExpr("n_nationkey AS key", "n_name AS name")])


@query("SELECT s_suppkey AS label, s_name AS name, s_nationkey AS nation FROM supplier")
def json_decode(spark, sf):
    s = loading.as_json(table(spark, sf, "supplier").selectExpr("s_suppkey", "s_name AS name", "s_nationkey AS nation"), "s_suppkey")
    return loading.parse_json(s, "doc", "name string, nation int")
