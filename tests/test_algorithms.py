"""Properties and brute-force checks of what SQL can't express."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import bradley_terry as bt
from cairn.operators import frames, loading, network, races, select
from cairn.plans import queries as plans
from cairn.sources import output, tables

SF = "/root/testdata/sf0.001"


def test_fit_has_zero_gradient_and_is_relabelling_invariant():
    rng = np.random.default_rng(1)
    w, l = rng.integers(0, 30, 300), rng.integers(0, 30, 300)
    keep = w != l
    w, l = w[keep], l[keep]
    x = bt.fit(w, l, 30)
    p = 1 / (1 + np.exp(x[w] - x[l]))
    grad = x - np.bincount(w, p, 30) + np.bincount(l, p, 30)
    assert np.abs(grad).max() < 1e-8
    order = rng.permutation(30)
    assert np.allclose(bt.fit(order[w], order[l], 30)[order], x, atol=1e-8)


def test_ratings_are_centred_and_ranked(spark):
    out = plans.QUERIES["bt_rating"](spark, SF)
    by = out.groupBy(*races.GROUP).agg(F.avg("rating").alias("m"), F.stddev_pop("bt").alias("s"), F.avg("bt").alias("b"), F.max("confidence").alias("c")).collect()
    assert by
    for r in by:
        assert abs(r["m"] - 100) < 1e-9 and abs(r["b"] - 100) < 1e-9 and abs(r["s"] - 10) < 1e-9 and r["c"] < 1


def test_opponents_are_rated_without_their_own_fold(spark):
    rows = [(f"r{i}", 2000, "FLAT", "TURF", i % 5, p, pk) for i, trio in enumerate(itertools.permutations("abcd", 3)) for p, pk in enumerate(trio, 1)]
    e = spark.createDataFrame(rows, "race_id string, year int, race_type string, surface_family string, fold int, placing int, pk string")
    assert bt.fit_groups(e).where("contexts = 0").count() == 0
    one = e.withColumn("fold", F.lit(0))  # the only fold is held out: no model rates anyone
    assert bt.fit_groups(one).where("contexts > 0").count() == 0


def test_partition_keeps_small_components_and_splits_loose_ones():
    a, b = [], []
    for base in (0, 20):
        for i, j in itertools.combinations(range(base, base + 20), 2):
            a.append(i)
            b.append(j)
    a.append(3)
    b.append(25)
    a += [40, 41]
    b += [41, 42]
    net, parent, size = network.partition(43, np.array(a), np.array(b), np.full(len(a), np.log(2)))
    assert len(set(net[:20])) == 1 and len(set(net[20:40])) == 1 and net[0] != net[20]
    assert set(net[40:]) == {3} and set(parent[40:]) == {2} and set(size[:40]) == {40}


def test_a_sweep_takes_the_best_gain_of_each_node_in_order():
    rng = random.Random(11)
    edges = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(70)})
    weight = [rng.choice([1.0, 2.0, 0.5]) for _ in edges]
    p = network.Partition(network.Graph(25, *np.array(edges).T, np.array(weight)))
    label = list(range(25))
    both = {**dict(zip(edges, weight)), **{(b, a): w for (a, b), w in zip(edges, weight)}}
    total = sum(both.values())
    degree = [sum(w for (a, _), w in both.items() if a == x) for x in range(25)]
    for _ in range(4):
        for x in range(25):
            gains = {c: sum(w for (a, b), w in both.items() if a == x and label[b] == c) - degree[x] * sum(degree[y] for y in range(25) if y != x and label[y] == c) / total for c in {label[b] for a, b in both if a == x} | {label[x]}}
            label[x] = min(c for c, v in gains.items() if v >= max(gains.values()) - 1e-12)
        p.sweep()
        assert p.label.tolist() == label


def test_partition_leaves_no_leaky_community():
    random.seed(3)
    edges = {tuple(sorted(random.sample(range(80), 2))) for _ in range(160)}
    a, b = np.array(sorted(edges)).T
    net, parent, _ = network.partition(80, a, b, np.ones(len(a)))
    for p in set(parent):
        nodes = np.flatnonzero(parent == p)
        if len(nodes) < network.WHOLE_BELOW:
            assert len(set(net[nodes])) == 1
            continue
        g = network.Graph(80, a, b, np.ones(len(a)))
        total = sum(g.degree[x] for x in nodes)
        for c in set(net[nodes]):
            own = [x for x in nodes if net[x] == c]
            vol = sum(g.degree[x] for x in own)
            cut = sum(w for x in own for y, w in zip(g.to[g.first[x] : g.first[x + 1]], g.weight[g.first[x] : g.first[x + 1]]) if net[y] != c)
            assert min(vol, total - vol) <= 1e-12 or cut / min(vol, total - vol) <= 0.2 + 1e-9


PATH = [
    (0, "SOURCE", "A@0.5|B@0.5", 1.0, 1.0, 1.0),
    (4, "REPRODUCED", "C@0.50|D@0.25|E@0.25", 0.970, 0.90, 0.97),
    (8, "REPRODUCED", "C@0.35|D@0.25|E@0.20|F@0.12|G@0.08", 0.983, 0.957, 1.0),
    (16, "REPRODUCED", "C@0.25|D@0.20|E@0.15|F@0.12|G@0.10|H@0.07|I@0.05|J@0.04|K@0.02", 0.999, 1.0, 1.0),
    (17, "BREAK_CANDIDATE", "X@0.5|Y@0.5", 0.70, 0.55, 0.65),
]


def golden(spark):
    p = spark.createDataFrame([("A|B", *r) for r in PATH], "source string, step int, state string, representation string, similarity double, high_jaccard double, carrier_recall double")
    return p.withColumn("leaves", select.leaves(F.col("representation"))).withColumn("effective", select.effective_leaves(F.col("leaves")))


def test_golden_path(spark):
    p = golden(spark)
    assert select.deepest(p).first()["deepest"] == 16 and select.first_break(p).first()["first_break"] == 17
    m = select.minimum(p).first()
    assert (m["step"], m["policy"]) == (4, "STRICT") and abs(m["effective"] - 2.828427) < 1e-6
    front = select.frontier(p)
    assert sorted(r["step"] for r in front.collect()) == [4, 8, 16]
    k = select.knee(front).first()
    assert k["step"] == 8 and abs(k["knee_distance"] - 0.083677) < 1e-6


def test_four_weight_notations():
    assert select.read_leaves("A@0.5|B*0.25, C:0.15; D(0.1)") == [("A", 0.5), ("B", 0.25), ("C", 0.15), ("D", 0.1)]
    assert select.read_leaves("X, Y; Y | none") == [("X", 0.5), ("Y", 0.5)]
    assert select.read_leaves(None) == []


def test_cleaning(spark):
    rows = [("2001.0", "ＪＰＮ", " turf ", "Tokyo ,Fuchu", "Novice  Chase"), ("abc", "日本", "ダート", "MIZASAWA", "障害"), ("", None, "A.W.", "", "plain"), ("1e400", "x", "Synthetic dirt", "Ascot", None)]
    d = spark.createDataFrame(rows, "y string, c string, s string, t string, n string")
    got = d.select(T.whole_year(F.col("y")), T.country(F.col("c")), T.surface_family(F.col("s")), T.track(F.col("t")), T.race_type(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        (2001, "JAPAN", "TURF", "TOKYO", "JUMP"), (None, "JAPAN", "DIRT", "MIZUSAWA", "JUMP"), (None, "UNKNOWN", "SYNTHETIC", "UNKNOWN", "FLAT"), (None, "X", "SYNTHETIC", "ASCOT", "FLAT"),
    ]


def test_folds_are_those_of_the_hash(spark):
    import hashlib

    ids = ["1", " 1 ", "", "日本-7", None, *map(str, range(50))]
    want = [int.from_bytes(hashlib.blake2b((x or "").strip().encode(), digest_size=8).digest(), "big") % 5 for x in ids]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ids], "x string").coalesce(1).select(T.stable_fold(F.col("x"))).collect()] == want


def test_wide_races_drop_placeholders_and_repeats(spark):
    row = ("r1", "2001.0", "Cup", None, None, "USA", "Ascot", "Turf", " H1 ", "One", "need winners name", "", "h1", "Again")
    cols = "race_id string, year string, race_name string, comment string, condition string, country string, track string, surface string, winner_pk string, winner_name string, second_pk string, second_name string, third_pk string, third_name string"
    got = races.normalise_races(spark.createDataFrame([row], cols)).collect()
    assert [(r["pk"], r["placing"], r["repeated"], r["n_valid"]) for r in got] == [("h1", 1, 1, 1)]


def test_ramp_never_falls(spark):
    lab = spark.createDataFrame([("a", 3.0, 5), ("b", 7.0, 15)], "label string, value double, start int")
    by = {}
    for r in frames.ramp(lab, 30, 10).orderBy("step").collect():
        by.setdefault(r["label"], []).append(r["value"])
    assert all(x <= y for v in by.values() for x, y in zip(v, v[1:])) and by["a"][-1] == 3.0 and by["b"][0] == 0.0


def test_frames_in_sequence(spark):
    lab = spark.createDataFrame([("b", 3.0), ("a", 7.0), ("c", 3.0)], "label string, value double")
    turn = frames.sequence(lab, 2, first=1)
    assert {r["label"]: r["start"] for r in turn.collect()} == {"b": 1, "c": 3, "a": 5}
    assert {r["label"]: r["start"] for r in frames.sequence(lab, 2, top=True).collect()} == {"a": 0, "b": 2, "c": 4}
    by = collections.defaultdict(list)
    for r in frames.rising(turn, 7, 2).orderBy("step").collect():
        by[r["label"]].append(r["value"])
    assert by == {"b": [None, 1.5, 3.0, 3.0, 3.0, 3.0, 3.0], "c": [None, None, None, 1.5, 3.0, 3.0, 3.0], "a": [None] * 5 + [3.5, 7.0]}
    jump = {(r["step"], r["label"]): r["value"] for r in frames.jumping(turn, 6).collect()}
    assert jump[4, "a"] is None and jump[5, "a"] == 7.0 and jump[0, "b"] is None and jump[1, "b"] == 3.0
    assert frames.clipped(frames.jumping(turn, 6), 0.5).agg(F.max("value")).first()[0] == 3.5


def test_aliases_and_loading(spark):
    assert tables.resolve(["Competitor PK", "Birth-Year"], {"pk": ["competitor_pk"], "year": ["birthyear"], "no": ["x"]}) == {"pk": "Competitor PK", "year": "Birth-Year", "no": None}
    assert tables.guess_encoding("日本\n".encode("cp932")) == "cp932"
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 3, 3.0)], "k string, o int, v double")
    assert [tuple(r) for r in loading.last_wins(d, ["k"], "o").collect()] == [("a", 2, 2.0)]
    x = spark.createDataFrame([(0.00005,), (float("inf"),), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in x.select(loading.round_or_null(F.col("x"))).collect()] == [0.0, None, None, None]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿race_id,year,pk\n1,2001,a\n2,NA,\n", encoding="utf-8")
    got = tables.read_strings(spark, str(tmp_path / "r.csv"), ["race_id", "year", "pk", "gone"]).collect()
    assert [tuple(r) for r in got] == [("1", "2001", "a", None), ("2", None, None, None)]


def test_stream_of_parts_adds_up(spark, tmp_path):
    from cairn.operators.summary import overlap, overlap_sums
    from cairn.streaming import overlap as stream

    d = spark.createDataFrame([(y, f"h{i}", s, 100.0 + (i * 7 + y) % 23) for y in (1, 2) for i in range(9) for s in ("DIRT", "TURF")], "year int, pk string, surface_family string, rating double")
    for y in (1, 2):
        d.where(F.col("year") == y).write.mode("append").parquet(str(tmp_path / "in"))
    q = stream.follow(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in")), str(tmp_path / "sums"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = stream.current(spark, str(tmp_path / "sums")).drop("batch").first()
    want = overlap(overlap_sums(d)).first()
    assert got["n"] == want["n"] == 18 and abs(got["mean_a"] - want["mean_a"]) < 1e-9


def test_leaf_jaccard_at_any_threshold(spark, monkeypatch):
    rng = random.Random(5)
    leaves = {}
    for k in range(120):
        base = rng.sample(range(60), rng.randint(1, 12)) if k % 3 or not leaves else list(leaves[k - 1])
        raw = {n: rng.random() + 0.05 for n in base[: rng.randint(1, len(base))]}
        leaves[k] = {n: w / sum(raw.values()) for n, w in raw.items()}
    rows = spark.createDataFrame([(k, f"n{n}", w) for k, own in leaves.items() for n, w in own.items()], "k int, name string, weight double")
    for least, cells in ((0.0, 1 << 20), (0.3, 0), (0.55, 1 << 20), (0.55, 0), (0.8, 0)):
        monkeypatch.setattr(select, "MATRIX_CELLS", cells)
        want = {}
        for a, b in itertools.combinations(sorted(leaves), 2):
            x, y = leaves[a], leaves[b]
            low = sum(min(x[n], y[n]) for n in x.keys() & y.keys())
            if x.keys() & y.keys() and low / (2 - low) >= least:
                want[a, b] = (low / (2 - low), len(x.keys() & y.keys()) / len(x.keys() | y.keys()))
        got = {(r["a"], r["b"]): (r["weighted_jaccard"], r["plain_jaccard"]) for r in select.leaf_similarity(rows, "k", least).collect()}
        assert got.keys() == want.keys() and want
        assert all(np.allclose(got[p], want[p], atol=1e-9) for p in want)


def test_leaf_jaccard_in_blocks_and_by_prefix(spark, monkeypatch):
    """Many keys over few names, copies among them: the ways agree, and in blocks no pair is shuffled."""
    rng = random.Random(6)
    leaves = {k: {n: rng.random() + 0.05 for n in rng.sample(range(20), rng.randint(5, 20))} for k in range(90)}
    leaves |= {k: leaves[k % 7] for k in range(90, 130)}
    rows = [(f"k{k}", f"n{n}", w / sum(own.values())) for k, own in leaves.items() for n, w in own.items()]
    rows = spark.createDataFrame(rows, "k string, name string, weight double")
    found, plans = [], []
    for meeting, cells, sent in ((0, 0, 1 << 18), (1 << 40, 1 << 21, 1 << 18), (1 << 40, 400, 7), (select.CELLS_A_MEETING, 400, 1 << 18)):
        monkeypatch.setattr(select, "MATRIX_CELLS", 0)
        monkeypatch.setattr(select, "CELLS_A_MEETING", meeting)
        monkeypatch.setattr(select, "BLOCK_CELLS", cells)
        monkeypatch.setattr(select, "TILE_CELLS", cells // 2 + 1)
        monkeypatch.setattr(select, "SENT_PAIRS", sent)
        out = select.leaf_similarity(rows, "k", 0.45)
        plans.append("Join Inner, (name" in out._jdf.queryExecution().optimizedPlan().toString())
        got = out.collect()
        found.append({(r["a"], r["b"]): (round(r["weighted_jaccard"], 9), round(r["plain_jaccard"], 9)) for r in got})
        assert len(found[-1]) == len(got)
    assert plans == [True, False, False, False]
    assert len(found[0]) > 1000 and all(x == found[0] for x in found)


def test_clusters_of_long_chains(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    chains = [[f"a{i:02}" for i in range(60)], [f"b{i:02}" for i in order]]
    pairs = [(*sorted(p), 0.9, 0.9) for c in chains for p in itertools.pairwise(c)] + [("a00", "b00", 0.5, 0.9)]
    similar = spark.createDataFrame(pairs, "a string, b string, weighted_jaccard double, plain_jaccard double")
    keys = spark.createDataFrame([(k,) for c in chains for k in c] + [("c",)], "id string")
    label = select.components(similar, keys, "id")
    got = {r["id"]: r for r in select.medoids(label, similar.where("weighted_jaccard > 0.5"), "id").collect()}
    assert {k: (r["cluster"], r["size"]) for k, r in got.items()} == {k: (min(c), len(c)) for c in [*chains, ["c"]] for k in c}
    assert sorted(k for k, r in got.items() if r["is_medoid"]) == ["a01", min(chains[1][1:-1]), "c"]


def test_medoid_weighs_pairs_that_are_not_alike_too(spark):
    # x-y and y-z are alike, x-z aren't; w is alike to x only, so that sums over alike pairs alone would mislead
    rows = [("x", "a", 0.6), ("x", "b", 0.4), ("y", "a", 0.85), ("y", "b", 0.15), ("z", "a", 0.9), ("z", "c", 0.1), ("w", "b", 0.55), ("w", "a", 0.45)]
    d = spark.createDataFrame(rows, "k string, name string, weight double")
    by = {}
    for k, n, w in rows:
        by.setdefault(k, {})[n] = w
    sim = lambda p, q: (low := sum(min(by[p].get(n, 0), by[q].get(n, 0)) for n in "abc")) / (2 - low)
    got = {r["k"]: r for r in select.clusters(d, "k").collect()}
    assert {r["size"] for r in got.values()} == {4}
    best = max(sorted(by), key=lambda p: sum(sim(p, q) for q in by if q != p))
    assert [k for k, r in got.items() if r["is_medoid"]] == [best]


def test_cluster_table_numbers_clusters_by_size(spark):
    rows = [("b", "x", 1.0), ("a", "x", 1.0), ("c", "y", 0.5), ("c", "x", 0.5), ("d", "z", 1.0)]
    got = sorted(map(tuple, select.cluster_table(spark.createDataFrame(rows, "k string, name string, weight double"), "k").collect()))
    assert got == [(1, 2, "a", "a", 1.0, 1.0), (1, 2, "b", "a", 1.0, 1.0), (2, 1, "c", "c", 1.0, 1.0), (3, 1, "d", "d", 1.0, 1.0)]


def test_leaves_by_functions_equal_the_reader(spark):
    texts = ["A@0.5|B@0.25|C x@0.25", "A@0.5|A@0.25", "A@0.5|B*0.25, C:0.15; D(0.1)", "X, Y; Y | none", "p=>q|r", "", None, "a@1e3|b@2", " a @ 0.5 | b@0", "A@0.5 (x) | B@.5"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, got in zip(texts, [[(x["name"], x["weight"]) for x in r[0]] for r in d.select(select.leaves(F.col("t"))).collect()], strict=True):
        assert got == select.read_leaves(t), t


def test_path_rows_and_selections(spark):
    cols = "source string, source_rank string, step string, state string, representation string, similarity string, high_jaccard string, carrier_recall string, leaf_count string"
    raw = spark.createDataFrame([("", " 3 ", "1.0", None, "A@0.5|B@0.5", "0.97", "nan", "inf", ""), (None, None, "0", "x", "R", "", None, None, "7"), (None, "", "2", "y", None, "0.1", None, None, None)], cols)
    got = select.path_rows(raw).collect()
    assert [(r["source"], r["step"], r["similarity"], r["high_jaccard"], r["carrier_recall"], r["raw_leaf_count"]) for r in got] == [("SOURCE_RANK_3", 1, 0.97, None, None, 2), ("SOURCE_REP_R", 0, None, None, None, 7), ("UNKNOWN_SOURCE", 2, 0.1, None, None, None)]
    assert got[0]["effective"] == 2.0 and got[1]["effective"] == 1.0 and got[2]["effective"] is None
    p = golden(spark).unionByName(golden(spark).where("step = 0").withColumn("source", F.lit("Z")))
    chosen = {(r["source"], r["label"]): (r["status"], r["step"]) for r in select.selections(p).collect()}
    assert len(chosen) == 8 and chosen["A|B", "PRACTICAL_KNEE"] == ("OK", 8) and chosen["A|B", "FIRST_BREAK"] == ("OK", 17) and chosen["Z", "PRACTICAL_KNEE"] == ("NOT_AVAILABLE", None)
    assert [r[0] for r in spark.sql("SELECT 1").select(select.plain_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).collect()] == [1.0]


# sources and sinks ------------------------------------------------------------------------------


def test_finding_inputs(tmp_path):
    import os

    for i, name in enumerate(["a_path.csv", "b_path.csv", "cache/c_path.csv", "d_path_v3_9.csv"]):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x" * i)
        os.utime(p, (1000 + i, 1000 + i))
    assert tables.newest(tmp_path, ["*_path.csv", "*/*_path.csv"], without=["cache"]).name == "b_path.csv"
    assert tables.newest(tmp_path, ["*/*_path.csv"]).name == "c_path.csv" and tables.newest(tmp_path, ["*.txt"]) is None
    assert tables.discover(tmp_path, None, ["a_path.csv"], ["*.csv"]).name == "a_path.csv"
    assert tables.discover(tmp_path, "b_path.csv", ["a_path.csv"], []).name == "b_path.csv"
    with pytest.raises(FileNotFoundError):
        tables.discover(tmp_path, "gone.csv", [], [])
    with pytest.raises(FileNotFoundError):
        tables.discover(tmp_path, None, ["gone.csv"], ["*.xlsx"])
    assert [p.name for p in tables.find_inputs(tmp_path, "*.csv", "_v3_9")] == ["c_path.csv", "b_path.csv", "a_path.csv"]
    assert tables.output_stem("x/run_path.csv", "_path.csv") == "run" and tables.output_stem("x/run.csv", "_path.csv") == "run"
    for name in ("old", "new"):
        (tmp_path / name / "ratings").mkdir(parents=True)
        os.utime(tmp_path / name, (2000 + len(name) + (name == "new"), 2000 + len(name) + (name == "new")))
    assert tables.discover_results(tmp_path, None, [], ["ratings"]).name == "new" and tables.discover_results(tmp_path, None, ["old"], ["ratings"]).name == "old"
    with pytest.raises(FileNotFoundError):
        tables.discover_results(tmp_path, str(tmp_path / "cache"), [], ["ratings"])


def test_signatures_follow_the_content(tmp_path):
    p = tmp_path / "x.bin"
    p.write_bytes(b"a" * (tables.EDGE * 4))
    first, sampled = tables.file_signature(p)["sha256"], tables.sampled_signature(p)
    assert tables.file_signature(p)["sha256"] == first and tables.sampled_signature(p) == sampled
    data = bytearray(p.read_bytes())
    data[tables.EDGE * 2] = 7  # in the middle: only the sampled one looks there
    p.write_bytes(data)
    assert tables.file_signature(p)["sha256"] == first and tables.sampled_signature(p) != sampled
    data[-1] = 7
    p.write_bytes(data)
    assert tables.file_signature(p)["sha256"] != first


def test_reading_results_paths_and_parts(spark, tmp_path):
    (tmp_path / "p.csv").write_text("\ufeffStep,Representation,Similarity,Path State\n0,A@1,1.0,SOURCE\n", encoding="utf-8")
    path = tables.read_path(spark, str(tmp_path / "p.csv"))
    assert {"step": "0", "state": "SOURCE", "representation": "A@1", "similarity": "1.0"}.items() <= path.first().asDict().items()
    typed = select.path_rows(path).first()
    assert (typed["source"], typed["step"], typed["similarity"], typed["median_year"], [tuple(x) for x in typed["leaves"]]) == ("SOURCE_REP_A@1", 0, 1.0, None, [("A", 1.0)])
    (tmp_path / "q.csv").write_text("zq,xx\n0,A\n")
    with pytest.raises(ValueError, match="step, representation, similarity"):
        tables.read_path(spark, str(tmp_path / "q.csv"))
    schema = "a int, b string"
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    (tmp_path / "good.csv").write_text("\ufeffa,c\n1,2\nz,3\n", encoding="utf-8")
    for name, want in (("gone", []), ("empty", []), ("other", []), ("good", [(1, None), (None, None)])):
        got = tables.read_if_exists(spark, str(tmp_path / f"{name}.csv"), schema)
        assert [tuple(r) for r in got.collect()] == want and got.columns == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        tables.read_results(spark, str(tmp_path / "no"))
    r = spark.createDataFrame([("2001.0", " flat", "Turf ", " H1 ", "One", "101.5", "3.0", "1"), ("", "FLAT", "TURF", "h2", "", "1", "1", "0"), ("2001", "FLAT", "TURF", "", "", "1", "1", "0"), ("2001", "FLAT", "TURF", "h3", "", "inf", "", "0")], "year string, race_type string, surface_family string, pk string, name string, rating string, network_id string, japan_top3 string")
    r.write.option("header", True).csv(str(tmp_path / "res" / "ratings"))
    n = spark.createDataFrame([("2001", "FLAT", "TURF", "3", "10", "4", "5", "6"), ("2001", "FLAT", "TURF", "", "10", "4", "5", "6")], "year string, race_type string, surface_family string, network_id string, network_competitors string, network_races string, internal_comparisons string, external_comparisons string")
    n.write.option("header", True).csv(str(tmp_path / "res" / "networks"))
    got = tables.read_results(spark, str(tmp_path / "res"))
    assert sorted(tuple(x) for x in got["ratings"].collect()) == [(2001, "FLAT", "TURF", "h1", "One", 101.5, 3, 1), (2001, "FLAT", "TURF", "h3", None, None, None, 0)]
    assert [x["network_id"] for x in got["networks"].collect()] == [3]
    (tmp_path / "m.csv").write_text("name,a,b\nx,1,nan\ny,2.5,z\n")
    assert sorted(map(tuple, tables.read_matrix(spark, str(tmp_path / "m.csv")).collect()), key=str) == [("x", "a", 1.0), ("x", "b", None), ("y", "a", 2.5), ("y", "b", None)]
    assert tables.columns_of(tables.literal(spark, [(1, "a")], schema), ["a"]) == {"a": "int", "b": "string"}
    with pytest.raises(ValueError, match="z"):
        tables.columns_of(tables.literal(spark, [], schema), ["z"])


def test_parts_are_resumed_and_dropped_with_their_manifest(spark, tmp_path):
    folder = output.Folder(spark, str(tmp_path / "out"))
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "year int, kind string")
    made = []

    def make(todo):
        made.append(sorted(tuple(r) for r in todo.collect()))
        return todo.withColumn("v", F.col("year") * 10)

    assert output.read_parts(folder, "v int, year int, kind string").count() == 0
    assert output.prepare(folder, {"v": 1}) is False and output.write_missing(folder, keys.where("year = 1"), make, ["year", "kind"]) == 2
    assert output.prepare(folder, {"v": 1}) is True and output.write_missing(folder, keys, make, ["year", "kind"]) == 1
    assert output.write_missing(folder, keys, make, ["year", "kind"]) == 0
    assert made == [[(1, "a"), (1, "b")], [(2, "a")]]
    assert sorted(tuple(r) for r in output.read_parts(folder, "v int, year int, kind string").collect()) == [(10, 1, "a"), (10, 1, "b"), (20, 2, "a")]
    assert output.prepare(folder, {"v": 2}) is False and output.read_parts(folder, "v int, year int, kind string").count() == 0
    with pytest.raises(ValueError):
        folder.delete("../elsewhere")


def test_staged_build_swaps_whole_sets(spark, tmp_path):
    folder = output.Folder(spark, str(tmp_path))
    calls = []

    def make(n):
        def run():
            calls.append(n)
            return spark.range(n)

        return run

    got = output.build(folder, "set", {"a": make(3), "b": make(4)}, "s1", {"version": 7})
    assert (got["a"].count(), got["b"].count(), calls) == (3, 4, [3, 4])
    output.build(folder, "set", {"a": make(5), "b": make(6)}, "s1")
    assert calls == [3, 4] and output.valid(folder, "set", {"a": ["id"]}, "s1") and not output.valid(folder, "set", {"a": ["x"]}, "s1")

    def broken():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        output.build(folder, "set", {"a": make(9), "b": broken}, "s2")
    assert spark.read.parquet(folder.at("set/a")).count() == 3  # the old set still stands
    assert output.build(folder, "set", {"a": make(5), "b": make(6)}, "s2")["b"].count() == 6
    assert output.missing_outputs(folder, ["set/a", "set/zzz"]) == ["set/zzz"]
    assert [tuple(r) for r in output.metadata_table(spark, {"version": 1, "x": "y"}).collect()] == [("version", "1"), ("x", "y")]


def test_exports_and_reports(spark, tmp_path):
    d = spark.createDataFrame([("b", 1 / 3, None), ("a", None, 2)], "k string, x double, n int")
    output.export_csv(output.as_text(d), str(tmp_path / "csv"), ["k"])
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.startswith("\ufeffk,x,n\n") and "b,0.333333," in text
    assert output.export_rows([spark.range(1).select()]).collect()[0].asDict() == {"status": "NO_ROWS"}
    folder = output.Folder(spark, str(tmp_path))
    output.write_report(folder, "report.txt", "Ratings", {"rows": 2}, {"ROWS": d}, {"ROWS": [F.desc("k")]})
    assert folder.read("report.txt") == "Ratings\n=======\n\nrows: 2\n\n[ROWS]\nk | x | n\nb | 0.333333 | \na |  | 2\n" and folder.read("none.txt") is None


# both stages ------------------------------------------------------------------------------------


def test_stages_hang_together(spark):
    from cairn.operators import calibrate
    from cairn.plans import adapters as A

    entries = races.normalise_races(A.wide_races(spark, SF).where("surface IN ('Turf', ' Dirt')"))
    lone = spark.createDataFrame([("z1", 1950, "FLAT", "OTHER", "JAPAN", "TOKYO", "grassless", 0, 1, 1, "solo", "Solo", 0, 1)], "race_id string, year int, race_type string, surface_family string, country string, track string, surface_raw string, fold int, ordinal long, placing int, pk string, name string, repeated int, n_valid long")
    entries = entries.select(*(F.col(c).cast(lone.schema[c].dataType) for c in lone.columns)).unionByName(lone)
    out = calibrate.Stages(entries, output.Store(spark, "test").save)
    ratings = out.ratings.count()
    assert ratings and out.calibrated.count() == ratings and out.groups.where("fitted = 1").count() == out.groups.count()
    rows = out.competitors.collect()
    assert rows and all(0 <= r["bridge_comparison_share"] <= 1 and r["network_rank"] >= 1 for r in rows)
    summary = {(r["year"], r["race_type"], r["surface_family"], r["network_id"]): r for r in out.networks.collect()}
    for key, n in collections.Counter((r["year"], r["race_type"], r["surface_family"], r["network_id"]) for r in rows).items():
        assert summary[key]["network_competitors"] >= n and summary[key]["network_races"] >= 1
    assert all(r["dominant_country_share"] <= 1 and r["top_countries"].startswith(r["dominant_country"] + ":") for r in summary.values())
    assert out.calibrated.where("retention < 0.25 OR retention > 1 OR ceiling > rating + 1e-9 AND rating > 100").count() == 0
    assert out.host_ranking.where("japan_top3 IS NULL OR japan_top3 <= 0").count() == 0 and out.multi_surface.count() > 0
    names = {r["pk"]: r["name"] for r in out.ratings.select("pk", "name").collect()}
    assert all(v == f"Supplier {k[1:]}" for k, v in names.items())


def test_names_are_the_last_told_and_unfitted_groups_are_told_of(spark):
    rows = [("r1", 1, 0, 1, "a", "Old"), ("r1", 1, 0, 2, "b", ""), ("r2", 0, 1, 1, "a", "Older"), ("r2", 0, 1, 2, "b", None), ("r3", 2, 1, 1, "b", ""), ("r3", 2, 1, 2, "a", "New")]
    e = spark.createDataFrame([("x", *r) for r in rows] + [("y", "q", 0, 0, 1, "a", "A")], "g string, race_id string, ordinal long, fold int, placing int, pk string, name string")
    got = bt.fit_groups(e, ("g",))
    assert {r["pk"]: r["name"] for r in got.where("g = 'x'").collect()} == {"a": "New", "b": "b"}
    assert [(r["g"], r["competitors"], r["fitted"], r["races"], r["comparisons"]) for r in bt.group_meta(got, ("g",)).orderBy("g").collect()] == [("x", 2, 1, 3, 3), ("y", 0, 0, 1, 0)]
    assert bt.adjust(got, ("g",)).count() == 2
