"""The operators of cairn.llm against brute force, the tokenizers library, and held-out labels."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import bpe, components, html_extract, jaccard_join, language_id, lm_scoring, mixing, quality_classifier, quality_rules, topk_search, toxicity
from cairn.llm import queries as Q
from cairn.llm._common import Scratch
from cairn.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, "a b c d e f", "en", "s", 1.0, True), (1, "a b c d e f", "en", "s", 1.0, True), (2, None, None, None, None, None), (None, "x", "en", None, 0.5, False), (3, "", "de", "s", 0.1, False), (4, long, "en", "t", 0.2, True), (5, "123 ...", "en", "t", 0.2, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept boolean")


# 1 ---------------------------------------------------------------------------------------------


def brute_topk(rows, k):
    v = {i: np.floor(np.array(x, dtype=float) * 1024) for i, x in rows if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x)}
    out = []
    for q in v:
        if q % 100 == 0:
            best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_topk_is_exact(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted(tuple(r) for r in topk_search.topk_search(d, block_rows=128).collect())
    assert got == brute_topk([(r["vec_id"], r["embedding"]) for r in d.collect()], 10)


def test_topk_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], i, 1) for i in range(300)]
    rows += [rows[7], rows[7], (200, rows[5][1], 0, 0)]  # a candidate twice more, and an id with two vectors
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score int")
    got = collections.defaultdict(list)
    for r in topk_search.topk_search(d, block_rows=64, query_rows=2).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    v = [(i, np.floor(np.array(x, dtype=np.float32).astype(float) * 1024)) for i, x, _, _ in rows]
    for q in (0, 100, 200):
        asked = {tuple(x) for i, x in v if i == q}
        best = sorted((-int(np.dot(a, x)), i) for a in asked for i, x in v if i != q)[:10]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]


def test_topk_ties_nulls_and_small_tables(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (100, [-0.1, 0.3]), (None, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk_search.topk_search(d).collect()) == brute_topk(rows, 10)
    assert topk_search.topk_search(d.limit(0)).count() == 0


def test_index_stops_early_but_keeps_the_best():
    rng = np.random.default_rng(0)
    rows = (rng.normal(0, 0.125, (4000, 64)) * 1024).astype(np.int64)
    index = topk_search.ImpactIndex(np.arange(4000), rows)
    for q in rows[:20]:
        at = index.candidates(q, 10)
        assert len(at) < 4000 and set(np.argsort(-(rows @ q), kind="stable")[:10]) <= set(at)


# 2 ---------------------------------------------------------------------------------------------


def test_word_baseline_is_exact(spark, texts):
    got = lm_scoring.lm_scores(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    count = collections.Counter()
    for i, x in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(WORDS.findall(lower(x)))
            count["\n"] += 1
    n, v = sum(count.values()), len(count)
    assert len(got) == len(texts)
    for r in got:
        w = [*WORDS.findall(lower(texts[r["doc_id"]])), "\n"]
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[t] > 0 for t in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)


def test_ppm_is_a_distribution():
    rng = random.Random(1)
    docs = [[bytes(rng.choices(b"abcd", k=rng.randint(1, 4))) for _ in range(30)] for _ in range(20)]
    levels = []
    for k in range(lm_scoring.ORDER + 1):
        data = [np.frombuffer(lm_scoring.END * lm_scoring.ORDER + lm_scoring.coded(d), dtype=np.uint8) for d in docs]
        keys, n = np.unique(np.concatenate([lm_scoring.context_keys(x, k) for x in data]), return_counts=True)
        levels.append((keys, n))
    trie = lm_scoring.Trie([k for k, _ in levels], [n for _, n in levels], int(levels[0][1].sum()))
    scorer = lm_scoring.PpmScorer(trie)
    for context in (b"\n\n\n\n\n", b"abcda", b"zzzzz", b"ab cd", b"d ab "):
        data = np.frombuffer(b"".join(context + bytes([s]) for s in range(256)), dtype=np.uint8)
        p = [2 ** scorer.log2(data[6 * s : 6 * s + 6])[0] for s in range(256)]
        assert 0.98 < sum(p) <= 1 + 1e-9


def plain_ppm(train, text, order):
    """log2 probability of ``text`` by PPM with escape method D and exclusion, byte by byte from the definition."""
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[t[i - k : i]][t[i]] += 1
    out = 0.0
    for i in range(order, len(text)):
        out_of, p = set(), 1.0
        for k in range(order, -1, -1):
            here = seen.get(text[i - k : i])
            if not here:
                continue
            left = {c: n for c, n in here.items() if c not in out_of}
            total = sum(left.values())
            if text[i] in left:
                p *= (left[text[i]] - 0.5) / total
                break
            if total:
                p *= 0.5 * len(left) / total
            out_of |= set(here)
        else:
            p /= 256 - len(out_of)
        out += math.log2(p)
    return out


def test_score_equals_a_plain_ppm(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(60)]
    docs = {i: " ".join(rng.choices(words, k=rng.randint(0, 25))) for i in range(60)}
    docs[60], docs[61] = "zebra quokka Q", None
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    mark = lm_scoring.END * lm_scoring.ORDER
    data = {i: mark + lm_scoring.coded(lower(x).encode().split()) for i, x in docs.items()}
    train = [x for i, x in data.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(rows).collect()}
    for i, x in data.items():
        assert got[i] == pytest.approx(plain_ppm(train, x, lm_scoring.ORDER) * math.log10(2), rel=1e-6), i


def test_layout_keeps_rows_between_chunks_and_buckets_large():
    for n in (10**9, 10**11, 10**13):
        chunks, buckets = lm_scoring.layout(n, 50)
        assert lm_scoring.PACKED * n / (chunks * buckets) > 2000
        assert lm_scoring.CHUNK_BYTES[0] / 2 <= n / chunks <= lm_scoring.CHUNK_BYTES[1] + 1


def test_ppm_keeps_every_context(spark):
    rng = random.Random(2)
    names = [f"w{rng.randint(0, 99999)}" for _ in range(3000)]
    docs = {i: " ".join(rng.choices(names, k=1000)) for i in range(400)}
    train = {i for i in docs if zlib.crc32(str(i).encode()) % 5 != 1}
    rare = "once quietly zigzagging"  # stands in one training row of about 2 MB
    docs[min(train)] += " " + rare
    docs[min(set(docs) - train)] = rare
    data = [np.frombuffer(lm_scoring.END * lm_scoring.ORDER + lm_scoring.coded(docs[i].encode().split()), dtype=np.uint8) for i in train]
    levels = [np.unique(np.concatenate([lm_scoring.context_keys(x, k) for x in data]), return_counts=True) for k in range(lm_scoring.ORDER + 1)]
    scorer = lm_scoring.PpmScorer(lm_scoring.Trie([k for k, _ in levels], [n for _, n in levels], int(levels[0][1].sum())))
    assert scorer.counts[0].sum() > 1 << 20
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for r in lm_scoring.lm_scores(rows).collect():
        x = lm_scoring.END * lm_scoring.ORDER + lm_scoring.coded(docs[r["doc_id"]].encode().split())
        assert r["score"] == pytest.approx(scorer.log2(np.frombuffer(x, dtype=np.uint8)).sum() * math.log10(2), rel=1e-9)


def test_lm_odd_rows(spark, odd):
    assert lm_scoring.lm_scores(odd).count() == 7
    assert lm_scoring.lm_scores(odd.limit(0)).count() == 0


# 3 ---------------------------------------------------------------------------------------------


def brute_components(rows, k, num, den):
    def shingles(x):
        w = WORDS.findall(lower(x))
        return frozenset([tuple(w)] if 0 < len(w) < k else zip(*(w[i:] for i in range(k))))

    sets = {i: shingles(x) for i, x in rows}
    up = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
                links[a] += 1
                links[b] += 1
    return sorted((i, len(sets[i]), root(i), links[i]) for i in ids)


def families(seed):
    rng = random.Random(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=60)
    for f in range(12):
        base = rng.choices(vocabulary, k=rng.choice([4, 12, 40, 150]))
        for _ in range(rng.choice([1, 2, 6, 15])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w + passage if f % 4 == 0 else w))
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "num", "seed"), [(3, 90, 1), (5, 80, 2), (3, 70, 3)])
def test_components_equal_brute_force(spark, monkeypatch, k, num, seed):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)  # so that families span blocks
    rows = families(seed)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, k, num, 100)


def test_matching_sets_share_a_key():
    rng = np.random.default_rng(5)
    groups = jaccard_join.SizeGroups(8, 10)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(len(x) * rng.uniform(0, 0.2))
        y = np.sort(rng.permutation(x)[: len(x) - drop]) if drop < len(x) else x
        if jaccard_join.matches(len(y), len(x), len(y), 8, 10):
            hot = lambda s: (s % np.uint64(10)) < np.uint64(7)
            assert set(jaccard_join.index_keys(x, groups, hot(x))) & set(jaccard_join.index_keys(y, groups, hot(y)))


def test_components_odd_rows(spark, odd):
    got = [tuple(r) for r in jaccard_join.jaccard_components(odd).collect()]
    assert len(got) == 7 and got.count((1, 4, 1, 1)) == 2 and (2, 0, 2, 0) in got and (3, 0, 3, 0) in got and (None, 1, None, 0) in got
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("finish", [0, 40, 100_000])
def test_connected_components_of_a_chain(spark, monkeypatch, finish):
    monkeypatch.setattr(components, "FINISH_EDGES", finish)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# 4 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("leaf", [2, 5, 16])
def test_bpe_equals_the_library(leaf):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.TreeBpe(path, leaf)
    rng = random.Random(leaf)
    parts = ["th", "er", "ing", "a", "e", "ation", "ß", "İ", "Σ", "é", "é", "中", "'s", "!", "!!", "?", "1", " ", "\n", " ", "zz", "<|endoftext|>", "<|", "|>"]
    for n in (0, 1, 3, 30, 300):
        for _ in range(60):
            s = "".join(rng.choice(parts[: rng.choice([6, len(parts)])]) for _ in range(n))
            ids = lib.encode(s, add_special_tokens=False).ids
            assert own.encode(s) == ids
            assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library_on_any_character():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.TreeBpe(path)
    rng = random.Random(7)
    odd = [0, 9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, 8192, 8232, 8233, 8239, 8287, 12288, 0xFEFF, 0x200D, 0x200B, 0xAD, 0x1C89, 0xA7CB, 0x10D50, 0x16EA0, 0x208F]
    ranges = [(32, 126), (0x300, 0x36F), (0xA0, 0x2FFF), (0x1100, 0xD7FF), (0xE000, 0xFFFF), (0x10000, 0x10FFFF)]
    for _ in range(2000):
        s = "".join(chr(rng.choice(odd) if rng.random() < 0.1 else rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(0, 40)))
        ids = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert own.encode("x" + chr(0x1C89) * 100) == lib.encode("x" + chr(0x1C89) * 100, add_special_tokens=False).ids


def test_bpe_query(spark, odd):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = bpe.bpe_encode_decode(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == 7
    for r, text in zip(got, [x["text"] for x in odd.select("text").collect()], strict=True):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


# 5, 6, 8 ---------------------------------------------------------------------------------------


def test_quality_classifier(spark, odd):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.quality_scores(d, l, F.col("source"), F.concat_ws("/", "source", "lang")).join(l, "doc_id").where("held_out").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.9 and got[got["quality"] == 1]["kept"].mean() > 0.95
    out = quality_classifier.quality_scores(odd, l, F.col("source"), F.col("lang"))
    assert out.count() == 7 and out.where("score IS NULL").count() == 0
    assert quality_classifier.quality_scores(odd, l.limit(0), F.col("source"), F.col("lang")).where("abs(path_rate - 0.5) > 1e-9").count() == 0


def test_site_rates_equal_brute_force_and_help(spark, monkeypatch):
    """Texts say nothing; sites differ. Rates are checked against plain Python, and order must follow the sites."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(3000):
        host = f"h{rng.randint(0, 5)}"
        path = f"{host}/p{rng.randint(0, 3)}"
        good = rng.random() < 0.1 + 0.15 * int(host[1]) + 0.03 * int(path[-1])
        rows.append((i, " ".join(rng.choices([f"w{k}" for k in range(500)], k=60)), host, path))
        labels.append((i, int(good)))
    d, l = spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int")
    train = [(r, y) for r, (i, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5 != 0]
    by = {"host": collections.defaultdict(lambda: [0, 0]), "path": collections.defaultdict(lambda: [0, 0])}
    for r, y in train:
        for k, name in (("host", r[2]), ("path", r[3])):
            by[k][name][0] += 1
            by[k][name][1] += y
    rate = (sum(y for _, y in train) + 1) / (len(train) + 2)

    def strength(groups):
        n = sum(g[0] for g in groups)
        room = n - sum(g[0] ** 2 for g in groups) / n - (len(groups) - 1)
        spread = sum(g[0] * (g[1] / g[0] - rate) ** 2 for g in groups)
        rho = min(0.99, max(1e-3, (spread - rate * (1 - rate) * (len(groups) - 1)) / (rate * (1 - rate) * room)))
        return (1 - rho) / rho

    kh, kp = strength(list(by["host"].values())), strength(list(by["path"].values()))
    for limit in (100_000, 0):  # broadcast, and joined by key
        monkeypatch.setattr(quality_classifier, "MAX_BROADCAST_SITES", limit)
        got = quality_classifier.quality_scores(d, l, F.col("host"), F.col("path")).collect()
        assert len(got) == len(rows)
        for r in got:
            _, _, host, path = rows[r["doc_id"]]
            h = (by["host"][host][1] + kh * rate) / (by["host"][host][0] + kh)
            assert r["host_rate"] == pytest.approx(h) and r["path_rate"] == pytest.approx((by["path"][path][1] + kp * h) / (by["path"][path][0] + kp))
            site = math.log(r["path_rate"] / (1 - r["path_rate"])) - math.log(rate / (1 - rate))
            z = math.log(r["doc_score"] / (1 - r["doc_score"])) + site
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    held = [(r["score"], r["doc_score"], labels[r["doc_id"]][1]) for r in got if r["held_out"]]

    def auc(k):
        ones, zeros = [h[k] for h in held if h[2]], [h[k] for h in held if not h[2]]
        return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))

    assert auc(0) > 0.7 > auc(1)


def test_language_id(spark, odd):
    got = Q.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    by = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(odd).collect()}
    assert by[2] == by[3] == by[5] == "und" and by[1] in ("en", "de")
    assert language_id.language_id(odd.limit(0)).count() == 0


def test_bloom_filters_have_no_false_negatives():
    keys = np.arange(1, 5000, dtype=np.uint32) * np.uint32(7919)
    f = language_id.LanguageFilters.build({"aa": keys, "bb": keys[:100]}, ["aa", "bb"])
    assert (f.masks(keys)[0] & np.uint64(1)).all() and f.false_rate[0] < 0.01
    assert (f.masks(keys[:100])[0] & np.uint64(2)).all()


def test_filters_answer_like_exact_sets_of_grams():
    rng = random.Random(4)
    words = {f"l{k}": ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(300)] for k in range(70)}  # two words a position
    texts = {k: [" ".join(rng.choices(v, k=20)) for _ in range(20)] for k, v in words.items()}

    def grams(t):
        keys, starts = language_id.gram_keys([t])
        return set(keys[: starts[1] - 3].tolist())

    exact = {k: set().union(*map(grams, v)) for k, v in texts.items()}
    f = language_id.LanguageFilters.build({k: np.array(sorted(v), dtype=np.uint32) for k, v in exact.items()}, list(exact))
    for k, v in texts.items():
        fresh = " ".join(rng.choices(words[k], k=30))
        for t in (v[0], fresh):
            keys, starts = language_id.gram_keys([t])
            own = keys[: starts[1] - 3].tolist()
            want = [sum(g in exact[x] for g in own) / len(own) for x in exact]
            got = f.shares([t])[0]
            assert np.abs(got - want).max() < 0.03 and f.predict([t])[0] == [k]


def test_more_languages_than_bits_in_a_word(spark):
    rng = random.Random(1)
    rows = []
    for k in range(130):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(40)]
        rows += [(len(rows) + j, " ".join(rng.choices(own, k=30)), f"l{k}") for j in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.language_id(d).collect()
    assert len(got) == len(rows) and sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in got) > 0.98 * len(rows)
    assert language_id.fit_filters(d, max_docs=3).words.shape[0] == 3


def test_toxicity(spark, odd):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(d, l).join(l, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.98
    out = toxicity.toxicity(odd, spark.createDataFrame([(1, 1), (4, 0), (3, None)], "doc_id long, toxic int"))
    assert out.count() == 7 and out.where("score BETWEEN 0 AND 1").count() == 7


def test_terms_tell_how_many_forms_share_a_beginning():
    read = toxicity.TermReader().read
    first, second, third = toxicity.beginning_terms("stem")
    assert [toxicity.is_shared(t) for t in (first, second, third)] == [False, True, True]
    assert first in read("stemas") and second not in read("stemas Stemas stemas")
    assert second in read("stemas stemon") and third not in read("stemas stemon")
    assert third in read("Stemas, stemon; stemul stemik") and toxicity.word_term("stemas") in read("STEMAS")
    assert read(None) == read("") == read("12 ...") == []
    kept = toxicity.TermReader({second: 0, toxicity.word_term("x"): 1})
    assert kept.read("stemas stemon x") == [0, 1] and kept.read("stemas y") == []


def test_machine_learns_a_pair_that_no_sum_of_weights_can():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append([int(a), 2 + int(b)])
        y.append(float(a == b))
    m = toxicity.FactorizationMachine.train(np.arange(4), rows, np.array(y), epochs=30)
    s = m.scores([[0, 2], [0, 3], [1, 2], [1, 3]])
    assert s[0] > 0.8 and s[3] > 0.8 and s[1] < 0.2 and s[2] < 0.2


def test_pair_sum_equals_the_double_sum():
    rng = np.random.default_rng(6)
    m = toxicity.FactorizationMachine(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    rows = [sorted(rng.choice(30, size=k, replace=False).tolist()) for k in (0, 1, 2, 7, 30)]
    for r, got in zip(rows, m.logits(rows), strict=True):
        want = 0.3 + sum(m.linear[i] for i in r) + sum(float(m.latent[i] @ m.latent[j]) for a, i in enumerate(r) for j in r[a + 1 :])
        assert got == pytest.approx(want)


def test_settings_are_chosen_without_the_deciding_rows(monkeypatch):
    rng = np.random.default_rng(9)
    y = (rng.random(2000) < 0.3).astype(float)
    rows = [np.array([0] if v and rng.random() < 0.9 else [1], dtype=np.int64) for v in y]
    rows = [np.append(r, rng.integers(2, 400, 12)) for r in rows]  # terms 2 and up are noise
    inner = np.arange(2000) % 5 != 0
    terms = np.arange(400)

    def strength(at):
        n = np.stack([np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(at & (y == c))]), minlength=400) for c in (0, 1)])
        return toxicity.strengths(n[0].astype(float), n[1].astype(float), int((at & (y == 0)).sum()), int((at & (y == 1)).sum()))

    trained = []
    train = toxicity.FactorizationMachine.train
    monkeypatch.setattr(toxicity.FactorizationMachine, "train", lambda t, r, y, *a, **b: trained.append(len(r)) or train(t, r, y, *a, **b))
    least, _, epochs = toxicity.choose(terms, rows, y, inner, strength(inner), 8192)
    assert least in toxicity.STRENGTHS and 1 <= epochs <= toxicity.MAX_EPOCHS
    assert trained == [inner.sum()] * len(toxicity.STRENGTHS) * len(toxicity.SHARED)
    assert toxicity.choose(terms, rows[:20], y[:20], inner[:20], strength(inner), 8192) == (toxicity.STRENGTHS[0], toxicity.SHARED[0], toxicity.EPOCHS)
    assert set(toxicity.pick(terms, np.array([5.0, 9.0, *[0.0] * 398]), 4.0, True, 1)) == {1}


# 7 ---------------------------------------------------------------------------------------------


def test_article_text_without_the_rest():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
    <div class="cookie-notice">We use cookies on every page that you visit here</div><main><article><h1>Big&nbsp;news</h1><p>One &amp; <b>two</b>
    three.<p>Go.<form><p>Mail</p></form><aside>Side</aside><div class="comments"><p>I like this very much indeed, thanks for it all</p></div></article></main>
    <div class=sidebar>more</div><footer>&copy;</footer><script>var t="</p>";</script>"""
    assert html_extract.extract_text(page) == "Big news\n\nOne & two three.\n\nGo."
    assert html_extract.extract_text(None) == html_extract.extract_text("") == html_extract.extract_text("<nav>x</nav>") == ""


P = "<p>A paragraph of the article that is long enough to count as text.</p>"
T = "A paragraph of the article that is long enough to count as text."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><div class='social-history'>{P}{P}</div></article>", [T, T]),
        (f"<article><div class='social'>{P}{P}</div></article>", [T, T]),
        (f"<article><div class='post header'><h1>Title</h1></div>{P}</article>", ["Title", T]),
        (f"<body><div class='post header'><h1>Title</h1></div><div class='post'>{P}{P}</div></body>", ["Title", T, T]),
        (f"<article><header><h1>Title</h1><p>By me</p></header>{P}<footer>tags</footer></article>", ["Title", "By me", T]),
        (f"<article><select><option>A<option>B{P}{P}</article>", [T, T]),
        (f"<article><svg><path d=''>{P}{P}</article><footer>x</footer>", [T, T]),
        (f"<article><svg><title>icon</title><text>zz</text></svg>{P}</article>", [T]),
        (f"<article><noscript>{P}</article>", [T]),
        (f"<article>{P}<noscript><p>Enable scripts</p></noscript></article>", [T]),
        (f"<div class='has-sidebar'><article>{P}</article><div class=sidebar>{P}</div></div>", [T]),
        (f"<div class='no-comments'>{P}{P}</div>", [T, T]),
        (f"<article>{P}</article><ol class=commentlist><li class=comment><article>{P.replace('article', 'reader, at more length than the article itself has,')}</article></ol>", [T]),
        (f"<article>{P}<div id='comments'>{P * 5}</div></article>", [T]),
        (f"<form id=aspnetForm><nav>menu</nav><div id=content><h1>Hi</h1>{P}{P}</div></form>", ["Hi", T, T]),
        (f"<div id=wrap><div class=top><a href=a>Home</a> <a href=b>About</a></div><div class=x><h1>Hi</h1>{P}{P}<p>Ok.</p></div><div class='footer'>c</div></div>", ["Hi", T, T, "Ok."]),
        (f"<main><h1>Head</h1><article>{P}{P}</article><div class='newsletter-signup'>Sign</div><p>stray</p></main>", ["Head", T, T]),
        (f"<article>{P}<p class='advert'>Buy now</p>{P}<p>Of.</p></article>", [T, T, "Of."]),
        (f"<article>{P}<div hidden>x</div><div style='display: none'>y</div></article>", [T]),
        (f"<article>{P}</article><article>{P}</article>", [T, T]),
        ("<p>only text", ["only text"]),
        ("<nav>menu</nav>", []),
    ],
)
def test_pages_by_hand(page, want):
    assert html_extract.extract_text(page) == "\n\n".join(want)


def test_deep_pages_take_linear_time():
    import time

    for n in (2_000, 50_000):
        began = time.process_time()
        for unit in ("<div>x", "<div class='ad'>x<section>", "<article>x</section>", "<noscript>x"):
            html_extract.extract_text(unit * n)
        spent = time.process_time() - began
        if n == 2_000:
            first = spent
    assert spent < 100 * max(first, 0.02)


def test_no_page_is_an_error():
    rng = random.Random(1)
    parts = ["<", "</", ">", "<!", "<![", "[", "]]>", "<!--", "-->", "p", "div", "article", "nav", " class=", "'", '"', "&", "#", "x", "text words here", " ", "<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<script>", "</script>", "<svg>", "</svg>", "<select>", "<noscript>", "</noscript>", "<h1>", "\n", "é", "日"]
    for _ in range(3000):
        html_extract.extract_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))))
    assert html_extract.extract_text("<![foo[ bar ]]><p>x text") == "x text"
    assert html_extract.extract_text("<![if !IE]><p>t text<![endif]><![CDATA[ abc ]]>") == "t text"


def test_html_odd_rows(spark):
    rows = [(1, "u", "<p>A text", "x", 5), (1, "u", "<p>A text", "y", 6), (2, None, None, None, None), (None, "v", "", "z", 1), (3, "w", "<<>&&amp; <b", "", 0)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = [tuple(r) for r in html_extract.html_extract(d).collect()]
    assert len(got) == 5 and got.count((1, "u", "A text", 6)) == 2 and (2, None, "", 0) in got and (None, "v", "", 0) in got
    assert html_extract.html_extract(d.limit(0)).count() == 0


def test_every_page_yields_its_article(spark):
    import html

    for r in Q.op7_html_extract(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# 9 ---------------------------------------------------------------------------------------------


def test_mixture_meets_its_targets(spark, odd):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(d, l).toPandas()
    total = got["n_tokens"].sum()
    assert (got["rate"] >= 0).all()
    for k, share in mixing.TARGETS.items():
        assert (got["n_tokens"] * got[f"p_{k}"] * got["rate"]).sum() / total == pytest.approx(share, abs=2e-3)
    assert np.allclose(got[[f"p_{k}" for k in mixing.DOMAINS]].sum(axis=1), 1)
    # by their true labels the mixture's tokens hold about the wanted shares too
    known = got.merge(l.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain IS NOT NULL").toPandas(), on="doc_id")
    weight = known["n_tokens"] * known["rate"]
    for k, share in mixing.TARGETS.items():
        assert weight[known["domain"] == k].sum() / weight.sum() == pytest.approx(share, abs=0.01)


def test_mixing_odd_rows(spark, odd):
    l = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert mixing.mix(odd, l.limit(0)).count() == 7 and mixing.mix(odd.limit(0), l).count() == 0
    kept = mixing.mixed_rows(odd, l.limit(0))
    assert kept.columns == odd.columns and kept.count() == 7  # nothing tells the domains apart
    assert mixing.mixed_rows(odd.limit(0), l).count() == 0
    assert mixing.mixed_rows(odd, l, dict.fromkeys(mixing.DOMAINS, 0.0)).count() == 7


@pytest.mark.parametrize(("cap", "spare"), [(None, False), (1.0, False), (1.0, True)])
def test_rates_equal_a_plain_least_squares_solver(spark, cap, spare):
    """Against plain projected gradient steps of constant length, many of them, in numpy."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(10, 5000, 200).astype(float)
    cells = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "n_tokens long, p_clean double, p_junk double, p_toxic double")
    targets = {"clean": 0.5, "junk": 0.02, "toxic": 0.05} if cap else {"clean": 0.7, "junk": 0.1, "toxic": 0.2}
    least = F.when(F.col("p_clean") >= 0.5, 1.0).otherwise(0.0) if spare else None
    fit = mixing.fit_rates(cells, targets, None, cap, least)
    wanted = np.array([targets[d] for d in mixing.DOMAINS]) * n.sum()
    inverse = np.linalg.inv((p * n[:, None]).T @ p)
    low = np.where(p[:, 0] >= 0.5, 1.0, 0.0) if spare else 0.0
    r = np.ones(200)
    for _ in range(20_000):
        r = np.clip(r - p @ (inverse @ ((r * n) @ p - wanted)), low, np.inf if cap is None else cap)
    off = (r * n) @ p - wanted
    mine = np.array([fit.held[d] for d in mixing.DOMAINS]) - wanted
    assert mine @ inverse @ mine <= off @ inverse @ off + 1e-3 * n.sum() * 1e-3
    rates = [x["r"] for x in cells.select(mixing.rate_column(fit.steps, cap, least).alias("r")).collect()]
    assert min(rates) >= 0 and (cap is None or max(rates) <= cap) and np.allclose((np.array(rates) * n) @ p, [fit.held[d] for d in mixing.DOMAINS])


# 10 --------------------------------------------------------------------------------------------


def brute_rules(x):
    w = WORDS.findall(x or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [y for y in (x or "").split("\n") if WORDS.search(y)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(texts):
    for x in [*texts.values(), None, "", " ", "a b\n\na b\n é $", "x " * 40, "a b c d"]:
        m = quality_rules.measure(x)
        assert tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_rules(x)


def test_cover_and_verdict_equal_brute_force(texts):
    limits = quality_rules.COVER_LIMITS
    for x in [*list(texts.values())[:150], "a b c d e f g h " * 5, "one two three four five six seven " * 3 + " ".join(map(str, range(40))), "x\ny\nx\nx\n" * 9]:
        w = [y.encode() for y in WORDS.findall(x or "")]
        m = quality_rules.measure(x)
        for n in limits:
            at = collections.defaultdict(list)
            for i in range(len(w) - n + 1):
                at[tuple(w[i : i + n])].append(i)
            covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + n)}
            assert m["cover"][n] == pytest.approx(sum(len(w[j]) for j in covered) / max(1, sum(map(len, w))))
        lines = [y.encode() for y in (x or "").split("\n") if WORDS.search(y)]
        doubled = sum(len(y) for k, y in enumerate(lines) if y in lines[:k])
        assert m["dup_line_share"] == pytest.approx(doubled / max(1, sum(map(len, lines))))
        base = len(w) < 20 or 100 * m["n_repeat_words"] > 30 * len(w)
        bad = any(m["cover"][n] > t for n, t in limits.items()) or m["dup_line_share"] > quality_rules.LINE_LIMIT or m["n_symbols"] > quality_rules.SYMBOL_LIMIT * len(w)
        assert quality_rules.judge(m, limits, quality_rules.LINE_LIMIT, quality_rules.SYMBOL_LIMIT) == (base, not base and not bad)


def test_rules_query(spark, odd):
    got = quality_rules.quality_rules(odd)
    assert got.count() == 7 and got.where("kept AND base_failed").count() == 0
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert sorted(map(tuple, got[sorted(got.columns)].values.tolist())) == sorted(map(tuple, want[sorted(got.columns)].values.tolist()))


# pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = docs.toPandas()
        assert 0 < len(now) <= len(before)
        if name != "bpe":
            assert docs.columns == columns
        if name == "quality_rules":
            kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(before)).collect()}
            assert set(now["doc_id"]) == {i for i, k in kept.items() if k}
        if name == "jaccard_join":
            want = brute_components(list(zip(before["doc_id"], before["text"], strict=True)), 5, 80, 100)
            assert set(now["doc_id"]) == {i for i, _, c, _ in want if i == c}
        before = now


def test_near_copy_stage_keeps_one_of_equal_rows(spark):
    d = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (None, "q r s t u", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(corpus_pipeline.drop_near_copies(spark, d, SF).toPandas()["text"]) == ["a b c d e f g", "q r s t u"]
    e = spark.createDataFrame([(None, "a b c d e f g"), (7, "a b c d e f g"), (None, "q r s t u"), (None, "q r s t u"), (None, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, e, SF).collect()), key=str) == [(3, ""), (7, "a b c d e f g"), (None, "q r s t u"), (None, None)]


def shuffled(spark, wait=lambda n: False):
    """Bytes of shuffle files on disk; asks again for some seconds while ``wait`` is true of them."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for k in range(40):
        files = disk.getAllFiles()
        n = sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))
        if not wait(n):
            break
        time.sleep(0.25)
    return n


def test_near_copy_stage_frees_its_shuffles_and_shuffles_few_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(4000)) for _ in range(60)]
    d = Scratch(spark, "texts").save(spark.createDataFrame([(i, t, i) for i, t in enumerate([*texts, texts[0] + " end", texts[1], texts[2]])] + [(62, texts[2], 62)], "doc_id long, text string, extra long"))
    size = sum(map(len, texts))
    asked = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sparkContext._jvm.System.gc()
        before = shuffled(spark, lambda n: n > size // 20)
        out = corpus_pipeline.drop_near_copies(spark, d, SF)
        assert shuffled(spark, lambda n: n - before > size // 20) - before < size // 20
        got = out.toPandas()
        assert shuffled(spark) - before < size // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", asked)
    assert sorted(got["doc_id"]) == list(range(60)) and list(got["extra"].sort_values()) == list(range(60))


def test_pipeline_takes_odd_tables(spark, tmp_path):
    """Empty table, nulls in every column, equal rows, and columns with the names that stages use inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    extra = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(["n_tokens", "cell", "score", "lang_pred", "key", "node", "id", "_rate"])))
    rows = extra.limit(60)
    nulls = rows.limit(2).select(*(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    for n, table in enumerate((extra.limit(0), rows.unionByName(rows.limit(5)).unionByName(nulls))):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"{n}-{name}"))
            now = spark.read.parquet(str(tmp_path / f"{n}-{name}"))
            if name != "bpe":
                assert now.columns == extra.columns
        assert now.count() == 0 if n == 0 else 0 < now.count() <= 60
