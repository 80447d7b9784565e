"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on a text's own measurements gives document evidence. Labelled rows are
counted by host and by path; a host's rate of good documents is shrunk toward the global one
and a path's toward its host's, each by a pseudo-count that the spread of the observed rates
itself yields (method of moments of the beta-binomial). The document's log odds are then moved
by its path's log odds against the global ones, so a sparse site adds little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, fold, pieces
from .quality_rules import measure

#: Bound of the sample of labelled rows that the regression is fitted on.
MAX_TRAIN_ROWS = 20_000
KEEP_SCORE = 0.5
#: A table of sites is broadcast up to so many rows; larger ones are joined by key.
MAX_BROADCAST_SITES = 100_000
FEATURES = 9


def features(text: str | None) -> list[float]:
    """Measurements of one whole text; null counts as empty."""
    text = text or ""
    m = measure(text, (4, 8))
    n = max(1, m["n_words"])
    chars = max(1, m["word_chars"])
    return [
        float(np.log1p(m["n_words"])),
        m["cover"][4],
        m["cover"][8],
        m["dup_line_share"],
        min(4.0, m["n_symbols"] / n),
        min(4.0, text.count("!") / n),
        min(20.0, chars / n) / 10,
        sum(map(text.count, "0123456789")) / chars,
        float(text.isupper()),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton steps on the ridge-penalised logistic loss; the last weight is the bias."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        move = np.linalg.solve(curve, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def _logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(q / (1 - q))


def pseudo_count(groups: DataFrame, rate: float) -> float:
    """Strength of the prior for groups with ``n`` and ``good``, by the spread of their rates."""
    n, good = F.col("n"), F.col("good")
    s = groups.agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(n * F.pow(good / n - rate, 2)).alias("s")).first()
    if not s["n"] or s["k"] < 2 or not 0 < rate < 1:
        return 100.0
    within = rate * (1 - rate)
    room = s["n"] - s["nn"] / s["n"] - (s["k"] - 1)
    rho = (s["s"] - within * (s["k"] - 1)) / (within * room) if room > 0 else 0.0
    rho = min(0.99, max(1e-3, rho))
    return (1 - rho) / rho


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text_col: str = "text", id_col: str = "doc_id", folds: int = 5, held_fold: int = 0, keep_score: float = KEEP_SCORE) -> DataFrame:
    """Score of every row of ``docs``; labels are learned outside the held-out fold only.

    ``host`` and ``path`` are columns of ``docs``; a path belongs to its host. Result: ``doc_id``,
    ``held_out``, ``doc_score`` (the text alone), ``host_rate``, ``path_rate`` (shrunk), ``score``
    (double, 0 to 1) and ``kept``. Null hosts and paths count as the empty name. Null and empty
    texts are scored by their measurements (all zero). Without labels every rate is one half.
    Repeated labels of a document count as often as they stand. Repeated rows and null ids come back as they are; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_fold)).select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("y"))
    n = known.count()
    few = known if n <= MAX_TRAIN_ROWS else known.where(F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("quality")), F.lit(1_000_000)) < int(MAX_TRAIN_ROWS / n * 1_000_000))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    sample = source.join(F.broadcast(few), F.col("id") == F.col("label_id")).select("y", "text")  # MAX_TRAIN_ROWS labels, about
    got = sorted((r["y"], tuple(r["x"])) for r in sample.mapInArrow(encode, "y int, x array<double>").toLocalIterator())
    x = np.array([g[1] for g in got], dtype=float).reshape(-1, FEATURES)
    y = np.array([g[0] for g in got], dtype=float)
    weights = fit_logistic(x, y) if len(set(y.tolist())) == 2 else np.zeros(FEATURES + 1)

    id_type = source.schema["id"].dataType.simpleString()

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            a = np.array([features(t) for t in batch.column(3).to_pylist()], dtype=float).reshape(-1, FEATURES)
            z = np.clip(a @ weights[:-1] + weights[-1], -30, 30)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(z)], ["id", "host", "path", "z"])

    scored = scratch.save(source.mapInArrow(evidence, f"id {id_type}, host string, path string, z double"))
    # counts over all labelled rows; a hot host is added up before it moves
    counted = scored.join(known, F.col("id") == F.col("label_id")).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    paths = scratch.save(counted)
    hosts = scratch.save(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (whole["good"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    k_host, k_path = pseudo_count(hosts, rate), pseudo_count(paths, rate)
    host_rate = hosts.select(F.col("host").alias("h"), ((F.col("good") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
    path_rate = scratch.save(paths.join(host_rate, F.col("host") == F.col("h")).select(F.col("host").alias("ph"), F.col("path").alias("pp"), ((F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate")))
    both = scratch.save(
        scored.select("host", "path").distinct()
        .join(host_rate, F.col("host") == F.col("h"), "left")
        .join(path_rate, (F.col("host") == F.col("ph")) & (F.col("path") == F.col("pp")), "left")
        .select(F.col("host").alias("sh"), F.col("path").alias("sp"), F.coalesce("host_rate", F.lit(rate)).alias("host_rate"), F.coalesce("path_rate", "host_rate", F.lit(rate)).alias("path_rate"))
    )
    # both sides are read from tables, so that beyond the bound Spark can split a hot site's rows
    few_sites = F.broadcast(both) if both.count() <= MAX_BROADCAST_SITES else both
    joined = scored.join(few_sites, (F.col("host") == F.col("sh")) & (F.col("path") == F.col("sp")), "left")
    odds = F.col("z") + _logit(F.col("path_rate")) - _logit(F.lit(rate))
    score = 1 / (1 + F.exp(-odds))
    return joined.select(
        F.col("id").alias(id_col),
        (fold(F.col("id"), folds) == held_fold).alias("held_out"),
        (1 / (1 + F.exp(-F.col("z")))).alias("doc_score"),
        "host_rate",
        "path_rate",
        score.alias("score"),
        (score >= keep_score).alias("kept"),
    )
