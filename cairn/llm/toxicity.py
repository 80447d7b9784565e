"""Toxicity by a factorization machine over hashed terms.

A text's terms, hashed, are its distinct words, the beginnings of its longer words, and the
beginnings that two or three of its distinct words share. The machine's score is a bias, a
weight for each term, and an inner product of latent vectors for each pair of terms in the text,
so that a pair (an insult with the mention of a group) can weigh more than its parts. It is
trained by mini-batch AdaGrad on a bounded sample of the labelled rows; every row is then scored
over its whole text.

Nothing about the labels is set by hand: which terms take part (how strong their association
must be, whether shared beginnings count) and for how many epochs the machine is trained is
decided by the loss on a fifth of the training sample, whose rows help neither to choose terms
nor to train for that decision. The machine is then trained anew on the whole sample.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, fold, pieces, released

#: Bounds: labelled rows that the machine is fitted on, hashed terms that it may keep.
MAX_TRAIN_ROWS = 20_000
MAX_TERMS = 8192
HASH_BITS = 21
FACTORS = 4
MIN_DOCS = 4
#: What the inner split chooses from: the least chi-square association of a term with the label,
#: and whether beginnings that several words share are terms. Its fifth needs so many rows of
#: each class to decide; with fewer the first choice stands, for EPOCHS.
STRENGTHS = (10.0, 6.0, 3.0)
SHARED = (True, False)
DECIDING_ROWS = 10
EPOCHS = 30
MAX_EPOCHS = 40
PATIENCE = 5
PREFIXES = (4, 5, 6)
#: A beginning has one term for each number of distinct words, up to this, that share it.
MAX_FORMS = 3
MEMO_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def word_term(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << HASH_BITS) - 1)


def beginning_terms(beginning: str) -> tuple[int, ...]:
    """The terms of a beginning that one, two, ... distinct words of a text share."""
    return tuple(word_term(f"{beginning}~{n}") | (n > 1) << HASH_BITS for n in range(1, MAX_FORMS + 1))


def is_shared(term: int) -> bool:
    """Whether a term says that several words share a beginning: these have a bit of their own."""
    return term >> HASH_BITS == 1


class TermReader:
    """The distinct terms of texts, with bounded memos of words; ``keep`` maps hash to column."""

    def __init__(self, keep: dict[int, int] | None = None) -> None:
        self.keep = keep
        self.words: dict[str, tuple[int | None, tuple[tuple[int | None, ...], ...]]] = {}
        self.beginnings: dict[str, tuple[int | None, ...]] = {}

    def _column(self, term: int) -> int | None:
        return term if self.keep is None else self.keep.get(term)

    def _beginning(self, beginning: str) -> tuple[int | None, ...]:
        got = self.beginnings.get(beginning)
        if got is None:
            got = tuple(self._column(t) for t in beginning_terms(beginning))
            self.beginnings[beginning] = got
        return got

    def _word(self, word: str) -> tuple[int | None, tuple[tuple[int | None, ...], ...]]:
        """The word's own column, and its beginnings that have any; equal beginnings are one object."""
        own = [self._beginning(word[:k]) for k in PREFIXES if len(word) > k]
        got = self._column(word_term(word)), tuple(b for b in own if any(c is not None for c in b))
        self.words[word] = got
        return got

    def read(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
            self.beginnings.clear()
        found: set[int | None] = set()
        forms: dict[tuple[int | None, ...], int] = {}
        known = self.words
        for word in set(_WORD.findall(text.lower())):
            got = known.get(word) or self._word(word)
            found.add(got[0])
            for b in got[1]:
                forms[b] = forms.get(b, 0) + 1
        for b, n in forms.items():
            found.update(b[:n])
        found.discard(None)
        return sorted(found)


def _flat(rows: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row lists as one index array and each row's first place; empty rows get none."""
    sizes = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
    index = np.fromiter((t for r in rows for t in r), dtype=np.int64, count=int(sizes.sum()))
    return index, sizes


@dataclass
class FactorizationMachine:
    """Bias, linear weights and latent vectors over ``terms`` (hashes, by column)."""

    terms: np.ndarray
    bias: float
    linear: np.ndarray
    latent: np.ndarray

    def logits(self, rows: Sequence[Sequence[int]]) -> np.ndarray:
        index, sizes = _flat(rows)
        out = np.full(len(rows), self.bias)
        if not len(index):
            return out
        row = np.repeat(np.arange(len(rows)), sizes)
        out += np.bincount(row, weights=self.linear[index], minlength=len(rows))
        for f in range(self.latent.shape[1]):
            v = self.latent[index, f]
            s = np.bincount(row, weights=v, minlength=len(rows))
            out += 0.5 * (s * s - np.bincount(row, weights=v * v, minlength=len(rows)))
        return out

    def scores(self, rows: Sequence[Sequence[int]]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(rows), -40, 40)))

    @classmethod
    def train(
        cls, terms: np.ndarray, rows: Sequence[Sequence[int]], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-4, seed: int = 7, watch: Callable[[FactorizationMachine], bool] | None = None
    ) -> FactorizationMachine:
        """Mini-batch AdaGrad on the logistic loss. Without rows of both classes only the bias is fitted.

        ``watch`` sees the machine after every epoch and may end the training by returning true.
        """
        d = max(1, len(terms))
        p = (float(y.sum()) + 0.5) / (len(y) + 1.0)
        rng = np.random.default_rng(seed)
        m = cls(terms, float(np.log(p / (1 - p))), np.zeros(d), rng.normal(0, 0.02, (d, FACTORS)))
        if len(set(y.tolist())) < 2:
            m.latent[:] = 0
            return m
        g_lin, g_lat, g_bias = np.full(d, 1e-6), np.full((d, FACTORS), 1e-6), 1e-6
        index, sizes = _flat(rows)
        first = np.concatenate([[0], np.cumsum(sizes)])
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 256):
                at = order[k : k + 256]
                idx = np.concatenate([index[first[i] : first[i + 1]] for i in at]) if len(at) else index[:0]
                row = np.repeat(np.arange(len(at)), sizes[at])
                v = m.latent[idx]
                sums = np.stack([np.bincount(row, weights=v[:, f], minlength=len(at)) for f in range(FACTORS)], axis=1)
                squares = np.bincount(row, weights=(v * v).sum(axis=1), minlength=len(at))
                z = m.bias + np.bincount(row, weights=m.linear[idx], minlength=len(at)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
                err = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y[at]
                g_bias += float(err.sum()) ** 2
                m.bias -= rate * float(err.sum()) / np.sqrt(g_bias)
                if not len(idx):
                    continue
                used, back = np.unique(idx, return_inverse=True)
                e = err[row]
                g = np.bincount(back, weights=e, minlength=len(used)) + l2 * m.linear[used]
                g_lin[used] += g * g
                m.linear[used] -= rate * g / np.sqrt(g_lin[used])
                gv = e[:, None] * (sums[row] - v)
                g2 = np.stack([np.bincount(back, weights=gv[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1) + l2 * m.latent[used]
                g_lat[used] += g2 * g2
                m.latent[used] -= 0.5 * rate * g2 / np.sqrt(g_lat[used])
            if watch and watch(m):
                break
        return m

    def loss(self, rows: Sequence[Sequence[int]], y: np.ndarray) -> float:
        p = np.clip(self.scores(rows), 1e-6, 1 - 1e-6)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def strengths(n0: np.ndarray, n1: np.ndarray, of0: int, of1: int) -> np.ndarray:
    """Chi-square of each term's rows of class 1 against the share of that class; 0 below MIN_DOCS rows."""
    n = n0 + n1
    expected = n * (max(1, of1) / (max(1, of0) + max(1, of1)))
    return np.where(n >= MIN_DOCS, (n1 - expected) ** 2 / np.maximum(expected, 1e-9), 0.0)


def pick(terms: np.ndarray, strength: np.ndarray, least: float, shared: bool, max_terms: int) -> np.ndarray:
    """Places of the terms that take part, the strongest first."""
    at = np.flatnonzero((strength >= least) & (shared | (terms >> HASH_BITS == 0)))
    return at[np.lexsort((terms[at], -strength[at]))][:max_terms]


def choose(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray, inner: np.ndarray, strength: np.ndarray, max_terms: int) -> tuple[float, bool, int]:
    """(least strength, shared beginnings, epochs) with the least loss on the rows not ``inner``.

    ``rows`` are places in ``terms``; ``strength`` is counted on the ``inner`` rows alone.
    """
    best = (math.inf, STRENGTHS[0], SHARED[0], EPOCHS)
    held = ~inner
    if min((y[held] == c).sum() for c in (0, 1)) < DECIDING_ROWS or len(set(y[inner].tolist())) < 2:
        return best[1:]
    for least in STRENGTHS:
        for shared in SHARED:
            at = pick(terms, strength, least, shared, max_terms)
            place = np.full(len(terms), -1)
            place[at] = np.arange(len(at))
            own = [(p := place[r])[p >= 0].tolist() for r in rows]
            train, test = [r for r, i in zip(own, inner, strict=True) if i], [r for r, i in zip(own, held, strict=True) if i]
            losses: list[float] = []

            def watch(m: FactorizationMachine, test: list = test, losses: list = losses) -> bool:
                losses.append(m.loss(test, y[held]))
                return len(losses) - int(np.argmin(losses)) > PATIENCE

            FactorizationMachine.train(terms[at], train, y[inner], MAX_EPOCHS, watch=watch)
            epochs = int(np.argmin(losses)) + 1
            best = min(best, (losses[epochs - 1], least, shared, epochs), key=lambda x: x[0])
    return best[1:]


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS, max_terms: int = MAX_TERMS) -> FactorizationMachine:
    """Fit on the documents that have a 0/1 label; null texts count as empty.

    About ``max_rows`` labels are used, chosen by a hash of the id, so the sample of labels is
    small enough to broadcast and the texts need no shuffle. What reaches the driver is at most
    twice ``max_terms`` terms with the strongest association to the label, and the sample's rows
    as places among them.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(label_col).cast("int").alias("y"), F.col(id_col).alias("label_id"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("sample")), F.lit(1_000_000)) < int(max_rows / n * 1_000_000))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    group = (F.col("y") + 2 * (F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("inner")), F.lit(5)) != 0).cast("int")).alias("g")
    rows = Scratch(docs.sparkSession, "toxicity").save(texts.join(F.broadcast(known), F.col("id") == F.col("label_id")).select(group, "text"))
    names = ["n0", "n1", "n2", "n3"]  # class 0 and 1 of the deciding fifth, then of the rest

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader()
        got = np.zeros((4, 2 << HASH_BITS), dtype=np.uint16)  # a task holds fewer rows than max_rows
        for batch in pieces(batches):
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got[g, reader.read(text)] += 1
        at = np.flatnonzero(got.any(axis=0))
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(got[g, part].astype(np.int64)) for g in range(4))], ["term", *names])

    sizes = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    of = [sizes.get(g, 0) for g in range(4)]
    counts = rows.mapInArrow(released(count), "term long, n0 long, n1 long, n2 long, n3 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in names))
    n, ones = sum((F.col(c) for c in names), F.lit(0)), F.col("n1") + F.col("n3")
    expected = n * (max(1, of[1] + of[3]) / (max(1, of[0] + of[2]) + max(1, of[1] + of[3])))
    strength = (ones - expected) * (ones - expected) / expected
    # the deciding fifth can weaken a term's association as seen on the rest, so weaker ones come too
    best = counts.where(n >= MIN_DOCS).withColumn("s", strength).where(F.col("s") >= min(STRENGTHS) / 2).orderBy(F.desc("s"), "term").limit(2 * max_terms)
    got = best.select("term", *names).collect()
    terms = np.array([r["term"] for r in got], dtype=np.int64)
    table = np.array([[r[c] for c in names] for r in got], dtype=float).reshape(-1, 4).T
    keep = {int(t): i for i, t in enumerate(terms)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader(keep)
        for batch in pieces(batches):
            found = [np.array(reader.read(x), dtype="<i4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["g", "found"])

    sample = sorted((r["g"], bytes(r["found"])) for r in rows.mapInArrow(encode, "g int, found binary").toLocalIterator())
    g = np.array([s[0] for s in sample], dtype=np.int64)
    y = (g % 2).astype(float)
    places = [np.frombuffer(s[1], dtype="<i4") for s in sample]
    least, shared, epochs = choose(terms, places, y, g >= 2, strengths(table[2], table[3], of[2], of[3]), max_terms)
    at = pick(terms, strengths(table[0] + table[2], table[1] + table[3], of[0] + of[2], of[1] + of[3]), least, shared, max_terms)
    place = np.full(len(terms), -1)
    place[at] = np.arange(len(at))
    return FactorizationMachine.train(terms[at], [(p := place[r])[p >= 0].tolist() for r in places], y, epochs)


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``id_cols``, ``score`` double and ``predicted`` int of every row, from its text alone.

    Null and empty texts have no terms and get the bias's score. Repeated rows and null ids
    come back as they are; an empty table gives an empty result; other columns are not read.
    """
    ids = list(id_cols)
    source = docs.select(*ids, text_col)
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ids) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_TERMS * (FACTORS + 2) numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = TermReader({int(t): i for i, t in enumerate(own.terms)})
        for batch in pieces(batches):
            got = own.scores([reader.read(x) for x in batch.column(len(ids)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(ids))), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], [*ids, "score", "predicted"])

    return source.mapInArrow(released(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """Learn ``labels.toxic`` outside the held-out fold, then score every document.

    Result: ``doc_id``, ``held_out`` boolean, ``score``, ``predicted``. A document with several
    labels trains once with each; a label without a document or with a null is not used.
    """
    out = score(docs, fit(docs, labels.where(fold(F.col("doc_id"), folds) != held_fold)))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), "score", "predicted")
