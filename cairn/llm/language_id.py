"""Language identification by language-bitmask n-gram filters.

Each language's frequent byte n-grams go into one bit-sliced Bloom filter: a table of 64-bit
words in which bit l of a word says that language l has set this position; every further 64
languages add one word a position. The AND of an n-gram's words is the set of all languages
that contain it. Per text, the set bits are counted for each language, the counts are corrected
for the filter's false positives (estimated from its fill), and the language with the largest
corrected share wins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, pieces, release, released

GRAM = 4
#: Bound of the sample that the filters are fitted on: documents a language.
MAX_DOCS_PER_LANGUAGE = 4000
#: An n-gram belongs to a language if it makes up at least this share of its n-grams, so that
#: no language has more than 1 / MIN_SHARE of them.
MIN_SHARE = 1 / 20_000
BITS = 19
HASHES = 3
WORD = 64
UND = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def gram_keys(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-byte n-grams of the lower-cased texts as 32-bit keys, and each text's first index.

    ASCII signs and digits count as spaces; a text is framed by one space. Keys that span two
    texts stand after a text's own ones, at its last three indexes, and must be left out.
    """
    framed = [b" " + (x or "").lower().encode().translate(_FOLD) + b"  " for x in texts]
    starts = np.zeros(len(framed) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in framed], out=starts[1:])
    raw = np.frombuffer(b"".join([*framed, b" " * (GRAM - 1)]), dtype=np.uint8).astype(np.uint32)
    n = len(raw) - (GRAM - 1)
    keys = raw[:n] | raw[1 : n + 1] << 8 | raw[2 : n + 2] << 16 | raw[3 : n + 3] << 24
    return keys, starts


def positions(keys: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    wide = keys.astype(np.uint64)
    return [((wide * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in _MIX[:HASHES]]


@dataclass
class LanguageFilters:
    """The fitted filters: ``languages`` by bit, the bit-sliced tables (one row of 2 ** BITS words
    for each 64 languages, so 64 KB a language), and false-positive rates."""

    languages: list[str]
    words: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], order: Sequence[str]) -> LanguageFilters:
        """``grams``: each language's keys; ``order``: languages from the most to the least frequent."""
        words = np.zeros((max(1, -(-len(order) // WORD)), 1 << BITS), dtype=np.uint64)
        rate = np.zeros(len(order))
        for i, lang in enumerate(order):
            row, bit = words[i // WORD], np.uint64(i % WORD)
            for at in positions(grams.get(lang, np.zeros(0, np.uint32))):
                row[at] |= np.uint64(1) << bit
            rate[i] = float(((row >> bit) & np.uint64(1)).mean()) ** HASHES
        return cls(list(order), words, rate)

    def masks(self, keys: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the bits of the languages that contain it, 64 languages a row."""
        a, b, c = positions(keys)
        return [row[a] & row[b] & row[c] for row in self.words]

    def shares(self, texts: Sequence[str | None]) -> np.ndarray:
        """For each text and language, the corrected share of the text's n-grams in the filter."""
        keys, starts = gram_keys(texts)
        masks = self.masks(keys)
        ends = starts[1:] - (GRAM - 1)
        edges = np.empty(2 * len(texts), dtype=np.int64)
        edges[0::2], edges[1::2] = starts[:-1], np.maximum(ends, starts[:-1])
        total = np.maximum(1, ends - starts[:-1])
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            hits = ((masks[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).astype(np.int32)
            count = np.add.reduceat(np.append(hits, 0), edges)[0::2]
            count = np.where(ends > starts[:-1], count, 0)
            rate = min(self.false_rate[i], 0.999)
            out[:, i] = np.clip((count / total - rate) / (1 - rate), 0.0, 1.0)
        return out

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: ``und`` and 0 if it is null or has no letter."""
        if not self.languages:
            return [UND] * len(texts), [0.0] * len(texts)
        shares = self.shares(texts)
        best = shares.argmax(axis=1)  # ties: the more frequent language
        known = [x is not None and _LETTER.search(x) is not None for x in texts]
        langs = [self.languages[b] if k else UND for b, k in zip(best, known, strict=True)]
        return langs, [float(s[b]) if k else 0.0 for s, b, k in zip(shares, best, known, strict=True)]


def fit_filters(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    max_docs: int = MAX_DOCS_PER_LANGUAGE,
    min_share: float = MIN_SHARE,
) -> LanguageFilters:
    """Fit on the rows of ``labelled`` with a text and a language.

    At most about ``max_docs`` rows a language are used, chosen by a hash of the id; within
    them every n-gram counts. What reaches the driver is one row a language and at most
    1 / ``min_share`` keys for each.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counted = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("n"), "lang").collect()}
    if not counts:
        return LanguageFilters([], np.zeros((1, 1 << BITS), np.uint64), np.zeros(0))
    bucket = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1_000_000))
    common = {lang: max(1, int(max_docs / n * 1_000_000)) for lang, n in counts.items() if n > max_docs}  # the others come whole
    taken = F.lit(1_000_000)
    if common:
        parts = F.map_from_arrays(F.from_json(F.lit(json.dumps(list(common))), "array<string>"), F.from_json(F.lit(json.dumps(list(common.values()))), "array<int>"))
        taken = F.coalesce(parts[F.col(lang_col).cast("string")], taken)
    sample = rows.where(bucket < taken).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in pieces(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                keys, starts = gram_keys(texts)
                own = np.ones(len(keys), dtype=bool)
                for back in range(1, GRAM):
                    own[starts[1:] - back] = False
                got = np.unique(keys[own], return_counts=True)
                held.setdefault(lang, []).append(got)
                if len(held[lang]) >= 16:
                    held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            keys, n = merged(parts)
            for k in range(0, len(keys), 50_000):
                size = len(keys[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(keys[k : k + 50_000].astype(np.int64)), pa.array(n[k : k + 50_000])], ["lang", "gram", "n"])

    grams = sample.mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = grams.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * min_share).select("lang", "gram")
    kept: dict[str, list[int]] = {}
    for row in frequent.toLocalIterator():
        kept.setdefault(row["lang"], []).append(row["gram"])
    return LanguageFilters.build({k: np.array(v, dtype=np.uint32) for k, v in kept.items()}, list(counts))


def _shared(spark: SparkSession, filters: LanguageFilters):
    """A broadcast of the filters: 64 KB a language, whatever the corpus."""
    return spark.sparkContext.broadcast((filters.languages, filters.words.tobytes(), filters.false_rate.tolist()))


def _own(value: tuple[list[str], bytes, list[float]]) -> LanguageFilters:
    langs, words, rate = value
    return LanguageFilters(langs, np.frombuffer(words, dtype=np.uint64).reshape(-1, 1 << BITS), np.array(rate))


def identify_languages(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``id_cols``, ``lang_pred`` string and ``score`` double (0 to 1) of every row, from its text alone.

    The prediction is a learned language, or ``und`` if the text is null or has no letter.
    Ties go to the language with more training rows. Repeated rows and null ids come back as
    they are; an empty table gives an empty result; other columns are not read.
    """
    ids = list(id_cols)
    source = docs.select(*ids, text_col)
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ids) + ", lang_pred string, score double"
    shared = _shared(docs.sparkSession, filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(shared.value)
        for batch in pieces(batches, 128):
            pred, score = own.predict(batch.column(len(ids)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(ids))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*ids, "lang_pred", "score"])

    return source.mapInArrow(released(run), schema)


def language_column(spark: SparkSession, filters: LanguageFilters, text: Column) -> Column:
    """The prediction as a column, struct<lang_pred, score>, so that rows keep all their columns."""
    shared = _shared(spark, filters)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _own(shared.value)
        for part in parts:
            found = [own.predict(part.iloc[k : k + 128].tolist()) for k in range(0, len(part), 128)]
            yield pd.DataFrame({"lang_pred": [x for f in found for x in f[0]], "score": [x for f in found for x in f[1]]})
        release()

    return predict(text)


def language_id(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """Fit on the rows outside the held-out fold, then predict every row.

    Result: ``doc_id``, ``held_out`` boolean, ``lang_pred``, ``score``. Rows without a text or a
    language teach nothing; null texts and those without a letter are ``und`` with score 0. Where
    nothing can be learned every row is ``und``. Any number of languages may occur; ties go to the
    one with more training rows, then by name. Repeated rows and null ids come back as they are;
    an empty table gives an empty result; other columns are not read.
    """
    held = fold(F.col(id_col), folds) == held_fold
    filters = fit_filters(docs.where(~held), text_col, lang_col, id_col)
    out = identify_languages(docs, filters, text_col, (id_col,))
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score")
