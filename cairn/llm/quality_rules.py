"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy, mark every word that lies in an n-gram
found twice or more in the same text; the share of characters that they cover, and that
duplicated lines cover, decides. One pass, no shuffle, whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import pieces, release, released
from ._text import WordHasher

SYMBOLS = b"#*$%&|<>"
#: n-gram length in words -> largest share of word characters that repeated n-grams may cover.
COVER_LIMITS = {4: 0.60, 6: 0.50, 8: 0.45}
LINE_LIMIT = 0.50
SYMBOL_LIMIT = 0.25
BASE_WINDOW = 8

_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_hasher = WordHasher()
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least ``n`` of each."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        tables = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers, _inverse = tables
    return _powers, _inverse


def repeated_words(hashes: np.ndarray, lengths: Sequence[int]) -> dict[int, np.ndarray]:
    """For each length n, which words lie in an n-word window that occurs twice or more.

    One cumulative sum serves all lengths: the hash of window i is the difference of two
    prefix sums, scaled back by the base's power. Windows that overlap each other count.
    """
    n = len(hashes)
    power, inverse = _tables(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * inverse[:n], out=prefix[1:])
    found = {}
    for k in lengths:
        covered = np.zeros(n, dtype=bool)
        if n > k:
            window = (prefix[k:] - prefix[:-k]) * power[: n - k + 1]
            order = np.argsort(window)
            ranked = window[order]
            same = ranked[1:] == ranked[:-1]
            if same.any():
                edge = np.zeros(n + 1, dtype=np.int64)
                starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
                edge[starts] += 1
                edge[starts + k] -= 1
                covered = np.cumsum(edge[:-1]) > 0
        found[k] = covered
    return found


def measure(text: str | None, lengths: Sequence[int] = tuple(COVER_LIMITS)) -> dict:
    """All measurements of one text. Null counts as empty; an empty text has zeros everywhere."""
    raw = (text or "").encode()
    words = raw.split()  # bytes.split cuts at \x20 and \x09-\x0D exactly
    n = len(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    doubled = sum(len(x) for x in lines if x in seen or seen.add(x))
    out = {
        "n_words": n,
        "word_chars": len(text or "") - (len(raw) - int(sizes.sum())),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(seen),
        "dup_line_share": doubled / max(1, sum(map(len, lines))),
    }
    want = sorted({BASE_WINDOW, *lengths})
    cover = {k: np.zeros(0, bool) for k in want}
    if n:
        hashes = _hasher.array(words)
        cover = repeated_words(hashes, want)
    out["n_repeat_words"] = int(cover[BASE_WINDOW].sum())
    total = max(1, int(sizes.sum()))
    out["cover"] = {k: float(sizes[cover[k]].sum() / total) if n else 0.0 for k in lengths}
    return out


def judge(m: dict, cover_limits: dict[int, float], line_limit: float, symbol_limit: float) -> tuple[bool, bool]:
    """(base_failed, kept) of one text's measurements."""
    base = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
    bad = (
        any(m["cover"][k] > limit for k, limit in cover_limits.items())
        or m["dup_line_share"] > line_limit
        or m["n_symbols"] > symbol_limit * m["n_words"]
    )
    return base, not (base or bad)


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    id_cols: Sequence[str] = ("doc_id",),
    cover_limits: dict[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
    symbol_limit: float = SYMBOL_LIMIT,
) -> DataFrame:
    """Measurements and verdict of every row of ``docs``.

    Result: ``id_cols``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long), ``cover_<n>`` and ``dup_line_share`` (double), ``base_failed``
    and ``kept`` (boolean). Null and empty texts have no words and fail the base rule.
    Repeated rows and null ids come back as they are; an empty table gives an empty result;
    other columns of ``docs`` are not read, so clashing names do no harm.
    """
    limits = dict(COVER_LIMITS if cover_limits is None else cover_limits)
    lengths = sorted(limits)
    ids = list(id_cols)
    source = docs.select(*ids, text_col)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = ", ".join(
        [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ids]
        + [f"{c} long" for c in longs]
        + [f"cover_{k} double" for k in lengths]
        + ["dup_line_share double", "base_failed boolean", "kept boolean"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [measure(x, lengths) for x in batch.column(len(ids)).to_pylist()]
            said = [judge(m, limits, line_limit, symbol_limit) for m in rows]
            columns = [batch.column(i) for i in range(len(ids))]
            columns += [pa.array([m[c] for m in rows], pa.int64()) for c in longs]
            columns += [pa.array([m["cover"][k] for m in rows], pa.float64()) for k in lengths]
            columns.append(pa.array([m["dup_line_share"] for m in rows], pa.float64()))
            columns += [pa.array([x[i] for x in said], pa.bool_()) for i in (0, 1)]
            names = [*ids, *longs, *(f"cover_{k}" for k in lengths), "dup_line_share", "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(released(run), schema)


def kept_column(text: Column, cover_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, symbol_limit: float = SYMBOL_LIMIT) -> Column:
    """The verdict as a boolean column, so that rows keep all their columns.

    Null, empty and blank texts have no words and are false; equal texts have equal verdicts.
    """
    limits = dict(COVER_LIMITS if cover_limits is None else cover_limits)
    lengths = sorted(limits)

    @F.pandas_udf("boolean")
    def verdict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([judge(measure(x, lengths), limits, line_limit, symbol_limit)[1] for x in part], dtype=bool)
        release()

    return verdict(text)
