"""Language-model scoring by prediction by partial matching (PPM).

A byte-context trie of order ``ORDER`` is counted over all training texts, and every node stays.
A byte is coded in the longest context that the trie holds; if it was not seen there, the code
escapes to the next shorter context, in which the bytes just ruled out are excluded, down to a
uniform order -1. Escape is estimated by method D: each distinct byte of a context gives half an
occurrence to the escape.

A byte's code length depends on itself and the ORDER bytes before it only. Chunks of documents,
of so many bytes of text that rows between chunks and buckets stay large enough (their number
grows with the input, not its square), send their distinct strings of ORDER + 1 bytes with training counts to buckets by the last
LOW + 1 bytes of the context, so that a bucket holds all of each context longer than LOW; it
sends each chunk its own strings' code lengths back. Orders up to LOW have 2 ** 24 possible
nodes at any input size; they are counted first and broadcast whole.

A text is coded as its lower-cased words with one space between and one end mark, so the score
is the probability of the same tokens that the word baseline scores. The baseline needs every
word's count over all training texts: these go the same way, by the words' hashes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, fold, pieces, release, released
from ._text import mix, words_of

ORDER = 5
LOW = 2  # longest context that is broadcast
#: Bytes of text in a chunk, about: the least, and the most that a chunk grows to on large inputs.
CHUNK_BYTES = (12 << 20, 192 << 20)
#: A small input is dealt to all tasks, but not in chunks below this.
SPREAD_BYTES = 1 << 20
#: Bytes of a row between a chunk and a bucket, about, and packed bytes for each byte of text.
ROW_BYTES, PACKED = 4096, 2.4
TAKEN = 0.5  # of each distinct byte's count, for the escape
END = b"\n"  # no word holds one

_U = np.uint64
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def coded(words: list[bytes]) -> bytes:
    """The byte string that the model codes."""
    return b" ".join(words) + END


def context_keys(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte, the key of it and the ``order`` bytes before; ``data`` starts with ORDER marks."""
    n = len(data) - ORDER
    out = np.zeros(n, dtype=np.uint64)
    for j in range(order, -1, -1):
        out = (out << _U(8)) | data[ORDER - j : ORDER - j + n]
    return out


class HashTable:
    """From 64-bit keys to their places 0..n-1, by open addressing in numpy."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(8, (4 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, _NONE, dtype=np.uint64)
        self.places = np.full(size, -1, dtype=np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot] == _NONE
            _, winner = np.unique(np.where(free, slot, -1), return_index=True)
            winner = winner[free[winner]]
            self.keys[slot[winner]] = keys[todo[winner]]
            self.places[slot[winner]] = todo[winner]
            rest = np.ones(len(todo), dtype=bool)
            rest[winner] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self._slot(keys)
        got = self.keys[slot]
        out = self.places[slot]
        out[got != keys] = -1
        open_ = np.flatnonzero((got != keys) & (got != _NONE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.places[slot[open_[hit]]]
            open_ = open_[~hit & (got != _NONE)]
        return out


@dataclass
class Trie:
    """Nodes by order: sorted keys (context and byte) with their training counts."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]
    total: int


class PpmScorer:
    """Code lengths under a trained trie; all tables are arrays, and bytes are scored in batches.

    ``low`` is a scorer of the orders below those of ``trie``, if these are held apart.
    """

    def __init__(self, trie: Trie, low: PpmScorer | None = None) -> None:
        self.nodes = [*(low.nodes if low else []), *map(HashTable, trie.keys)]
        self.counts = [*(low.counts if low else []), *(c.astype(np.float64) for c in trie.counts)]
        self.contexts: list[HashTable] = [*low.contexts] if low else []
        self.hit: list[np.ndarray] = [*low.hit] if low else []  # by node: log2 probability in a context with nothing excluded
        self.escape: list[np.ndarray] = [*low.escape] if low else []  # by context: the same for the escape
        self.below: list[np.ndarray] = [*low.below] if low else []  # by context: weight left in the next shorter one after exclusion
        self.escape_below: list[np.ndarray] = [*low.escape_below] if low else []  # and its share that escapes further
        self.held: list[tuple[np.ndarray, np.ndarray]] = [*low.held] if low else []  # by context: occurrences and distinct bytes
        for k, keys in enumerate(trie.keys, len(self.contexts)):
            n, ctx = self.counts[k], keys >> _U(8)
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(keys) else np.zeros(0, np.int64)
            names = ctx[first]
            full = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            distinct = np.diff(np.append(first, len(keys))).astype(np.float64)
            self.contexts.append(HashTable(names))
            of = np.repeat(np.arange(len(first)), distinct.astype(np.int64))
            self.hit.append(np.log2((n - TAKEN) / full[of]) if len(keys) else np.zeros(0))
            self.escape.append(np.log2(TAKEN * distinct / full) if len(first) else np.zeros(0))
            if k:
                at = self.nodes[k - 1].find(keys & _U((1 << (8 * k)) - 1))
                ruled_out = np.add.reduceat(self.counts[k - 1][at], first) if len(first) else np.zeros(0)
                short = self.contexts[k - 1].find(names & _U((1 << (8 * (k - 1))) - 1) if k > 1 else np.zeros(len(names), np.uint64))
                f, d = (x[short] for x in self.held[-1])
                self.below.append(np.maximum(0.0, f - ruled_out))
                self.escape_below.append(TAKEN * np.maximum(0.0, d - distinct))
            else:
                self.below.append(256.0 - distinct)
                self.escape_below.append(np.zeros(len(first)))
            self.held.append((full, distinct))
        self.order = len(self.contexts) - 1

    def log2(self, data: np.ndarray) -> np.ndarray:
        """log2 probability of each byte of ``data`` after its first ORDER bytes."""
        return self.log2_keys(context_keys(data, self.order))

    def log2_keys(self, strings: np.ndarray) -> np.ndarray:
        """log2 probability of the last byte of each key after the others."""
        n = len(strings)
        out = np.zeros(n)
        left = np.arange(n)
        came = np.full(n, -1, dtype=np.int64)  # the longer context just escaped from, by its place
        for k in range(self.order, -1, -1):
            keys = strings[left] & _U((1 << (8 * (k + 1))) - 1)
            node = self.nodes[k].find(keys)
            found = node >= 0
            fresh = came < 0
            easy = found & fresh
            out[left[easy]] += self.hit[k][node[easy]]
            again = np.flatnonzero(found & ~fresh)
            if len(again):
                count = self.counts[k][node[again]]
                out[left[again]] += np.log2((count - TAKEN) / np.maximum(self.below[k + 1][came[again]], count))
            missed = np.flatnonzero(~found)
            ctx = self.contexts[k].find(keys[missed] >> _U(8))
            known = ctx >= 0
            at = missed[known]
            first = at[fresh[at]]
            out[left[first]] += self.escape[k][ctx[known][fresh[at]]]
            later = at[~fresh[at]]
            if len(later):
                below, away = self.below[k + 1][came[later]], self.escape_below[k + 1][came[later]]
                out[left[later]] += np.where(below > 0, np.log2(np.maximum(away, 1e-9) / np.maximum(below, 1e-9)), 0.0)
            left, came = left[missed], np.where(known, ctx, -1)
        if len(left):
            room = np.where(came >= 0, self.below[0][came] if len(self.below[0]) else 256.0, 256.0)
            out[left] -= np.log2(np.maximum(1.0, room))
        return out


def score_texts(texts: list[list[bytes]], log2_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """log10 probability of each text, given by its words; ``log2_of`` gives it for each key of order ORDER."""
    parts = [END * ORDER + coded(w) for w in texts]
    out = np.zeros(len(parts))
    k = 0
    while k < len(parts):  # about a megabyte at a time
        end, size = k, 0
        while end < len(parts) and (end == k or size + len(parts[end]) < 1 << 20):
            size += len(parts[end])
            end += 1
        data = np.frombuffer(b"".join(parts[k:end]), dtype=np.uint8)
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts[k:end]])])
        own = _own(first, len(data))  # the marks before each text aren't coded
        bits = np.zeros(len(data))
        bits[own] = log2_of(context_keys(data, ORDER)[own[ORDER:]])
        sums = np.concatenate([[0.0], np.cumsum(bits)])
        out[k:end] = (sums[first[1:]] - sums[first[:-1]]) * math.log10(2)
        k = end
    return out


def _own(first: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` bytes are coded: not the ORDER marks from each place in ``first[:-1]``."""
    own = np.ones(n, dtype=bool)
    for j in range(ORDER):
        own[first[:-1] + j] = False
    return own


def _add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(first) else c)


def count_strings(texts: Iterator[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of ``order`` with their counts, a few megabytes at a time."""
    held_k: list[np.ndarray] = [np.zeros(0, np.uint64)]
    held_c: list[np.ndarray] = [np.zeros(0, np.int64)]
    parts: list[bytes] = []
    size = 0

    def take() -> None:
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        keys = context_keys(data, order)[_own(first, len(data))[ORDER:]]
        keys.sort()
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        held_k.append(keys[cut])
        held_c.append(np.diff(np.append(cut, len(keys))))
        if len(held_k) >= 8:
            k, c = _add_up(held_k, held_c)
            held_k[:], held_c[:] = [k], [c]

    for text in texts:
        parts.append(END * ORDER + coded(words_of(text)))
        size += len(parts[-1])
        if size >= 1 << 22:
            take()
            parts, size = [], 0
    if parts:
        take()
    return _add_up(held_k, held_c)


def fit_low(training: DataFrame, text_col: str = "text") -> Trie:
    """Every node of orders 0 to LOW over all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = count_strings((text for batch in pieces(batches) for text in batch.column(0).to_pylist()), LOW)
        for k in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)].astype(np.int64)), pa.array(counts[k : k + (1 << 16)])], ["key", "n"])

    got = training.select(text_col).mapInArrow(released(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    level = _add_up([got.column("key").to_numpy().astype(np.uint64)], [got.column("n").to_numpy()])
    levels = [level]
    for k in range(LOW - 1, -1, -1):
        level = _add_up([level[0] & _U((1 << (8 * (k + 1))) - 1)], [level[1]])
        levels.insert(0, level)
    return Trie([k for k, _ in levels], [c for _, c in levels], int(level[1].sum()))


def code_lengths(keys: np.ndarray, counts: np.ndarray, low: PpmScorer, total: int) -> np.ndarray:
    """log2 of each key of order ORDER; the keys hold all of each context longer than LOW that they touch."""
    at = counts > 0
    levels = [(keys[at], counts[at])]
    for k in range(ORDER - 1, LOW, -1):
        levels.insert(0, _add_up([levels[0][0] & _U((1 << (8 * (k + 1))) - 1)], [levels[0][1]]))
    return PpmScorer(Trie([k for k, _ in levels], [c for _, c in levels], total), low).log2_keys(keys)


def pack(x: np.ndarray) -> bytes:
    """The bytes of 64-bit values, the first byte of each value first: they compress better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(dtype)


def _cuts(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket that keeps the order within, and where each bucket begins in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


@lru_cache(maxsize=1)
def _low_scorer(fit: str) -> PpmScorer:
    """The scorer of the broadcast orders of one fit; a worker builds it once, not once a task."""
    return PpmScorer(_low[fit].value)


_low: dict[str, Broadcast] = {}


def low_scorer(fit: str, shared: Broadcast) -> PpmScorer:
    """This module's own function, so that task functions share its memory of the last fit."""
    if fit not in _low:
        _low.clear()
        _low[fit] = shared
    return _low_scorer(fit)


def layout(total_bytes: int, least: int) -> tuple[int, int]:
    """Chunks and buckets for so many bytes of text and ``least`` tasks."""
    size = min(CHUNK_BYTES[1], max(CHUNK_BYTES[0], int(math.sqrt(total_bytes * ROW_BYTES / PACKED))))
    chunks = max(1, -(-total_bytes // size), min(least, -(-total_bytes // SPREAD_BYTES)))
    buckets = min(max(least, chunks), max(least, int(size * PACKED / ROW_BYTES)))
    return chunks, buckets


def in_order(docs: DataFrame) -> bool:
    """Whether reading ``docs`` again yields the same rows in the same order: a plain scan of files does."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    kinds = {m for line in plan.splitlines() for m in re.findall(r"^[\s:+\-]*([A-Z]\w+)", line)}
    return "Relation" in plan and kinds <= {"Project", "Filter", "Relation"}


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


_END_HASH = xxhash.xxh3_64_intdigest(END)


def lm_scores(docs: DataFrame, folds: int = 5, held_fold: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Word baseline and PPM score of every whole text, learned outside the held-out fold.

    Result: ``doc_id``, ``held_out`` boolean, ``n_tokens`` (words and one end), ``n_known``,
    ``train_tokens`` (long), ``base_score`` and ``score`` (log10 probabilities, double). Null
    texts count as empty: one end token. Without training rows the baseline has N = V = 0 and
    the model is uniform. Repeated rows and null ids come back as they are and are counted as
    often as they stand; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = fold(F.col(id_col), folds) == held_fold
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    work = Scratch(spark, "lm_work")
    if not in_order(docs):  # a lost task made anew could deal its rows out differently
        rows = work.save(rows)
    total_bytes = rows.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1), F.lit(0)).alias("n")).first()["n"]
    chunks, buckets = layout(total_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(fit_low(rows.where(~F.col("held_out"))))
    fitted = scratch.root

    # equal rows are spread by a counter within their partition, so that copies don't meet in one chunk
    spread = F.pmod(F.xxhash64("id", F.length("text"), F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    dealt = rows.withColumn("chunk", spread)  # both uses below read the same exchange of the texts

    def own_entries(table: pa.Table) -> pa.Table:
        train: Counter[bytes] = Counter()
        every: set[bytes] = set()
        ends = 0
        for out, text in zip(table.column("held_out").to_pylist(), table.column("text").to_pylist(), strict=True):
            words = words_of(text)
            if out:
                every.update(words)
            else:
                train.update(words)
                ends += 1
        listed = [*train, *(w for w in every if w not in train)]
        keys = np.append(_hashes(listed), _U(_END_HASH))
        counts = np.append(np.fromiter((train.get(w, 0) for w in listed), dtype=np.int64, count=len(listed)), ends)
        keys, counts = _add_up([keys], [counts])
        order, cut = _cuts(keys % _U(buckets), buckets)
        keys, counts = keys[order], counts[order]
        out = table.column("held_out").to_numpy()
        texts = table.column("text")
        strings, seen = count_strings(iter(texts.filter(pa.array(~out)).to_pylist()), ORDER)
        more, none = count_strings(iter(texts.filter(pa.array(out)).to_pylist()), ORDER)
        strings, seen = _add_up([strings, more], [seen, none * 0])
        order, cut_s = _cuts(mix((strings >> _U(8)) & _U((1 << (8 * (LOW + 1))) - 1)) % _U(buckets), buckets)
        strings, seen = strings[order], seen[order]
        del train, every, listed, texts
        release()
        full = [b for b in range(buckets) if cut[b] < cut[b + 1] or cut_s[b] < cut_s[b + 1]]
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "chunk": pa.array([table.column("chunk")[0].as_py()] * len(full), pa.int32()),
                "keys": pa.array([keys[cut[b] : cut[b + 1]].astype("<u8").tobytes() for b in full], pa.binary()),
                "counts": pa.array([counts[cut[b] : cut[b + 1]].astype("<i4").tobytes() for b in full], pa.binary()),
                "strings": pa.array([pack(strings[cut_s[b] : cut_s[b + 1]].astype("<u8")) for b in full], pa.binary()),
                "seen": pa.array([pack(seen[cut_s[b] : cut_s[b + 1]].astype("<i8")) for b in full], pa.binary()),
            }
        )

    def add_entries(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        counts = [np.frombuffer(x, "<i4").astype(np.int64) for x in table.column("counts").to_pylist()]
        all_keys, all_counts = _add_up(keys, counts)
        back = [all_counts[np.searchsorted(all_keys, k)] for k in keys]
        n = len(keys)  # the bucket's own totals stand on its first row
        strings = [unpack(x, "<u8") for x in table.column("strings").to_pylist()]
        all_strings, all_seen = _add_up(strings, [unpack(x, "<i8") for x in table.column("seen").to_pylist()])
        bits = code_lengths(all_strings, all_seen, low_scorer(fitted, shared), shared.value.total)
        return pa.table(
            {
                "chunk": table.column("chunk").cast(pa.int32()),
                "keys": table.column("keys"),
                "counts": pa.array([b.astype("<i8").tobytes() for b in back], pa.binary()),
                "strings": table.column("strings"),
                "bits": pa.array([pack(bits[np.searchsorted(all_strings, k)].astype("<f8")) for k in strings], pa.binary()),
                "tokens": pa.array([int(all_counts.sum())] + [0] * (n - 1), pa.int64()),
                "distinct": pa.array([int((all_counts > 0).sum())] + [0] * (n - 1), pa.int64()),
            }
        )

    sent = dealt.groupBy("chunk").applyInArrow(own_entries, "bucket int, chunk int, keys binary, counts binary, strings binary, seen binary")
    told = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(add_entries, "chunk int, keys binary, counts binary, strings binary, bits binary, tokens long, distinct long")
    names = ["id", "held_out", "n_tokens", "n_known", "base_sum", "score", "tokens", "distinct"]

    def score(mine: pa.Table, told: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in told.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<i8") for x in told.column("counts").to_pylist()])
        count_of = dict(zip(keys.tolist(), counts.tolist(), strict=True))
        NEW = math.log10(0.5)

        class Logs(dict):
            def __missing__(self, word: bytes) -> float:
                c = count_of[xxhash.xxh3_64_intdigest(word)]
                value = self[word] = math.log10(c + 0.5) if c else NEW
                return value

        logs = Logs()
        places = HashTable(np.concatenate([unpack(x, "<u8") for x in told.column("strings").to_pylist()]))
        bits = np.concatenate([unpack(x, "<f8") for x in told.column("bits").to_pylist()])
        end_log = logs[END]
        tokens, known, base, model = [], [], [], []
        column = mine.column("text")
        for k in range(0, mine.num_rows, 512):
            texts = [words_of(x) for x in column.slice(k, 512).to_pylist()]
            model.append(score_texts(texts, lambda strings: bits[places.find(strings)]))
            for words in texts:
                got = np.fromiter(map(logs.__getitem__, words), dtype=np.float64, count=len(words))
                tokens.append(len(words) + 1)
                known.append(int((got != NEW).sum()) + (end_log != NEW))
                base.append(float(got.sum()) + end_log)
        del places, bits, count_of, logs
        release()
        rest = [0] * (mine.num_rows - 1)
        columns = [
            mine.column("id"),
            mine.column("held_out"),
            pa.array(tokens, pa.int64()),
            pa.array(known, pa.int64()),
            pa.array(base, pa.float64()),
            pa.array(np.concatenate(model), pa.float64()),
            pa.array([sum(told.column("tokens").to_pylist()), *rest], pa.int64()),
            pa.array([sum(told.column("distinct").to_pylist()), *rest], pa.int64()),
        ]
        return pa.table(dict(zip(names, columns, strict=True)))

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_sum double, score double, tokens long, distinct long"
    scored = scratch.save(dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, schema))
    work.drop()
    shared.unpersist()
    sums = scored.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    low = math.log10(sums["n"] + 0.5 * (sums["v"] + 1))
    base = (F.col("base_sum") - F.col("n_tokens") * F.lit(low)).alias("base_score")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(sums["n"]).cast("long").alias("train_tokens"), base, "score")
