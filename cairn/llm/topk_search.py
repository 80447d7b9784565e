"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks of bounded size. In a block every dimension has a posting list
cut into segments by quantised value; the index is built once and written with its block. A query takes all segments of all dimensions by
descending impact (the largest contribution that the segment can make) and adds the
contributions to the accumulators of its members. A vector's score can't exceed its
accumulator plus, for each dimension not yet met, that dimension's next impact. The leaders
by this bound are rescored exactly, which sets a bar that k vectors are known to reach;
processing stops only once the bounds prove that few vectors can still reach the bar. Those
are rescored exactly with 64-bit integers, so the result is the exact top k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, pieces

SCALE = 1024
BLOCK_ROWS = 4096
QUERY_ROWS = 512
LEVELS = 16
#: Blocks in a group at most, where there are more than tasks.
GROUP_BLOCKS = 64
#: Shares of the segments after which the bounds are computed; past the last, all vectors are rescored.
CHECKPOINTS = (0.6, 0.7, 0.8, 0.92)
#: Components beyond this could overflow a 64-bit inner product; such blocks use Python integers.
WIDE = 1 << 24


class ImpactIndex:
    """The index of one block: ``ids`` and an integer matrix with one row for each vector.

    For each dimension it has the posting list ordered by value and cut into segments of equal
    width; ``low`` and ``high`` are a segment's least and largest value, ``level`` the segment
    of each vector.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS, lists: np.ndarray | None = None) -> None:
        """``lists``: the posting lists' places as ``build`` gave them, if they are known."""
        self.ids, self.rows = ids, rows
        n, width = rows.shape
        lists = self.build(rows) if lists is None else lists
        self.order = np.empty((width, n), dtype=np.intp)
        self.values = np.empty((width, n), dtype=np.int64)  # in the list's order
        self.first = np.zeros((width, levels + 1), dtype=np.int64)
        self.low = np.zeros((width, levels), dtype=np.int64)
        self.high = np.zeros((width, levels), dtype=np.int64)
        self.level = np.empty((width, n), dtype=np.intp)
        for d in range(width if rows.dtype != object else 0):
            order = lists[d].astype(np.intp)
            ranked = rows[order, d]
            step = (int(ranked[-1]) - int(ranked[0])) // levels + 1
            level = (ranked - ranked[0]) // step
            self.order[d], self.values[d] = order, ranked
            self.level[d, order] = level
            self.first[d] = np.searchsorted(level, np.arange(levels + 1))
            full = self.first[d, 1:] > self.first[d, :-1]
            self.low[d, full] = ranked[self.first[d, :-1][full]]
            self.high[d, full] = ranked[self.first[d, 1:][full] - 1]

    @staticmethod
    def build(rows: np.ndarray) -> np.ndarray:
        """For each dimension the vectors' places by value; none for components beyond 64 bits."""
        if rows.dtype == object or not len(rows):
            return np.zeros((0, len(rows)), dtype="<u4")
        return np.argsort(rows.T, axis=1, kind="stable").astype("<u4")

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Places of all vectors that can be among the k best for ``q``: a superset, by proof."""
        n, width = self.rows.shape
        if n <= 4 * k or self.rows.dtype == object or q.dtype == object:
            return np.arange(n)
        w = q[:, None]
        impact = np.maximum(w * self.low, w * self.high)
        full = (self.first[:, 1:] > self.first[:, :-1]) & (w != 0)
        dims, levels = np.nonzero(full)
        by_impact = np.argsort(-impact[dims, levels], kind="stable")
        dims, levels = dims[by_impact], levels[by_impact]
        used = np.flatnonzero(full.any(axis=1))
        met = np.zeros(full.shape, dtype=bool)
        score = np.zeros(n, dtype=np.int64)  # of the segments met
        at = 0
        for stop in CHECKPOINTS:
            until = int(len(dims) * stop)
            for d, s in zip(dims[at:until].tolist(), levels[at:until].tolist(), strict=True):
                i, j = self.first[d, s], self.first[d, s + 1]
                score[self.order[d, i:j]] += q[d] * self.values[d, i:j]
            met[dims[at:until], levels[at:until]] = True
            at = until
            # the largest impact that a dimension has left bounds all its vectors not met
            left = np.where(full & ~met, impact, np.iinfo(np.int64).min).max(axis=1)
            ahead = np.where(met, 0, left[:, None])
            high = score.copy()
            for d in used:
                high += ahead[d].take(self.level[d])
            probe = np.argpartition(high, n - 2 * k)[n - 2 * k :]
            bar = np.sort(self.rows[probe] @ q)[-k]  # k vectors are known to reach it
            possible = np.flatnonzero(high >= bar)
            if len(possible) <= max(8 * k, n // 16):
                return possible
        return np.arange(n)

    def search(self, q: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) for ``q`` among vectors with another id, ties to the smaller id."""
        own = int((self.ids == own_id).sum())  # these may fill places, so look for as many more
        at = self.candidates(q, k + own)
        at = at[self.ids[at] != own_id]
        if not len(at):
            return []
        if self.rows.dtype == object or q.dtype == object:
            score = np.array([min(max(sum(int(a) * int(b) for a, b in zip(self.rows[i], q, strict=True)), -(1 << 63)), (1 << 63) - 1) for i in at], dtype=np.int64)
        else:
            score = self.rows[at] @ q
        best = np.lexsort((self.ids[at], -score))[:k]
        return [(int(score[b]), int(self.ids[at[b]])) for b in best]


def quantise(vectors: list[list[float] | None], ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(1024 x) of the rows that take part, short vectors filled with zeros."""
    rows, kept = [], []
    for i, v in zip(ids, vectors, strict=True):
        if i is None or v is None or any(x is None for x in v):
            continue
        x = np.asarray(v, dtype=np.float64)
        if np.isfinite(x).all():
            rows.append(np.floor(x * SCALE))
            kept.append(i)
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return np.array(kept, dtype=np.int64), out


def _pack(out: np.ndarray) -> bytes:
    return np.ascontiguousarray(out, dtype="<f8" if len(out) and np.abs(out).max(initial=0) >= 1 << 15 else "<i2").tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not n or not width:
        return np.zeros((n, width), dtype=np.int64)
    if len(data) == 2 * n * width:
        return np.frombuffer(data, dtype="<i2").reshape(n, width).astype(np.int64)
    x = np.frombuffer(data, dtype="<f8").reshape(n, width)
    if np.abs(x).max() < WIDE:
        return x.astype(np.int64)
    return np.array([[int(y) for y in r] for r in x], dtype=object)


def topk_search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each row whose id is divisible by ``every``, its ``k`` best other rows.

    Result: ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (long), ties to the smaller id.
    Fewer rows come back if there are fewer candidates. Rows with a null id, a null vector or a
    null or non-finite component take no part; where lengths differ the shorter vector counts
    as filled with zeros. A repeated row is a candidate each time; rows with the query's own id
    are none. Equal query rows are asked once; where one id has several vectors, each is asked
    and the rank runs over all they find. An empty table gives an empty result; other columns are not read.

    Blocks of vectors are built and indexed from the scan's partitions, without a shuffle of
    single rows, and written. They are dealt to as many groups as there are tasks (a fixed number
    of blocks at most each); a block of queries goes once to each group, and only the k best of
    each pair of blocks come back.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    shape = "block long, n int, width int, ids binary, data binary, lists binary"

    def blocks_of(size: int, indexed: bool):
        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def emit() -> pa.RecordBatch:
                width = max(x.shape[1] for _, x in held)
                ids = np.concatenate([i for i, _ in held])
                rows = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in held])
                held.clear()
                name = xxhash.xxh3_64_intdigest(ids.tobytes() + rows.tobytes()) - (1 << 63)  # the same whenever it is built again
                packed = _pack(rows)
                lists = ImpactIndex.build(_unpack(packed, len(ids), width)).tobytes() if indexed else b""
                columns = [pa.array([name]), pa.array([len(ids)], pa.int32()), pa.array([width], pa.int32()), *(pa.array([x]) for x in (ids.astype("<i8").tobytes(), packed, lists))]
                return pa.RecordBatch.from_arrays(columns, ["block", "n", "width", "ids", "data", "lists"])

            for batch in pieces(batches, min(size, 2048)):
                ids, rows = quantise(batch.column(1).to_pylist(), batch.column(0).to_pylist())
                if len(ids):
                    held.append((ids, rows))
                if sum(len(i) for i, _ in held) >= size:
                    yield emit()
            if held:
                yield emit()

        return build

    spark = vectors.sparkSession
    base = Scratch(spark, "topk").save(source.mapInArrow(blocks_of(block_rows, True), shape))
    n_blocks = base.count()
    groups = max(1, min(n_blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // GROUP_BLOCKS))))
    group = F.pmod(F.col("block"), F.lit(groups)).cast("int")
    asked = source.where(F.col("id") % every == 0).distinct().mapInArrow(blocks_of(query_rows, False), shape)
    queries = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("n", "width", "ids", "data")), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("to"))
    dealt = base.withColumn("group", group).repartition(groups, "group")
    pairs = dealt.join(queries.repartition(groups, "to").hint("shuffle_merge"), F.col("group") == F.col("to")).select("block", "n", "width", "ids", "data", "lists", "q_n", "q_width", "q_ids", "q_data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if last != r["block"]:
                    lists = np.frombuffer(r["lists"], dtype="<u4").reshape(-1, r["n"])
                    index = ImpactIndex(np.frombuffer(r["ids"], dtype="<i8"), _unpack(r["data"], r["n"], r["width"]), lists=lists)
                    last = r["block"]
                q_ids, q = np.frombuffer(r["q_ids"], dtype="<i8"), _unpack(r["q_data"], r["q_n"], r["q_width"])
                width = index.rows.shape[1]
                q = q[:, :width] if q.shape[1] >= width else np.pad(q, ((0, 0), (0, width - q.shape[1])))
                for one, vector in zip(q_ids.tolist(), q, strict=True):
                    out += [(one, i, s) for s, i in index.search(vector, one, k)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
