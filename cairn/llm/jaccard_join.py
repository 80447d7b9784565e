"""Exact Jaccard self-join on word shingles, with set-relation skipping.

1. Every text becomes a set of shingle hashes; equal sets are one node from here on.
2. Global index by position: the hash range is cut into so many positions that two sets similar
   enough must agree in at least one whole position (a pigeonhole bound on their difference, in
   groups of sets of like size). Positions filled only by shingles that are common in the corpus
   (a shared passage) count as blank, of which the bound allows some. A list holds the nodes with the same content at the same
   position, so blocks of sets that can't match are never read together. Nodes on one list,
   and only those, can be linked; their connected components are families.
3. Within a family, in blocks of bounded size, an inverted index with lists sorted by set size
   yields exact overlaps: prefix lists are entered at the first set large enough and left at
   positions too late for the bound (index-level skipping), and a set's overlaps with all others
   are derived from those of a highly similar set by adding and subtracting only the lists of
   the shingles in which they differ (answer-level skipping). Every matching pair is counted.
4. One link for each merge goes on to be joined to components; copies take their node's.

Nothing is capped: a family beyond one block is split into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, pieces, release, released
from ._text import WordHasher, mix, shingles, words_of
from .components import connected_components, stars

#: Sets in one block of a family, and shingles. Each block meets all of its family: a sixteenth of
#: the family makes a block, so that no set is copied more often, but within these bounds.
BLOCK_SETS, MOST_SETS = 1024, 8192
BLOCK_SHINGLES = 2_000_000
#: Answers of a block that are kept to derive others from.
ANSWERS = 128
#: Entries of the index that one task of the second step reads, about.
INDEX_ENTRIES = 1_000_000
#: And entries that a task of the first step sorts at once, about.
SENT_ENTRIES = 600_000
#: Cells of the filter that says which nodes are in families: a bitmap of 16 cells a node, within bounds.
FILTER_BITS = (20, 28)

#: A shingle is common if COMMON_DOCS texts of about COMMON_SHINGLES shingles hold it. The cells
#: of common shingles, by their first bits, form a bounded bitmap.
COMMON_DOCS = 5
COMMON_SHINGLES = 2_000_000
COMMON_BITS = 26

_U = np.uint64
_POSITION, _GROUP, _EMPTY = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xC13FA9A902A6328F)


class SizeGroups:
    """Size classes for a threshold num / den: sets that can match are in the same or the next class."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.starts = [1]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def positions(self, group: int) -> tuple[int, int]:
        """(largest difference of a matching pair in the group, number of positions)."""
        self.of(1)
        while len(self.starts) < group + 2:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        small = self.starts[group + 1] - 1
        most = (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        return most, most + 2 + most // 4


def index_keys(s: np.ndarray, groups: SizeGroups, common: np.ndarray | None = None) -> np.ndarray:
    """The keys of a set's lists: one for each position of its two size groups.

    Two matching sets differ in at most ``most`` shingles, so at least (positions - most) of the
    positions hold the same content in both. A position is blank if it holds no shingle but
    ``common`` ones (a mask over ``s`` that depends on the shingle alone). A set with fewer
    blank positions than that shares one that isn't; only sets with more list blank ones too.
    """
    own = groups.of(len(s))
    out = []
    for g in (own - 1, own) if own else (own,):
        most, m = groups.positions(g)
        at = ((s >> _U(32)) * _U(m)) >> _U(32)  # rises with the hash, so positions are runs of s
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        content = np.add.reduceat(mix(s ^ _GROUP), first)
        salt = _U((g + 1) * int(_GROUP) % (1 << 64))
        keys = mix(content + at[first] * _POSITION + salt)
        plain = np.ones(len(first), dtype=bool) if common is None else ~np.logical_and.reduceat(common, first)
        if plain.sum() > most:
            out.append(keys[plain])
        else:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at[first])
            out += [keys, mix((empty * _POSITION + salt) ^ _EMPTY)]
    return np.concatenate(out)


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def matches(overlap: int, a: int, b: int, num: int, den: int) -> bool:
    return den * overlap >= num * (a + b - overlap)


class RelationJoin:
    """Exact links among the sets of one block, or between two blocks."""

    def __init__(self, sets: Sequence[np.ndarray], num: int, den: int, side: Sequence[int] | None = None) -> None:
        self.num, self.den = num, den
        by_size = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
        self.original = by_size
        self.sizes = np.array([len(sets[i]) for i in by_size], dtype=np.int64)
        self.side = None if side is None else np.array([side[i] for i in by_size])
        flat = np.concatenate([sets[i] for i in by_size])
        _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
        rare_first = np.empty(len(count), dtype=np.int64)
        rare_first[np.argsort(count, kind="stable")] = np.arange(len(count))
        rank = rare_first[token]
        edges = np.concatenate([[0], np.cumsum(self.sizes)])
        self.sets = [np.sort(rank[edges[i] : edges[i + 1]]) for i in range(len(by_size))]
        owner = np.repeat(np.arange(len(by_size)), self.sizes)
        order = np.argsort(rank, kind="stable")  # within a token by set, so by size
        self.list_first = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(count)))])
        self.list_sets = owner[order]
        where = np.concatenate(self.sets)
        place = np.concatenate([np.arange(len(x)) for x in self.sets])
        self.list_place = place[np.argsort(where, kind="stable")]
        self.prefix = self.sizes - (self.sizes * num + den - 1) // den + 1
        self.answers: dict[int, np.ndarray] = {}

    def members(self, token: int) -> np.ndarray:
        return self.list_sets[self.list_first[token] : self.list_first[token + 1]]

    def overlaps(self, i: int, near: int | None) -> np.ndarray:
        """Overlap of set i with every set, derived from those of set ``near`` if that is known."""
        if near is not None and (base := self.answers.get(near)) is not None:
            mine, theirs = self.sets[i], self.sets[near]
            more, less = np.setdiff1d(mine, theirs, assume_unique=True), np.setdiff1d(theirs, mine, assume_unique=True)
            if len(more) + len(less) < len(mine) // 2:
                out = base.copy()
                for t in more:
                    out[self.members(t)] += 1
                for t in less:
                    out[self.members(t)] -= 1
                return out
        tokens = self.sets[i]
        lists = [self.list_sets[a:b] for a, b in zip(self.list_first[tokens], self.list_first[tokens + 1], strict=True)]
        return np.bincount(np.concatenate(lists), minlength=len(self.sets)).astype(np.int32)

    def links(self, copies: Sequence[int]) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Pairs (indexes of the given sets) that suffice for the components of all matching pairs,
        and for each set how many copies the sets have that match it; a set has ``copies``."""
        n, found = len(self.sets), []
        weight = np.array([copies[i] for i in self.original], dtype=np.int64)
        count = np.zeros(n, dtype=np.int64)
        label = np.arange(n)
        for i in range(n):
            size = int(self.sizes[i])
            lowest = int(np.searchsorted(self.sizes, -(-self.num * size // self.den)))
            seen = []
            for p, t in enumerate(self.sets[i][: self.prefix[i]].tolist()):
                a, b = self.list_first[t], self.list_first[t + 1]
                if b - a < 2:
                    continue
                ids = self.list_sets[a:b]
                lo, hi = np.searchsorted(ids, lowest), np.searchsorted(ids, i)  # skip the blocks of sets too small
                if lo == hi:
                    continue
                ids, places = ids[lo:hi], self.list_place[a + lo : a + hi]
                room = 1 + np.minimum(size - p - 1, self.sizes[ids] - places - 1)  # what can still be shared from here on
                need = -(-self.num * (size + self.sizes[ids]) // (self.num + self.den))
                seen.append(ids[room + np.minimum(p, places) >= need])
            if not seen:
                continue
            met = np.bincount(np.concatenate(seen), minlength=i)
            asked = np.flatnonzero(met)
            if self.side is not None:
                asked = asked[self.side[asked] != self.side[i]]
            if not len(asked):
                continue
            near = max((j for j in self.answers if j < i and met[j]), key=lambda j: (met[j], j), default=None)
            if len(asked) <= 2 and near is None:
                shared = np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in asked])
            else:
                answer = self.overlaps(i, near)
                self.answers[i] = answer
                if len(self.answers) > ANSWERS:
                    del self.answers[next(iter(self.answers))]
                shared = answer[asked].astype(np.int64)
            hit = asked[self.den * shared >= self.num * (size + self.sizes[asked] - shared)]
            if not len(hit):
                continue
            count[i] += weight[hit].sum()
            count[hit] += weight[i]
            labels, at = np.unique(label[hit], return_index=True)
            for old, j in zip(labels.tolist(), hit[at].tolist(), strict=True):
                if old != label[i]:
                    found.append((self.original[i], self.original[j]))
                    label[label == old] = label[i]
        out = np.zeros(n, dtype=np.int64)
        out[self.original] = count
        return found, out


def _solve(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links and counts of one group: many whole families, or one pair of blocks of a large one.

    Rows with ``a`` other than ``b`` are links; a row with both alike has that set's ``n``.
    """
    nodes, family, block, copies = (table.column(c).to_numpy() for c in ("node", "family", "block", "copies"))
    data = table.column("shingles").to_pylist()
    bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
    order = np.lexsort((nodes, family))
    a: list[int] = []
    b: list[int] = []
    n: list[int] = []
    k = 0
    while k < len(order):
        end = k
        while end < len(order) and family[order[end]] == family[order[k]]:
            end += 1
        rows = [i for p, i in enumerate(order[k:end]) if p == 0 or nodes[i] != nodes[order[k + p - 1]]]  # copies from several tasks
        k = end
        if len(rows) < 2:
            continue
        sets = [np.frombuffer(data[i], dtype="<u8") for i in rows]
        links, counts = RelationJoin(sets, num, den, [int(block[i]) for i in rows] if bi != bj else None).links([int(copies[i]) for i in rows])
        own = np.flatnonzero(counts)
        a += [int(nodes[rows[x]]) for x, _ in links] + [int(nodes[rows[x]]) for x in own]
        b += [int(nodes[rows[y]]) for _, y in links] + [int(nodes[rows[x]]) for x in own]
        n += [0] * len(links) + counts[own].tolist()
    del data, table
    release()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def bits_for(n: int) -> int:
    """The size of a filter of ``n`` nodes, as a power of 2."""
    return min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * n).bit_length()))


def _bitmap(cells: DataFrame, bits: int) -> bytes:
    """A bitmap of 2 ** ``bits`` with the values of the only column set, put together by the executors."""
    x = F.col(cells.columns[0]) + 1
    rows = cells.groupBy(F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("b")).collect()  # 2 ** bits / 8 bytes at most
    out = np.zeros(max(4096, (1 << bits) // 8), dtype=np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["b"], dtype=np.uint8)
    return out.tobytes()


def _is_set(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[(cells >> _U(3)).astype(np.int64)] >> (cells & _U(7)).astype(np.uint8)) & np.uint8(1) > 0


def perhaps_among(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test of a hash against the ``n`` ones in the only column of a table, by a bitmap of bounded
    size: true for each of them and for a few others, so that only such rows need an exact join."""
    bits = bits_for(n)
    cell = lambda c: F.pmod(c, F.lit(1 << bits))
    shared = hashes.sparkSession.sparkContext.broadcast(_bitmap(hashes.select(cell(F.col(hashes.columns[0])).alias("cell")), bits))

    @F.pandas_udf("boolean")
    def among(cells: pd.Series) -> pd.Series:
        return pd.Series(_is_set(np.frombuffer(shared.value, dtype=np.uint8), cells.to_numpy().astype(np.uint64)))

    return lambda c: among(cell(c))


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Components of the documents under links with 100% exact Jaccard >= num / den on k-word shingles.

    Result: ``doc_id``, ``n_shingles`` (long, the set's size), ``component_id``, the smallest id
    reachable by links, its own included, and ``n_links`` (long), the other rows linked with it. Texts with fewer than k words are one shingle. Null,
    empty and blank texts have no shingles and are linked with nothing; their component is their
    own id. A null id takes part, but is no component's smallest unless all are null. Rows with
    the same id stay apart rows. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch, work = Scratch(spark, "jaccard"), Scratch(spark, "jaccard_work")  # what the result reads, and the rest
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held: list[np.ndarray] = []
        size = 0
        id_kind = None

        def common() -> pa.RecordBatch:
            flat = np.sort(np.concatenate(held))
            held.clear()
            cut = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            often = flat[cut[np.diff(np.append(cut, len(flat))) >= COMMON_DOCS]]
            cells = np.unique(often >> _U(64 - COMMON_BITS)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.nulls(len(cells), id_kind), pa.array(cells), pa.array(np.full(len(cells), -1))], ["id", "node", "n"])

        for batch in pieces(batches):
            sets = [shingles(words_of(x), k, hasher) for x in batch.column(1).to_pylist()]
            id_kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["id", "node", "n"])
            held += [s for s in sets if len(s)]
            size += sum(map(len, sets))
            if size >= COMMON_SHINGLES:
                yield common()
                size = 0
        if held:
            yield common()

    measured = scratch.save(texts.mapInArrow(released(measure), f"id {id_type}, node long, n long"))
    rows = measured.where("n >= 0")
    frequent = spark.sparkContext.broadcast(_bitmap(measured.where("n < 0").select("node"), COMMON_BITS))  # 8 MB
    nodes = work.save(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least_id"), F.first("n").alias("n"), F.count("*").alias("copies")))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 2.5 * (den - num) / num / INDEX_ENTRIES) + 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, groups = WordHasher(), SizeGroups(num, den)
        bits = np.frombuffer(frequent.value, dtype=np.uint8)
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            key, owner = np.concatenate(keys), np.concatenate(owners)
            keys.clear()
            owners.clear()
            seen.clear()
            part = (key >> _U(40)) % _U(parts)
            order = np.lexsort((owner, key, part))
            key, owner, part = key[order], owner[order], part[order]
            # nodes of this task that share a list are joined here, so that a list gets one row from each task
            first = np.concatenate([[True], key[1:] != key[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            own = np.flatnonzero(~first & (owner != owner[head]))
            edges = np.unique(np.stack([owner[own], owner[head[own]]], axis=1), axis=0) if len(own) else np.zeros((0, 2), np.int64)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array([int(edges[0, 0] % parts)], pa.int32()), pa.nulls(1, pa.binary()), pa.array([edges.astype("<i8").tobytes()], pa.binary())], ["part", "keys", "nodes"])
            key, owner, part = key[first], owner[first], part[first]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([key[a:b].astype("<u8").tobytes()], pa.binary()), pa.array([owner[a:b].astype("<i8").tobytes()], pa.binary())], ["part", "keys", "nodes"])

        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                s = shingles(words_of(text), k, hasher)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                got = index_keys(s, groups, _is_set(bits, s >> _U(64 - COMMON_BITS)))
                keys.append(got)
                owners.append(np.full(len(got), node, dtype=np.int64))
                held += len(got)
            if held >= SENT_ENTRIES:
                yield from emit()
                held = 0
        if held:
            yield from emit()

    def read_lists(table: pa.Table) -> pa.Table:
        keys, owners, edges = [], [], []
        for x, y in zip(table.column("keys").to_pylist(), table.column("nodes").to_pylist(), strict=True):
            if x is None:
                edges.append(np.frombuffer(y, dtype="<i8").reshape(-1, 2))
            else:
                keys.append(np.frombuffer(x, dtype="<u8"))
                owners.append(np.frombuffer(y, dtype="<i8"))
        if keys:
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            rest = np.flatnonzero(~first & (owner != owner[head]))
            edges.append(np.stack([owner[rest], owner[head[rest]]], axis=1))
            keys, owners = [], []
        out = np.concatenate(edges) if edges else np.zeros((0, 2), dtype=np.int64)
        x, y = stars(out[:, 0], out[:, 1])
        release()
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    lists = texts.select("text").mapInArrow(released(index), "part int, keys binary, nodes binary")
    shared = lists.repartition(parts, "part").groupBy("part").applyInArrow(read_lists, "a long, b long")
    families = work.save(connected_components(shared, work, contracted=True))
    work.free()  # the index, twice the input

    members = work.save(families.join(nodes, "node").select("node", F.col("root").alias("family"), "n", "copies"))
    spans = members.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    spans = spans.select("family", F.greatest(F.ceil(F.col("sets") / F.greatest(F.lit(BLOCK_SETS), F.least(F.lit(MOST_SETS), F.col("sets") / 16))), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    # read from a table, so that Spark can split the rows of a hot family
    spans = work.save(spans)
    members = work.save(members.join(spans, "family", "left").select("node", "family", "copies", F.coalesce("blocks", F.lit(1)).alias("blocks")))
    n_members = members.count()
    filter_bits = bits_for(n_members)
    cells = 1 << filter_bits
    wanted = spark.sparkContext.broadcast(_bitmap(members.select(F.pmod("node", F.lit(cells)).alias("cell")), filter_bits))  # 32 MB at most

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        bits = wanted.value
        seen: set[int] = set()
        for batch in pieces(batches):
            ids, data = [], []
            for text in batch.column(0).to_pylist():
                s = shingles(words_of(text), k, hasher)
                if not len(s) or (node := node_of(s)) in seen or not bits[(c := node % cells) >> 3] >> (c & 7) & 1:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                ids.append(node)
                data.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["node", "shingles"])

    sets = texts.select("text").mapInArrow(released(fetch), "node long, shingles binary").join(members, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    bins = max(1, n_members // 500)
    sets = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = F.col("blocks") == 1
    sets = sets.select(
        "node",
        "family",
        "block",
        "copies",
        "shingles",
        F.when(whole, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(F.col("family")).alias("task"),
        F.when(whole, F.lit(-1)).otherwise(F.least("block", "other")).alias("bi"),
        F.when(whole, F.lit(-1)).otherwise(F.greatest("block", "other")).alias("bj"),
    )
    solved = work.save(sets.groupBy("task", "bi", "bj").applyInArrow(lambda t: _solve(t, num, den), "a long, b long, n long"))
    work.free()
    linked = work.save(connected_components(solved.where("a <> b").select("a", "b"), work, contracted=True))

    owned = linked.join(nodes.select("node", "least_id"), "node")
    least = work.save(owned.groupBy("root").agg(F.min("least_id").alias("component")))
    named = owned.select("node", "root").join(least, "root").select(F.col("node").alias("linked_node"), "component")
    counted = solved.where("a = b").groupBy("a").agg(F.sum("n").alias("links"))
    found = nodes.join(named, F.col("node") == F.col("linked_node"), "left").join(counted, F.col("node") == F.col("a"), "left")
    found = scratch.save(found.select(F.col("node").alias("of_node"), F.coalesce("component", "least_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    work.drop()
    work.free()
    for shared_value in (frequent, wanted):
        shared_value.unpersist()
    out = rows.join(found, (F.col("node") == F.col("of_node")) & (F.col("n") > 0), "left")
    some = F.col("n") > 0
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(some, F.col("component")).otherwise(F.col("id")).alias("component_id"), F.when(some, F.col("links")).otherwise(F.lit(0)).alias("n_links"))
