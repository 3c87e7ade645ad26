"""Operator 2: SimHash near-duplicates through a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field_type, shared_table
from .components import connected_components

SEED, SHINGLE_WORDS, DISTANCE = 42, 4, 4
#: fingerprints differing in at most DISTANCE of their bits agree on all but DISTANCE of these blocks
BLOCKS = 6
#: rows indexed together, rows of one index part, children of a node, (query, node) pairs held at once
HELD_ROWS, PART_ROWS, FANOUT, PAIRS = 1 << 16, 4096, 8, 1 << 20


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """Majority bits over the hashes of the word shingles; bytes.lower and bytes.split know ASCII alone."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65_536):
        ones += np.unpackbits(hashes[lo : lo + 65_536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): fp as a signed 64-bit number; no words give zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(v.as_py() or "", size) for v in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {field_type(docs, id_col)}, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a code in Gray order, as a signed number in the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Bit masks of the block choices of which any two fingerprints within the distance agree on one at least."""
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    return [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - distance)]


# ---------------------------------------------------------------- index


class GrayIndex:
    """Index over groups of fingerprints, each group in Gray order.

    Neighbours in Gray order differ in few bits, so the bits on which FANOUT consecutive entries agree are factored
    into a parent node, and so on up to one root per group. A search adds up the differing bits of the shared
    patterns on its way down and leaves a whole subtree as soon as the sum exceeds the distance.
    """

    def __init__(self, fps: np.ndarray, starts: np.ndarray):
        n = len(fps)
        self.fps = fps
        group = np.zeros(n, np.int64)
        group[starts] = 1
        self.group = np.cumsum(group) - 1
        every, some, owner = fps, fps, self.group
        self.levels = [(np.full(n, 2**64 - 1, np.uint64), fps, np.arange(n), np.arange(1, n + 1))]
        low, high = np.arange(n), np.arange(1, n + 1)  # rows below a node
        first_of = starts
        self.rows = [(low, high)]
        while len(owner) > len(starts):
            place = np.arange(len(owner)) - first_of[owner]
            cut = np.flatnonzero(place % FANOUT == 0)
            stop = np.r_[cut[1:], len(owner)]
            every, some = np.bitwise_and.reduceat(every, cut), np.bitwise_or.reduceat(some, cut)
            low, high = low[cut], high[stop - 1]
            owner = owner[cut]
            first_of = np.searchsorted(owner, np.arange(len(starts)))
            self.levels.append((~(every ^ some), every, cut, stop))
            self.rows.append((low, high))

    def search(self, queries: np.ndarray, group: np.ndarray, after: np.ndarray, labels: np.ndarray, own: np.ndarray, distance: int):
        """(query, row) pairs within ``distance``; rows up to ``after`` and subtrees that carry the query's own label
        throughout are left out."""
        mask, value, _, _ = self.levels[-1]
        q, node = np.arange(len(queries)), group
        spent = np.bitwise_count((queries ^ value[node]) & mask[node]).astype(np.int16)
        for level in range(len(self.levels) - 1, -1, -1):
            low, high = self.rows[level]
            least, most = np.minimum.reduceat(labels, low), np.maximum.reduceat(labels, low)
            keep = (spent <= distance) & (high[node] > after[q] + 1) & ~((least[node] == own[q]) & (most[node] == own[q]))
            q, node, spent = q[keep], node[keep], spent[keep]
            if level == 0 or not len(q):
                return q, node
            above = self.levels[level][0]
            _, _, first, stop = self.levels[level]
            mask, value, _, _ = self.levels[level - 1]
            number = stop[node] - first[node]
            child = np.repeat(first[node] - np.r_[0, np.cumsum(number)[:-1]], number) + np.arange(number.sum())
            rest = mask[child] & ~np.repeat(above[node], number)
            q, spent = np.repeat(q, number), np.repeat(spent, number)
            spent = spent + np.bitwise_count((queries[q] ^ value[child]) & rest)
            node = child


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each component after adding the edges."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            deeper = labels[labels]
            if (deeper == labels).all():
                break
            labels = deeper
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
    return labels


def _slices(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    total, i = np.cumsum(weights), 0
    while i < len(weights):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        yield i, j
        i = j


def links_within(fps: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (row, first row of its component) of the links inside each group."""
    index, labels = GrayIndex(fps, starts), np.arange(len(fps))
    size = np.diff(np.r_[starts, len(fps)])[index.group]
    for i, j in _slices(size):
        rows = np.arange(i, j)
        q, hit = index.search(fps[i:j], index.group[i:j], rows, labels, labels[i:j], distance)
        labels = unite(labels, q + i, hit)
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return moved, labels[moved]


def links_between(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges over the rows of both sides (right ones counted after left ones) of the links between two parts."""
    n = len(left)
    index, labels = GrayIndex(right, np.zeros(1, np.int64)), np.arange(n + len(right))
    for i, j in _slices(np.full(n, len(right))):
        none = np.full(j - i, -1)
        q, hit = index.search(left[i:j], np.zeros(j - i, np.int64), none, labels[n:], labels[i:j], distance)
        labels = unite(labels, q + i, hit + n)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return moved, labels[moved]


# ---------------------------------------------------------------- join

_ROWS = "t int, key long, part long, mask long, value long, fps array<long>, a long, b long"
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n, kinds = len(a), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*[pa.nulls(n, k) for k in kinds], pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], _NAMES)


def near_links(codes: DataFrame, distance: int = DISTANCE, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b) edges that connect exactly the fingerprints linked by chains of steps within ``distance``.

    ``codes`` holds distinct values ``fp``. Every code is routed by the blocks it may share with a neighbour, and the
    routed rows are range-partitioned by (route, Gray rank): a crowded route is spread over tasks in Gray order,
    never gathered. A task indexes parts of at most ``part_rows`` rows and emits star edges, not pairs. Parts of a route that
    continues elsewhere are kept with their shared bit pattern; two such parts are joined only if their patterns
    differ in at most ``distance`` bits, and then searched the same way.
    """
    routes = F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key"))
        for i, m in enumerate(block_masks(distance=distance))
    ]))
    routed = codes.select("fp", gray_rank(F.col("fp")).alias("g"), routes.alias("r")).select("r.t", "r.key", "g", "fp")
    order = ("t", "key", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << 33, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def index(t, key, fp, before: bool, behind: bool):
            """``before``, ``behind``: the first or last route may have rows elsewhere."""
            nonlocal serial
            n = len(fp)
            new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])]
            route = np.cumsum(new) - 1
            place = np.arange(n) - np.flatnonzero(new)[route]
            starts = np.flatnonzero(place % part_rows == 0)
            of, stops = route[starts], np.r_[starts[1:], n]
            shared = np.bincount(of)[of] > 1
            shared |= (of == 0) & before
            shared |= (of == of[-1]) & behind
            row, root = links_within(fp, starts, distance)
            if len(row):
                yield _edges(fp[row], fp[root])
            at = np.flatnonzero(shared)
            if len(at):
                every, some = np.bitwise_and.reduceat(fp, starts)[at], np.bitwise_or.reduceat(fp, starts)[at]
                lists = [fp[a:b].view(np.int64).tolist() for a, b in zip(starts[at], stops[at], strict=True)]
                columns = [
                    pa.array(t[starts[at]]), pa.array(key[starts[at]]), pa.array(base + serial + np.arange(len(at))), pa.array((~(every ^ some)).view(np.int64)),
                    pa.array(every.view(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()),
                ]
                serial += len(at)
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

        before = True
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)))
            if sum(len(h[0]) for h in held) < HELD_ROWS:
                continue
            t, key, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            last = np.flatnonzero((t != t[-1]) | (key != key[-1]))
            start = int(last[-1]) + 1 if len(last) else 0  # the last route may go on
            whole = (len(t) - start) // part_rows * part_rows
            cut = start + whole
            if cut:
                yield from index(t[:cut], key[:cut], fp[:cut], before, whole > 0)
                before = whole > 0
            held = [(t[cut:], key[cut:], fp[cut:])]
        if sum(len(h[0]) for h in held):
            t, key, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from index(t, key, fp, before, True)

    spread = routed.repartitionByRange(*order).sortWithinPartitions(*order).select("t", "key", "fp")
    found = shared_table(spread.mapInArrow(run, _ROWS), "gray-index")
    parts = found.where("fps is not null").select("t", "key", "part", "mask", "value", "fps")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                both = [np.asarray(x.values).view(np.uint64) for x in (left, right)]
                row, root = links_between(*both, distance)
                fp = np.concatenate(both)
                yield pa.RecordBatch.from_arrays([pa.array(fp[row].view(np.int64)), pa.array(fp[root].view(np.int64))], ["a", "b"])

    x, y = parts.alias("x"), parts.alias("y")
    differ = F.col("x.value").bitwiseXOR(F.col("y.value")).bitwiseAND(F.col("x.mask")).bitwiseAND(F.col("y.mask"))
    near = (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.part") < F.col("y.part")) & (F.bit_count(differ) <= distance)
    between = x.join(y, near).select(F.col("x.fps").alias("left"), F.col("y.fps").alias("right")).mapInArrow(cross, "a long, b long")
    return found.where("a is not null").select("a", "b").union(between)


def near_duplicates(
    docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable by links of at
    most ``distance`` differing bits).

    Equal fingerprints are one code before any search, so a group of copies of any size is one row there. Texts are
    read once; all later steps move codes and ids.

    Null and empty texts have fingerprint zero and are linked like any other. A null id is never the component's id unless
    the component has no other; repeated rows keep a row each; an empty table gives an empty table; other columns
    are not read.
    """
    rows = shared_table(fingerprints(docs, id_col, text_col, size), "fingerprints")
    codes = shared_table(rows.groupBy("fp").agg(F.min("id").alias("first")), "codes")
    roots = connected_components(near_links(codes.select("fp"), distance))
    rooted = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_code = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = rows.join(of_code, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
