"""Operator 11: Jaccard join of shingle sets. Tiles of one size band, bit-count bounds on hashed bitmaps, exact intersection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field_type, file_row, shared_table
from .components import connected_components
from .decontaminate import WordScan, _buffers, _mixed, _passes, _slices, shingle_filter, shingles
from .simhash import unite

SHINGLE, PERCENT = 3, 90
#: bitmap words of pairs, and shingles, compared at once
WORDS_AT_ONCE, COMPARED = 1 << 21, 1 << 21

_BAND = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- sets and keys


class Words(WordScan):
    """Words between ASCII white space."""

    def __init__(self):
        super().__init__()
        space = np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        self.word = ~space


def shingle_sets(scan: Words, data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, codes): number of distinct shingles of each text, and their sorted 64-bit codes, text after text. A text of fewer words is
    one shingle."""
    _, _, owner, hashes = scan(data, offsets)
    words = np.bincount(owner, minlength=len(offsets) - 1)
    own, codes = [], []
    for k in range(1, size + 1):
        at, h = shingles(hashes, owner, k)
        keep = slice(None) if k == size else words[owner[at]] == k
        own.append(owner[at][keep])
        codes.append(h[keep])
    own, codes = np.concatenate(own), np.concatenate(codes)
    order = np.lexsort((codes, own))
    own, codes = own[order], codes[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (codes[1:] != codes[:-1])][: len(own)]
    return np.bincount(own[new], minlength=len(words)), codes[new]


@dataclass(frozen=True)
class Bands:
    """Size bands of the join and how many shingles two linked sets may differ in.

    Sets of sizes a <= b with intersection / union of at least ``percent`` differ in at most a * (100 - percent) / percent
    shingles, and b is at most a * 100 / percent. A band is two such steps wide, so b is in the band of a or, if a reaches
    so far, in the next one.
    """

    percent: int

    def differ(self, least: np.ndarray) -> np.ndarray:
        return least * (100 - self.percent) // self.percent

    @property
    def first(self) -> int:
        """Smallest size of the smaller set of a pair that may differ in two shingles."""
        return -(-2 * self.percent // (100 - self.percent))

    def edges(self, most: int) -> np.ndarray:
        out = [self.first]
        while len(out) < 3 or out[-3] <= most:
            out.append(max(out[-1] + 1, -(-out[-1] * 10_000 // self.percent**2)))
        return np.array(out)


def set_keys(n: np.ndarray, codes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key): any two linked, different sets share a key.

    Small sets differ in one shingle: the keys are the set and the set without each one. Others are cut by shingle code into
    segments, two more than the shingles they may differ in, for their own band and, where a partner may be there, the next: two
    segments at least are equal then. A key is a segment's sum of mixed codes. One empty segment may be left out; a set with more emits them
    too.
    """
    owner = np.repeat(np.arange(len(n)), n)
    mixed = _mixed(codes ^ _BAND)
    total = np.zeros(len(n), np.uint64)
    np.add.at(total, owner, mixed)
    one = int(-(-bands.percent // (100 - bands.percent)))
    whole = np.flatnonzero((n >= one) & (n < bands.first))
    name = lambda sums, size: _mixed(sums + size.astype(np.uint64) * _BAND)
    without = np.flatnonzero((n[owner] > one) & (n[owner] <= bands.first))
    owners = [whole, owner[without]]
    keys = [name(total[whole], n[whole]), name(total[owner[without]] - mixed[without], n[owner[without]] - 1)]
    large = n >= bands.first
    if large.any():
        edges = bands.edges(int(n.max()))
        band = np.searchsorted(edges, n, "right") - 1
        reach = large & (n * 100 // bands.percent >= edges[np.maximum(band, 0) + 1])
        for step, wanted in ((0, large), (1, reach)):
            in_band, inside = np.maximum(band + step, 0), wanted[owner]
            segments = np.where(wanted, bands.differ(edges[in_band + 1] - 1) + 2, 0)
            base = np.r_[0, np.cumsum(segments)]
            at = base[owner[inside]] + ((codes[inside] >> np.uint64(32)) % segments[owner[inside]].astype(np.uint64)).astype(np.int64)
            sums = np.zeros(base[-1], np.uint64)
            np.add.at(sums, at, mixed[inside])
            empty = np.bincount(at, minlength=base[-1]) == 0
            of = np.repeat(np.arange(len(n)), segments)
            place = np.arange(base[-1]) - base[of]
            keep = ~empty | (np.bincount(of, weights=empty, minlength=len(n))[of] > 1)
            tag = _mixed((in_band[of] << 32).astype(np.uint64) + place.astype(np.uint64) + _BAND)
            owners.append(of[keep])
            keys.append(_mixed(sums ^ tag)[keep])
    return np.concatenate(owners), np.concatenate(keys)


def document_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, row, n, digest, keys) from (id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, bands = Words(), Bands(percent)
        for batch in batches:
            data, offsets = _buffers(batch.column(2))
            for i, j in _slices(offsets):
                n, codes = shingle_sets(scan, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                ends = np.r_[0, np.cumsum(n)]
                raw = codes.tobytes()
                digests = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                owner, keys = set_keys(n, codes, bands)
                keys = keys[np.argsort(owner, kind="stable")]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(n)))], pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "row", "n", "digest", "keys"]
                )

    return docs.select("id", "row", "text").mapInArrow(run, f"id {field_type(docs, 'id')}, row {field_type(docs, 'row')}, n long, digest binary, keys array<long>")


def key_edges(keys: DataFrame) -> DataFrame:
    """(a, b): every name of a key beside the first one, from (key, name).

    Rows are range-partitioned by both, so a frequent key is spread over tasks; a task reads its rows in order and holds
    the current key alone. Where a key may go on in another task its first name there is handed on; those, two a
    task at most, are joined by key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = first = None
        ends: list[tuple[int, int]] = []

        def rows(*columns):
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], ["a", "b", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.r_[key[0] != current, key[1:] != key[:-1]]
            run_of = np.cumsum(new)
            leads = np.r_[0 if first is None else first, name[new]]
            lead, later = leads[run_of], ~new
            if current is None:
                ends.append((int(key[0]), int(name[0])))
            current, first = key[-1], lead[-1]
            yield rows(name[later], lead[later], pa.nulls(int(later.sum()), pa.int64()))
        if current is not None:
            ends.append((int(current), int(first)))
        yield rows([n for _, n in ends], pa.nulls(len(ends), pa.int64()), [k for k, _ in ends])

    found = keys.repartitionByRange("key", "name").sortWithinPartitions("key", "name").mapInArrow(run, "a long, b long, key long")
    found = shared_table(found, "key-edges")
    ends = found.where("key is not null").select("key", "a")
    least = ends.groupBy("key").agg(F.min("a").alias("b"))
    return found.where("key is null").select("a", "b").union(ends.join(least, "key").where("a <> b").select("a", "b"))


def rows_among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, text) of the ``rows`` that may be in ``wanted`` (row): all of those, and few others while a filter of bounded
    size can tell them apart. Spares the exchange of most texts."""
    shared = rows.sparkSession.sparkContext.broadcast(shingle_filter(wanted.select(F.xxhash64("row").alias("h")), wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _passes(shared.value, batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(batch.columns[1:], ["row", "text"]).filter(pa.array(keep))

    return rows.select(F.xxhash64("row").alias("h"), "row", "text").mapInArrow(run, f"row {field_type(rows, 'row')}, text string")


# ---------------------------------------------------------------- tiles


@dataclass(frozen=True)
class TileSizes:
    """Shingles a task holds, shingles and rows of a tile, and places a crowded root is sent to; none changes a result."""

    held: int = 1 << 20
    shingles: int = 1 << 18
    rows: int = 4096
    places: int = 64


@dataclass
class Sets:
    """Sets as sorted codes, row after row, with sizes, names and weights (documents)."""

    n: np.ndarray
    codes: np.ndarray
    name: np.ndarray
    weight: np.ndarray

    def take(self, rows: np.ndarray) -> Sets:
        n = self.n[rows]
        first = np.r_[0, np.cumsum(self.n)][rows]
        at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return Sets(n, self.codes[at], self.name[rows], self.weight[rows])

    @staticmethod
    def join(parts: list[Sets]) -> Sets:
        return Sets(*(np.concatenate(c) for c in zip(*((p.n, p.codes, p.name, p.weight) for p in parts), strict=True)))

    def bitmaps(self) -> np.ndarray:
        """One bit per code, hashed to twice the bits the largest set has shingles."""
        bits = 64
        while bits < 2 * self.n.max():
            bits *= 2
        flags = np.zeros(len(self.n) * bits, bool)
        flags[np.repeat(np.arange(len(self.n)) * bits, self.n) + (self.codes & np.uint64(bits - 1)).astype(np.int64)] = True
        return np.packbits(flags, bitorder="little").view("<u8").reshape(len(self.n), -1)


def linked_pairs(sets: Sets, first: np.ndarray, stop: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the linked ones among row i and rows ``first[i]`` to ``stop[i]``, in slices.

    A bit that only one of two bitmaps has stands for a shingle that only its set has, which bounds the overlap from
    above. Pairs that pass are intersected: the sorted codes of the one are searched in those of the other.
    """
    maps = sets.bitmaps()
    number = np.maximum(stop - first, 0)
    starts = np.r_[0, np.cumsum(sets.n)]
    # codes of all rows as one ascending array: rank of the code behind the row
    values, rank = np.unique(sets.codes, return_inverse=True)
    ascending = np.repeat(np.arange(len(sets.n)) * len(values), sets.n) + rank
    total, lo, most = np.cumsum(number), 0, max(1, WORDS_AT_ONCE // maps.shape[1])
    enough = lambda common, a, b: 100 * common >= percent * (a + b - common)
    while lo < len(number):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        k = number[lo:hi]
        i = np.repeat(np.arange(lo, hi), k)
        j = np.repeat(first[lo:hi] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
        lo = hi
        for s in range(0, len(i), most):  # one row may have more partners than a slice
            a, b = i[s : s + most], j[s : s + most]
            x, y = maps[a], maps[b]
            both = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64)
            only = np.bitwise_count(x).sum(axis=1, dtype=np.int64) - both, np.bitwise_count(y).sum(axis=1, dtype=np.int64) - both
            bound = np.minimum(sets.n[a] - only[0], sets.n[b] - only[1])
            keep = enough(bound, sets.n[a], sets.n[b])
            a, b = a[keep], b[keep]
            ends, at = np.cumsum(sets.n[b]), 0
            while at < len(a):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right")))
                p, q, n = a[at:to], b[at:to], sets.n[b[at:to]]
                code = rank[np.repeat(starts[q] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                asked = np.repeat(p * len(values), n) + code
                hit = ascending[np.minimum(np.searchsorted(ascending, asked), len(ascending) - 1)] == asked
                common = np.add.reduceat(hit, np.r_[0, np.cumsum(n)[:-1]], dtype=np.int64)
                linked = enough(common, sets.n[p], sets.n[q])
                yield p[linked], q[linked]
                at = to


def link_rows(sets: Sets, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(name, links, least): documents that each linked row gains, and the smallest name of its component here."""
    labels, links = np.arange(len(sets.n)), np.zeros(len(sets.n), np.int64)
    for i, j in pairs:
        np.add.at(links, i, sets.weight[j])
        np.add.at(links, j, sets.weight[i])
        labels = unite(labels, i, j)
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(sets.name[at]), pa.array(links[at]), pa.array(sets.name[labels[at]])], ["name", "links", "least"])


def links_inside(sets: Sets, tile: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal ``tile`` numbers (ascending, sizes ascending within). Tiles of one bitmap width are
    done together."""
    new = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    stop = np.r_[new[1:], len(tile)]
    width = np.ceil(np.log2(np.maximum(sets.n[stop - 1], 32))).astype(np.int64)  # the last of a tile is its largest
    for w in np.unique(width[stop - new > 1]):
        chosen = (width == w) & (stop - new > 1)
        size = (stop - new)[chosen]
        end = np.cumsum(size)
        rows = np.repeat(new[chosen] - (end - size), size) + np.arange(size.sum())
        part = sets.take(rows)
        after = np.arange(len(rows)) + 1
        bound = np.repeat(end, size)
        high = np.minimum(bound, _size_end(part.n, np.repeat(np.arange(len(size)), size), percent))
        yield link_rows(part, linked_pairs(part, after, high, percent))


def _size_end(n: np.ndarray, tile: np.ndarray, percent: int) -> np.ndarray:
    """Row after the last one of the tile whose size fits."""
    span = int(n.max()) * 100 // percent + 2
    return np.searchsorted(tile * span + n, tile * span + n * 100 // percent, "right")


def links_between(left: Sets, right: Sets, percent: int) -> pa.RecordBatch:
    """Links of two sides, each ascending in size."""
    sets, m = Sets.join([left, right]), len(left.n)
    first = m + np.searchsorted(right.n, -(-left.n * percent // 100), "left")
    stop = m + np.searchsorted(right.n, left.n * 100 // percent, "right")
    none = np.zeros(len(right.n), np.int64)
    return link_rows(sets, linked_pairs(sets, np.r_[first, none], np.r_[stop, none], percent))


_PART = "root long, part long, low long, high long, n binary, codes binary, names binary, weights binary"
_ROWS = "name long, links long, least long, " + _PART
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]


def _link_batch(rows: pa.RecordBatch) -> pa.RecordBatch:
    k = rows.num_rows
    kinds = [pa.int64()] * 4 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([*rows.columns, *[pa.nulls(k, t) for t in kinds]], _NAMES)


def _part_batch(root: int, part: int, s: Sets) -> pa.RecordBatch:
    values = [None, None, None, root, part, int(s.n[0]), int(s.n[-1]), *(x.tobytes() for x in (s.n, s.codes, s.name, s.weight))]
    kinds = [pa.int64()] * 7 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], _NAMES)


def _unpacked(n: bytes, codes: bytes, names: bytes, weights: bytes) -> Sets:
    return Sets(np.frombuffer(n, np.int64), np.frombuffer(codes, np.uint64), np.frombuffer(names, np.int64), np.frombuffer(weights, np.int64))


def tile_links(sets: DataFrame, percent: int, sizes: TileSizes = TileSizes()) -> DataFrame:
    """(name, links, least) of the links among sets (root, n, name, weight, codes) of one ``root``: a row may come several
    times, its links add up.

    Rows are range-partitioned by (root, size): a crowded root is spread over tasks, by size. A task cuts them
    into tiles of bounded size, compares within tiles, and hands on tiles of roots that continue; two of these meet if
    their sizes may. The left one is sent to as many places as the root has tiles (up to a bound), so that a
    crowded root's comparisons spread too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held, shingles_held = TaskContext.get().partitionId() << 33, [], 0

        def tiles():
            nonlocal serial
            root = np.concatenate([r for r, _ in held])
            sets = Sets.join([s for _, s in held])
            new = np.r_[True, root[1:] != root[:-1]]
            group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
            before = np.r_[0, np.cumsum(sets.n)[:-1]]
            cut = np.maximum((before - before[begin][group]) // sizes.shingles, (np.arange(len(root)) - begin[group]) // sizes.rows)
            tile = np.cumsum(np.r_[True, new[1:] | (cut[1:] != cut[:-1])]) - 1
            for rows in links_inside(sets, tile, percent):
                yield _link_batch(rows)
            of = group[np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])]
            open_ = (np.bincount(of)[of] > 1) | (of == of[0]) | (of == of[-1])  # the first and last root may have rows elsewhere
            for t in np.flatnonzero(open_):
                rows = np.flatnonzero(tile == t)
                yield _part_batch(int(root[rows[0]]), serial, sets.take(rows))
                serial += 1

        for batch in batches:
            root, n, name, weight = (batch.column(k).to_numpy() for k in range(4))
            codes = batch.column(4).flatten().to_numpy().view(np.uint64)
            held.append((root, Sets(n, codes, name, weight)))
            shingles_held += len(codes)
            if shingles_held >= sizes.held:
                yield from tiles()
                held, shingles_held = [], 0
        if held:
            yield from tiles()

    order = ("root", "n", "name")
    spread = sets.repartitionByRange(*order).sortWithinPartitions(*order).select("root", "n", "name", "weight", "codes")
    found = shared_table(spread.mapInArrow(run, _ROWS), "tiles")
    parts = found.where("part is not null").select(*[f.split()[0] for f in _PART.split(", ")])
    several = parts.groupBy("root").agg(F.least(F.count("*"), F.lit(sizes.places)).alias("places")).where("places > 1")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (_unpacked(*(batch.column(c)[k].as_py() for c in range(lo, lo + 4))) for lo in (0, 4))
                yield links_between(left, right, percent)

    held = ["n", "codes", "names", "weights"]
    side = parts.join(several, "root")
    left = side.select("root", F.col("part").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), *[F.col(c).alias(f"a_{c}") for c in held], F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"))
    right = side.select("root", F.pmod(F.xxhash64("part"), F.col("places")).alias("place"), F.col("part").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), *[F.col(c).alias(f"b_{c}") for c in held])
    meet = (F.col("a") < F.col("b")) & (F.col("b_low") * percent <= F.col("a_high") * 100) & (F.col("a_low") * percent <= F.col("b_high") * 100)
    pairs = left.join(right, ["root", "place"]).where(meet).select(*[f"a_{c}" for c in held], *[f"b_{c}" for c in held])
    return found.where("name is not null").select("name", "links", "least").union(pairs.mapInArrow(cross, "name long, links long, least long"))


# ---------------------------------------------------------------- join


def jaccard_groups(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None,
    sizes: TileSizes = TileSizes(),
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable by links, its own included),
    ``n_links`` (rows that it links to).

    Two documents link if the intersection of their sets of word shingles is at least ``percent`` hundredths of the union. Equal
    sets are one row with its number of documents before any search. Keys that any two linked sets share (``set_keys``)
    meet without the sets; sets that share one are drawn into one root, so every pair is met in one
    place, and only their texts are cut into shingles again. Tiles then hold sets of one root by size; ``linked_pairs``
    bounds and verifies. Links add up to counts and star edges in the task; no pair is ever a row.

    Shingles are 64-bit codes of the word bytes, lower-cased A-Z. Null and empty texts and texts without words have the empty set: they link
    with nothing. A null id is a component's id only if it has no other. Repeated rows are copies. ``row`` tells
    the rows of ``docs`` apart and must be the same whenever it is read (``common.file_row``); without it id and text
    are written first. An empty table gives an empty table; other columns are not read.
    """
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    rows = shared_table(docs.select(*columns), "joined").select("*", file_row().alias("row")) if row is None else docs.select(*columns, row.alias("row"))
    found = shared_table(document_sets(rows, size, percent), "shingle-keys")
    classes = found.where("n > 0").groupBy("digest").agg(
        F.count("*").alias("weight"), F.min("id").alias("first"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    classes = shared_table(classes.withColumn("name", F.monotonically_increasing_id()), "set-classes")

    roots = connected_components(key_edges(classes.select(F.explode("keys").alias("key"), "name")))
    wanted = shared_table(classes.select("name", "row", "weight").join(roots.withColumnRenamed("node", "name"), "name"), "join-candidates")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Words()
        for batch in batches:
            data, offsets = _buffers(batch.column(3))
            for i, j in _slices(offsets):
                n, codes = shingle_sets(scan, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(codes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:3]], pa.array(n, pa.int64()), lists], ["root", "name", "weight", "n", "codes"])

    texts = rows_among(rows, wanted).join(wanted, "row").select("root", "name", "weight", "text")
    sets = shared_table(texts.mapInArrow(cut, "root long, name long, weight long, n long, codes array<long>"), "candidate-sets")
    links = shared_table(tile_links(sets, percent, sizes).groupBy("name", "least").agg(F.sum("links").alias("links")), "links")

    joined = connected_components(links.where("name <> least").select(F.col("name").alias("a"), F.col("least").alias("b")))
    number = links.groupBy("name").agg(F.sum("links").alias("links"))
    of = classes.select("digest", "name", "weight", "first").join(joined.withColumnRenamed("node", "name"), "name", "left").join(number, "name", "left")
    of = of.withColumn("root", F.coalesce("root", "name"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(least, "root").select("digest", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    empty = found.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = found.where("n > 0").select("id", "n", "digest").join(of, "digest")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links").union(empty)
