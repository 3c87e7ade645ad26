"""Operator 6: benchmark decontamination by a prefix-filtered join of item windows with document shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_type, shared_table

WINDOW, SHINGLE = 10, 3
#: bits of the filter over benchmark shingles: sixteen per shingle, within these bounds (16 MB at most)
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: bytes whose hashes are computed at once, and shingle counts a task holds before it hands them on
STRETCH, HELD = 1 << 19, 500_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Word bytes (digits, letters, everything beyond ASCII), and bytes with A-Z lowered."""
    b = np.arange(256)
    word = ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    return word, np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


class WordScan:
    """Words of many texts at once: byte ranges, owning text, and 64-bit hashes of the lower-cased words.

    The hash of a word is a polynomial in its bytes, read off running sums over a stretch of text; it only selects
    candidates, which are compared as text afterwards.
    """

    def __init__(self):
        self.word, self.lower = _byte_tables()
        self._powers(STRETCH)

    def _powers(self, n: int) -> None:
        self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
        self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BACK, np.uint64)])

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(starts, ends, owner, hashes) of the words in ``data``; text k is ``data[offsets[k]:offsets[k + 1]]``."""
        inside = self.word[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[:-1][np.diff(offsets) > 0]
        first[cuts] = inside[cuts]  # a word ends with its text
        last[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi - lo >= len(self.up):
                self._powers(hi - lo)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.lower[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * self.up[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            hashes[i:j] = (sums[e] - sums[s]) * self.down[s]
            i = j
        return starts, ends, np.searchsorted(offsets, starts, "right") - 1, _mixed(hashes)

    def text(self, data: np.ndarray, start: int, end: int) -> bytes:
        return self.lower[data[start:end]].tobytes()


def shingles(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, hashes) of the runs of ``size`` words inside one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :]) if size > 1 else np.arange(n)
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = _mixed(h * _M2 + hashes[at + k])
    return at, h


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a stretch each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STRETCH, "right")) - 1)
        yield i, j
        i = j


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, window, n, shingles): each distinct run of ``window`` words of an item; a shorter item is one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = WordScan()
        for batch in batches:
            data, offsets = _buffers(batch.column(1))
            item, texts, sizes, hashes = [], [], [], []
            starts, ends, owner, word_hashes = scan(data, offsets)
            for k in range(batch.num_rows):
                lo, hi = np.searchsorted(owner, [k, k + 1])
                words = [scan.text(data, starts[w], ends[w]).decode("utf-8", "replace") for w in range(lo, hi)]
                n = min(window, len(words))
                seen = set()
                for w in range(len(words) - n + 1 if n else 0):
                    text = " ".join(words[w : w + n])
                    if text not in seen:
                        seen.add(text)
                        part = word_hashes[lo + w : lo + w + n]
                        item.append(k)
                        texts.append(text)
                        sizes.append(n)
                        hashes.append(shingles(part, np.zeros(n, int), min(SHINGLE, n))[1].view(np.int64).tolist())
            columns = [batch.column(0).take(pa.array(item, pa.int32())), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "window", "n", "shingles"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"item {field_type(items, id_col)}, window string, n int, shingles array<long>")


def shingle_filter(hashes: DataFrame, count: int) -> np.ndarray:
    """Bit table over the column ``h``: no shingle of the table is missed; its size has a fixed bound. Aggregated on the
    executors to 64-bit words, so at most ``MOST_BITS / 64`` rows reach the driver."""
    bits = LEAST_BITS
    while bits < min(16 * count, MOST_BITS):
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast((h & {bits - 1}L) & 63L as int))").alias("b"))
    words = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return table


def _passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(len(table) * 64 - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def shingle_counts(texts: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """(h, occurrences) over all documents, of shingles that pass the filter."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, bits = WordScan(), shared.value
        held, number = [], 0

        def rows():
            h, n = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "occurrences"])

        for batch in batches:
            data, offsets = _buffers(batch.column(0))
            for i, j in _slices(offsets):
                _, _, owner, hashes = scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for size in sizes:
                    h = shingles(hashes, owner, size)[1]
                    held.append(h[_passes(bits, h)])
                    number += len(held[-1])
                if number > HELD:
                    yield rows()
                    number = 0
        yield rows()

    return texts.mapInArrow(run, "h long, occurrences long").groupBy("h").agg(F.sum("occurrences").alias("occurrences"))


def candidates(docs: DataFrame, id_col: str, text_col: str, table: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """(id, n_words, found): for each shingle that passes the filter its hash, word number, and the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, bits = WordScan(), shared.value
        for batch in batches:
            data, offsets = _buffers(batch.column(1))
            n_words, found = [], []
            for i, j in _slices(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, owner, hashes = scan(part, offsets[i : j + 1] - offsets[i])
                first = np.searchsorted(owner, np.arange(j - i + 1))
                n_words.append(np.diff(first))
                rows: list[list] = [[] for _ in range(j - i)]
                for size in sizes:
                    at, h = shingles(hashes, owner, size)
                    keep = _passes(bits, h)
                    for w, x in zip(at[keep].tolist(), h[keep].view(np.int64).tolist(), strict=True):
                        k = int(owner[w])
                        lo, hi = max(int(first[k]), w - window + 1), min(int(first[k + 1]), w + window)
                        around = b" ".join(scan.text(part, starts[v], ends[v]) for v in range(lo, hi)).decode("utf-8", "replace")
                        rows[k].append({"h": x, "at": w - int(first[k]), "before": w - lo, "around": around})
                found += rows
            n_words = np.concatenate([*n_words, np.empty(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(found, kind)], ["id", "n_words", "found"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {field_type(docs, id_col)}, n_words long, found array<struct<h:long,at:int,before:int,around:string>>")


def merged_spans(rows: DataFrame) -> DataFrame:
    """(row, spans): the ranges of each row in order, those that touch or overlap as one; one pass over the sorted ranges."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(1)
            flat = ranges.flatten()
            start, stop = (c.to_numpy() for c in flat.flatten())
            owner = np.repeat(np.arange(len(ranges)), ranges.value_lengths().to_numpy())
            order = np.lexsort((start, owner))
            start, stop, owner = start[order].astype(np.int64), stop[order].astype(np.int64), owner[order]
            # behind the owner, so that one running maximum serves all rows
            shift = owner * (int(stop.max(initial=0)) + 2)
            reach = np.maximum.accumulate(stop + shift)
            first = np.flatnonzero(np.r_[True, start[1:] + shift[1:] > reach[:-1]][: len(start)])
            last = np.r_[first[1:], len(start)] - 1
            spans = pa.StructArray.from_arrays([pa.array(start[first], pa.int32()), pa.array(reach[last] - shift[last], pa.int32())], names=["start", "stop"])
            offsets = np.r_[0, np.cumsum(np.bincount(owner[first], minlength=len(ranges)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans).cast(kind)], ["row", "spans"])

    return rows.select("row", "ranges").mapInArrow(run, "row long, spans array<struct<start:int,stop:int>>")


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` (words inside an occurring window), ``spans`` (merged word ranges
    [start, stop) of those), ``items`` (sorted ids, as text, of the items that occur).

    A window occurs only if each of its shingles does, so its prefix is one shingle: the one that is rarest in the
    documents. A first pass counts the benchmark's shingles there, behind a bit filter of bounded size; a second looks
    for the chosen shingles and keeps the few words around each. These candidates are joined with the windows by
    shingle; offset and length bound where a window can lie, and the words are compared as text. Candidates, not
    documents, are shuffled; Spark splits a hot shingle or broadcasts a small benchmark by measured size.

    Null and empty texts have no words, hits or items; items without words have no windows; an item that stands under
    two ids counts for both; a null item id still hits words but is no item. Repeated rows and null ids keep a row
    each; empty tables on either side are allowed; other columns are not read.
    """
    windows = shared_table(item_windows(items, item_col, item_text, window), "windows")
    distinct = windows.dropDuplicates(["window"])
    shape = distinct.agg(F.sum(F.size("shingles")).alias("h"), F.collect_set(F.least("n", F.lit(SHINGLE))).alias("sizes")).first()
    sizes = sorted(shape["sizes"])
    every = distinct.select("window", "n", F.posexplode("shingles").alias("offset", "h"))
    table = shingle_filter(every.select("h"), shape["h"] or 0)
    counts = shingle_counts(docs.select(F.col(text_col).alias("text")), table, sizes)
    # a shingle that no document holds leaves its windows out
    least = F.min(F.struct("occurrences", "h", "offset")).alias("least")
    rarity = every.join(counts, "h", "left").groupBy("window", "n").agg(F.count("occurrences").alias("present"), F.count("*").alias("all"), least)
    prefixes = shared_table(rarity.where("present = all").select("window", "n", "least.h", "least.offset"), "prefixes")
    chosen = shingle_filter(prefixes.select("h"), prefixes.count())
    rows = shared_table(candidates(docs, id_col, text_col, chosen, sizes, window).withColumn("row", F.monotonically_increasing_id()), "candidates")

    found = rows.select("row", F.explode("found").alias("c")).select("row", "c.*").join(prefixes, "h")
    inside = found.where(F.col("before") >= F.col("offset")).where(
        F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("window")
    )
    hits = inside.select("row", "window", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("n")).alias("stop"))
    covered = merged_spans(hits.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")))
    named = hits.select("row", "window").distinct().join(windows.select("window", "item").distinct(), "window")
    of_row = named.where("item is not null").groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    out = rows.select("row", "id", "n_words").join(covered, "row", "left").join(of_row, "row", "left")
    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    out = out.withColumns({"spans": F.coalesce("spans", none), "items": F.coalesce("items", F.expr("cast(array() as array<string>)"))})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items")
