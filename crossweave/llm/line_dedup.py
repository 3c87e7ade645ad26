"""Operator 7: removal of line chunks with content-defined boundaries, and of runs of lines, that repeat across documents."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field_type, shared_table

#: lines in the rolling hash, one boundary per so many lines on average, least and most lines of a chunk
ROLL_LINES, BOUNDARY_EVERY, LEAST_LINES, MOST_LINES = 2, 3, 2, 64
#: a line of so many words is a chunk of its own and counts like several lines
LONG_LINE_WORDS = 50

_WRAP, _BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15
_LEAVING = pow(_BASE, ROLL_LINES, 1 << 64)


def chunks(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, stop, weight) of the chunks of a text, in bytes; they cover it without gaps. ``weight`` counts lines that
    are not blank; a long line weighs LEAST_LINES.

    The rolling hash covers the last ROLL_LINES line hashes, so a boundary depends on these lines alone and a
    passage is cut at the same places wherever it stands.
    """
    out: list[tuple[int, int, int]] = []
    if not raw:
        return out
    lines = raw.split(b"\n")
    start = at = weight = count = rolling = 0
    window: list[int] = []

    def close(stop):
        nonlocal start, weight, count
        if stop > start:
            out.append((start, stop, weight))
        start, weight, count = stop, 0, 0

    for line in lines:
        stop = min(at + len(line) + 1, len(raw))
        long = len(line) >= 2 * LONG_LINE_WORDS - 1 and len(line.split()) >= LONG_LINE_WORDS
        if long:
            close(at)
        window.append(xxhash.xxh64_intdigest(line))
        rolling = (rolling * _BASE + window[-1]) & _WRAP
        if len(window) > ROLL_LINES:
            rolling = (rolling - window.pop(0) * _LEAVING) & _WRAP
        weight += LEAST_LINES if long else bool(line.strip())
        count += 1
        at = stop
        if long or count >= MOST_LINES or count >= LEAST_LINES and (rolling ^ rolling >> 32) * _BASE % (1 << 64) // (1 << 32) % BOUNDARY_EVERY == 0:
            close(at)
    close(at)
    return out


def runs(raw: bytes) -> list[tuple[int, int, int]]:
    """(line, start, stop) of the shortest runs of lines with more than LONG_LINE_WORDS words that begin or end with a
    given line, for every line that is not blank; in bytes. Together they cover every line of a repeated passage of so
    many words; either kind alone leaves an end of it."""
    lines = raw.split(b"\n")
    words = [len(line.split()) for line in lines]
    edge = [0]
    for line in lines:
        edge.append(min(edge[-1] + len(line) + 1, len(raw)))
    found: set[tuple[int, int]] = set()
    stop = held = 0
    for i, n in enumerate(words):
        while stop < len(lines) and held <= LONG_LINE_WORDS:
            held += words[stop]
            stop += 1
        if held <= LONG_LINE_WORDS:
            break
        if n:
            found.add((i, stop))
        held -= n
    start = held = 0
    for j, n in enumerate(words):
        held += n
        while held - words[start] > LONG_LINE_WORDS:
            held -= words[start]
            start += 1
        if n and held > LONG_LINE_WORDS:
            while not words[start]:
                start += 1
            found.add((start, j + 1))
    return sorted((i, edge[i], edge[j]) for i, j in found)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def besides(spans: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The disjoint ``spans``, and as further spans what ``more`` covers besides."""
    spans, k = sorted(spans), 0
    out = list(spans)
    for a, b in united(more):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        while k < len(spans) and spans[k][0] < b:
            if a < spans[k][0]:
                out.append((a, spans[k][0]))
            a = spans[k][1]
            k += a <= b
            if a > b:
                break
        if a < b:
            out.append((a, b))
    return sorted(out)


CHUNK, RUN = 0, 1


def piece_table(rows: DataFrame, passages: bool) -> DataFrame:
    """(id, row, pieces) from (id, row, text): the heavy enough chunks, and with ``passages`` the runs, with their place and
    128-bit hash. The hash and later comparisons leave the final line end out, so a piece at the end of a text equals
    one inside a text."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("place", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("h", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(2):
                raw = (value.as_py() or "").encode()
                cut = [(CHUNK, place, a, b) for place, (a, b, weight) in enumerate(chunks(raw)) if weight >= LEAST_LINES]
                cut += [(RUN, *r) for r in runs(raw)] if passages else []
                found.append([{"kind": k, "place": p, "start": a, "stop": b, "h": xxhash.xxh3_128_digest(raw[a : b - (raw[b - 1] == 10)])} for k, p, a, b in cut])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["id", "row", "pieces"])

    form = f"id {field_type(rows, 'id')}, row {field_type(rows, 'row')}, pieces array<struct<kind:int,place:int,start:int,stop:int,h:binary>>"
    return rows.select("id", "row", "text").mapInArrow(run, form)


def open_runs(later: DataFrame) -> DataFrame:
    """(h) of the runs that reach beyond the chunks of their document that go anyhow, from later occurrences by
    document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for found in batch.column(0).to_pylist():
                gone = united([(x["start"], x["stop"]) for x in found if x["kind"] == CHUNK])
                starts = [a for a, _ in gone]
                for x in found:
                    k = bisect_right(starts, x["start"]) - 1
                    if x["kind"] == RUN and (k < 0 or gone[k][1] < x["stop"]):
                        out.add(x["h"])
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary())], ["h"])

    return later.select("found").mapInArrow(run, "h binary").distinct()


def removed_spans(later: DataFrame) -> DataFrame:
    """(id, row, removed) from later occurrences by document: the chunks, and what the runs cover besides."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(2).to_pylist():
                of = [[(x["start"], x["stop"]) for x in found if x["kind"] == k] for k in (CHUNK, RUN)]
                out.append([{"start": a, "stop": b} for a, b in besides(*of)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["id", "row", "removed"])

    form = f"id {field_type(later, 'id')}, row {field_type(later, 'row')}, removed array<struct<start:int,stop:int>>"
    return later.select("id", "row", "found").mapInArrow(run, form)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), passages: bool = False, row: Column | None = None) -> DataFrame:
    """One row per document: id, carried columns, ``text`` without repeated chunks, ``removed`` (byte spans cut out).

    A chunk is removed if it holds several lines (or one long line) and its bytes occur before: in a document with a smaller id, or
    earlier in the same one. The first occurrence stays. With ``passages``, so is every repeated run of lines of more than
    LONG_LINE_WORDS words, wherever chunks end: the shortest such runs from and up to every line are pieces
    like chunks, overlapping pieces are cut as one, and ``removed`` has what they cover besides chunks as spans of its
    own. A run that overlaps its first occurrence is cut from that one's end on.

    Hashes of all pieces are counted (a frequent piece is one row per task); texts of pieces with a repeated hash are
    compared per hash by their least and greatest value, which is aggregated before the exchange too; only equal
    ones are cut. Runs inside chunks that go are not compared. Documents travel twice, by id and row: once to read the
    repeated pieces' bytes, once to be cut.

    Null texts stay null, empty ones empty. ``row`` tells rows of one id apart, the least one first; it must be the same whenever
    ``docs`` is read (``common.file_row``). Without it rows that repeat id and text are one document and are cut alike.
    Null ids come after all others. Blank lines alone are never a chunk to remove. An empty table gives an empty table.
    """
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("id"), (F.xxhash64(F.col(text_col)) if row is None else row).alias("row"), F.col(text_col).alias("text"), *kept)
    found = shared_table(piece_table(rows, passages).where(F.size("pieces") > 0), "line-pieces")
    each = found.select("id", "row", F.explode("pieces").alias("c")).select("id", "row", "c.*")
    repeated = each.groupBy("kind", "h").agg(F.count("*").alias("n")).where("n > 1").select("kind", "h")
    members = shared_table(each.join(repeated, ["kind", "h"]), "repeated-pieces")
    doc = [F.col("id").isNull().alias("last"), F.col("id"), F.col("row")]
    key = F.struct(*doc, "place", "stop")
    firsts = shared_table(members.groupBy("kind", "h").agg(F.min(key).alias("first")), "first-pieces")

    def later(of: DataFrame) -> DataFrame:
        """Occurrences after the first, by document; a run begins after the first occurrence of its own document."""
        inside = F.struct(*doc).eqNullSafe(F.struct("first.last", "first.id", "first.row")) & (F.col("kind") == RUN)
        start = F.when(inside, F.greatest("start", F.col("first.stop"))).otherwise(F.col("start")).alias("start")
        after = members.join(of, ["kind", "h"]).where(~key.eqNullSafe(F.col("first")))
        return after.groupBy("id", "row").agg(F.collect_set(F.struct("kind", start, "stop", "h")).alias("found"))

    asked = members
    if passages:
        wanted = shared_table(open_runs(later(firsts)), "open-runs")
        asked = members.where(F.col("kind") == CHUNK).unionByName(members.where(F.col("kind") == RUN).join(wanted, "h").select(members.columns))
    in_doc = asked.groupBy("id", "row").agg(F.collect_set(F.struct("kind", "place", "start", "stop", "h")).alias("pieces"))

    def with_documents(table: DataFrame, how: str) -> DataFrame:
        a, b = rows.alias("a"), table.alias("b")
        return a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.row") == F.col("b.row")), how)

    raw = F.encode("text", "utf-8")
    texts = with_documents(in_doc, "inner").select(raw.alias("raw"), F.explode("pieces").alias("c"))
    body = F.expr("substring(raw, c.start + 1, c.stop - c.start)")
    body = F.when(F.expr("substring(raw, c.stop, 1) = X'0A'"), F.expr("substring(raw, c.start + 1, c.stop - c.start - 1)")).otherwise(body)
    compared = texts.select("c.kind", "c.h", body.alias("body")).groupBy("kind", "h").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    equal = shared_table(compared.where("least = most").select("kind", "h").join(firsts, ["kind", "h"]), "equal-pieces")
    cut = removed_spans(later(equal))

    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    joined = with_documents(cut, "left").select("a.*", F.array_sort(F.coalesce("removed", none)).alias("removed"))
    pieces = F.expr(
        """transform(sequence(0, size(removed)), i -> substring(encode(text, 'utf-8'),
             if(i = 0, 0, removed[i - 1].stop) + 1, if(i = size(removed), octet_length(text), removed[i].start) - if(i = 0, 0, removed[i - 1].stop)))"""
    )
    rebuilt = F.decode(F.aggregate(pieces, F.lit(b""), lambda a, x: F.concat(a, x)), "utf-8")
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(rebuilt)
    return joined.select(F.col("id").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], text.alias("text"), "removed")
