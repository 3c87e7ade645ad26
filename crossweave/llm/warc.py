"""Operator 4: WARC archives and their capture index. Sorted runs per archive are merged by a loser tree."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field_type, file_row, shared_dir, shared_table

#: compressed bytes after which an archive is closed, and bytes read from one at a time
ARCHIVE_BYTES, READ_BYTES = 16 << 20, 1 << 16
#: one archive a reading task up to so many tasks, beyond them up to so many archives a task
MOST_READERS, ARCHIVES_A_TASK = 4096, 4
#: merged captures per output batch
OUT_ROWS = 10_000
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- records


def record_uri(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + page)}>"


def header_value(text: str) -> str:
    """A value that fits one header line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def header_text(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, which tells the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(str(page) + date)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    if page is not None:
        head.append(f"X-Page-ID: {header_value(page)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"X-Refers-To-Page: {header_value(refers_to)}"]
    return _gzip("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _gzip(raw: bytes) -> bytes:
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


def members(source) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an open file, read piece by piece."""
    offset, spare = 0, b""
    while True:
        unpack, used, parts = zlib.decompressobj(31), 0, []
        while not unpack.eof:
            piece = spare or source.read(READ_BYTES)
            spare = b""
            if not piece:
                if used:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(unpack.decompress(piece))
            used += len(piece)
        spare = unpack.unused_data
        used -= len(spare)
        yield offset, used, b"".join(parts)
        offset += used


def parse(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record; lengths are checked."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit")
    if not fields["content-type"].startswith("application/http"):
        return fields, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def url_key(url: str | None) -> str:
    """Sort-friendly URL: host labels reversed, no scheme, user, ``www``, default port or fragment; query sorted."""
    m = re.match(r"\s*(?:([a-z][a-z0-9+.-]*):)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?", (url or "").lower())
    scheme, host, port, path, query = m.groups()
    if not host and not path:
        return "-"
    host = re.sub(r"^www\d*\.", "", host)
    port = "" if port in (None, "", {"http": "80", "https": "443"}.get(scheme or "http")) else ":" + port
    path = re.sub(r"/+$", "", path) or "/"
    query = "?" + "&".join(sorted(query.split("&"))) if query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + path + query


# ---------------------------------------------------------------- archives


def _store(path: str):
    return pa.fs.FileSystem.from_uri(path)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write (page, url, date, digest, refers_to, payload) rows as archives under ``folder``; returns the list of
    archives, (path, records), as written by the tasks that succeeded. An attempt that is lost leaves files that no
    list names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, records = None, "", 0, 0
        info = _gzip(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n")

        def done():
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([records], pa.int64())], ["path", "records"])

        for batch in batches:
            for page, url, date, digest, refers_to, payload in zip(*batch.columns, strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, place = _store(path)
                    store.create_dir(place.rsplit("/", 1)[0])
                    out, size, records = store.open_output_stream(place, compression=None), 0, 0
                    out.write(info)
                blob = record(page.as_py(), url.as_py(), date.as_py(), payload.as_py(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers_to.as_py())
                out.write(blob)
                size, records = size + len(blob), records + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.close()
            yield done()

    order = ["page", "url", "date", "digest", "refers_to", "payload"]
    return shared_table(rows.select(*order).mapInArrow(run, "path string, records long"), "archives")


_CAPTURE = "run string, url_key string, date string, page string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to string"


def read_archives(archives: DataFrame) -> DataFrame:
    """Capture rows of the archives: one locally sorted run per archive. Payloads of responses are digested again and held
    against their headers."""
    names = [f.split()[0] for f in _CAPTURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = _store(path)
                rows = []
                with store.open_input_file(place) as f:
                    for offset, length, content in members(f):
                        fields, http, payload = parse(content)
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                        if kind == "response" and (len(payload), base32_sha1(payload)) != (size, digest):
                            raise ValueError(f"{path}: the payload at {offset} does not fit its digest")
                        page, to = fields.get("x-page-id"), fields.get("x-refers-to-page")
                        uri = fields.get("warc-target-uri")
                        rows.append((
                            path, url_key(None if uri is None else header_text(uri)), fields["warc-date"], None if page is None else header_text(page), offset, length, kind,
                            size, digest, None if to is None else header_text(to),
                        ))
                rows.sort(key=lambda r: (r[1], r[2], r[3] is not None, r[3] or "", r[4]))
                kinds = [pa.int64() if f.endswith("long") else pa.string() for f in _CAPTURE.split(", ")]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    number = archives.count()
    tasks = max(1, min(number, MOST_READERS), -(-number // ARCHIVES_A_TASK))
    # a stated number of partitions: the list itself is tiny, so measured sizes would put all archives into one task
    return shared_table(archives.select("path").repartition(tasks).mapInArrow(run, _CAPTURE), "capture-runs")


# ---------------------------------------------------------------- merge


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, so a step replays one path to the root."""

    def __init__(self, runs: list, key: Callable):
        self.key, self.runs = key, runs
        self.next = [0] * len(runs)
        self.heads = [self._head(r) for r in range(len(runs))]
        self.losers = [-1] * max(1, len(runs))
        for r in range(len(runs) - 1, -1, -1):
            self._play(r)

    def _head(self, r: int):
        """Exhausted runs lose every match; equal keys go to the earlier run."""
        at = self.next[r]
        return (1,) if at >= len(self.runs[r]) else (0, self.key(self.runs[r][at]), r)

    def _play(self, r: int) -> None:
        node = (r + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = r
                return
            if self.heads[other] < self.heads[r]:
                self.losers[node], r = r, other
            node //= 2
        self.losers[0] = r

    def __iter__(self) -> Iterator:
        while self.runs:
            r = self.losers[0]
            if self.heads[r] == (1,):
                return
            yield self.runs[r][self.next[r]]
            self.next[r] += 1
            self.heads[r] = self._head(r)
            self._play(r)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Captures in global order by (url key, date, page): ``part`` and ``position`` in it give the place.

    Runs are dealt by ranges of the full key, so a URL with very many captures spreads over several ranges. A range
    receives a slice of every run; a loser tree merges its slices. A task holds the index rows of one range, no payloads.
    """
    order = ["url_key", "date", "page", "offset"]
    schema = _CAPTURE + ", part int, position long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, slices = TaskContext.get().partitionId(), {}
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None:
            return
        url, date, page, offset = (table.column(c).to_pylist() for c in order)
        for i, name in enumerate(table.column("run").to_pylist()):
            slices.setdefault(name, []).append(i)
        key = lambda i: (url[i], date[i], page[i] is not None, page[i] or "", offset[i])
        merged = pa.array(LoserTree(list(slices.values()), key), pa.int64())
        done = 0
        for batch in table.take(merged).combine_chunks().to_batches(OUT_ROWS):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(done, done + n), pa.int64())], names)
            done += n

    ranged = runs.repartitionByRange(*order).sortWithinPartitions("run", *order)
    return shared_table(ranged.mapInArrow(run, schema), "captures")


def archive_captures(pages: DataFrame, captured: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, row: Column | None = None) -> DataFrame:
    """Archive the pages and index their captures: one row per page record, in columns of ``merge_runs`` with the page id
    and ``refers_to`` in the type of the table.

    ``captured`` is the time of a capture (to the second). Of pages with equal payloads (SHA-1 and length) of at least ``least_bytes`` bytes the one
    with the smallest id is a response, the others revisit it. Digests are counted before any exchange, and meet the pages
    without their html; the revisits found come back by row, so no join is keyed by a payload that a third of all pages
    share. Every column of the result is read back from the archives.

    ``row`` tells the rows of ``pages`` apart and must be the same whenever it is read (``common.file_row``); without
    it the columns used are written first.

    A null html is an empty payload; a null url has the key ``-``; pages with a null id are responses, as are rows
    that repeat the smallest id. An empty table gives an empty table. Other columns are not read.
    """
    kind = field_type(pages, id_col)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    date = F.date_format(F.coalesce(captured, F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), date.alias("date"), payload.alias("payload"), *([] if row is None else [row.alias("row")]))
    if row is None:
        rows = shared_table(rows, "captured").select("*", file_row().alias("row"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    slim = rows.where(F.col("id").isNotNull()).select("row", "id", "digest", F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= least_bytes)
    first = slim.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("digest", "bytes", "first")
    revisits = slim.join(first, ["digest", "bytes"]).where("id <> first").select("row", F.col("first").cast("string").alias("refers_to"))
    marked = rows.join(revisits, "row", "left").select(F.col("id").cast("string").alias("page"), "url", "date", "digest", "refers_to", "payload")
    captures = merge_runs(read_archives(write_archives(marked, shared_dir(pages.sparkSession, "warc"))))
    return captures.withColumns({"page": F.col("page").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("page", id_col)
