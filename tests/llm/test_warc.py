"""Archives, their records, and the merged capture index."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from crossweave.llm import warc
from crossweave.llm.common import file_row
from crossweave.llm.warc import LoserTree, archive_captures, header_text, header_value, members, parse, record, url_key



def captured():
    return F.timestamp_seconds(F.lit(1_000_000_000) + F.coalesce(F.col("page_id"), F.lit(0)) % 3)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
    assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_loser_tree_keeps_the_order_of_runs_for_equal_keys():
    runs = [[(1, "a"), (2, "a")], [(1, "b"), (1, "c")], [(0, "d"), (2, "d")]]
    assert list(LoserTree(runs, lambda x: x[0])) == [(0, "d"), (1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "d")]


def test_records_are_gzip_members():
    blobs = [record("1", "http://a/\r\nb %41", "2001-01-01T00:00:00Z", b"\r\n\r\nx" * 9000, "D", None), record(None, None, "2001-01-01T00:00:00Z", b"abc", "E", "7")]
    found = list(members(io.BytesIO(b"".join(blobs))))
    assert [(o, n) for o, n, _ in found] == [(0, len(blobs[0])), (len(blobs[0]), len(blobs[1]))]
    assert gzip.decompress(b"".join(blobs)) == b"".join(c for _, _, c in found)
    fields, http, payload = parse(found[0][2])
    assert payload == b"\r\n\r\nx" * 9000 and header_text(fields["warc-target-uri"]) == "http://a/\r\nb %41"
    fields, http, payload = parse(found[1][2])
    assert fields["warc-type"] == "revisit" and payload == b"" and http["content-length"] == "3" and "x-page-id" not in fields


def test_cut_archives_are_noticed():
    blob = record("1", None, "2001-01-01T00:00:00Z", b"abc" * 100, "D", None)
    with pytest.raises(ValueError):
        list(members(io.BytesIO(blob[:-9])))


def test_headers_and_keys():
    for text in ["", "a b", "é%20\t", "%0A", "100%"]:
        assert header_text(header_value(text)) == text
    assert url_key("HTTPS://user@WWW.Example.com:443/A/?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert url_key("http://b.example.com:8080") == "com,example,b:8080)/"
    assert url_key(None) == url_key("") == "-"


@pytest.mark.parametrize("size", [1, 16 << 20])
def test_pages(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    html = [None, "", "x", "x", "é" * 500, "y" * 300_000, "x", "\r\n\r\n", "é" * 500, "z\x00"]
    rows = [(i, f"http://h{i % 3}.org/{'a' if i % 2 else 'b'}", h, "k") for i, h in enumerate(html)] + [(None, None, "x", "k"), (2, "http://u", "x", "k"), (30, "bad url\n", "q", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = archive_captures(pages, captured()).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, u, h, _ in rows:
        raw = (h or "").encode()
        to = first[h or ""] if i is not None and i != first[h or ""] else None
        want.append((i, url_key(u), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if to is not None else "response", to))
    assert sorted(((r.page_id, r.url_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    placed = sorted(got, key=lambda r: (r.part, r.position))
    keys = [(r.url_key, r.date) for r in placed]
    assert keys == sorted(keys) and len({(r.part, r.position) for r in got}) == len(got)
    assert archive_captures(pages.limit(0), captured()).count() == 0


def test_a_payload_of_a_third_of_the_pages(spark, tmp_path, monkeypatch):
    """Many archives are read by as many tasks, and no join is keyed by the shared payload."""
    shared = "<html>" + "same " * 2000
    rows = [(i, f"http://h{i % 7}.org/{i}", shared if i % 3 == 0 else f"own {i}") for i in range(600)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages")).withColumn("file", F.lit("clash"))
    seen = []
    monkeypatch.setattr(warc, "read_archives", lambda archives, read=warc.read_archives: seen.append((archives.count(), read(archives))) or seen[0][1])
    got = {r.page_id: r.refers_to for r in archive_captures(pages, captured(), row=file_row()).collect()}
    assert got == {i: 0 if i % 3 == 0 and i else None for i in range(600)}
    number, runs = seen[0]
    assert number > 1 and len([f for f in runs.inputFiles()]) == number


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in archive_captures(pages, captured(), least_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
