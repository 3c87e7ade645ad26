"""Stored texts, signature sniffing and carving."""

import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest

from crossweave.llm import media
from crossweave.llm.media import automaton, carved, sniff, sniff_media, store_texts, wav


def png():
    chunk = lambda n, d: struct.pack(">I4s", len(d), n) + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02xyz\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 30, 0, 26, 12) + b"\0" * 8 + b"\1\2\3\4"
PDF = b"%PDF-1.4\nx\n%%EOF"
MP4 = struct.pack(">I4s4s", 12, b"ftyp", b"isom") + struct.pack(">I4s", 8, b"moov")
OGG = b"OggS\0\x04" + b"\0" * 20 + b"\x01\x03abc"
FLAC = b"fLaC\x80" + (34).to_bytes(3, "big") + b"\0" * 34 + b"\xff\xf8"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


CASES = {
    "audio/wav": wav(b"abc"), "image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF,
    "application/zip": zipped(), "application/gzip": gzip.compress(b"hi" * 50), "audio/flac": FLAC, "application/ogg": OGG, "video/mp4": MP4,
}


@pytest.mark.parametrize("kind", CASES)
def test_every_format_is_confirmed_and_carved(kind):
    blob, search = CASES[kind], automaton()
    assert (kind, 0, len(blob)) in sniff(blob, search)
    assert (kind, 7, len(blob)) in sniff(b"prefix " + blob, search)
    cut = blob[: len(blob) // 2]
    assert all(k != kind for k, _, _ in sniff(cut, search)) or kind == "audio/flac"


def test_formats_and_validators_agree():
    assert set(media.MAGIC) == set(media.VALIDATORS) == set(CASES)


def test_chance_hits_are_no_media():
    assert sniff(b"BM RIFF GIF89a PK\x03\x04 %PDF-x \xff\xd8\xff ftyp OggS fLaC", automaton()) == []


def test_texts_round_trip(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "RIFF GIF89a %PDF-1.4 %%EOF", "a", "y" * 100_000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "n", "c")], "doc_id long, text string, media string")
    stored = store_texts(docs)
    rows = {r.doc_id: r for r in stored.collect()}
    found = {r.doc_id: r for r in sniff_media(stored).collect()}
    for i, t in [*enumerate(texts), (None, "n")]:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        f = found[i]
        assert (rows[i].n_bytes, f.payload_bytes, f.media_type, f.corrected) == (len(raw), len(payload), "audio/wav", True)
        assert f.payload_sha256 == hashlib.sha256(payload).hexdigest() and f.tail_crc32 == zlib.crc32(payload[-32:])
        assert f.media_bytes == len(rows[i].media) and f.media_sha256 == hashlib.sha256(rows[i].media).hexdigest()
    assert [c.media_type for c in found[5].carved] == ["audio/wav", "application/pdf"]
    assert found[2].media_sha256 == found[6].media_sha256
    assert sniff_media(store_texts(docs.limit(0))).count() == 0


@pytest.mark.parametrize("mark", [m for kinds in media.MAGIC.values() for m, _ in kinds])
@pytest.mark.parametrize("tail", [b"", b"1.4 "])
def test_long_runs_of_magic_bytes(mark, tail):
    """Linear in the blob: twice the bytes take about twice the time, with the end marks behind them all."""
    search = automaton()

    def seconds(n):
        blob = (mark + tail) * (n // len(mark + tail)) + b"%%EOF PK\x05\x06" + b"\0" * 18 + b"\xff\xd9"
        began = time.perf_counter()
        sniff(blob, search)
        return time.perf_counter() - began

    seconds(50_000)
    assert seconds(1_600_000) < max(16 * min(seconds(200_000), seconds(200_000)), 1.0)


def test_findings_of_one_type_inside_another_have_no_digest():
    blob = PDF[:-5] * 3 + PDF
    found = sniff(blob, automaton())
    listed = carved(blob, found, "whole")
    assert [(x["start"], x["sha256"]) for x in listed] == [(0, "whole"), *[(at, None) for _, at, _ in found[1:]]] and len(found) == 4


@pytest.mark.parametrize("kind", media.WRITERS)
def test_payloads_come_back_from_every_form(spark, kind):
    payload = bytes(range(256)) * 9
    blob = media.WRITERS[kind](payload)
    rows = [(1, blob, kind), (2, media.boxed("payload", blob), "image/gif"), (3, b"xx" + blob, None)]
    out = {r.doc_id: r for r in sniff_media(spark.createDataFrame(rows, "doc_id int, media binary, declared string")).collect()}
    assert {i: (r.payload_sha256, r.media_type, r.corrected) for i, r in out.items()} == {
        1: (hashlib.sha256(payload).hexdigest(), kind, False), 2: (hashlib.sha256(payload).hexdigest(), "application/zip", True),
        3: (hashlib.sha256(payload).hexdigest(), "application/octet-stream", False)}
    assert [c.sha256 for c in out[2].carved if c.media_type == kind] == [hashlib.sha256(blob).hexdigest()]


def test_mixed_store(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "repeat(concat('text ', id), 1 + id * 3) as text")
    found = sniff_media(store_texts(docs, mixed=True)).collect()
    assert {r.media_type for r in found} == {"audio/wav", "image/bmp", "image/png", "application/zip"}
    assert 0.2 < sum(r.corrected for r in found) / 200 < 0.7
    for r in found:
        raw = (f"text {r.doc_id}" * (1 + r.doc_id * 3)).encode()
        assert r.payload_sha256 == hashlib.sha256(raw + b"\xff" * (-len(raw) % 576)).hexdigest()


def test_declared_types(spark):
    rows = [(1, CASES["image/png"], "image/jpeg"), (2, b"plain", "text/plain"), (3, None, None), (4, CASES["image/gif"], "image/gif")]
    out = {r.doc_id: (r.media_type, r.corrected) for r in sniff_media(spark.createDataFrame(rows, "doc_id int, media binary, declared string")).collect()}
    assert out == {1: ("image/png", True), 2: ("text/plain", False), 3: ("application/octet-stream", False), 4: ("image/gif", False)}
