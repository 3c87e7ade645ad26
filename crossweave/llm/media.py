"""Operator 9: media columns. Stored bytes are sniffed by signature, checked by structure, and carved."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_type

# ---- fixed values: magic bytes of the formats and how far they stand from the start of the file
MAGIC = {
    "audio/wav": [(b"RIFF", 0)],
    "image/png": [(b"\x89PNG\r\n\x1a\n", 0)],
    "image/gif": [(b"GIF87a", 0), (b"GIF89a", 0)],
    "image/jpeg": [(b"\xff\xd8\xff", 0)],
    "image/bmp": [(b"BM", 0)],
    "application/pdf": [(b"%PDF-", 0)],
    "application/zip": [(b"PK\x03\x04", 0)],
    "application/gzip": [(b"\x1f\x8b\x08", 0)],
    "audio/flac": [(b"fLaC", 0)],
    "application/ogg": [(b"OggS", 0)],
    "video/mp4": [(b"ftyp", 4)],
}
END_MARKS = {"application/pdf": b"%%EOF", "application/zip": b"PK\x05\x06", "image/jpeg": b"\xff\xd9"}
# ---- end of fixed values

#: payload bytes come in whole blocks of so many samples, filled with this byte
BLOCK, FILL = 576, 255
SAMPLE_RATE = 8000
UNKNOWN = "application/octet-stream"


class Blob:
    """Bytes under search: where the end marks of some formats stand, and what chains of blocks are known to lead to, so
    that a block is walked once however many signatures lead to it."""

    def __init__(self, raw: bytes, ends: dict[str, list[int]]):
        self.raw, self.ends = raw, ends
        self.known: dict[str, dict[int, int]] = {}

    def next_end(self, kind: str, at: int) -> int:
        """First place of the format's end mark (or of a zero byte) from ``at`` on, or -1."""
        if kind == "zero" and kind not in self.ends:
            self.ends[kind] = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 0).tolist()
        places = self.ends.get(kind, [])
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def follow(self, kind: str, p: int, step: Callable[[bytes, int], tuple[int, int | None]]) -> int:
        """Where the chain of blocks from ``p`` ends (0: it breaks). ``step`` gives the next block, or the end."""
        known, path, end = self.known.setdefault(kind, {}), [], None
        while end is None:
            if p in known:
                end = known[p]
                break
            path.append(p)
            p, end = step(self.raw, p)
        for q in path:
            known[q] = end
        return end


def _wav(blob: Blob, at: int) -> int:
    """Length of a WAVE file whose chunks add up to its RIFF length, else 0."""
    b = blob.raw
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= end:
        name, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        seen.add(name)
        p += 8 + n + n % 2
    return end - at if p == end and {b"fmt ", b"data"} <= seen else 0


def _png_chunk(b: bytes, p: int) -> tuple[int, int | None]:
    if p + 12 > len(b):
        return p, 0
    n, name = struct.unpack_from(">I4s", b, p)
    stop = p + 12 + n
    if stop > len(b) or name == b"IHDR" or zlib.crc32(b[p + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
        return p, 0
    return (stop, stop) if name == b"IEND" else (stop, None)


def _png(blob: Blob, at: int) -> int:
    """The first chunk is a header of 13 bytes; every checksum fits up to the end chunk."""
    b, p = blob.raw, at + 8
    if b[p : p + 8] != b"\0\0\0\x0dIHDR" or len(b) < p + 25 or zlib.crc32(b[p + 4 : p + 21]) != struct.unpack_from(">I", b, p + 21)[0]:
        return 0
    return max(blob.follow("png", p + 25, _png_chunk) - at, 0)


def _gif_table(flags: int) -> int:
    return 3 << ((flags & 7) + 1) if flags & 128 else 0


def _gif_piece(b: bytes, p: int) -> tuple[int, int | None]:
    return (p + b[p] + 1, None) if p < len(b) and b[p] else (p, p + 1)


def _gif(blob: Blob, at: int) -> int:
    b = blob.raw
    if len(b) < at + 14:
        return 0
    pieces = lambda p: blob.follow("gif pieces", p, _gif_piece)

    def block(b: bytes, p: int) -> tuple[int, int | None]:
        if p >= len(b):
            return p, 0
        if b[p] == 0x3B:
            return p, p + 1
        if b[p] == 0x21:
            return pieces(p + 2), None
        if b[p] == 0x2C and p + 10 < len(b):
            return pieces(p + 10 + _gif_table(b[p + 9]) + 1), None
        return p, 0

    return max(blob.follow("gif", at + 13 + _gif_table(b[at + 10]), block) - at, 0)


def _jpeg(blob: Blob, at: int) -> int:
    def segment(b: bytes, p: int) -> tuple[int, int | None]:
        if p + 4 > len(b) or b[p] != 0xFF or not 0xC0 <= b[p + 1] <= 0xFE:
            return p, 0
        if b[p + 1] == 0xDA:
            return p, blob.next_end("image/jpeg", p) + 2 if blob.next_end("image/jpeg", p) >= 0 else 0
        return p + 2 + struct.unpack_from(">H", b, p + 2)[0], None

    return max(blob.follow("jpeg", at + 2, segment) - at, 0)


def _bmp(blob: Blob, at: int) -> int:
    b = blob.raw
    if len(b) < at + 26:
        return 0
    size, spare, start, header = struct.unpack_from("<IIII", b, at + 2)
    return size if spare == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(b) - at else 0


def _pdf(blob: Blob, at: int) -> int:
    if not re.match(rb"\d\.\d", blob.raw[at + 5 : at + 8]):
        return 0
    end = blob.next_end("application/pdf", at)
    return end + 5 - at if end >= 0 else 0


def _zip(blob: Blob, at: int) -> int:
    b, end = blob.raw, blob.next_end("application/zip", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    stop = end + 22 + note
    return stop - at if start + size == end - at and stop <= len(b) else 0


def _deflate(b: bytes, p: int) -> tuple[int, int | None]:
    """End of a deflate stream and its checksum and length."""
    unpack, q, size, check = zlib.decompressobj(-15), p, 256, 0
    total = 0
    try:
        while q < len(b) and not unpack.eof:
            out = unpack.decompress(b[q : q + size])
            check, total = zlib.crc32(out, check), total + len(out)
            q, size = q + size, 65536
    except zlib.error:
        return p, 0
    end = min(q, len(b)) - len(unpack.unused_data)
    return p, end + 8 if unpack.eof and b[end : end + 8] == struct.pack("<II", check, total & 0xFFFFFFFF) else 0


def _gzip(blob: Blob, at: int) -> int:
    """The header's optional fields are stepped over; hits that lead to one stream share it."""
    b, p = blob.raw, at + 10
    flags = b[at + 3] if at + 3 < len(b) else 0xE0
    if flags & 0xE0:
        return 0
    if flags & 4:
        p += 2 + int.from_bytes(b[p : p + 2], "little")
    for named in (8, 16):  # file name and comment end with a zero byte
        if flags & named:
            zero = blob.next_end("zero", p)
            if zero < 0:
                return 0
            p = zero + 1
    head = p + (2 if flags & 2 else 0)
    size = max(blob.follow("deflate", head, _deflate) - at, 0) if head < len(b) else 0
    if size and flags & 2 and b[p:head] != struct.pack("<H", zlib.crc32(b[at:p]) & 0xFFFF):
        return 0
    return size


def _flac_block(b: bytes, p: int) -> tuple[int, int | None]:
    if p + 4 > len(b):
        return p, 0
    q = p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
    if b[p] & 128:
        return p, len(b) if b[q : q + 1] == b"\xff" else 0  # frames carry no length: up to the end
    return q, None


def _flac(blob: Blob, at: int) -> int:
    b, p = blob.raw, at + 4
    if len(b) < p + 4 or b[p] & 127 or int.from_bytes(b[p + 1 : p + 4], "big") != 34:
        return 0
    return max(blob.follow("flac", p, _flac_block) - at, 0)


def _ogg_page(b: bytes, p: int) -> tuple[int, int | None]:
    if b[p : p + 5] != b"OggS\x00" or p + 27 > len(b):
        return p, 0
    n = b[p + 26]
    stop = p + 27 + n + sum(b[p + 27 : p + 27 + n])
    if stop > len(b):
        return p, 0
    return (p, stop) if b[p + 5] & 4 else (stop, None)


def _ogg(blob: Blob, at: int) -> int:
    return max(blob.follow("ogg", at, _ogg_page) - at, 0)


def _box(b: bytes, p: int) -> tuple[int, bytes]:
    """Length and name of the box at ``p``; length 0 if there is none."""
    if p + 8 > len(b):
        return 0, b""
    n, name = struct.unpack_from(">I4s", b, p)
    return (n, name) if n >= 8 and p + n <= len(b) and name.isalnum() else (0, b"")


def _mp4(blob: Blob, at: int) -> int:
    if _box(blob.raw, at)[1] != b"ftyp":
        return 0

    def box(b: bytes, p: int) -> tuple[int, int | None]:
        n, _ = _box(b, p)
        return (p + n, None) if n else (p, p)

    def movie(b: bytes, p: int) -> tuple[int, int | None]:
        n, name = _box(b, p)
        return (p, p) if name == b"moov" else (p + n, None) if n else (p, 0)

    return blob.follow("mp4", at, box) - at if blob.follow("mp4 movie", at, movie) else 0


VALIDATORS = {
    "audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "application/ogg": _ogg, "video/mp4": _mp4,
}

#: bytes that a signature's own neighbourhood must hold, by distance from the file's start: what many chance hits fail
NEAR = {
    "audio/wav": [(8, b"W"), (9, b"A"), (10, b"V"), (11, b"E")], "image/png": [(8, b"\0"), (11, b"\x0d"), (12, b"I"), (15, b"R")],
    "image/bmp": [(6, b"\0"), (7, b"\0"), (8, b"\0"), (9, b"\0"), (16, b"\0"), (17, b"\0")],
    "application/pdf": [(6, b".")], "application/ogg": [(4, b"\0")], "audio/flac": [(5, b"\0"), (6, b"\0"), (7, b"\x22")],
}


def possible(kind: str, data: np.ndarray, at: np.ndarray, ends: dict[str, list[int]]) -> np.ndarray:
    """The hits whose neighbouring bytes fit the format, all hits of a blob at once."""
    for place, byte in NEAR.get(kind, []):
        at = at[at + place < len(data)]
        at = at[data[at + place] == byte[0]]
    if kind == "image/jpeg":
        at = at[at + 3 < len(data)]
        at = at[(data[at + 3] >= 0xC0) & (data[at + 3] <= 0xFE)]
    elif kind == "image/gif":
        at = at[at + 13 < len(data)]
        flags = data[at + 10].astype(np.int64)
        block = at + 13 + np.where(flags & 128, 3 << ((flags & 7) + 1), 0)
        at, block = at[block < len(data)], block[block < len(data)]
        at = at[np.isin(data[block], (0x3B, 0x21, 0x2C))]
    elif kind in END_MARKS:
        at = at[at <= max(ends.get(kind, [-1]))]
    return at


def automaton() -> ahocorasick.Automaton:
    """All magic bytes and end marks, one character per byte. A word stands for (its length, formats that begin so far
    before it, format that ends with it)."""
    words: dict[bytes, list] = {}
    for kind, signatures in MAGIC.items():
        for magic, ahead in signatures:
            words.setdefault(magic, [[], None])[0].append((kind, ahead))
    for kind, mark in END_MARKS.items():
        words.setdefault(mark, [[], None])[1] = kind
    out = ahocorasick.Automaton()
    for word, (kinds, ends) in words.items():
        out.add_word(word.decode("latin-1"), (word, kinds, ends))
    out.make_automaton()
    return out


def sniff(raw: bytes, search: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Confirmed media in a blob: (type, start, length), by start; of those at one start the longest.

    One pass of the automaton finds signatures and end marks. Hits whose neighbouring bytes cannot fit go at once;
    the others are validated, along chains of blocks that are walked once.
    """
    places: dict[bytes, list[int]] = {}
    words: dict[bytes, tuple[list, str | None]] = {}
    for last, (word, kinds, ends) in search.iter(raw.decode("latin-1")):
        if word not in places:
            places[word], words[word] = [], (kinds, ends)
        places[word].append(last)
    if not places:
        return []
    blob = Blob(raw, {ends: [last + 1 - len(word) for last in places[word]] for word, (_, ends) in words.items() if ends})
    data, best = np.frombuffer(raw, np.uint8), {}
    for word, (kinds, _) in words.items():
        for kind, ahead in kinds:
            at = np.array(places[word], np.int64) + 1 - len(word) - ahead
            at = possible(kind, data, at[at >= 0], blob.ends)
            for p in at.tolist():
                if size := VALIDATORS[kind](blob, p):
                    best[p] = max(best.get(p, (0, "")), (size, kind))
    return [(kind, at, size) for at, (size, kind) in sorted(best.items())]


def carved(blob: bytes, found: list[tuple[str, int, int]], whole: str) -> list[dict]:
    """Findings with the digest of their bytes. One that begins inside another of its type has none, so a blob is
    digested once per type at most."""
    reach: dict[str, int] = {}
    out = []
    for kind, at, n in found:
        digest = None
        if at >= reach.get(kind, 0):
            reach[kind] = at + n
            digest = whole if n == len(blob) else hashlib.sha256(blob[at : at + n]).hexdigest()
        out.append({"media_type": kind, "start": at, "length": n, "sha256": digest})
    return out


def wav(payload: bytes) -> bytes:
    """Payload as one channel of 8-bit samples."""
    odd = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def wav_samples(blob: bytes, at: int, size: int) -> bytes:
    p = at + 12
    while p + 8 <= at + size:
        name, n = struct.unpack_from("<4sI", blob, p)
        if name == b"data":
            return blob[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    return b""


def bmp(payload: bytes) -> bytes:
    """Payload as grey pixels of 8 bits, rows of one block from the top."""
    grey = b"".join(bytes((k, k, k, 0)) for k in range(256))
    start = 54 + len(grey)
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(payload), 0, start, 40, BLOCK, -(len(payload) // BLOCK), 1, 8, 0, len(payload), 0, 0, 256, 0)
    return head + grey + payload


def bmp_pixels(blob: bytes, at: int, size: int) -> bytes:
    return blob[at + struct.unpack_from("<I", blob, at + 10)[0] : at + size]


def png(payload: bytes) -> bytes:
    """Payload as grey pixels of 8 bits, rows of one block."""
    chunk = lambda name, data: struct.pack(">I4s", len(data), name) + data + struct.pack(">I", zlib.crc32(name + data))
    rows = np.zeros((len(payload) // BLOCK, BLOCK + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    head = struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)
    return MAGIC["image/png"][0][0] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def png_pixels(blob: bytes, at: int, size: int) -> bytes:
    """Pixels of an 8-bit grey image without filters; of any other image its bytes."""
    width, height, *form = struct.unpack_from(">IIBBBBB", blob, at + 16)
    p, data = at + 33, []
    while p + 12 <= at + size:
        n, name = struct.unpack_from(">I4s", blob, p)
        if name == b"IDAT":
            data.append(blob[p + 8 : p + 8 + n])
        p += 12 + n
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error:
        return blob[at : at + size]
    if form != [8, 0, 0, 0, 0] or len(rows) != height * (width + 1) or rows[:: width + 1].any():
        return blob[at : at + size]
    return rows.reshape(height, width + 1)[:, 1:].tobytes()


def boxed(name: str, blob: bytes) -> bytes:
    """A ZIP archive of one file, stored as it is."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(name), blob)
    return out.getvalue()


#: forms a payload of samples can be stored in, and how they are read back
WRITERS = {"audio/wav": wav, "image/bmp": bmp, "image/png": png}
READERS = {"audio/wav": wav_samples, "image/bmp": bmp_pixels, "image/png": png_pixels}


def stored(payload: bytes) -> tuple[str, bytes]:
    """(declared type, blob) of a payload, both chosen by its checksum: one of three forms, in one of four cases inside an
    archive, and in another one of four declared as the next form."""
    kinds, draw = list(WRITERS), zlib.crc32(payload)
    kind = kinds[draw % 3]
    blob = WRITERS[kind](payload)
    declared = kinds[(draw + 1) % 3] if draw >> 8 & 3 == 0 else kind
    return declared, boxed("payload", blob) if draw >> 16 & 3 == 0 else blob


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mixed: bool = False) -> DataFrame:
    """A media column from texts: id, ``n_bytes``, ``declared`` type, ``media``. UTF-8 bytes filled up to a positive
    multiple of 576 become 8-bit samples of a WAVE file of undeclared type, or, if ``mixed``, what ``stored`` makes of
    them: sound or image, some in archives, some with a wrong declared type. Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kinds, blobs = [], [], []
            for value in batch.column(1):
                raw = (value.as_py() or "").encode()
                payload = raw + bytes([FILL]) * ((-len(raw)) % BLOCK if raw else BLOCK)
                kind, blob = stored(payload) if mixed else (UNKNOWN, wav(payload))
                sizes.append(len(raw))
                kinds.append(kind)
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(kinds, pa.string()), pa.array(blobs, pa.binary())], ["id", "n_bytes", "declared", "media"]
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {field_type(docs, id_col)}, n_bytes long, declared string, media binary"
    )
    return out.withColumnRenamed("id", id_col)


def sniff_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """One row per media row: id, ``media_type`` (confirmed at the start of the blob, else the declared one, else
    unknown), ``corrected`` (it differs from the declared one), ``carved`` (type, start, length and SHA-256 of everything
    confirmed inside, itself included; no SHA-256 inside another of the type), ``media_bytes``, ``media_sha256``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``
    (last 32 payload bytes). The payload is the samples of the first confirmed WAVE, BMP or grey PNG file, be it inside
    an archive; without one the blob itself.

    An Aho-Corasick automaton finds all magic bytes in one pass over a blob; a format's validator then has to
    confirm structure and lengths, so chance hits in a text are no media. Each row is handled alone: no shuffle.
    Null blobs count as empty and are of the declared type; repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for value, said in zip(batch.column(1), batch.column(2), strict=True):
                blob, declared = value.as_py() or b"", said.as_py()
                found = sniff(blob, search)
                kind = next((k for k, at, _ in found if at == 0), None)
                payload = next((READERS[k](blob, at, n) for k, at, n in found if k in READERS), blob)
                whole = hashlib.sha256(blob).hexdigest()
                row = (
                    kind or declared or UNKNOWN, kind is not None and kind != declared,
                    carved(blob, found, whole), len(blob), whole,
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                )
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            listed = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())]))
            kinds = [pa.string(), pa.bool_(), listed, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], ["id", *names])

    names = ["media_type", "corrected", "carved", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32"]
    types = ["string", "boolean", "array<struct<media_type:string,start:long,length:long,sha256:string>>", "long", "string", "long", "string", "long"]
    schema = f"id {field_type(media, id_col)}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    declared = F.col(declared_col).cast("string") if declared_col in media.columns else F.lit(None).cast("string")
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"), declared.alias("declared")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
