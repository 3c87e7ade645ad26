"""Operator 13: fill-in-the-middle documents. Cuts between characters are found on 64-bit words of the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field_type

# ---- fixed values: marks of the three parts, and shares (percent) of plain documents and of suffix-first ones
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
KEEP_FROM, SUFFIX_FIRST_BELOW = 90, 20
# ---- end of fixed values

#: bytes marked at once; a longer text is marked alone
STRETCH = 1 << 22

_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def unit_ends(words: np.ndarray) -> np.ndarray:
    """For bytes viewed as little-endian 64-bit words: a one in the lowest bit of every byte that ends a character, that is,
    whose next byte does not continue one (10xxxxxx). After the last word a character begins."""
    starts = (~(words >> np.uint64(7)) | (words >> np.uint64(6))) & _ONES
    after = np.r_[starts[1:], _ONES] if len(starts) else starts
    return (starts >> np.uint64(8)) | (after << np.uint64(56))


def select_end(marks: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Bytes of each word up to and with its ``rank``-th mark (1 to 8): running counts of all bytes by one product, then
    the bytes whose count is below the rank are counted."""
    running = marks * _ONES
    reached = (running | _TOPS) - rank.astype(np.uint64) * _ONES
    return 9 - np.bitwise_count(reached & _TOPS).astype(np.int64)


class UnitIndex:
    """Characters of UTF-8 bytes: how many end in a byte range, and where the k-th after a place ends."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(-(-len(data) // 8) * 8 + 8, np.uint8)
        padded[: len(data)] = data
        self.marks = unit_ends(padded.view("<u8"))
        self.total = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Characters that end before byte ``at``."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        part = self.marks[word] & ((np.uint64(1) << (inside * np.uint64(8))) - np.uint64(1))
        return np.r_[0, self.total][word] + np.bitwise_count(part)

    def end_of(self, k: np.ndarray) -> np.ndarray:
        """First byte after the k-th character of all (0: the beginning)."""
        word = np.searchsorted(self.total, k, "left")
        rank = k - np.r_[0, self.total][word]
        return np.where(k > 0, word * 8 + select_end(self.marks[word], np.maximum(rank, 1)), 0)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of each text, of its prefix and middle, and the bytes where the prefix and the middle end."""
    index = UnitIndex(data)
    base = index.before(offsets)
    n = np.diff(base)
    a, b = first % (n + 1), second % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    place = lambda k: np.where(k > 0, index.end_of(base[:-1] + k), offsets[:-1])
    return n, low, high - low, place(low), place(high)


def draws(id_col: str) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of ``1:`` and the id as text (a null id: nothing after the colon)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n`` (characters), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (null
    if plain), ``output``.

    Two draws choose the cuts, a third whether the text stays plain, a fourth which part comes first. Texts that are empty
    or hold one of the marks are plain. A batch of texts is one run of bytes: ends of characters are marked by
    arithmetic on 64-bit words and counted per word; a cut is searched in the running counts, then inside its word. Each
    row is handled alone: no shuffle, and a task holds a batch.

    A null text counts as empty. Repeated rows and null ids keep a row each, of which equal ones are cut alike; an empty
    table gives an empty table; other columns are not read.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _buffers(batch.column(1))
            i, rows = 0, batch.num_rows
            while i < rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STRETCH, "right")) - 1)
                draw = [batch.column(2 + k).slice(i, j - i).to_numpy() for k in range(4)]
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n, prefix, middle, first, second = _cuts(part, at, *draw[:2])
                raw, forms, outs = part.tobytes(), [], []
                cut = zip(at[:-1].tolist(), first.tolist(), second.tolist(), at[1:].tolist(), (draw[2] % 100).tolist(), (draw[3] % 100).tolist(), strict=True)
                for start, a, b, stop, keep, turn in cut:
                    text = raw[start:stop]
                    if not text or keep >= KEEP_FROM or any(m in text for m in marks):
                        forms.append("plain")
                        outs.append(text)
                        continue
                    parts = [marks[0] + raw[start:a], marks[1] + raw[b:stop]]
                    forms.append("spm" if turn < SUFFIX_FIRST_BELOW else "psm")
                    outs.append(b"".join([*(parts[::-1] if turn < SUFFIX_FIRST_BELOW else parts), marks[2], raw[a:b]]))
                plain = np.array([f == "plain" for f in forms])
                columns = [
                    batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=plain),
                    pa.array(middle, pa.int64(), mask=plain), pa.array(outs, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                i = j

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *draws(id_col))
    schema = f"id {field_type(docs, id_col)}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from an output and its form: the parts between the marks, in their order. A mark cannot arise where two parts
    meet, as texts hold none and a mark neither begins nor ends inside another."""
    out, p, s, m = F.col(output), F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    between = lambda a, b: F.substr(F.substring_index(out, b, 1), F.instr(out, a) + 3)
    after = lambda a: F.substr(out, F.instr(out, a) + 3)
    psm = F.concat(between(p, SUFFIX), after(m), between(s, MIDDLE))
    spm = F.concat(between(p, MIDDLE), after(m), between(s, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
