"""Operator 10: byte-pair encoding and decoding through a table of distinct words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import SpacedSplitter, Vocabulary
from .common import field_type, shared_dir, shared_table

#: bounds of the broadcast part of the word table: number of words, and bytes of a word in it
FREQUENT_WORDS = 1 << 18
FREQUENT_BYTES = 64
#: words a task counts before it hands its counts on
COUNTED_WORDS = 250_000
#: documents whose ids and texts a task holds before it hands them on
OUT_ROWS = 250


def _words(vocabulary: Vocabulary, split: SpacedSplitter, text: str) -> list[str]:
    """All words of a text in order; a special string is one word."""
    pieces = vocabulary.pieces(text)
    if len(pieces) == 1 and not pieces[0][0]:
        return split(text)
    return [w for special, part in pieces for w in ((part,) if special else split(part))]


def pieces(vocabulary: Vocabulary) -> list[bytes]:
    """Bytes of each id; as long as the vocabulary."""
    back = {c: b for b, c in enumerate(vocabulary.byte)}
    out = [b""] * (1 + max([*vocabulary.ids.values(), *vocabulary.special.values()]))
    for s, i in vocabulary.ids.items():
        out[i] = bytes(bytearray(back[c] for c in s))
    for s, i in vocabulary.special.items():
        out[i] = s.encode()
    return out


def word_table(texts: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(word, n, ids) of the distinct words with their count and ids (little-endian unsigned 32 bits), and (word, split,
    ids) of each word in each input split that holds it.

    A task sends each of its words once, with a count and its own number, so a frequent word is one row per task. The
    rows of a word then come one after the other: it is encoded at the first, counted up to the last, and its splits
    are rows all along, however many.
    """
    shared = texts.sparkSession.sparkContext.broadcast(source)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split, seen = Vocabulary(shared.value), SpacedSplitter(), Counter()
        task = TaskContext.get().partitionId()

        def rows():
            words = sorted(seen)
            columns = [pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64()), pa.array([task] * len(words), pa.int32())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n", "split"])

        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if text:
                    seen.update(_words(vocabulary, split, text))
                if len(seen) > COUNTED_WORDS:
                    yield rows()
        yield rows()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        word, ids, total = None, b"", 0

        def rows(words, n, splits, ids):
            whole = [s is None for s in splits]
            columns = [pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(splits, pa.int32()), pa.array(ids, pa.binary()), pa.array(whole, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n", "split", "ids", "whole"])

        for batch in batches:
            out: list[list] = [[], [], [], []]

            def put(*row, out=out):
                for column, x in zip(out, row, strict=True):
                    column.append(x)

            for w, n, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if w != word:
                    if word is not None:
                        put(word, total, None, ids)
                    word, ids, total = w, vocabulary.word_ids(w), 0
                total += n
                put(w, n, s, ids)
            yield rows(*out)
        if word is not None:
            yield rows([word], [total], [None], [ids])

    counted = texts.mapInArrow(count, "word string, n long, split int").repartition("word").sortWithinPartitions("word")
    path = shared_dir(texts.sparkSession, "words")
    counted.mapInArrow(encode, "word string, n long, split int, ids binary, whole boolean").write.partitionBy("whole").option("compression", "zstd").parquet(path)
    table = texts.sparkSession.read.schema("word string, n long, split int, ids binary, whole boolean").parquet(path)
    return table.where("whole").select("word", "n", "ids"), table.where("not whole").select("word", "split", "ids")


def count_level() -> Column:
    """Steps of the word counts, sixteen per power of two."""
    return F.floor(F.log2(F.col("n").cast("double")) * 16)


def frequent_words(words: DataFrame, most: int = FREQUENT_WORDS) -> DataFrame:
    """The words above a count that at most ``most`` words reach; words over the byte bound stay out."""
    level = count_level()
    short = words.where(F.octet_length("word") <= FREQUENT_BYTES)
    steps = sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True)  # at most 16 rows per power of two
    total, bound = 0, float("inf")
    for step in steps:
        total += step["count"]
        if total > most:
            break
        bound = step["level"]
    return short.where(level >= bound)


def encode_decode(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
    frequent: int = FREQUENT_WORDS, report: bool = False,
) -> DataFrame:
    """One row per document: id, carried columns, ``ids`` (little-endian unsigned 32-bit), ``decoded`` text, and with
    ``report`` the number of words ``in_place`` that no table held.

    The word table is joined back in two ways. Its most frequent words (a stated number of bounded words) are
    broadcast, which also takes the hot keys out of every exchange. The others are sent to the input splits that hold
    them: one dictionary file per split in the shared folder, never larger than the words of the split. The last
    pass takes the ids of each word by position, and decodes by joining every id with the id-to-piece table,
    which is as long as the vocabulary. Texts are never shuffled.

    Both passes read ``docs`` as the same splits. Should a split differ (another plan, other settings), a word that its
    dictionary lacks is encoded where it stands and reported, so results never depend on it.

    Null and empty texts have no ids and decode to the empty text. Repeated rows, null ids and extra columns are kept
    as they are; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        source = f.read()
    words, places = word_table(docs.select(F.col(text_col).alias("text")), source)
    often = frequent_words(words, frequent)
    table = often.select("word", "ids").toArrow()
    shared = spark.sparkContext.broadcast(source)
    dictionary = spark.sparkContext.broadcast((table.column("word").to_pylist(), table.column("ids").to_pylist()))
    others = places.join(F.broadcast(often.select("word")), "word", "left_anti").select("split", "word", "ids")  # at most ``frequent`` bounded words
    folder = shared_dir(spark, "split-words")
    others.repartition("split").write.partitionBy("split").option("compression", "zstd").parquet(folder)

    kind = field_type(docs, id_col)
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    kinds = "".join(f", c{i} {field_type(docs, c)}" for i, c in enumerate(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = Vocabulary(shared.value), SpacedSplitter()
        piece = pa.array(pieces(vocabulary), pa.large_binary())
        known = WordIds(vocabulary, zip(*dictionary.value, strict=True))
        store, path = pa.fs.FileSystem.from_uri(f"{folder}/split={TaskContext.get().partitionId()}")
        for info in store.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.endswith(".parquet"):
                with store.open_input_file(info.path) as f:
                    own = pq.read_table(f, columns=["word", "ids"])
                known.update(zip(own.column("word").to_pylist(), own.column("ids").to_pylist(), strict=True))
        look = known.__getitem__
        for batch in (whole.slice(lo, OUT_ROWS) for whole in batches for lo in range(0, whole.num_rows, OUT_ROWS)):
            ids, texts, missed = [], [], []
            for value in batch.column(1):
                known.missed = 0
                joined = b"".join(map(look, _words(vocabulary, split, value.as_py() or "")))
                ids.append(joined)
                missed.append(known.missed)
                texts.append(_joined(piece.take(pa.array(np.frombuffer(joined, "<u4")))).decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string()), pa.array(missed, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded", "in_place", *batch.schema.names[2:]])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *kept).mapInArrow(run, f"id {kind}, ids binary, decoded string, in_place long{kinds}")
    return out.select(F.col("id").alias(id_col), "ids", "decoded", *(["in_place"] if report else []), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


class WordIds(dict):
    """Ids of words by position in a text; a word without an entry is encoded in place."""

    def __init__(self, vocabulary: Vocabulary, entries):
        super().__init__(entries)
        self.vocabulary, self.missed = vocabulary, 0

    def __missing__(self, word: str) -> bytes:
        self.missed += 1
        return self.vocabulary.word_ids(word)


def _joined(column: pa.Array) -> bytes:
    """All values of a binary column as one: its data buffer."""
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return b""
    ends = np.frombuffer(offsets, np.int64)
    return data[int(ends[column.offset]) : int(ends[column.offset + len(column)])].to_pybytes()
