"""Operator 8: token counts by heap-and-linked-list pair merging, without identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LowerSplitter, Vocabulary
from .common import field_type

#: words whose count a task remembers; a full memory is emptied, never a limit on words
REMEMBERED_WORDS = 400_000


class _Counts(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        n = self[word] = self.vocabulary.count(word)
        return n


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Each task splits its texts into words and merges each word's symbols: the lowest-ranked adjacent pair leaves the
    heap first, leftmost among equals, and the count is symbols minus merges. There is no shuffle, and memory is one
    batch of texts plus the remembered word counts. The vocabulary has a fixed size and travels as a broadcast.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids stay as they are; other columns are
    not read; an empty table gives an empty table. Special strings in a text count as one token each.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = Vocabulary(shared.value), LowerSplitter()
        counts = _Counts(vocabulary)
        one = counts.__getitem__
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(sum(1 if special else sum(map(one, split(part))) for special, part in vocabulary.pieces(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {field_type(docs, id_col)}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
