"""A training corpus from raw documents: five stages, each one operator over all rows its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.bpe_table import encode_decode
from crossweave.llm.common import file_row, folders_used, remove_folders, shared_table, table
from crossweave.llm.decontaminate import decontaminate
from crossweave.llm.line_dedup import line_dedup
from crossweave.llm.simhash import near_duplicates
from crossweave.llm.toxicity import fit_toxicity, keep_below

TOXIC = 0.3

#: no stage but decontamination is expressible in SQL
ORACLE_SQL = None


def _key() -> Column:
    """What tells rows apart: id (null ones last), and the place in the written stage input, so that rows that repeat id
    and text are told apart too."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), file_row().alias("row"))


def _packed(docs: DataFrame, leave: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list[str]]:
    """(doc_id, text, rest), and the names of the other columns: they travel as fields of ``rest``, beside the row, so that
    no name of theirs meets one of an operator's."""
    names = [c for c in docs.columns if c not in leave]
    rest = F.struct(file_row().alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return docs.select("doc_id", "text", rest.alias("rest")), names


def _unpacked(names: list[str]) -> list[Column]:
    return [F.col(f"rest.c{i}").alias(c) for i, c in enumerate(names)]


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose key is not in ``keys`` (key). The keys are the few documents to drop: Spark broadcasts them if
    they measure small, else the documents travel once."""
    rows, names = _packed(docs)
    left = rows.join(keys.select(F.col("key.row").alias("drop")), F.col("rest.row") == F.col("drop"), "left_anti")
    return left.select("doc_id", "text", *_unpacked(names)).select(*[f"`{c}`" for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more by the weakly supervised classifier go."""
    model, _ = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return keep_below(docs, model, TOXIC)


def repeats(docs: DataFrame) -> DataFrame:
    """(drop) of the rows that repeat id and text of an earlier one. Counted before the exchange; the groups of several
    rows are few and meet the rows without their text."""
    rows = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), file_row().alias("drop"))
    several = rows.groupBy("id", "digest").agg(F.count("*").alias("n"), F.min("drop").alias("first")).where("n > 1 and digest is not null").alias("b")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.digest") == F.col("b.digest"))
    return rows.alias("a").join(several, same).where("drop <> first").select("drop")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks and passages go; so do rows that repeat id and text, of which short ones would leave a rest,
    and documents of which nothing but white space is left. ``n_chars`` follows the text."""
    rows, names = _packed(docs)
    out = line_dedup(rows, carry=("rest",), passages=True, row=F.col("rest.row"))
    changed = F.size("removed") > 0
    out = out.where(~changed | F.col("text").rlike(r"\S")).join(repeats(docs), F.col("rest.row") == F.col("drop"), "left_anti")
    n_chars = lambda old: F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    columns = [n_chars(c).alias(name) if name == "n_chars" else c for name, c in zip(names, _unpacked(names), strict=True)]
    return out.select("doc_id", "text", *columns).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, of rows that repeat an id one."""
    groups = near_duplicates(docs.select(_key().alias("key"), "text"), id_col="key")
    return _without(docs, groups.where("key <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    hits = decontaminate(docs.select(_key().alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    return _without(docs, hits.where("n_hit > 0"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32 bits), their number, and the text as decoded from them; columns ``n_tokens`` and
    ``token_ids`` of the input are replaced."""
    rows, names = _packed(docs, ("doc_id", "text", "n_tokens", "token_ids"))
    out = encode_decode(rows, public_tokenizers.path("byte_bpe_50k.json"), carry=("rest",))
    tokens = F.floor(F.octet_length("ids") / 4).alias("n_tokens")
    return out.select("doc_id", F.col("decoded").alias("text"), *_unpacked(names), tokens, F.col("ids").alias("token_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's rows are written to the shared folder and read again. When they
    are written, its input and what it wrote on its way are deleted."""
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with folders_used() as used:
            docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove_folders(spark, held + used[:-1])
        held = used[-1:]
    return docs
