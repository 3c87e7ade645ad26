"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bpe_table import encode_decode
from .common import file_row, shared_table, table
from .decontaminate import decontaminate
from .divergence import source_divergence
from .fill_middle import fill_in_middle, restored
from .labels import held_out
from .line_dedup import line_dedup
from .media import sniff_media, store_texts
from .ngram_join import jaccard_groups
from .preferences import format_preferences, swapped_answers
from .quality import score_quality
from .registry import query
from .toxicity import score_toxicity
from .simhash import near_duplicates
from .token_counts import count_tokens
from .warc import archive_captures


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_bpe_encode_decode")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


@query("op9_media_columns")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = shared_table(store_texts(table(spark, sf_dir, "documents"), mixed=True).withColumn("key", F.struct("doc_id", "n_bytes", "declared")), "media")
    found = sniff_media(stored, id_col="key").select("key.*", "*").drop("key")
    inside = F.array_join(F.transform("carved", lambda c: F.concat_ws(":", c["media_type"], c["start"], c["length"], F.substring(c["sha256"], 1, 16))), ",")
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(";", "declared", "media_type", F.col("corrected").cast("string"), inside).alias("feature"),
    )


def decided(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    predicted = (F.col("score") >= 0.3).cast("int")
    return scored.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", predicted.alias("predicted"))


@query("op3_quality_discriminant")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 5, 0)


@query("op5_toxicity_weak_supervision")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 4, 2)


@query("op6_benchmark_decontamination", sql=oracles.DECONTAMINATION)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_line_chunk_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), passages=True, row=file_row())
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    return out.select(
        "doc_id", F.size("removed").cast("long").alias("removed_chunks"), cut.alias("removed_bytes"),
        F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"),
    )


@query("op4_warc_index_merge", sql=oracles.WARC)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no capture time: one page a second
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))
    return archive_captures(table(spark, sf_dir, "pages"), captured, row=file_row()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_preference_formatting", sql=oracles.PREFERENCES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = format_preferences(turns, swapped_answers(turns), pair_col="conv_id")
    spans = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",").alias(name)
    return out.withColumnRenamed("conv_id", "pair_id").select(
        "pair_id", "status", "prefix_turns", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask")
    )


@query("op11_jaccard_join", sql=oracles.JACCARD)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), row=file_row())


@query("op12_source_divergence", sql=oracles.DIVERGENCE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), row=file_row())


@query("op13_fill_in_middle", sql=oracles.FILL_IN_MIDDLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256")
    )
