"""Operator 1: preference pairs as one prompt and two masked completions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

# ---- fixed values: chat template
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
# ---- end of fixed values


def _harmless(value: Column) -> Column:
    """Template marks inside a text would end its turn: they get a space."""
    return F.replace(value, F.lit("<|im_"), F.lit("<| im_"))


def turns_by_pair(rows: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str, side: int) -> DataFrame:
    return rows.where(F.col(pair_col).isNotNull()).select(
        F.col(pair_col).alias("pair"), F.lit(side).alias("side"), F.col(turn_col).alias("turn"),
        _harmless(F.coalesce(F.col(role_col), F.lit("unknown"))).alias("role"), _harmless(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )


def rendered(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit("\n"), t["text"], F.lit(TURN_END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def learned_spans(turns: Column) -> Column:
    """Character ranges [start, stop) of what the loss covers: text and end mark of each assistant turn."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))

    def step(a, t):
        start = a["at"] + F.length(t["role"]) + len(TURN_START) + 1
        stop = start + F.length(t["text"]) + len(TURN_END)
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct((stop + 1).alias("at"), F.when(t["role"] == LEARNED_ROLE, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per pair id: ``status``, ``prefix_turns``, ``prompt``, ``chosen`` and ``rejected`` completions, and their masks.

    The longest common turn prefix (same role and text, turn by turn) is rendered once as the prompt; what follows on
    either side is that side's completion, whose mask lists the character ranges the loss covers. Both sides
    of a pair meet in one aggregation; a pair is as large as its two conversations, and nothing else is gathered.

    ``status`` is ``pair``; ``identical`` if nothing follows the prefix; ``prefix`` if one side ends with it; ``chosen_only`` or
    ``rejected_only`` if a side has no turns (then the prompt is empty). Turns are ordered by number, a missing number
    first, equal numbers by role and text; a row that repeats all of these is one turn. A null role is ``unknown``, a null text empty; rows
    without a pair id are left out. Empty tables give an empty table; other columns are not read.
    """
    sides = [turns_by_pair(d, pair_col, turn_col, role_col, text_col, k) for k, d in enumerate((chosen, rejected))]
    turn = F.struct("turn", "role", "text")
    of = lambda k: F.transform(F.sort_array(F.collect_set(F.when(F.col("side") == k, turn))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    pairs = sides[0].unionByName(sides[1]).groupBy("pair").agg(of(0).alias("c"), of(1).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first_change = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("k", F.when(first_change == 0, F.size("c")).otherwise(first_change - 1).cast("int"))
    rest = lambda side: F.slice(side, F.col("k") + 1, F.greatest(F.size(side) - F.col("k"), F.lit(0)))
    pairs = pairs.select("pair", "k", F.slice("c", F.lit(1), F.col("k")).alias("p"), "c", "r", rest("c").alias("c_rest"), rest("r").alias("r_rest"))
    empty = lambda name: F.size(name) == 0
    status = (
        F.when(empty("r"), "chosen_only").when(empty("c"), "rejected_only").when(empty("c_rest") & empty("r_rest"), "identical")
        .when(empty("c_rest") | empty("r_rest"), "prefix").otherwise("pair")
    )
    return pairs.select(
        F.col("pair").alias(pair_col), status.alias("status"), F.col("k").alias("prefix_turns"), rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c_rest")).alias("chosen"), rendered(F.col("r_rest")).alias("rejected"),
        learned_spans(F.col("c_rest")).alias("chosen_mask"), learned_spans(F.col("r_rest")).alias("rejected_mask"),
    )


def next_ids(ids: DataFrame, column: str) -> DataFrame:
    """(``column``, next): every distinct value beside the next larger one that exists.

    The values are range-partitioned and written with their partition: an ordered window inside each finds the next one, and
    the last of a partition takes the first of the next partition that has rows, of which there are as many as partitions.
    """
    order = Window.partitionBy("part").orderBy(column)
    spread = ids.select(column).distinct().repartitionByRange(column).withColumn("part", F.spark_partition_id())
    spread = shared_table(spread, "ordered-ids")
    firsts = spread.groupBy(F.col("part").alias("of")).agg(F.min(column).alias("first"))
    firsts = firsts.select("of", F.lead("first").over(Window.orderBy("of")).alias("behind"))  # one row per partition
    inside = spread.select("part", column, F.lead(column).over(order).alias("next"))
    return inside.join(firsts, F.col("part") == F.col("of")).select(column, F.coalesce("next", "behind").alias("next"))


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Rejected counterparts (conv_id, turn, role, text): the turns of a conversation before its last assistant turn, then the last
    assistant turn of the conversation with the next id among those that have one, however far the ids are apart. The
    last conversation and those without an assistant turn have no counterpart."""
    answers = conversations.where((F.col("role") == LEARNED_ROLE) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    last = answers.groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    last = shared_table(last, "last-answers")
    donors = last.select(F.col("conv_id").alias("next"), F.col("last.text").alias("given"))
    both = last.join(next_ids(last, "conv_id"), "conv_id").join(donors, "next").select("conv_id", F.col("last.turn").alias("at"), "given")
    before = conversations.join(both, "conv_id").where("turn < at").select("conv_id", "turn", "role", "text")
    return before.unionByName(both.select("conv_id", F.col("at").alias("turn"), F.lit(LEARNED_ROLE).alias("role"), F.col("given").alias("text")))
