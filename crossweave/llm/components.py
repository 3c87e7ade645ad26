"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node in ``edges`` (a, b); null-free, any order.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to its smallest one,
    then its smaller ones. The rounds grow with the logarithm of the longest path. A round is written to the
    shared folder; a node with many neighbours is aggregated before the exchange, and its join can be split because
    the other side has one row per node.
    """
    state, before = shared_table(_oriented(edges).distinct(), "edges"), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        state = both.join(smallest, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = state.groupBy("a").agg(F.min("b").alias("m"))
        hung = state.join(smallest, "a")
        state = hung.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b"))).distinct()
        state = shared_table(state, "edges")


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
