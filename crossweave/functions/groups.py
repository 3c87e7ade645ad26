"""Statistics, ranks, order positions and quantiles inside groups of any size.

A cross-section (all rows of one date) grows with the data. Every function here
takes ``group_rows``, an upper bound on the rows of one group that the caller can
prove (for a panel keyed by date and instrument: the number of instruments), or
``None`` to have it measured. Up to ``GROUP_ROW_LIMIT`` rows a group fits one task
and a plain window is the cheapest plan. Beyond it no task ever sees a whole group:

* means and deviations are partial aggregates joined back;
* order positions come from a range partitioning by group and order, which splits a
  hot group and a hot value alike. Its slices are written once, so that every later
  step and every retried task sees the same slices; rows are numbered inside their
  slice, and the sizes of the slices before it are added;
* the last known value crosses slices as one row per group and slice.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.datasets import materialize
from .columns import col

GROUP_ROW_LIMIT = 500_000


def _keys(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def measured_group_rows(df: DataFrame, keys: Sequence[str] | str) -> int:
    """Rows of the largest group; only one number reaches the driver."""
    row = df.groupBy(*_keys(keys)).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def fits_one_task(df: DataFrame, keys, group_rows: int | None, limit: int | None = None) -> bool:
    limit = GROUP_ROW_LIMIT if limit is None else limit
    if group_rows is None:
        group_rows = measured_group_rows(df, keys)
    return group_rows <= limit


def group_stats(
    df: DataFrame, keys: Sequence[str] | str, aggs: Mapping[str, Column], group_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add per-group aggregates to every row. Rows with a null key get nulls."""
    keys = _keys(keys)
    if fits_one_task(df, keys, group_rows, limit):
        w = Window.partitionBy(*keys)
        known = _known(keys)
        return df.withColumns({name: F.when(known, a.over(w)) for name, a in aggs.items()})
    stats = df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggs.items()])
    return df.join(stats, keys, "left")


def range_slices(df: DataFrame, keys: Sequence[str], sort: Sequence[Column | str], slice_rows: int | None = None) -> DataFrame:
    """The rows range-partitioned by group and order and written once, with the number of their slice as ``_slice``.

    Slices follow one another in (keys, sort); a hot group takes part in many of them. Rows equal in all of it share one.
    """
    slices = max(2, math.ceil(df.count() / slice_rows)) if slice_rows else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = df.repartitionByRange(max(2, slices), *keys, *sort).withColumn("_slice", F.spark_partition_id())
    return materialize(split, "slices")


def carry_last(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[Column | str],
    value: str,
    out: str,
    group_rows: int | None = None,
    limit: int | None = None,
    slice_rows: int | None = None,
    ties: Sequence[Column | str] = (),
) -> DataFrame:
    """Last non-null ``value`` of the group up to and including each row; rows with a null key are a group of their own.

    Rows equal in ``order`` come one after the other in no fixed order; ``ties`` lets slices divide many of them.
    Beyond one task the last value is carried across range slices: each (group, slice) gives one row, the value that enters it is
    looked up among these few, and joins the slice as a row ahead of it. No task sees more than its slice.
    """
    keys = _keys(keys)
    if fits_one_task(df, keys, group_rows, limit):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    names = [f"_o{i}" for i in range(len(order))]
    split = range_slices(df.withColumns(dict(zip(names, [col(o) for o in order]))), keys, [*names, *ties], slice_rows)
    place = F.struct(*names) if len(names) > 1 else F.col(names[0])
    # a missing place sorts first; as a lone order it would be skipped, inside a struct it is not
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(place.alias("p"))))
    left_behind = split.groupBy(*keys, "_slice").agg(newest.alias("_left"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    entering = left_behind.select(*keys, "_slice", F.last("_left", ignorenulls=True).over(earlier).alias(value), F.lit(0).alias("_body"))
    both = split.withColumn("_body", F.lit(1)).unionByName(entering, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_body", *names).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn(out, F.last(value, ignorenulls=True).over(w)).where("_body = 1")
    return seen.select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def order_position(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[Column | str],
    out: str,
    group_rows: int | None = None,
    limit: int | None = None,
    slice_rows: int | None = None,
    descending: Sequence[bool] | None = None,
) -> DataFrame:
    """1-based position of each row in its group; rows with a null key are a group of their own on both plans.

    ``order`` must end on a column that makes it a total order; ``descending`` turns single columns round. The number of
    slices is the session's number of shuffle partitions unless ``slice_rows`` asks for a size.
    """
    keys = _keys(keys)
    order = [col(o) for o in order]
    turned = list(descending or [False] * len(order))
    sort = lambda columns: [F.desc(c) if d else F.asc(c) for c, d in zip(columns, turned)]
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order)))
    if fits_one_task(df, keys, group_rows, limit):
        w = Window.partitionBy(*keys).orderBy(*sort(names))
        return keyed.withColumn(out, F.row_number().over(w).cast("long")).drop(*names)

    split = range_slices(keyed, keys, sort(names), slice_rows)
    sizes = split.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*sort(names))
    a, b = split.withColumn("_r", F.row_number().over(inside)).alias("a"), offsets.alias("b")
    same = F.col("a._slice") == F.col("b._slice")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    place = (F.col("a._r").cast("long") + F.col("b._before")).alias(out)
    return a.join(b, same).select(*[F.col(f"a.`{c}`") for c in df.columns], place)


def average_rank(
    df: DataFrame,
    x: str,
    keys: Sequence[str] | str,
    out: str,
    tiebreak: str = "ts_code",
    pct: bool = False,
    group_rows: int | None = None,
    limit: int | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Ascending rank with ties averaged; ``pct`` divides by the non-null count. Null stays null."""
    keys = _keys(keys)
    known = F.col(x).isNotNull() & _known(keys)
    if fits_one_task(df, keys, group_rows, limit):
        ordered = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
        peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
        rank = F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)
        if pct:
            rank = rank / F.count(x).over(Window.partitionBy(*keys))
        return df.withColumn(out, F.when(known, rank))
    valid = df.where(known).select(*keys, x, tiebreak)
    placed = order_position(valid, keys, [x, tiebreak], "_p", group_rows, limit=0, slice_rows=slice_rows)
    # one row per distinct value: ties collapse in the partial aggregate
    per_value = placed.groupBy(*keys, x).agg(((F.min("_p") + F.max("_p")) / F.lit(2.0)).alias(out))
    if pct:
        n = valid.groupBy(*keys).agg(F.count("*").alias("_n"))
        per_value = per_value.join(n, keys).withColumn(out, F.col(out) / F.col("_n")).drop("_n")
    return df.join(per_value, [*keys, x], "left").select(*df.columns, out)


def group_quantiles(
    df: DataFrame,
    x: str,
    keys: Sequence[str] | str,
    quantiles: Mapping[str, float],
    tiebreak: str | Sequence[str] = "ts_code",
    group_rows: int | None = None,
    limit: int | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """One row per group with exact, linearly interpolated quantiles of the non-null values.

    Rows with a null key belong to no group.
    """
    keys = _keys(keys)
    df = df.where(_known(keys))
    if fits_one_task(df, keys, group_rows, limit):
        names = list(quantiles)
        qs = F.array(*[F.lit(float(q)) for q in quantiles.values()])
        agg = df.groupBy(*keys).agg(F.percentile(F.col(x), qs).alias("_q"))
        return agg.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    tie = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    valid = df.where(F.col(x).isNotNull()).select(*dict.fromkeys([*keys, x, *tie]))
    placed = order_position(valid, keys, [x, *tie], "_p", group_rows, limit=0, slice_rows=slice_rows)
    n = valid.groupBy(*keys).agg(F.count("*").alias("_n"))
    placed = placed.join(n, keys)
    picks, outs, wanted = [], [], F.lit(False)
    for i, (name, q) in enumerate(quantiles.items()):
        h = (F.col("_n") - 1) * F.lit(float(q))
        lo = F.floor(h) + 1
        is_lo, is_hi = F.col("_p") == lo, F.col("_p") == F.least(lo + 1, F.col("_n"))
        wanted = wanted | is_lo | is_hi
        picks += [
            F.max(F.when(is_lo, F.col(x))).alias(f"_lo{i}"),
            F.max(F.when(is_hi, F.col(x))).alias(f"_hi{i}"),
            F.max(h - F.floor(h)).alias(f"_f{i}"),
            F.max(F.ceil(h) - h).alias(f"_c{i}"),
        ]
        between = F.col(f"_c{i}") * F.col(f"_lo{i}") + F.col(f"_f{i}") * F.col(f"_hi{i}")
        outs.append(F.when(F.col(f"_f{i}") == 0, F.col(f"_lo{i}")).otherwise(between).alias(name))
    return placed.where(wanted).groupBy(*keys).agg(*picks).select(*keys, *outs)


def _interpolated(q: float):
    """Aggregate over a window: exact quantile of the non-null values, linear between two as ``percentile`` has it."""

    def pick(v: pa.Array) -> float:
        x = v.drop_null().to_numpy(zero_copy_only=False)
        if not len(x):
            return None
        h = (len(x) - 1) * q
        lo, hi = math.floor(h), math.ceil(h)
        x = np.partition(x, [lo, hi])
        a, b = float(x[lo]), float(x[hi])
        return a if lo == hi or a == b else (hi - h) * a + (h - lo) * b

    return F.arrow_udf(pick, "double")


def with_quantiles(df, x, keys, quantiles, group_rows=None, tiebreak="ts_code", limit=None, slice_rows=None) -> DataFrame:
    """Add the group's quantiles of one column to every row."""
    return with_column_quantiles(df, {x: quantiles}, keys, group_rows, tiebreak, limit, slice_rows)


def with_column_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Mapping[str, float]],
    keys: Sequence[str] | str,
    group_rows: int | None = None,
    tiebreak: str | Sequence[str] = "ts_code",
    limit: int | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Add quantiles of several columns: column → {output name: quantile}. Rows with a null key get nulls.

    Groups that fit one task share a single window, whose columns are selected from as arrays of numbers: a map of
    boxed values per column, as ``percentile`` keeps, would outgrow the task. No key means the whole table.
    """
    keys = _keys(keys)
    if not keys:
        df = df.withColumn("_all", F.lit(0))
        for x, qs in wanted.items():
            # one row of quantiles, attached over a constant key
            q = group_quantiles(df, x, ["_all"], qs, tiebreak, group_rows, limit, slice_rows)
            df = df.join(F.broadcast(q), "_all", "left")
        return df.drop("_all")
    if fits_one_task(df, keys, group_rows, limit):
        w = Window.partitionBy(*keys)
        known = _known(keys)
        out = {n: _interpolated(q)(F.col(x).cast("double")).over(w) for x, qs in wanted.items() for n, q in qs.items()}
        return df.withColumns(out).withColumns({n: F.when(known, F.col(n)) for n in out})
    # all columns in one long table: one range partitioning, one offsets table, one join back
    tie = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    columns = list(wanted)
    values = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(x).cast("double").alias("_v")) for i, x in enumerate(columns)])
    long = df.select(*dict.fromkeys([*keys, *tie]), F.explode(values).alias("_e")).select(*dict.fromkeys([*keys, *tie]), "_e.*")
    distinct = {f"_q{i}": q for i, q in enumerate(sorted({q for qs in wanted.values() for q in qs.values()}))}
    name_of = {q: n for n, q in distinct.items()}
    found = group_quantiles(long, "_v", [*keys, "_c"], distinct, tie, group_rows, limit, slice_rows)
    pick = lambda i, q: F.max(F.when(F.col("_c") == i, F.col(name_of[q])))
    wide = found.groupBy(*keys).agg(*[pick(i, q).alias(n) for i, x in enumerate(columns) for n, q in wanted[x].items()])
    return df.join(wide, keys, "left")
