"""Panel joins: keyed, point-in-time, validity interval, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_date, as_int
from ..functions.groups import carry_last
from ..functions.rolling import PANEL_ROWS

PANEL = ("trade_date", "ts_code")


def left_join_key(panel: DataFrame, feature: DataFrame, keys: Sequence[str] = PANEL, validate: bool = True) -> DataFrame:
    """Left join on the key; ``validate`` fails if the right side repeats a key."""
    keys = list(keys)
    if validate:
        bad = feature.groupBy(*keys).count().where("count > 1").limit(1).count()
        if bad:
            raise ValueError(f"right side has duplicate keys {keys}")
    return panel.join(feature, keys, "left")


def latest_per_date(right: DataFrame, by: str, on: str, columns: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """One record per key and date: the one with the greatest tie columns."""
    value = F.struct(*columns)
    order = F.struct(*tie) if len(tie) > 1 else F.col(tie[0])
    return right.groupBy(by, on).agg(F.max_by(value, order).alias("_r"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    columns: Sequence[str],
    by: str = "ts_code",
    left_on: str = "trade_date",
    right_on: str = "ann_date",
    tie: Sequence[str] = ("end_date",),
    series_rows: int | None = PANEL_ROWS,
    limit: int | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Latest record of the key known on the row's date (equal dates included).

    Both sides are laid into one stream per key and the last record is carried
    forward: one exchange, no pair of rows is ever formed. ``series_rows`` bounds the
    rows of one key on both sides; the default holds for a panel (one row per date).
    ``None`` has it measured: a stream too long for one task is then cut into range
    slices and the last record carried across them (``carry_last``).
    """
    columns = list(columns)
    one = latest_per_date(right, by, right_on, columns, list(tie))
    rest = [c for c in left.columns if c not in (by, left_on)]
    carried = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_none"))
    rows = left.select(F.col(by).alias("_k"), F.col(left_on).alias("_t"), F.lit(1).alias("_side"), carried.alias("_l"))
    recs = one.select(F.col(by).alias("_k"), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), "_r")
    both = rows.unionByName(recs, allowMissingColumns=True)
    # rows of one key and date may be many: their content divides them between slices
    content = [F.col("_l")[f.name] for f in both.schema["_l"].dataType if "map<" not in f.dataType.simpleString()]
    seen = carry_last(both, "_k", ["_t", "_side"], "_r", "_r", series_rows, limit, slice_rows, [F.xxhash64(*content)] if content else []).where("_side = 1")
    # the key columns keep their identity, so later work by instrument needs no new exchange
    own = {by: F.col("_k"), left_on: F.col("_t")}
    return seen.select(
        *[own.get(c, F.col("_l")[c]).alias(c) for c in left.columns], *[F.col("_r")[c].alias(c) for c in columns]
    )


def expiring_asof_join(
    left: DataFrame, right: DataFrame, columns: Sequence[str], start: str = "in_date", end: str = "out_date", series_rows: int | None = PANEL_ROWS
) -> DataFrame:
    """As-of on the start date, cleared once the record has ended."""
    cols = list(dict.fromkeys([start, end, *columns]))
    ended = right.withColumn("_end", F.coalesce(F.col(end), F.lit(99991231)))
    df = asof_join(left, ended, cols, right_on=start, tie=["_end"], series_rows=series_rows)
    live = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col("trade_date")))
    return df.withColumns({c: F.when(live, F.col(c)) for c in cols})


def period_winners(
    right: DataFrame, columns: Sequence[str], by: str, start: str, end: str, closed: str = "left", first: bool = False, bucket: int = 10_000,
    ties: Sequence[str] = (),
) -> DataFrame:
    """(``by``, ``_from``, ``_best``): the record that holds for a key from a date on until the next ``_from``; null where none
    does. ``_best`` has the fields v0, v1, ….

    The winner only changes where a record begins or ends, and a key has no more such dates than the calendar. Records
    that share key and period are reduced to one before the exchange, and each meets the dates of its key bucket by
    bucket (for YYYYMMDD numbers a bucket is a year), so a key with very many records is spread over its years and
    neither its records nor its rows are ever gathered. The winners are a partial aggregate.
    """
    until = F.col(end) + F.lit(1 if closed == "both" else 0)  # no date lies between a number and the next one
    value = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    if ties:  # of records that begin together the one greatest in ``ties``, a null least
        value = F.struct(F.struct(*ties).alias("t"), value.alias("v"))
    least = F.max if ties else F.min
    one = right.where(F.col(start).isNotNull()).select(F.col(by).alias("_k"), F.col(start).alias("_s"), until.alias("_e"), value.alias("_v"))
    one = one.where(F.col("_k").isNotNull() & (F.col("_e").isNull() | (F.col("_s") < F.col("_e")))).groupBy("_k", "_s", "_e").agg(least("_v").alias("_v"))
    points = one.select("_k", F.explode(F.array("_s", "_e")).alias("_from")).where("_from is not null").distinct()
    last = points.groupBy("_k").agg(F.max("_from").alias("_last"))
    place = lambda c: F.floor(c / bucket)
    spread = one.join(last, "_k").withColumn("_b", F.explode(F.sequence(place(F.col("_s")), place(F.coalesce("_e", "_last")))))
    live = points.withColumn("_b", place(F.col("_from"))).join(spread, ["_k", "_b"]).where((F.col("_s") <= F.col("_from")) & (F.col("_e").isNull() | (F.col("_from") < F.col("_e"))))
    order = F.col("_s") if first != bool(ties) else -F.col("_s")
    best = live.groupBy("_k", "_from").agg(least(F.struct(order.alias("o"), F.col("_v").alias("v"), F.col("_e").alias("e"))).alias("_w"))
    return points.join(best, ["_k", "_from"], "left").select(F.col("_k").alias(by), "_from", F.col("_w.v.v" if ties else "_w.v").alias("_best"))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    columns: Sequence[str],
    by: str = "ts_code",
    on: str = "trade_date",
    start: str = "in_date",
    end: str = "out_date",
    closed: str = "left",
    first: bool = False,
    series_rows: int | None = PANEL_ROWS,
    limit: int | None = None,
) -> DataFrame:
    """Record valid on the row's date, ``closed`` ``'left'`` (end excluded) or ``'both'``. Every left row stays once.

    Several live records: the latest start wins (``first``: the earliest), then the smaller values, nulls smallest.
    The records are turned into periods with one winner each, and the rows take the last period that began
    (``asof_join``, which explains ``series_rows``): no pairs of rows and records are formed. Dates are numbers in calendar
    order (YYYYMMDD).
    """
    periods = period_winners(right, columns, by, start, end, closed, first)
    df = asof_join(left, periods, ["_best"], by=by, left_on=on, right_on="_from", tie=["_from"], series_rows=series_rows, limit=limit)
    return df.select(*left.columns, *[F.col("_best")[f"v{i}"].alias(c) for i, c in enumerate(columns)])


def join_calendar(df: DataFrame, series: DataFrame, date: str = "trade_date", how: str = "left") -> DataFrame:
    """Join a date-level series to a panel without moving the panel.

    One row per YYYYMMDD date, at most 366 for each of 9999 years, is what bounds the broadcast; a series that repeats
    a date fails when the query runs.
    """
    rest = [c for c in series.columns if c != date]
    row = F.when(F.count("*") > 1, F.raise_error(F.lit(f"the series repeats a {date}"))).otherwise(F.first(F.struct(*rest)))
    one = series.groupBy(date).agg(row.alias("_s")).select(date, *[F.col("_s")[c].alias(c) for c in rest])
    return df.join(F.broadcast(one), date, how)


def align_weights(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str = "w0", right: str = "w1") -> DataFrame:
    """Two weight vectors on the union of their names, zero where one lacks a name."""
    df = a.join(b, list(keys), "full_outer")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in (left, right)})


def dense_calendar(codes: DataFrame, start: int, end: int, code_col: str = "ts_code") -> DataFrame:
    """Every calendar day for every code: each code row unfolds its own day sequence."""
    days = F.sequence(as_date(F.lit(start)), as_date(F.lit(end)))
    unfolded = codes.select(code_col).distinct().select(F.explode(days).alias("_day"), code_col)
    return unfolded.select(as_int(F.col("_day")).alias("trade_date"), code_col)


def signal_dates(trade_dates: DataFrame, signal: DataFrame, delay: int = 1) -> DataFrame:
    """Trade date → the signal date usable on it (date-level tables, bounded by the calendar).

    Delay 0 takes the latest signal on or before the date; delay k the k-th strictly older.
    """
    t = trade_dates.select("trade_date").distinct().select("trade_date", F.lit(1).alias("_side"))
    s = signal.select("trade_date").distinct().select("trade_date", F.lit(0).alias("_side"))
    n = Window.orderBy("trade_date")
    if delay == 0:
        seen = n.rangeBetween(Window.unboundedPreceding, 0)
    else:
        seen = n.rangeBetween(Window.unboundedPreceding, -1)
    both = t.unionByName(s)
    count = F.sum(F.when(F.col("_side") == 0, 1).otherwise(0)).over(seen)
    pos = F.coalesce(count, F.lit(0)) - (0 if delay == 0 else delay - 1)
    placed = both.withColumn("_pos", pos).where("_side = 1").select("trade_date", "_pos")
    numbered = s.select(F.col("trade_date").alias("signal_date"), F.row_number().over(n).alias("_pos"))
    return placed.join(numbered, "_pos", "left").select("trade_date", "signal_date")


def forward_fill_series(dates: DataFrame, series: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Last known value of a date-level series on each date."""
    left = dates.select("trade_date").distinct().withColumn("_one", F.lit(0))
    right = series.withColumn("_one", F.lit(0))
    return asof_join(left, right, columns, by="_one", right_on="trade_date", tie=["trade_date"]).drop("_one")


def with_grid(df: DataFrame, rows: Sequence[dict], where=None) -> DataFrame:
    """Repeat the data for each parameter row: a generator over a literal array."""
    kept = [r for r in rows if where is None or where(r)]
    grid = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in kept])
    names = list(kept[0])
    return df.withColumn("_g", F.explode(grid)).select("*", *[F.col("_g")[n].alias(n) for n in names]).drop("_g")


def latest_label(df: DataFrame, label: str, by: str = "ts_code", date: str = "trade_date") -> DataFrame:
    """Label on the last date of the whole table."""
    last = df.agg(F.max(date).alias(date))
    return df.join(last, date, "left_semi").select(by, label)


def latest_known_label(df: DataFrame, label: str, by: str = "ts_code", date: str = "trade_date") -> DataFrame:
    """Last non-null label of each key."""
    return df.where(F.col(label).isNotNull()).groupBy(by).agg(F.max_by(label, date).alias(label))
