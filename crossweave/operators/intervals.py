"""Validity intervals unfolded to days, industry membership upkeep, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_date, as_int
from .clean import name_status
from .joins import dense_calendar, period_winners

CLASSIFICATION_ORDER = ("ts_code", "name", "industry_code", "industry", "level", "src", "in_date", "out_date", "is_new")


def daily_name_status(names: DataFrame, extend_to: int | None = None, source_order: str | None = None) -> DataFrame:
    """One row per code and calendar day with exclusive status flags.

    An open interval runs to the latest known date (or ``extend_to``). Where
    intervals overlap the latest start, then the latest announcement wins, then the row later in
    ``source_order`` (files have no order, so a column has to say it), then the higher status; days without any
    interval are normal. An empty table has no days. Intervals meet as periods with one winner each; only these
    unfold to days, so no table of days is joined, grouped or broadcast.
    """
    span = names.agg(
        F.min("start_date").alias("lo"), F.greatest(F.max("start_date"), F.max("end_date"), F.max("ann_date")).alias("hi")
    ).first()
    lo, known = (span["lo"], max(span["hi"] or 0, extend_to or 0)) if span["lo"] else (19700101, 19700101)
    day = lambda x: F.unix_date(as_date(x))
    later = (F.col(source_order) if source_order else F.lit(0)).alias("_later")
    ends = names.withColumn("_end", F.coalesce("end_date", F.lit(known))).where("_end >= start_date")
    named = ends.select("ts_code", day("start_date").alias("_from"), (day("_end") + 1).alias("_to"), "ann_date", later, name_status("name").alias("_status"))
    # every code is normal over the whole range, which any named interval beats
    codes = names.select("ts_code").distinct()
    normal = codes.where(F.col("ts_code").isNotNull()).select("ts_code", day(F.lit(lo)).alias("_from"), (day(F.lit(known)) + 1).alias("_to"), F.lit(0).alias("_status"))
    live = period_winners(
        named.unionByName(normal, allowMissingColumns=True), ["_status"], "ts_code", "_from", "_to", bucket=366, ties=["ann_date", "_later", "_status"]
    )
    until = F.lead("_from").over(Window.partitionBy("ts_code").orderBy("_from"))
    held = live.withColumn("_until", until).where("_until is not null").select("ts_code", F.col("_best.v0").alias("_status"), F.explode(F.sequence("_from", F.col("_until") - 1)).alias("_day"))
    unknown = dense_calendar(codes.where(F.col("ts_code").isNull()), lo, known).withColumn("_status", F.lit(0))
    days = held.select(as_int(F.date_from_unix_date("_day")).alias("trade_date"), "ts_code", "_status").unionByName(unknown)
    status = F.coalesce("_status", F.lit(0))
    return days.select(
        "trade_date",
        "ts_code",
        (status == 0).cast("tinyint").alias("no_st_stock"),
        (status == 1).cast("tinyint").alias("st_stock"),
        (status == 2).cast("tinyint").alias("star_st_stock"),
    )


def membership_snapshot(members: DataFrame, dates: DataFrame) -> DataFrame:
    """Industry of each code on each date.

    Several live records: the current flag first, then the latest entry, then the code.
    The winner of a code changes only on dates where one of its records begins or ends, so records meet these dates alone; each
    winner is unfolded to the wanted dates until the next change, and no table of days is moved or sorted.
    """
    d = dates.select("trade_date").distinct()
    cal = d.agg(F.sort_array(F.collect_set("trade_date")).alias("_cal")).withColumn("_one", F.lit(0))  # one row, bounded by the calendar
    m = members.withColumns(
        {"_in": F.coalesce("in_date", F.lit(0)), "_out": F.coalesce("out_date", F.lit(99991231)), "_one": F.lit(0)}
    )
    # places in the calendar: the first date of the record, and the first one after it
    begins = F.size("_cal") - F.size(F.filter("_cal", lambda t: t >= F.col("_in")))
    m = m.join(F.broadcast(cal), "_one").withColumns({"_begins": begins, "_ends": F.size(F.filter("_cal", lambda t: t < F.col("_out")))})
    m = m.where("_begins < _ends").drop("_cal")
    changes = m.select(F.col("ts_code").alias("_code"), F.explode(F.array("_begins", "_ends")).alias("_p"))
    changes = changes.groupBy("_code").agg(F.collect_set("_p").alias("_changes"))
    own = F.filter("_changes", lambda p: (p >= F.col("_begins")) & (p < F.col("_ends")))
    live = m.join(changes, F.col("ts_code").eqNullSafe(F.col("_code"))).withColumn("_p", F.explode(own))
    live = live.withColumn("_next", F.array_min(F.filter("_changes", lambda p: p > F.col("_p")))).drop("_code", "_changes")
    w = Window.partitionBy("ts_code", "_p").orderBy(F.desc("is_new"), F.desc("_in"), F.asc("industry_code"))
    best = live.repartition("ts_code", "_p").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")  # a code of many records spreads
    days = F.explode(F.slice("_cal", F.col("_p") + 1, F.col("_next") - F.col("_p")))
    unfolded = best.join(F.broadcast(cal), "_one").withColumn("trade_date", days)
    return unfolded.drop("_rn", "_in", "_out", "_one", "_cal", "_begins", "_ends", "_p", "_next")


def calendar_days(spark, start: int, end: int) -> DataFrame:
    """All days of a range."""
    days = spark.range(1).select(F.explode(F.sequence(as_date(F.lit(start)), as_date(F.lit(end)))).alias("_day"))
    return days.select(as_int(F.col("_day")).alias("trade_date"))


def normalize_members(raw: DataFrame, level: str, src: str) -> DataFrame:
    """Common column names and defaults for a membership extract of one level."""
    code, name = f"{level.lower()}_code", f"{level.lower()}_name"
    missing = [c for c in (code, name, "ts_code") if c not in raw.columns]
    if missing:
        raise ValueError(f"membership extract lacks {missing}")
    df = raw.withColumns(
        {"industry_code": F.col(code), "industry": F.col(name), "level": F.lit(level), "src": F.lit(src)}
    )
    if "in_date" not in df.columns:
        df = df.withColumn("in_date", F.lit("00000000"))
    if "out_date" not in df.columns:
        df = df.withColumn("out_date", F.lit(""))
    df = df.where(F.col("industry_code").isNotNull() & F.col("ts_code").isNotNull())
    first = [c for c in CLASSIFICATION_ORDER if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def supplement_members(members: DataFrame, basics: DataFrame, lookup: DataFrame, level: str = "L1", src: str = "mapped") -> DataFrame:
    """Append all codes whose secondary industry maps to a primary one.

    ``basics`` has (ts_code, secondary, list_date), ``lookup`` (secondary, industry). The
    appended records carry ``is_new = 'N'`` so the snapshot prefers original ones.
    """
    mapped = basics.join(lookup, "secondary", "inner").select(
        "ts_code",
        F.lit("MAPPED").alias("industry_code"),
        "industry",
        F.lit(level).alias("level"),
        F.lit(src).alias("src"),
        F.coalesce("list_date", F.lit(0)).alias("in_date"),
        F.lit(None).cast("int").alias("out_date"),
        F.lit("N").alias("is_new"),
    )
    return members.unionByName(mapped, allowMissingColumns=True)


def missing_codes(members: DataFrame, basics: DataFrame) -> DataFrame:
    """Codes without any membership record."""
    return basics.select("ts_code").distinct().join(members, "ts_code", "left_anti")


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def stitch_keep_last(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of overlapping frames; a later frame wins."""
    tagged = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    df = concat_frames(tagged)
    w = Window.partitionBy(*keys).orderBy(F.desc("_frame"))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_frame")


def shared_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def keys_only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def sort_panel(df: DataFrame) -> DataFrame:
    return df.orderBy("trade_date", "ts_code")


def first_dates(df: DataFrame, n: int, col: str = "trade_date") -> DataFrame:
    """Rows of the first ``n`` dates."""
    head = df.select(col).distinct().orderBy(col).limit(n)
    return df.join(head, col, "left_semi")


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in an order fixed by a hash of the seed and the key, which any engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(text), *keys).limit(n)
