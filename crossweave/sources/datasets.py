"""Partitioned panel datasets: reading with pruning, writing, and incremental upkeep."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_date, as_int

YEAR_MONTH = ("year", "month")


_local = None


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's derived files, in the shared folder the session names.

    Only a local session without that setting uses a temporary folder, which goes with the process.
    """
    global _local
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/crossweave/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local is None:
        _local = tempfile.TemporaryDirectory(prefix="crossweave-", ignore_cleanup_errors=True)
    return _local.name


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for derived files."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all derived files of this application; call it when no result of it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an expensive table once and read it back: its lineage is cut, and a lost executor
    re-reads files instead of recomputing the plan."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, counts: Mapping[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """``materialize`` and figures of the rows written (aggregates such as counts and sums), observed on their way: one job,
    no second scan."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name)
    return out, seen.get


def materialize_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write a table as one sorted file per hash bucket of ``keys`` and read it back: joins and aggregations on these keys
    need no exchange of it, and two tables with the same keys and buckets meet bucket by bucket. Its files go
    with ``clear_scratch``, its entry in the catalog with the session or ``DROP TABLE``."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    rows.option("path", scratch_dir(spark, name)).saveAsTable(table)
    return spark.table(table)


# ---------------------------------------------------------------- reading


def scan_partitioned(spark: SparkSession, root: str) -> DataFrame:
    """All partitions under ``root`` with the partition columns discovered."""
    return spark.read.parquet(root)


def scan_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def scan_dataset(
    spark: SparkSession,
    root: str,
    columns: Sequence[str],
    start: int,
    end: int,
    date_col: str = "trade_date",
    single_precision: bool = False,
) -> DataFrame:
    """Date range of a year/month dataset; the year predicate prunes partitions."""
    df = spark.read.parquet(root)
    df = df.where(F.col(date_col).between(start, end))
    if "year" in df.columns:
        df = df.where(F.col("year").between(start // 10000, end // 10000))
    df = df.select(*columns)
    if single_precision:
        df = to_single_precision(df)
    return df


def to_single_precision(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.col(c).cast("float") for c in doubles}) if doubles else df


def select_by_prefix(df: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """Columns by name or prefix; columns without a type hold no value and are left out."""
    keep = [
        f.name
        for f in df.schema.fields
        if (f.name in names or f.name.startswith(tuple(prefixes))) and not isinstance(f.dataType, T.NullType)
    ]
    return df.select(*keep)


def history_start(dates: DataFrame, start: int, lookback: int, date_col: str = "trade_date") -> int:
    """The date ``lookback`` trading dates before the first one in range (one number to the driver)."""
    first = dates.where(F.col(date_col) >= start).agg(F.min(date_col)).first()[0]
    if first is None:
        return start
    older = dates.where(F.col(date_col) < first).select(date_col).distinct()
    bound = older.orderBy(F.desc(date_col)).limit(lookback).agg(F.min(date_col)).first()[0]
    return int(first if bound is None else bound)


def future_end(dates: DataFrame, end: int, forward: int, date_col: str = "trade_date") -> int:
    """The date ``forward`` trading dates after the last one in range."""
    last = dates.where(F.col(date_col) <= end).agg(F.max(date_col)).first()[0]
    if last is None:
        return end
    later = dates.where(F.col(date_col) > last).select(date_col).distinct()
    bound = later.orderBy(date_col).limit(forward).agg(F.max(date_col)).first()[0]
    return int(last if bound is None else bound)


def with_history(df: DataFrame, start: int, end: int, lookback: int, dates: DataFrame | None = None) -> DataFrame:
    """Rows of the range plus ``lookback`` earlier trading dates; a literal bound, so it reaches the scan."""
    lo = history_start(dates if dates is not None else df, start, lookback)
    return df.where(F.col("trade_date").between(lo, end))


def with_future(df: DataFrame, start: int, end: int, forward: int, dates: DataFrame | None = None) -> DataFrame:
    hi = future_end(dates if dates is not None else df, end, forward)
    return df.where(F.col("trade_date").between(start, hi))


def warmup_start(start: int, periods: int, factor: float = 1.6) -> Column:
    """Calendar-day warm-up bound for ``periods`` trading days."""
    return as_int(F.date_sub(as_date(F.lit(start)), math.ceil(periods * factor)))


def with_warmup(df: DataFrame, start: int, end: int, periods: int, factor: float = 1.6) -> DataFrame:
    return df.where((F.col("trade_date") >= warmup_start(start, periods, factor)) & (F.col("trade_date") <= end))


# ---------------------------------------------------------------- writing


def with_year_month(df: DataFrame, date_col: str = "trade_date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns(
        {"year": F.floor(d / 10000).cast("int"), "month": F.lpad(F.floor(d / 100 % 100).cast("string"), 2, "0")}
    )


def write_by_date(df: DataFrame, root: str, date_col: str = "trade_date") -> None:
    """Write year/month partitions, replacing only the partitions that occur in ``df``.

    The rebalance hint groups rows by partition and splits a heavy month over tasks.
    """
    out = with_year_month(df, date_col).hint("rebalance", *YEAR_MONTH)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*YEAR_MONTH).parquet(root)


def merge_partitions(df: DataFrame) -> DataFrame:
    """Union of all partition files without full-row copies."""
    return df.drop(*[c for c in YEAR_MONTH if c in df.columns]).dropDuplicates()


def merge_key_files(
    spark: SparkSession,
    pattern: str,
    key: str | None = None,
    key_regex: str = r"([^/]+)\.parquet$",
    drop_duplicates: bool = True,
) -> DataFrame:
    """One frame from many per-key files; a missing key column is taken from the file name or folder."""
    df = spark.read.option("mergeSchema", "true").parquet(pattern)
    if key and key not in df.columns:
        df = df.withColumn(key, F.regexp_extract(F.input_file_name(), key_regex, 1))
    return df.dropDuplicates() if drop_duplicates else df


# ---------------------------------------------------------------- incremental


def pending_dates(wanted: DataFrame, written: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Dates still to be produced."""
    w = wanted.select(date_col).distinct()
    return w.join(written.select(date_col).distinct(), date_col, "left_anti")


def shared_dates(a: DataFrame, b: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Dates present on both sides."""
    return a.select(date_col).distinct().join(b.select(date_col).distinct(), date_col, "left_semi")


def high_water_mark(
    df: DataFrame, date_col: str, requested_start: int, key: str | None = None, default: int | None = None
) -> DataFrame:
    """Day after the latest valid stored date, not before the requested start; overall or per key.

    Dashes are dropped before a date is tested for eight digits; a day no calendar has is none. A key without a valid
    date starts at the default.
    """
    text = F.replace(F.trim(F.col(date_col).cast("string")), F.lit("-"), F.lit(""))
    valid = text.rlike(r"^\d{8}$") & F.try_to_date(text, "yyyyMMdd").isNotNull()
    latest = F.max(F.when(valid, text)).cast("int").alias("latest")
    agg = df.groupBy(key).agg(latest) if key else df.agg(latest)
    nxt = as_int(F.date_add(as_date("latest"), 1))
    start = F.greatest(F.coalesce(nxt, F.lit(default or requested_start)), F.lit(requested_start))
    return agg.withColumn("next_start", start)


def append_merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new rows without full-row copies."""
    return stored.unionByName(new, allowMissingColumns=True).dropDuplicates()


def update_columns(target: DataFrame, patch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` where the patch has a value; ``changed`` marks differing rows."""
    new = patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    df = target.join(new, list(keys), "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
    df = df.withColumn("changed", changed.cast("int"))
    df = df.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns})
    return df.drop(*[f"_new_{c}" for c in columns])


def processing_summary(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """One row of conditional counts for a job report."""
    aggs = [F.count("*").alias("rows")]
    aggs += [F.sum(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in counts.items()]
    return df.agg(*aggs)


def source_coverage(df: DataFrame, columns: Sequence[str], date_col: str = "trade_date") -> DataFrame:
    """Non-null count per column and date, and how many columns are empty that day."""
    agg = df.groupBy(date_col).agg(*[F.count(c).alias(f"{c}_nonnull") for c in columns])
    empty = reduce(lambda a, b: a + b, [(F.col(f"{c}_nonnull") == 0).cast("int") for c in columns])
    return agg.withColumn("empty_sources", empty)


def save_tables(df: DataFrame, path: str) -> None:
    """Result table as JSON and CSV."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
