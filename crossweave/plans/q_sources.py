"""Queries: scans, ranges, writing and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.price_volume import BY_STOCK
from ..sources import datasets as D
from .registry import query
from .sqltext import roll


def _stored_bars(m, name):
    """Bars written as a year/month dataset in the session's shared folder."""
    root = D.scratch_dir(m.spark, name)
    D.write_by_date(m.bars().drop("suppkey"), root)
    return root


@query(
    "partitioned_scan", "C1 C10", needs="bars", doubles="close amount",
    sql="""SELECT trade_date, ts_code, close, amount, CAST(trade_date // 10000 AS INTEGER) AS year,
                  CAST(trade_date // 100 % 100 AS INTEGER) AS month FROM bars""",
)
def _(m):
    df = D.scan_partitioned(m.spark, _stored_bars(m, "scan"))
    return df.select("trade_date", "ts_code", "close", "amount", "year", F.col("month").cast("int").alias("month"))


@query(
    "projected_scan", "C2", doubles="l_extendedprice",
    sql="SELECT l_orderkey, l_suppkey, l_extendedprice FROM lineitem",
)
def _(m):
    return D.scan_columns(m.spark, f"{m.dir}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_extendedprice"])


@query(
    "date_range_scan", "C3", needs="bars", doubles="close vol", digits=1,
    sql="""SELECT trade_date, ts_code, CAST(close AS FLOAT)::DOUBLE AS close, CAST(vol AS FLOAT)::DOUBLE AS vol
           FROM bars WHERE trade_date BETWEEN 19970301 AND 19990630""",
)
def _(m):
    return D.scan_dataset(
        m.spark, _stored_bars(m, "range"), ["trade_date", "ts_code", "close", "vol"], 19970301, 19990630,
        single_precision=True,
    )


@query(
    "prefix_column_scan", "C4", needs="moneyflow",
    doubles="buy_lg_amount buy_lg_vol buy_elg_amount buy_elg_vol net_mf_amount net_mf_vol",
    sql="""SELECT trade_date, ts_code, buy_lg_amount, buy_lg_vol, buy_elg_amount, buy_elg_vol, net_mf_amount, net_mf_vol
           FROM moneyflow""",
)
def _(m):
    df = m.moneyflow().withColumn("net_mf_empty", F.lit(None))
    return D.select_by_prefix(df, ["trade_date", "ts_code"], ["buy_lg", "buy_elg", "net_mf"])


@query(
    "history_range_scan", "C5", needs="bars", doubles="close",
    sql="""SELECT trade_date, ts_code, close FROM bars WHERE trade_date <= 19981228 AND trade_date >= (
             SELECT min(trade_date) FROM (SELECT DISTINCT trade_date FROM bars WHERE trade_date <
               (SELECT min(trade_date) FROM bars WHERE trade_date >= 19980105) ORDER BY trade_date DESC LIMIT 60))""",
)
def _(m):
    dates = m.lines().select("trade_date").distinct()
    return D.with_history(m.bars().select("trade_date", "ts_code", "close"), 19980105, 19981228, 60, dates)


@query(
    "future_range_scan", "C6", needs="bars", doubles="close",
    sql="""SELECT trade_date, ts_code, close FROM bars WHERE trade_date >= 19980105 AND trade_date <= (
             SELECT max(trade_date) FROM (SELECT DISTINCT trade_date FROM bars WHERE trade_date >
               (SELECT max(trade_date) FROM bars WHERE trade_date <= 19981228) ORDER BY trade_date LIMIT 20))""",
)
def _(m):
    dates = m.lines().select("trade_date").distinct()
    return D.with_future(m.bars().select("trade_date", "ts_code", "close"), 19980105, 19981228, 20, dates)


@query(
    "calendar_warmup", "C7", needs="bars", doubles="ma_20",
    sql=f"""SELECT trade_date, ts_code, ma_20 FROM (
              SELECT trade_date, ts_code, {roll('avg', 'close', 20, 1)} AS ma_20 FROM bars
              WHERE trade_date <= 19981228 AND trade_date >=
                CAST(strftime(DATE '1998-01-05' - 320, '%Y%m%d') AS INTEGER)) WHERE trade_date >= 19980105""",
    digits=4,
)
def _(m):
    df = D.with_warmup(m.bars(), 19980105, 19981228, 200)
    df = df.withColumn("ma_20", BY_STOCK.mean("close", 20, 1))
    return df.where("trade_date >= 19980105").select("trade_date", "ts_code", "ma_20")


@query(
    "merged_partitions", "C8", needs="bars", doubles="close amount",
    sql="SELECT DISTINCT trade_date, ts_code, close, amount FROM bars",
)
def _(m):
    root = D.scratch_dir(m.spark, "merge")
    b = m.bars()
    cols = ["trade_date", "ts_code", "close", "amount"]
    D.write_by_date(b.select(*cols).unionByName(b.where("suppkey % 5 = 0").select(*cols)), root)
    return D.merge_partitions(D.scan_partitioned(m.spark, root))


@query(
    "merged_key_files", "C9", needs="reports", doubles="roe",
    sql="""SELECT ann_date, end_date, roe, 'N' || (suppkey % 4) AS file_key FROM
             (SELECT DISTINCT ann_date, end_date, roe, suppkey % 4 AS suppkey FROM reports)""",
)
def _(m):
    root = D.scratch_dir(m.spark, "keys")
    r = m.reports().select("ann_date", "end_date", "roe", F.concat(F.lit("N"), F.col("suppkey") % 4).alias("shard"))
    r.unionByName(r.where("shard = 'N0'")).write.mode("overwrite").partitionBy("shard").parquet(root)
    # read the folders as plain files, so the key comes from the path only
    return D.merge_key_files(m.spark, f"{root}/*", key="file_key", key_regex=r"shard=([^/]+)/")


@query(
    "pending_dates", "C11 J10", needs="bars",
    sql="SELECT DISTINCT trade_date FROM bars WHERE trade_date NOT IN (SELECT trade_date FROM bars WHERE suppkey = 3)",
)
def _(m):
    b = m.lines().select("trade_date", "suppkey")
    return D.pending_dates(b, b.where("suppkey = 3"))


@query(
    "shared_dates", "C12 J9 N8", needs="bars",
    sql="SELECT DISTINCT trade_date FROM bars WHERE trade_date IN (SELECT trade_date FROM bars WHERE suppkey = 3)",
)
def _(m):
    b = m.lines().select("trade_date", "suppkey")
    return D.shared_dates(b, b.where("suppkey = 3"))


_DESCRIBED = ("mean", "std", "min", "max", "p01", "p50", "p99")


@query(
    "saved_validation_tables", "C13", needs="scores", doubles=" ".join(_DESCRIBED),
    sql="""SELECT trade_date, count(score) AS count, avg(score) AS mean, CASE WHEN count(score) > 1 THEN stddev_samp(score) END AS std,
      min(score) AS min, max(score) AS max, quantile_cont(score, 0.01) AS p01, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.99) AS p99
      FROM scores GROUP BY trade_date""",
)
def _(m):
    from ..operators.aggregates import describe_by

    path = D.scratch_dir(m.spark, "tables")
    df = describe_by(m.scores(), "score", ["trade_date"], {"p01": 0.01, "p50": 0.5, "p99": 0.99}, m.names)
    D.save_tables(df, path)
    return m.spark.read.schema(df.schema).option("header", "true").csv(f"{path}/csv")


_FLAGS = """
WITH old AS (SELECT trade_date, ts_code, CAST(suppkey % 3 = 0 AS INTEGER) AS st_flag FROM bars),
patch AS (SELECT trade_date, ts_code, CAST(suppkey % 6 = 0 AS INTEGER) AS st_flag FROM bars WHERE suppkey % 2 = 0)
"""


@query(
    "patched_columns", "C14", needs="bars",
    sql=_FLAGS + """SELECT o.trade_date, o.ts_code, coalesce(p.st_flag, o.st_flag) AS st_flag,
      CAST(p.st_flag IS NOT NULL AND p.st_flag <> o.st_flag AS INTEGER) AS changed
      FROM old o LEFT JOIN patch p ON p.trade_date = o.trade_date AND p.ts_code = o.ts_code""",
)
def _(m):
    b = m.bars().select("trade_date", "ts_code", "suppkey")
    old = b.select("trade_date", "ts_code", (F.col("suppkey") % 3 == 0).cast("int").alias("st_flag"))
    patch = b.where("suppkey % 2 = 0").select(
        "trade_date", "ts_code", (F.col("suppkey") % 6 == 0).cast("int").alias("st_flag")
    )
    return D.update_columns(old, patch, ["trade_date", "ts_code"], ["st_flag"])


@query(
    "processing_summary", "C15 A8", needs="reports_dirty",
    sql="""SELECT count(*) AS rows, sum(CASE WHEN or_yoy IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_growth,
                  sum(CASE WHEN ann_date = end_date THEN 1 ELSE 0 END)::BIGINT AS same_day,
                  sum(CASE WHEN ann_date LIKE '%.0' THEN 1 ELSE 0 END)::BIGINT AS float_text FROM reports_dirty""",
)
def _(m):
    return D.processing_summary(
        m.reports_dirty(),
        {
            "missing_growth": F.col("or_yoy").isNull(),
            "same_day": F.col("ann_date") == F.col("end_date"),
            "float_text": F.col("ann_date").endswith(".0"),
        },
    )


@query(
    "high_water_mark", "C16", needs="reports_dirty",
    sql="""SELECT ts_code, max(CAST(d AS INTEGER)) AS latest,
      greatest(coalesce(CAST(strftime(strptime(max(d), '%Y%m%d') + INTERVAL 1 DAY, '%Y%m%d') AS INTEGER), 20010601), 20010601) AS next_start
      FROM (SELECT ts_code, CASE WHEN regexp_full_match(replace(trim(ann_date), '-', ''), '[0-9]{8}') AND try_strptime(replace(trim(ann_date), '-', ''), '%Y%m%d') IS NOT NULL THEN replace(trim(ann_date), '-', '') END AS d FROM reports_dirty)
      GROUP BY ts_code""",
)
def _(m):
    return D.high_water_mark(m.reports_dirty(), "ann_date", 20010601, key="ts_code")


@query(
    "append_merge", "C17", needs="reports", doubles="roe",
    sql="SELECT DISTINCT ts_code, ann_date, end_date, roe FROM reports",
)
def _(m):
    r = m.reports().select("ts_code", "ann_date", "end_date", "roe")
    return D.append_merge(r.where("end_date <= 20000331"), r.where("end_date >= 19991231"))


@query(
    "source_coverage", "C18", needs="bars",
    sql="""SELECT trade_date, count(close) AS close_nonnull, count(pre_close) AS pre_close_nonnull,
             count(pct_chg) AS pct_chg_nonnull,
             CAST((count(close) = 0)::INT + (count(pre_close) = 0)::INT + (count(pct_chg) = 0)::INT AS INTEGER) AS empty_sources
           FROM bars GROUP BY trade_date""",
)
def _(m):
    return D.source_coverage(m.bars(), ["close", "pre_close", "pct_chg"])
