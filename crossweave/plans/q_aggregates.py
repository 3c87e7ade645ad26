"""Queries: aggregations and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from .registry import query

WITH_INDUSTRY = """SELECT b.*, g.l1_name FROM bars b LEFT JOIN members g ON g.ts_code = b.ts_code
  AND g.in_date <= b.trade_date AND (g.out_date IS NULL OR b.trade_date < g.out_date)"""
MARKET = "SELECT trade_date, avg(pct_chg) / 100.0 AS r FROM bars WHERE pct_chg IS NOT NULL GROUP BY trade_date"


def with_industry(m, bars=None):
    """Bars with the industry label of their date."""
    return J.interval_join(m.bars() if bars is None else bars, m.industry_members(), ["l1_name"])


@query(
    "daily_suspensions", "A1", needs="suspensions",
    sql="""SELECT trade_date, ts_code, max(CASE WHEN suspend_type = 'S' THEN 1 ELSE 0 END) AS is_suspect FROM suspensions GROUP BY ALL""",
)
def _(m):
    return A.suspend_daily(m.suspensions())


@query("market_return", "A2", needs="bars", doubles="mkt_ret", sql=f"SELECT trade_date, r AS mkt_ret FROM ({MARKET})")
def _(m):
    return A.market_return(m.bars())


@query(
    "industry_return", "A3", needs="bars members", doubles="ind_ret",
    sql=f"""SELECT trade_date, l1_name, avg(pct_chg) AS ind_ret FROM ({WITH_INDUSTRY}) WHERE l1_name IS NOT NULL GROUP BY ALL""",
)
def _(m):
    return A.industry_return(with_industry(m))


@query(
    "listing_dates", "A4", needs="bars",
    sql="""SELECT trade_date, ts_code, date_diff('day', strptime(min(trade_date) OVER (PARTITION BY ts_code)::VARCHAR, '%Y%m%d'),
           strptime(trade_date::VARCHAR, '%Y%m%d')) AS listed_days, min(trade_date) OVER (PARTITION BY ts_code) AS list_date FROM bars""",
)
def _(m):
    b = m.bars().select("trade_date", "ts_code")
    return A.listed_days(b).join(A.listing_dates(b), "ts_code").select("trade_date", "ts_code", "listed_days", "list_date")


@query(
    "latest_factor", "A5 A6", needs="adj_factors", doubles="last_factor first_factor",
    sql="""SELECT ts_code, arg_max(adj_factor, trade_date) AS last_factor, arg_min(adj_factor, trade_date) AS first_factor
           FROM adj_factors GROUP BY ts_code""",
)
def _(m):
    a = m.adj_factors()
    last = A.latest_value(a, "adj_factor").withColumnRenamed("adj_factor", "last_factor")
    first = A.first_value(a, "adj_factor").withColumnRenamed("adj_factor", "first_factor")
    return last.join(first, "ts_code")


@query(
    "panel_counts", "A7", needs="bars",
    sql="SELECT count(DISTINCT ts_code) AS stocks, count(DISTINCT trade_date) AS dates FROM bars",
)
def _(m):
    return A.panel_counts(m.lines())


@query(
    "null_counts", "A8", needs="reports",
    sql="""SELECT sum((or_yoy IS NULL)::INT)::BIGINT AS or_yoy_nulls, sum((roe IS NULL)::INT)::BIGINT AS roe_nulls,
           sum((netprofit_yoy IS NULL)::INT)::BIGINT AS netprofit_yoy_nulls FROM reports""",
)
def _(m):
    return A.null_counts(m.reports(), ["or_yoy", "roe", "netprofit_yoy"])


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "industry_onehot_pivot", "A9", needs="bars members",
    sql="SELECT trade_date, ts_code, "
    + ", ".join(f"""coalesce(max((l1_name = '{r}')::INT), 0) AS "L1_{r}" """ for r in _REGIONS)
    + f"FROM ({WITH_INDUSTRY}) GROUP BY trade_date, ts_code",
)
def _(m):
    df = A.onehot_pivot(with_industry(m), ["trade_date", "ts_code"], "l1_name", _REGIONS, "L1_")
    return df.select("trade_date", "ts_code", *[F.col(f"`L1_{r}`").cast("int").alias(f"L1_{r}") for r in _REGIONS])


@query(
    "membership_onehot", "A10", needs="members",
    sql="""SELECT ts_code, in_date, coalesce(out_date, 0) AS out_date, """
    + ", ".join(f"""(l1_name = '{r}')::INT AS "L1_{r}" """ for r in _REGIONS)
    + ", "
    + ", ".join(f"""(l2_name = 'NATION_{i}')::INT AS "L2_NATION_{i}" """ for i in range(25))
    + "FROM members",
)
def _(m):
    from ..operators.clean import keep_one, label_to_onehot

    mem = keep_one(m.industry_members(), ["ts_code", "in_date"], ["l2_name"], last=True)
    # the two levels have 5 and 25 values: the category pass stays small
    nations = [r[0] for r in A.categories(m.industry_members(), "l2_name").collect()]
    df = label_to_onehot(label_to_onehot(mem, "l1_name", _REGIONS, "L1_"), "l2_name", nations, "L2_")
    out = [f"L1_{r}" for r in _REGIONS] + [f"L2_{n}" for n in nations]
    return df.select("ts_code", "in_date", F.coalesce("out_date", F.lit(0)).alias("out_date"),
                     *[F.col(f"`{c}`").cast("int").alias(c) for c in out])


@query(
    "industry_categories", "A11", needs="members",
    sql="SELECT DISTINCT l2_name FROM members ORDER BY 1",
)
def _(m):
    return A.categories(m.industry_members(), "l2_name")


@query(
    "source_match_counts", "A12", needs="bars members suspensions",
    sql=f"""SELECT count(*) AS rows, count(x.l1_name) AS l1_name_matched, count(s.is_suspect) AS is_suspect_matched
            FROM ({WITH_INDUSTRY}) x LEFT JOIN (SELECT trade_date, ts_code, max((suspend_type = 'S')::INT) AS is_suspect FROM suspensions
            GROUP BY ALL) s ON s.trade_date = x.trade_date AND s.ts_code = x.ts_code""",
)
def _(m):
    df = J.left_join_key(with_industry(m), A.suspend_daily(m.suspensions()))
    return A.match_counts(df, ["l1_name", "is_suspect"])


@query(
    "global_winsorize", "A13", needs="bars", doubles="pct_chg vol",
    sql="""SELECT b.trade_date, b.ts_code, CASE WHEN b.pct_chg IS NOT NULL THEN least(greatest(b.pct_chg, q.a), q.b) END AS pct_chg,
           least(greatest(b.vol, q.c), q.d) AS vol FROM bars b, (SELECT quantile_cont(pct_chg, 0.01) AS a, quantile_cont(pct_chg, 0.99) AS b,
           quantile_cont(vol, 0.01) AS c, quantile_cont(vol, 0.99) AS d FROM bars) q""",
)
def _(m):
    return A.global_winsorize(m.bars(), ["pct_chg", "vol"]).select("trade_date", "ts_code", "pct_chg", "vol")


_DESC = """count(score) AS count, avg(score) AS mean, CASE WHEN count(score) > 1 THEN stddev_samp(score) END AS std, min(score) AS min, max(score) AS max, """ + ", ".join(
    f"quantile_cont(score, {q}) AS {n}" for n, q in A.DESCRIBE_QUANTILES.items()
)
_DESC_COLS = "mean std min max p01 p05 p25 p50 p75 p95 p99"


@query("score_summary", "A14 I7", needs="scores", doubles=_DESC_COLS, sql=f"SELECT {_DESC} FROM scores")
def _(m):
    return A.describe_by(m.scores(), "score", [], tiebreak=["trade_date", "ts_code"])


@query(
    "daily_score_summary", "A14 I7", needs="scores", doubles=_DESC_COLS,
    sql=f"SELECT trade_date, {_DESC} FROM scores GROUP BY trade_date",
)
def _(m):
    return A.describe_by(m.scores(), "score", ["trade_date"], group_rows=m.names)


@query(
    "score_histogram", "A15 I7", needs="scores", doubles='"left" "right"',
    sql="""WITH r AS (SELECT min(score) AS lo, max(score) AS hi, (max(score) - min(score)) / 20 AS w FROM scores),
      c AS (SELECT greatest(1, least(20, CAST(ceil((score - lo) / w) AS INTEGER))) AS bin, count(*) AS n FROM scores, r GROUP BY 1)
      SELECT CAST(b.bin AS INTEGER) AS bin, lo + (b.bin - 1) * w - CASE WHEN b.bin = 1 THEN 0.001 * (hi - lo) ELSE 0 END AS "left",
             lo + b.bin * w AS "right", coalesce(n, 0) AS count FROM range(1, 21) b(bin) CROSS JOIN r LEFT JOIN c ON c.bin = b.bin""",
)
def _(m):
    return A.histogram(m.scores(), "score", 20)


@query(
    "monthly_market_return", "A16", needs="bars", doubles="r",
    sql=f"""SELECT CAST(trade_date // 10000 AS INTEGER) AS year, CAST(trade_date // 100 % 100 AS INTEGER) AS month, avg(r) AS r
            FROM ({MARKET}) GROUP BY 1, 2""",
)
def _(m):
    return A.monthly_mean(A.market_return(m.bars()).withColumnRenamed("mkt_ret", "r"), ["r"])
