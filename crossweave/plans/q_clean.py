"""Queries: cleaning, deduplication, categories, trading-rule flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import is_blank, require_columns, to_numeric, yyyymmdd
from ..operators import clean as C
from ..operators.price_volume import average_amount
from .registry import query
from .sqltext import roll


@query("required_columns", "P1", needs="bars", doubles="close",
       sql="SELECT trade_date, ts_code, close FROM bars")
def _(m):
    return require_columns(m.bars(), ["trade_date", "ts_code", "close"]).select("trade_date", "ts_code", "close")


_PARSED = """CASE WHEN regexp_full_match(regexp_replace(trim(ann_date), '\\.0$', ''), '[0-9]{8}')
  THEN CAST(strftime(try_strptime(regexp_replace(trim(ann_date), '\\.0$', ''), '%Y%m%d'), '%Y%m%d') AS INTEGER) END"""


@query(
    "normalized_dates", "P2 P3", needs="reports_dirty",
    sql=f"""SELECT ts_code, src_row, coalesce({_PARSED}, 0) AS ann_int,
      CAST(end_date AS INTEGER) AS end_int, CASE WHEN suppkey % 3 = 0 THEN 0 ELSE CAST(end_date AS INTEGER) END AS optional_end
      FROM reports_dirty""",
)
def _(m):
    r = m.reports_dirty()
    r = C.parse_dates(r.withColumn("end_int", F.col("end_date")), ["end_int"], strict=True)
    r = r.withColumn("_opt", F.when(F.col("suppkey") % 3 == 0, F.lit(" ")).otherwise(F.col("end_date")))
    return r.select(
        "ts_code", "src_row", F.coalesce(yyyymmdd("ann_date"), F.lit(0)).alias("ann_int"), "end_int",
        F.coalesce(C.optional_date("_opt"), F.lit(0)).alias("optional_end"),
    )


@query(
    "numeric_coercion", "P4", needs="reports_dirty", doubles="number",
    sql="""SELECT ts_code, src_row, CASE WHEN NOT isnan(raw) THEN raw END AS number FROM (SELECT ts_code, src_row,
             try_cast(CASE WHEN src_row % 10 = 3 THEN 'n/a' WHEN src_row % 10 = 2 THEN 'NaN' ELSE ann_date END AS DOUBLE) AS raw
             FROM reports_dirty)""",
)
def _(m):
    text = F.when(F.col("src_row") % 10 == 3, "n/a").when(F.col("src_row") % 10 == 2, "NaN").otherwise(F.col("ann_date"))
    return m.reports_dirty().select("ts_code", "src_row", to_numeric(text).alias("number"))


_BLANK = "CASE WHEN suppkey % 9 = 0 THEN '  ' WHEN suppkey % 9 = 1 THEN NULL ELSE ts_code END"


@query(
    "blank_code_filter", "P5 P6", needs="bars",
    sql=f"""SELECT trade_date, code FROM (SELECT trade_date, {_BLANK} AS code FROM bars)
            WHERE code IS NOT NULL AND trim(code) <> ''""",
)
def _(m):
    code = F.when(F.col("suppkey") % 9 == 0, "  ").when(F.col("suppkey") % 9 == 1, None).otherwise(F.col("ts_code"))
    return C.drop_invalid_keys(m.bars().select("trade_date", code.alias("code")), code_col="code")


@query(
    "invalid_key_count", "P6", needs="bars",
    sql=f"""SELECT sum(CASE WHEN code IS NULL OR trim(code) = '' THEN 1 ELSE 0 END)::BIGINT AS invalid_keys, count(*) AS rows
            FROM (SELECT {_BLANK} AS code FROM bars)""",
)
def _(m):
    code = F.when(F.col("suppkey") % 9 == 0, "  ").when(F.col("suppkey") % 9 == 1, None).otherwise(F.col("ts_code"))
    return C.invalid_key_count(m.bars().select("trade_date", code.alias("code")), code_col="code")


@query(
    "complete_price_rows", "P7", needs="bars", doubles="open pre_close",
    sql="SELECT trade_date, ts_code, open, pre_close FROM bars WHERE open IS NOT NULL AND pre_close IS NOT NULL",
)
def _(m):
    return m.bars().dropna(subset=["open", "pre_close"]).select("trade_date", "ts_code", "open", "pre_close")


@query(
    "ordered_report_dates", "P8", needs="reports_dirty", doubles="roe",
    sql=f"""SELECT ts_code, src_row, ann AS ann_date, CAST(end_date AS INTEGER) AS end_date, roe
            FROM (SELECT *, {_PARSED} AS ann FROM reports_dirty) WHERE ann IS NOT NULL AND ann > CAST(end_date AS INTEGER)""",
)
def _(m):
    return C.ordered_dates(m.reports_dirty()).select("ts_code", "src_row", "ann_date", "end_date", "roe")


for _name, _id, _last, _dir in (("first_row_per_key", "P9", False, "ASC"), ("last_row_per_key", "P10", True, "DESC")):

    @query(
        _name, _id, needs="reports_dirty", doubles="roe",
        sql=f"""SELECT ts_code, end_date, ann_date, src_row, roe FROM (SELECT *, row_number() OVER
                 (PARTITION BY ts_code, end_date ORDER BY src_row {_dir}) AS rn FROM reports_dirty) WHERE rn = 1""",
    )
    def _(m, last=_last):
        df = C.keep_one(m.reports_dirty(), ["ts_code", "end_date"], ["src_row"], last=last)
        return df.select("ts_code", "end_date", "ann_date", "src_row", "roe")


@query(
    "distinct_rows", "P11", needs="reports_dirty", doubles="roe roa",
    sql="SELECT DISTINCT ts_code, ann_date, end_date, roe, roa FROM reports_dirty",
)
def _(m):
    return m.reports_dirty().select("ts_code", "ann_date", "end_date", "roe", "roa").dropDuplicates()


@query(
    "duplicate_key_report", "P12", needs="reports_dirty",
    sql="""SELECT ts_code, end_date, src_row, ann_date FROM reports_dirty SEMI JOIN
           (SELECT ts_code, end_date FROM reports_dirty GROUP BY ALL HAVING count(*) > 1) d USING (ts_code, end_date)""",
)
def _(m):
    return C.duplicate_rows(m.reports_dirty(), ["ts_code", "end_date"]).select("ts_code", "end_date", "src_row", "ann_date")


@query(
    "duplicate_key_counts", "P12", needs="suspensions",
    sql="SELECT trade_date, ts_code, count(*) AS n_rows FROM suspensions GROUP BY ALL HAVING count(*) > 1",
)
def _(m):
    return C.duplicate_keys(m.suspensions(), ["trade_date", "ts_code"])


@query(
    "conflicting_flags", "P13", needs="suspensions",
    sql="""SELECT trade_date, ts_code, min(suspend_type) AS lo, max(suspend_type) AS hi FROM suspensions
           GROUP BY trade_date, ts_code HAVING count(DISTINCT suspend_type) > 1""",
)
def _(m):
    return C.conflicting_keys(m.suspensions(), ["trade_date", "ts_code"], "suspend_type")


@query(
    "instrument_filter", "P14", needs="bars members", doubles="close",
    sql="""SELECT trade_date, ts_code, close FROM bars WHERE ts_code IN (SELECT ts_code FROM members WHERE l1_name = 'ASIA')
           UNION ALL SELECT trade_date, ts_code, close FROM bars WHERE ts_code = 'S000001' AND trade_date BETWEEN 19960101 AND 19971231""",
)
def _(m):
    b = m.bars().select("trade_date", "ts_code", "close")
    listed = C.filter_instruments(b, m.industry_members().where("l1_name = 'ASIA'"))
    spans = C.filter_instruments(C.filter_instruments(b, "all"), {"S000001": (19960101, 19971231)})
    return listed.unionByName(spans)


@query(
    "time_filter", "P15", needs="bars", doubles="close",
    sql="SELECT trade_date, ts_code, close FROM bars WHERE trade_date >= 19970101 AND trade_date <= 19971231",
)
def _(m):
    return C.filter_time(m.bars().select("trade_date", "ts_code", "close"), 19970101, 19971231)


@query(
    "output_date_filter", "P16", needs="bars", doubles="close",
    sql="SELECT trade_date, ts_code, close FROM bars WHERE trade_date IN (SELECT trade_date FROM bars WHERE suppkey % 10 = 3)",
)
def _(m):
    keep = m.lines().where("suppkey % 10 = 3").select("trade_date")
    return C.filter_dates(m.bars().select("trade_date", "ts_code", "close"), keep)


@query(
    "finite_values", "P17", needs="bars", doubles="change_ratio",
    sql="""SELECT trade_date, ts_code, pct_chg / nullif(change, 0) AS change_ratio FROM bars
           WHERE pct_chg IS NOT NULL AND change <> 0""",
)
def _(m):
    ratio = F.when(F.col("change") == 0, F.lit(float("inf"))).otherwise(F.col("pct_chg") / F.nullif("change", F.lit(0.0)))
    df = C.finite_columns(m.bars().withColumn("change_ratio", ratio), ["change_ratio"])
    return df.dropna(subset=["change_ratio"]).select("trade_date", "ts_code", "change_ratio")


@query(
    "default_flags", "P18 J1", needs="bars suspensions",
    sql="""SELECT b.trade_date, b.ts_code, CAST(coalesce(s.is_suspect, 0) AS INTEGER) AS is_suspect FROM bars b LEFT JOIN
           (SELECT trade_date, ts_code, max(CASE WHEN suspend_type = 'S' THEN 1 ELSE 0 END) AS is_suspect FROM suspensions
            GROUP BY ALL) s ON s.trade_date = b.trade_date AND s.ts_code = b.ts_code""",
)
def _(m):
    from ..operators.aggregates import suspend_daily
    from ..operators.joins import left_join_key

    df = left_join_key(m.bars().select("trade_date", "ts_code"), suspend_daily(m.suspensions()))
    return C.fill_defaults(df, {"is_suspect": 0}).withColumn("is_suspect", F.col("is_suspect").cast("int"))


@query(
    "exchange_symbols", "P19",
    sql="""SELECT s_suppkey, 'x' || printf('%06d', s_suppkey) AS symbol FROM supplier WHERE s_suppkey % 2 = 0
           UNION ALL SELECT s_suppkey, lower(printf('Y%06d', s_suppkey)) FROM supplier WHERE s_suppkey % 2 = 1""",
)
def _(m):
    code = F.when(F.col("s_suppkey") % 2 == 0, F.format_string("%06d.X", F.col("s_suppkey"))).otherwise(
        F.format_string("Y%06d", F.col("s_suppkey"))
    )
    df = m.table("supplier").select("s_suppkey", code.alias("code"))
    return df.select("s_suppkey", C.normalize_symbol("code").alias("symbol"))


_DERIVED = ["ret_1", "range", "close_open", "high_open", "low_open", "log_volume", "log_amount", "vwap"]


@query(
    "derived_bar_features", "P20", needs="bars", doubles=" ".join(_DERIVED),
    sql="""SELECT trade_date, ts_code, close / nullif(pre_close, 0) - 1 AS ret_1, (high - low) / nullif(close, 0) AS range,
      close / nullif(open, 0) - 1 AS close_open, high / nullif(open, 0) - 1 AS high_open, low / nullif(open, 0) - 1 AS low_open,
      ln(1 + vol) AS log_volume, ln(1 + amount) AS log_amount, amount / nullif(vol, 0) AS vwap FROM bars""",
)
def _(m):
    return C.derived_features(m.bars()).select("trade_date", "ts_code", *_DERIVED)


@query(
    "aliased_columns", "P21", needs="reports", doubles="gross_margin debt_ratio",
    sql="SELECT ts_code, end_date, grossprofit_margin AS gross_margin, debt_to_assets AS debt_ratio FROM reports",
)
def _(m):
    df = m.reports().drop("gross_margin")
    df = C.alias_columns(
        df, {"gross_margin": ["gross_profit_margin", "grossprofit_margin"], "debt_ratio": ["leverage", "debt_to_assets"]}
    )
    return df.select("ts_code", "end_date", "gross_margin", "debt_ratio")


@query(
    "listing_status", "P22", needs="name_changes",
    sql="""SELECT ts_code, start_date, name, CASE WHEN name LIKE '*ST%' THEN 2 WHEN name LIKE 'ST%' THEN 1 ELSE 0 END AS status
           FROM name_changes""",
)
def _(m):
    return m.name_changes().select("ts_code", "start_date", "name", C.name_status("name").alias("status"))


def _region_lookup(m):
    """Nation → region, without the last region (its nations stay unmapped)."""
    n, r = m.table("nation"), m.table("region").where("r_regionkey < 4")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("l2_name"), F.col("r_name").alias("mapped"))


@query(
    "mapped_categories", "P23", needs="members",
    sql="""SELECT m.ts_code, m.in_date, m.l2_name, r.r_name AS mapped FROM members m JOIN nation n ON n.n_name = m.l2_name
           JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey < 4""",
)
def _(m):
    df = C.map_categories(m.industry_members(), _region_lookup(m), "l2_name", "mapped")
    return df.select("ts_code", "in_date", "l2_name", "mapped")


@query(
    "unmapped_categories", "P23", needs="members",
    sql="""SELECT DISTINCT m.l2_name FROM members m JOIN nation n ON n.n_name = m.l2_name WHERE n.n_regionkey >= 4""",
)
def _(m):
    return C.unmapped_categories(m.industry_members(), _region_lookup(m), "l2_name")


_L1 = [f"L1_{r}" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]


@query(
    "label_onehot_roundtrip", "P24 P25", needs="members",
    sql="SELECT ts_code, in_date, CASE WHEN l1_name <> 'EUROPE' THEN l1_name END AS label FROM members",
)
def _(m):
    df = C.label_to_onehot(m.industry_members(), "l1_name", [c[3:] for c in _L1], "L1_")
    kept = [c for c in _L1 if c != "L1_EUROPE"]
    return df.select("ts_code", "in_date", C.onehot_to_label(kept, "L1_").alias("label"))


@query(
    "dummies_without_benchmark", "P26", needs="members",
    sql="""SELECT ts_code, in_date, (l1_name = 'AMERICA')::INTEGER AS "L1_AMERICA", (l1_name = 'ASIA')::INTEGER AS "L1_ASIA",
      (l1_name = 'EUROPE')::INTEGER AS "L1_EUROPE" FROM members""",
)
def _(m):
    df = C.label_to_onehot(m.industry_members(), "l1_name", ["AFRICA", "AMERICA", "ASIA", "EUROPE"], "L1_")
    cols = [c for c in df.columns if c.startswith("L1_")]
    df = C.drop_benchmark_category(df, cols)
    return df.select("ts_code", "in_date", *[F.col(c).cast("int").alias(c) for c in cols if c in df.columns])


@query(
    "session_returns", "P27", needs="bars", doubles="full_ret gap_ret intraday_ret open_gap_pct",
    sql="""SELECT trade_date, ts_code, full_ret, gap_ret, intraday_ret, gap_ret * 100 AS open_gap_pct FROM (SELECT trade_date, ts_code,
      CASE WHEN pct_chg IS NOT NULL THEN least(greatest(pct_chg / 100.0, -0.35), 0.60) END AS full_ret,
      CASE WHEN pre_close > 0 AND open > 0 THEN least(greatest((open - pre_close) / pre_close, -0.35), 0.60) ELSE 0.0 END AS gap_ret,
      CASE WHEN close > 0 AND open > 0 THEN least(greatest((close - open) / open, -0.35), 0.60) ELSE 0.0 END AS intraday_ret FROM bars)""",
)
def _(m):
    return C.session_returns(m.bars()).select("trade_date", "ts_code", "full_ret", "gap_ret", "intraday_ret", "open_gap_pct")


# board prefixes stand in for the listing board of a supplier
_BOARD = "CASE suppkey % 5 WHEN 0 THEN '60' WHEN 1 THEN '30' WHEN 2 THEN '68' WHEN 3 THEN '92' ELSE '8' END || ts_code"
_STATUS = """SELECT trade_date, ts_code, open, vol, pre_close, pct_chg, amount, CAST(suppkey % 4 = 0 AS INTEGER) AS is_st,
  CASE WHEN code LIKE '8%' OR code LIKE '92%' THEN 0.29 WHEN code LIKE '68%' OR code LIKE '30%' THEN 0.19
       WHEN suppkey % 4 = 0 THEN 0.049 ELSE 0.095 END AS price_limit,
  suppkey FROM (SELECT *, """ + _BOARD + " AS code FROM bars)"


def market_status(m):
    prefix = F.expr("CASE suppkey % 5 WHEN 0 THEN '60' WHEN 1 THEN '30' WHEN 2 THEN '68' WHEN 3 THEN '92' ELSE '8' END")
    df = m.bars().withColumns(
        {
            "code": F.concat(prefix, F.col("ts_code")),
            "st_stock": (F.col("suppkey") % 4 == 0).cast("int"),
            "star_st_stock": F.lit(None).cast("int"),
        }
    )
    return df.withColumn("is_st", C.is_st()).withColumn("price_limit", C.price_limit("code", "is_st"))


@query(
    "board_price_limits", "P28 P31", needs="bars", doubles="price_limit",
    sql=f"SELECT trade_date, ts_code, is_st, price_limit::DOUBLE AS price_limit FROM ({_STATUS})",
)
def _(m):
    return market_status(m).select("trade_date", "ts_code", "is_st", "price_limit")


_BLOCKS = f"""SELECT *, CAST(open IS NULL OR open <= 0 OR vol <= 0 OR chg >= price_limit OR chg <= -price_limit AS INTEGER) AS buy_blocked,
  CAST(open IS NULL OR open <= 0 OR vol <= 0 OR chg <= -price_limit AS INTEGER) AS sell_blocked FROM
  (SELECT *, coalesce(pct_chg / 100.0, 0.0) AS chg FROM ({_STATUS}))"""


@query(
    "trade_blocks", "P29", needs="bars",
    sql=f"SELECT trade_date, ts_code, buy_blocked, sell_blocked FROM ({_BLOCKS})",
)
def _(m):
    return C.trade_blocks(market_status(m)).select("trade_date", "ts_code", "buy_blocked", "sell_blocked")


@query(
    "eligible_universe", "P30", needs="bars",
    sql=f"""SELECT trade_date, ts_code FROM (SELECT *, {roll('avg', 'amount', 20, 10)} AS aa FROM ({_BLOCKS}))
            WHERE buy_blocked = 0 AND is_st = 0 AND trade_date >= 19950301 AND coalesce(aa, 0) >= 50""",
)
def _(m):
    df = average_amount(C.trade_blocks(market_status(m)))
    df = df.withColumns(
        {"is_suspect": F.lit(None).cast("int"), "listed_days": F.when(F.col("trade_date") < 19950301, 10)}
    )
    return C.eligible_universe(df, 60, 50.0).select("trade_date", "ts_code")


@query(
    "feature_label_split", "P32", needs="bars_adj", doubles="ret_5 label",
    sql="""SELECT * FROM (SELECT trade_date, ts_code,
             coalesce(close / nullif(lag(close, 5) OVER (PARTITION BY ts_code ORDER BY trade_date), 0) - 1, 0.0) AS ret_5,
             lead(close, 1) OVER (PARTITION BY ts_code ORDER BY trade_date) / close - 1 AS label FROM bars_adj)
           WHERE label IS NOT NULL""",
)
def _(m):
    from ..operators.price_volume import BY_STOCK, returns

    df = returns(m.bars_adj(), (5,)).withColumn("label", BY_STOCK.lead("close", 1) / F.col("close") - 1)
    return C.split_feature_label(df, ["ret_5"], "label").select("trade_date", "ts_code", "ret_5", "label")


@query(
    "planned_feature_columns", "P33", needs="bars moneyflow", doubles="close net_mf_amount",
    sql="""SELECT b.trade_date, b.ts_code, b.close, f.net_mf_amount FROM bars b JOIN moneyflow f
           ON f.trade_date = b.trade_date AND f.ts_code = b.ts_code""",
)
def _(m):
    keys = ["trade_date", "ts_code"]
    plan = C.select_features({"bars": m.bars(), "flow": m.moneyflow()}, ["close", "net_mf_amount"], keys)
    return plan["bars"].join(plan["flow"], keys)
