"""Queries: price, volume and technical factors."""

from __future__ import annotations

from ..operators import price_volume as PV
from ..operators import smoothing as SM
from .registry import query
from .sqltext import BY, corr, div, lag, lead, over, pct, roll, select

KEYS = ["trade_date", "ts_code"]


def factor_query(name, covers, fn, cols, sql_cols=None, sql=None, table="bars", panel="bars", **kw):
    """A query that shows the factor columns of one operator next to the panel key."""
    text = sql or select(sql_cols, table)

    @query(name, covers, needs=table, doubles=" ".join(cols), sql=text, **kw)
    def _(m):
        return fn(getattr(m, panel)()).select(*KEYS, *cols)


def simple(name, covers, fn, sql_cols, **kw):
    factor_query(name, covers, fn, list(sql_cols), sql_cols, **kw)


simple("price_returns", "W1", PV.returns, {f"ret_{n}": pct("close", n) for n in (5, 10, 20, 60)})
simple(
    "moving_average_bias", "W2", PV.ma_bias,
    {f"ma{n}_bias": f"{div('close', roll('avg', 'close', n))} - 1" for n in (5, 10, 20, 60)},
)
simple(
    "return_volatility", "W3", PV.volatility,
    {f"volatility_{n}": roll("stddev_samp", "pct_chg", n) for n in (5, 20, 60)},
)
factor_query(
    "price_amplitude", "W4", PV.amplitude, ["amplitude", "amplitude_5", "amplitude_20"],
    sql=select(
        {"amplitude": "amplitude", "amplitude_5": roll("avg", "amplitude", 5), "amplitude_20": roll("avg", "amplitude", 20)},
        f"(SELECT *, {div('high - low', 'close')} AS amplitude FROM bars)",
    ),
)
simple("volume_ratio", "W5", PV.volume_ratio, {f"vol_ratio_{n}": div("vol", roll("avg", "vol", n)) for n in (5, 20)})
simple(
    "price_volume_correlation", "W6", PV.price_volume_corr,
    {f"corr_price_vol_{n}": corr("close", "vol", n) for n in (5, 20)},
)
simple(
    "skip_month_momentum", "W7", PV.skip_momentum,
    {
        "momentum_12m_skip1m": f"{div('1 + ' + pct('close', 252), '1 + ' + pct('close', 22))} - 1",
        "momentum_6m_skip2w": f"{div('1 + ' + pct('close', 126), '1 + ' + pct('close', 10))} - 1",
    },
)
factor_query(
    "year_high_distance", "W8", PV.high_52w, ["momentum_52w_high_dist", "momentum_52w_high_break"],
    sql=select(
        {
            "momentum_52w_high_dist": f"1 - {div('close', 'top')}",
            "momentum_52w_high_break": "CAST(close >= top * 0.98 AS DOUBLE)",
        },
        f"(SELECT *, {roll('max', 'close', 252, 126)} AS top FROM bars)",
    ),
)
factor_query(
    "relative_strength_index", "W9", PV.rsi, ["rsi_14"],
    sql=select(
        {"rsi_14": "CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END"},
        f"""(SELECT *, {roll('avg', 'up', 14, 10)} AS gain, {roll('avg', 'dn', 14, 10)} AS loss FROM
             (SELECT *, CASE WHEN pct_chg IS NOT NULL THEN greatest(pct_chg / 100.0, 0.0) END AS up,
                     CASE WHEN pct_chg IS NOT NULL THEN greatest(-(pct_chg / 100.0), 0.0) END AS dn FROM bars))""",
    ),
)
simple(
    "williams_percent_range", "W10", PV.williams_r,
    {
        "williams_r_14": div(
            f"-100 * ({roll('max', 'high', 14, 10)} - close)",
            f"{roll('max', 'high', 14, 10)} - {roll('min', 'low', 14, 10)}",
        )
    },
)

# Recursive means: the SQL walks each series row by row.
_EWM = """
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS rn FROM bars),
e AS (
  SELECT ts_code, trade_date, rn, close, close AS e12, close AS e26 FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.ts_code, n.trade_date, n.rn, n.close,
         e.e12 * (1 - 2.0 / 13) + n.close * (2.0 / 13), e.e26 * (1 - 2.0 / 27) + n.close * (2.0 / 27)
  FROM e JOIN numbered n ON n.ts_code = e.ts_code AND n.rn = e.rn + 1),
line AS (SELECT ts_code, trade_date, rn, CASE WHEN rn >= 26 THEN e12 - e26 END AS macd FROM e),
s AS (
  SELECT ts_code, trade_date, rn, macd, macd AS sig FROM line WHERE rn = 26
  UNION ALL
  SELECT l.ts_code, l.trade_date, l.rn, l.macd, s.sig * (1 - 2.0 / 10) + l.macd * (2.0 / 10)
  FROM s JOIN line l ON l.ts_code = s.ts_code AND l.rn = s.rn + 1)
SELECT l.trade_date, l.ts_code, l.macd, CASE WHEN l.rn >= 34 THEN s.sig END AS macd_signal,
       CASE WHEN l.rn >= 34 THEN l.macd - s.sig END AS macd_hist
FROM line l LEFT JOIN s ON s.ts_code = l.ts_code AND s.rn = l.rn
"""
factor_query("macd_lines", "W11", SM.macd, ["macd", "macd_signal", "macd_hist"], sql=_EWM, recursive=True, digits=4)


def _streak_sql(table: str, conds: dict[str, str]) -> str:
    """Run lengths by comparing the row number with the number of the last miss."""
    inner = ", ".join(f"coalesce({c}, false) AS h{i}" for i, c in enumerate(conds.values()))
    marks = ", ".join(
        f"coalesce(max(CASE WHEN NOT h{i} THEN rn END) OVER ({BY} ROWS UNBOUNDED PRECEDING), 0) AS m{i}"
        for i in range(len(conds))
    )
    outs = ", ".join(f"CAST(rn - m{i} AS DOUBLE) AS {n}" for i, n in enumerate(conds))
    return (
        f"SELECT trade_date, ts_code, {outs} FROM (SELECT *, {marks} FROM (SELECT *, {inner}, "
        f"row_number() OVER ({BY}) AS rn FROM {table}))"
    )


factor_query(
    "up_down_streaks", "W12", PV.up_down_streaks, ["consecutive_up_days", "consecutive_down_days"],
    sql=_streak_sql("bars", {"consecutive_up_days": "pct_chg > 0", "consecutive_down_days": "pct_chg < 0"}),
)
factor_query(
    "on_balance_volume", "W13", PV.on_balance_volume, ["obv", "obv_ma5_ratio"],
    sql=select(
        {"obv": "obv", "obv_ma5_ratio": div("obv", roll("avg", "obv", 5, 3))},
        f"""(SELECT *, sum(move) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS obv FROM
             (SELECT *, sign(coalesce(close - {lag('close')}, 0.0)) * vol AS move FROM bars))""",
    ),
)
simple(
    "volume_price_trend", "W14", PV.volume_price_trend,
    digits=2,
    sql_cols={
        "volume_price_trend": "CASE WHEN pct_chg IS NOT NULL THEN sum(vol * (pct_chg / 100.0)) "
        f"OVER ({BY} ROWS UNBOUNDED PRECEDING) END"
    },
)
simple(
    "volume_momentum", "W15", PV.volume_momentum,
    {"volume_momentum": div(roll("avg", "vol", 5, 3), roll("avg", "vol", 20, 10))},
)
factor_query(
    "amihud_illiquidity", "W18", PV.amihud, ["amihud_20"],
    sql=select({"amihud_20": roll("avg", "a", 20, 10)}, f"(SELECT *, {div('abs(pct_chg / 100.0)', 'amount')} AS a FROM bars)"),
)
simple("volume_volatility", "W19", PV.turnover_volatility, {"turnover_vol_20": roll("stddev_samp", "vol", 20, 10)})
factor_query(
    "downside_volatility", "W20", PV.downside_volatility, ["downside_vol_20"],
    sql=select(
        {"downside_vol_20": roll("stddev_samp", "d", 20, 10)},
        "(SELECT *, CASE WHEN pct_chg < 0 THEN pct_chg / 100.0 ELSE 0.0 END AS d FROM bars)",
    ),
)
simple("rolling_drawdown", "W21", PV.rolling_drawdown, {"max_drawdown_60": f"close / {roll('max', 'close', 60, 30)} - 1"})
factor_query(
    "bollinger_bands", "W22", PV.bollinger, ["bollinger_width_20", "bollinger_position_20"],
    sql=select(
        {
            "bollinger_width_20": "CASE WHEN mid > 0 THEN rng / mid END",
            "bollinger_position_20": "CASE WHEN rng > 0 THEN (close - (mid - 2 * sd)) / rng ELSE 0.5 END",
        },
        f"""(SELECT *, CASE WHEN hi = lo THEN 0.0 ELSE 4 * sd END AS rng FROM
             (SELECT *, {roll('avg', 'close', 20, 10)} AS mid, {roll('stddev_samp', 'close', 20, 10)} AS sd,
                     {roll('max', 'close', 20, 10)} AS hi, {roll('min', 'close', 20, 10)} AS lo FROM bars))""",
    ),
)
factor_query(
    "average_true_range", "W23", PV.true_range_average, ["atr_14"], digits=4,
    sql=select(
        {"atr_14": roll("avg", "tr", 14, 7)},
        "(SELECT *, greatest(high - low, abs(high - pre_close), abs(low - pre_close)) AS tr FROM bars)",
    ),
)


def _position(n):
    hi, lo = roll("max", "high", n, n // 2), roll("min", "low", n, n // 2)
    return f"CASE WHEN {hi} - {lo} > 0 THEN (close - {lo}) / ({hi} - {lo}) ELSE 0.5 END"


simple("price_position", "W24", PV.price_position, {f"price_position_{n}": _position(n) for n in (20, 60)})


def _shape():
    # moments of each frame from the list of its values
    w20, w60 = over(20), over(60)
    return f"""
WITH r AS (SELECT trade_date, ts_code, pct_chg / 100.0 AS r FROM bars),
f AS (SELECT trade_date, ts_code,
        count(r) {w20} AS n20, max(r) {w20} - min(r) {w20} AS s20, skewness(r) {w20} AS k20,
        count(r) {w60} AS n60, max(r) {w60} - min(r) {w60} AS s60, kurtosis(r) {w60} AS k60 FROM r)
SELECT trade_date, ts_code, CASE WHEN n20 >= 10 AND s20 > 0 THEN k20 END AS ret_skew_20,
       CASE WHEN n60 >= 30 AND s60 > 0 THEN k60 END AS ret_kurt_60 FROM f"""


factor_query("return_skew_kurtosis", "W25", PV.return_shape, ["ret_skew_20", "ret_kurt_60"], sql=_shape())

_KDJ = f"""
WITH raw AS (
  SELECT trade_date, ts_code, row_number() OVER ({BY}) AS rn,
         coalesce(100.0 * {div('close - ' + roll('min', 'low', 9, 5), roll('max', 'high', 9, 5) + ' - ' + roll('min', 'low', 9, 5))}, 50.0) AS v
  FROM bars),
e AS (
  SELECT ts_code, trade_date, rn, v AS k, v AS d FROM raw WHERE rn = 1
  UNION ALL
  SELECT r.ts_code, r.trade_date, r.rn, e.k * (2.0 / 3) + r.v * (1.0 / 3),
         e.d * (2.0 / 3) + (e.k * (2.0 / 3) + r.v * (1.0 / 3)) * (1.0 / 3)
  FROM e JOIN raw r ON r.ts_code = e.ts_code AND r.rn = e.rn + 1)
SELECT trade_date, ts_code, k AS kdj_k, d AS kdj_d, 3 * k - 2 * d AS kdj_j FROM e
"""
factor_query("kdj_oscillator", "W26", SM.kdj, ["kdj_k", "kdj_d", "kdj_j"], sql=_KDJ, recursive=True, digits=5)
factor_query(
    "commodity_channel_index", "W27", PV.cci, ["cci_20"],
    sql=select(
        {"cci_20": "CASE WHEN n >= 10 AND spread > 0 THEN (tp - ma) / (0.015 * md) END"},
        f"""(SELECT *, list_sum(list_transform(win, lambda v: abs(v - ma))) / n AS md, list_max(win) - list_min(win) AS spread FROM
             (SELECT *, count(tp) {over(20)} AS n, avg(tp) {over(20)} AS ma, list(tp) {over(20)} AS win FROM
               (SELECT *, (high + low + close) / 3.0 AS tp FROM bars)))""",
    ),
)
factor_query(
    "up_down_volume_ratio", "W28", PV.up_down_volume, ["up_down_volume_ratio_20"],
    sql=select(
        {"up_down_volume_ratio_20": "CASE WHEN down > 0 THEN up / down ELSE 1.0 END"},
        f"""(SELECT *, {roll('sum', 'u', 20, 10)} AS up, {roll('sum', 'd', 20, 10)} AS down FROM
             (SELECT *, CASE WHEN pct_chg > 0 THEN vol ELSE 0.0 END AS u, CASE WHEN pct_chg < 0 THEN vol ELSE 0.0 END AS d FROM bars))""",
    ),
)
factor_query(
    "volume_price_divergence", "W29", PV.volume_price_divergence, ["volume_price_divergence_20"],
    sql=select(
        {"volume_price_divergence_20": corr("r", "dv", 20, 10)},
        f"(SELECT *, pct_chg / 100.0 AS r, {pct('vol', 1)} AS dv FROM bars)",
    ),
)
simple("average_traded_amount", "W30", PV.average_amount, {"avg_amount_20d": roll("avg", "amount", 20, 10)}, digits=4)
factor_query(
    "sizing_volatility", "W31", PV.sizing_volatility, ["sizing_vol"],
    sql=select({"sizing_vol": roll("stddev_samp", "r", 20, 10)}, f"(SELECT *, {pct('close', 1)} AS r FROM bars)"),
)
_FIRST = f"(adj_factor / first_value(adj_factor) OVER ({BY}))"
simple(
    "forward_adjusted_prices", "W32 A6", PV.adjust_by_first_factor,
    {c: f"{c} * {_FIRST}" for c in ("open", "close", "pre_close")}, table="bars_adj", panel="bars_adj", digits=4,
)
_LAST = f"(last_value(adj_factor) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
simple(
    "latest_factor_close", "W33", PV.adjusted_close, {"adj_close": f"close * adj_factor / {_LAST}"},
    table="bars_adj", panel="bars_adj", digits=4,
)
_ADJ = f"(SELECT *, close * adj_factor / {_LAST} AS adj_close FROM bars_adj)"
factor_query(
    "forward_return_labels", "W34", PV.forward_labels, [f"label_{h}d" for h in PV.HORIZONS],
    sql=select({f"label_{h}d": f"{div(lead('adj_close', h), 'adj_close')} - 1" for h in PV.HORIZONS}, _ADJ),
    table="bars_adj", panel="bars_adj",
)


def _fwd_vol(df):
    from pyspark.sql import functions as F

    return PV.realised_forward_vol(df.withColumn("ret", F.col("pct_chg") / 100.0), "ret", 20)


_W20F = f"OVER ({BY} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)"
factor_query(
    "realised_forward_volatility", "W35", _fwd_vol, ["realised_vol"],
    sql=select(
        {"realised_vol": f"CASE WHEN count(*) {_W20F} = 20 AND count(sq) {_W20F} >= 10 THEN sqrt(avg(sq) {_W20F}) END"},
        "(SELECT *, (pct_chg / 100.0) * (pct_chg / 100.0) AS sq FROM bars)",
    ),
)


def _all_price_volume(df):
    return PV.price_volume_factors(df)


simple(
    "price_volume_factor_group", "W1 W2 W3 W4 W5 W6", _all_price_volume,
    {
        **{f"ret_{n}": pct("close", n) for n in (5, 10, 20, 60)},
        **{f"ma{n}_bias": f"{div('close', roll('avg', 'close', n))} - 1" for n in (5, 10, 20, 60)},
        **{f"volatility_{n}": roll("stddev_samp", "pct_chg", n) for n in (5, 20, 60)},
        "amplitude": div("high - low", "close"),
        **{f"amplitude_{n}": roll("avg", div("high - low", "close"), n) for n in (5, 20)},
        **{f"vol_ratio_{n}": div("vol", roll("avg", "vol", n)) for n in (5, 20)},
        **{f"corr_price_vol_{n}": corr("close", "vol", n) for n in (5, 20)},
    },
)
