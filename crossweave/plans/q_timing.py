"""Queries: curves, position sizes, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ic as I
from ..operators import timing as TM
from .q_ic import _IC, scored
from .q_portfolio import _REP, report
from .registry import query

# the market's mean move from open to close
SERIES = "SELECT trade_date, round(avg(close / open - 1) + 3.71728349e-9, 6) AS r FROM bars GROUP BY trade_date"


def market_series(m):
    return m.bars().groupBy("trade_date").agg(F.round(F.avg(F.col("close") / F.col("open") - 1) + 3.71728349e-9, 6).alias("r"))


_ALL = "ROWS UNBOUNDED PRECEDING"


@query(
    "drawdown_curve", "W16", needs="bars", doubles="r nav drawdown",
    sql=f"""SELECT trade_date, r, nav, nav / max(nav) OVER (ORDER BY trade_date {_ALL}) - 1 AS drawdown FROM
            (SELECT *, product(1 + r) OVER (ORDER BY trade_date {_ALL}) AS nav FROM ({SERIES}))""",
)
def _(m):
    return A.with_drawdown(market_series(m), "r")


@query(
    "drawdown_interval", "W16", needs="bars", doubles="max_drawdown",
    sql=f"""WITH c AS (SELECT *, round(product(1 + r) OVER (ORDER BY trade_date {_ALL}) + 3.71728349e-9, 6) AS nav FROM ({SERIES})),
      d AS (SELECT *, nav / max(nav) OVER (ORDER BY trade_date {_ALL}) - 1 AS dd FROM c),
      t AS (SELECT trade_date AS trough_date, dd FROM d ORDER BY dd, trade_date LIMIT 1)
      SELECT dd AS max_drawdown, (SELECT trade_date FROM c WHERE trade_date <= t.trough_date ORDER BY nav DESC, trade_date LIMIT 1) AS peak_date, trough_date FROM t""",
)
def _(m):
    nav = A.with_drawdown(market_series(m), "r").withColumn("nav", F.round(F.col("nav") + 3.71728349e-9, 6))
    return TM.drawdown_interval(nav)


@query(
    "cumulative_curves", "W17", needs="bars scores", doubles="return_curve benchmark_curve", digits=4,
    sql=f"""{_REP} SELECT trade_date, product(1 + "return") OVER (ORDER BY trade_date {_ALL}) AS return_curve,
            product(1 + benchmark) OVER (ORDER BY trade_date {_ALL}) AS benchmark_curve FROM report""",
)
def _(m):
    return TM.curves(report(m), ["return", "benchmark"]).select("trade_date", "return_curve", "benchmark_curve")


_DAYS = "SELECT *, date_diff('day', DATE '1970-01-01', strptime(trade_date::VARCHAR, '%Y%m%d')::DATE) AS d FROM ({})"
_TREND = f"""SELECT trade_date, len(h) AS n, h[-1] AS last, CASE WHEN len(h) > 0 THEN list_sum(h[greatest(1, len(h) - 9):]) / least(len(h), 10) END AS ma FROM
  (SELECT *, coalesce(list(nav) OVER (ORDER BY d RANGE BETWEEN 210 PRECEDING AND 1 PRECEDING), []) AS h FROM
    (SELECT *, product(1 + r) OVER (ORDER BY trade_date {_ALL}) AS nav FROM ({_DAYS.format(SERIES)})))"""


@query(
    "trend_position", "W36", needs="bars", doubles="position banded",
    sql=f"""SELECT trade_date, CASE WHEN n >= 5 THEN CASE WHEN last > ma THEN 1.0 ELSE 0.5 END ELSE 1.0 END::DOUBLE AS position,
      CASE WHEN n >= 5 THEN CASE WHEN last >= ma * 1.02 THEN 1.0 WHEN last <= ma * 0.98 THEN 0.5
        ELSE greatest(0.0, least(1.0, 0.5 + (last - ma * 0.98) / (ma * 1.02 - ma * 0.98) * 0.5)) END ELSE 1.0 END::DOUBLE AS banded FROM ({_TREND})""",
)
def _(m):
    b = market_series(m)
    banded = TM.trend_position(b, "r", 10, 210, band=0.02).withColumnRenamed("position", "banded")
    return TM.trend_position(b, "r", 10, 210).join(banded, "trade_date")


_PAST = "OVER (ORDER BY d RANGE BETWEEN 140 PRECEDING AND 1 PRECEDING)"


@query(
    "target_volatility_position", "W37", needs="bars", doubles="position",
    sql=f"""WITH v AS (SELECT trade_date, CASE WHEN count(r) {_PAST} >= 5 THEN stddev_samp(r) {_PAST} END * sqrt(252) AS vol FROM ({_DAYS.format(SERIES)})),
      p AS (SELECT trade_date, least(greatest(0.2 / nullif(avg(vol) OVER (ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0), 0.1), 1.0) AS p FROM v WHERE vol > 0)
      SELECT v.trade_date, coalesce(p.p, 1.0) AS position FROM v LEFT JOIN p ON p.trade_date = v.trade_date""",
)
def _(m):
    return TM.target_vol_position(market_series(m), "r", 0.2, 10, 3, low=0.1, lookback_days=140)


_DISP = """SELECT trade_date, avg(CASE WHEN p > n - greatest(1, floor(n * 0.1)) THEN score END) - avg(CASE WHEN p <= greatest(1, floor(n * 0.1)) THEN score END) AS x FROM
  (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score, ts_code) AS p, count(*) OVER (PARTITION BY trade_date) AS n FROM scores) GROUP BY trade_date"""
_HIST = "OVER (ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


def _ramp(x, lo, hi):
    return f"CASE WHEN {x} <= {lo} THEN 0.2 WHEN {x} >= {hi} THEN 1.0 ELSE 0.2 + least(greatest(({x} - {lo}) / ({hi} - {lo}), 0.0), 1.0) * 0.8 END"


@query(
    "dispersion_position", "W38", needs="scores", doubles="dispersion absolute relative",
    sql=f"""WITH d AS MATERIALIZED (SELECT trade_date, round(x + 3.71728349e-9, 6) AS dispersion FROM ({_DISP})),
      s AS (SELECT *, avg(dispersion) OVER (ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s, list(dispersion) {_HIST} AS h FROM d),
      q AS (SELECT *, len(list_filter(h, lambda v: v < s)) / len(h)::DOUBLE AS q FROM s)
      SELECT trade_date, dispersion, ({_ramp('s', 6.0, 10.0)})::DOUBLE AS absolute, CASE WHEN len(h) >= 20 THEN {_ramp('q', 0.2, 0.8)} ELSE 1.0 END::DOUBLE AS relative FROM q""",
)
def _(m):
    d = TM.score_dispersion(m.scores(), "score", 0.1, 0.1, m.names)
    d = d.withColumn("dispersion", F.round(F.col("dispersion") + 3.71728349e-9, 6))
    a = TM.dispersion_position(d, 5, 60, 0.2, 1.0, (6.0, 10.0)).withColumnRenamed("position", "absolute")
    r = TM.dispersion_position(d, 5, 60, 0.2, 1.0, (0.2, 0.8), relative=True).withColumnRenamed("position", "relative")
    return d.join(a, "trade_date").join(r, "trade_date")


@query(
    "score_threshold_position", "W39", needs="scores", doubles="position",
    sql="""SELECT trade_date, CASE WHEN t <= 0.5 THEN 0.2 ELSE least(greatest(0.2 + least(greatest((t - 0.5) / 0.5, 0.0), 1.0) * 0.8, 0.2), 1.0) END::DOUBLE AS position FROM (
      SELECT trade_date, avg(CASE WHEN p <= greatest(1, floor(n * 0.2)) THEN s END) AS t FROM (SELECT trade_date, score / 6.0 AS s,
        row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS p, count(*) OVER (PARTITION BY trade_date) AS n FROM scores) GROUP BY trade_date)""",
)
def _(m):
    return TM.threshold_position(m.scores().withColumn("score", F.col("score") / 6.0), "score", 0.2, 0.5, 0.2, group_rows=m.names)


_L20 = "OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(
    "volatility_regime_scale", "W40", needs="bars", doubles="scale",
    sql=f"""SELECT trade_date, CASE WHEN v < 0.012 THEN 1.2 WHEN v > 0.016 THEN 0.8 ELSE 1.0 END::DOUBLE AS scale FROM
            (SELECT trade_date, CASE WHEN count(r) {_L20} >= 20 THEN stddev_pop(r) {_L20} END AS v FROM ({SERIES}))""",
)
def _(m):
    return TM.vol_regime_scale(market_series(m), "r", 20, 0.012, 0.016, 1.2, 0.8)


@query(
    "ic_momentum_scale", "W41", needs="bars scores", doubles="scale",
    sql=f"""SELECT trade_date, CASE WHEN n >= 20 AND a IS NOT NULL THEN 0.5 + least(greatest((a - (-0.02)) / 0.05, 0.0), 1.0) * 1.0 ELSE 1.0 END AS scale FROM
            (SELECT trade_date, count(*) {_L20} AS n, avg(ic) {_L20} AS a FROM ({_IC}) WHERE count >= 10)""",
)
def _(m):
    ic = I.daily_ic(scored(m), min_rows=5, group_rows=m.names)
    return TM.ic_momentum_scale(ic, 20, -0.02, 0.05, 0.5, 1.5)


@query(
    "rebalance_calendar", "W42", needs="bars",
    sql="""WITH d AS (SELECT DISTINCT trade_date FROM bars), n AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM d)
      SELECT 'daily' AS freq, trade_date FROM d UNION ALL
      SELECT 'weekly', min(trade_date) FROM d GROUP BY date_trunc('week', strptime(trade_date::VARCHAR, '%Y%m%d')) UNION ALL
      SELECT 'monthly', min(trade_date) FROM d GROUP BY trade_date // 100 UNION ALL SELECT '10d', trade_date FROM n WHERE (i - 1) % 10 = 0""",
)
def _(m):
    dates = m.lines().select("trade_date").distinct()
    parts = [TM.rebalance_dates(dates, f).select(F.lit(f).alias("freq"), "trade_date") for f in ("daily", "weekly", "monthly", "10d")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    "smoothed_scores", "W43", needs="scores", doubles="smoothed", recursive=True,
    sql="""WITH n AS (SELECT ts_code, trade_date, score, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS rn FROM scores),
      e AS (SELECT ts_code, trade_date, rn, score AS smoothed FROM n WHERE rn = 1
            UNION ALL SELECT n.ts_code, n.trade_date, n.rn, (1 - 2.0 / 6) * e.smoothed + (2.0 / 6) * n.score FROM e JOIN n ON n.ts_code = e.ts_code AND n.rn = e.rn + 1)
      SELECT trade_date, ts_code, smoothed FROM e""",
)
def _(m):
    return TM.smooth_scores(m.scores(), "score", "smoothed", 5).select("trade_date", "ts_code", "smoothed")


_F20 = "OVER (ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)"


@query(
    "realised_portfolio_volatility", "W35", needs="bars", doubles="realised_vol",
    sql=f"""SELECT trade_date, CASE WHEN count(*) {_F20} = 20 AND count(r) {_F20} >= 10 THEN stddev_samp(r) {_F20} END AS realised_vol FROM ({SERIES})""",
)
def _(m):
    return TM.realised_portfolio_vol(market_series(m), "r")
