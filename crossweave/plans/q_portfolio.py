"""Queries: selection, weights, turnover, costs, reports and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import clean as C
from ..operators import ic as I
from ..operators import portfolio as P
from ..operators import price_volume as PV
from .q_aggregates import with_industry
from .q_clean import _BLOCKS, market_status
from .q_ic import ic_sql
from .q_joins import GRID
from .registry import query
from .sqltext import BY, roll

KEYS = ["trade_date", "ts_code"]

# label: the next bar's move from open to close
PRED = f"""SELECT s.trade_date, s.ts_code, s.score, l.label FROM scores s JOIN (SELECT trade_date, ts_code,
  round(lead(close) OVER ({BY}) / lead(open) OVER ({BY}) - 1 + 3.71728349e-9, 6) AS label FROM bars) l
  ON l.trade_date = s.trade_date AND l.ts_code = s.ts_code"""


def predictions(m):
    move = PV.BY_STOCK.lead("close") / PV.BY_STOCK.lead("open") - 1
    lab = m.bars().select(*KEYS, F.round(move + 3.71728349e-9, 6).alias("label"))
    return m.scores().join(lab, KEYS)


PREDI = f"SELECT p.*, g.l1_name FROM ({PRED}) p LEFT JOIN members g ON g.ts_code = p.ts_code AND g.in_date <= p.trade_date AND (g.out_date IS NULL OR p.trade_date < g.out_date)"


@query(
    "candidate_pool", "T1", needs="bars scores",
    sql=f"""WITH st AS (SELECT trade_date, ts_code, is_st, CAST(suppkey % 6 = 1 AS INTEGER) AS is_suspended, {roll('avg', 'amount', 20, 10)} AS aa
        FROM ({_BLOCKS})), sx AS (SELECT * FROM st WHERE ts_code <> 'S000002'),
      ok AS (SELECT s.trade_date, s.ts_code, s.score FROM scores s LEFT JOIN sx ON sx.trade_date = s.trade_date AND sx.ts_code = s.ts_code
             WHERE sx.ts_code IS NULL OR (sx.is_st = 0 AND sx.is_suspended = 0 AND coalesce(sx.aa >= 60, false)))
      SELECT trade_date, ts_code FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS rn FROM ok) WHERE rn <= 12
      UNION SELECT trade_date, ts_code FROM bars WHERE suppkey % 25 = 0""",
)
def _(m):
    st = PV.average_amount(market_status(m)).where("ts_code <> 'S000002'")
    st = st.select(*KEYS, "is_st", (F.col("suppkey") % 6 == 1).cast("int").alias("is_suspended"), "avg_amount_20d")
    alpha = m.scores().withColumnRenamed("score", "alpha")
    held = m.bars().select(*KEYS, F.when(F.col("suppkey") % 25 == 0, 0.1).otherwise(0.0).alias("weight"))
    return P.candidate_pool(alpha, st, held, 12, min_avg_amount=60.0)


TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS position FROM ({t}) WHERE score IS NOT NULL) WHERE position <= {k}"


def top(t, k):
    return TOP.format(t=t, k=k)


@query("top_scores_per_date", "T2", needs="scores", doubles="score",
       sql=f"SELECT trade_date, ts_code, score, position FROM ({top('SELECT * FROM scores', 10)})")
def _(m):
    return P.top_k(m.scores(), "score", 10).select(*KEYS, "score", "position")


_CAP = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, coalesce(l1_name, 'unknown') ORDER BY score DESC, ts_code) AS ir FROM ({PREDI})) WHERE ir <= 3"""


@query("industry_capped_top", "T3", needs="bars scores members", doubles="score",
       sql=f"SELECT trade_date, ts_code, score, position FROM ({top(_CAP, 12)})")
def _(m):
    return P.top_k_capped(with_industry(m, predictions(m)), "score", 12, 3).select(*KEYS, "score", "position")


_CNT = f"""SELECT trade_date, coalesce(l1_name, 'unknown') AS industry, count(*) AS n FROM ({PREDI}) WHERE score IS NOT NULL GROUP BY ALL"""
_QEQ = f"""SELECT trade_date, industry, n, CAST(least(17 // m + CASE WHEN r <= 17 % m THEN 1 ELSE 0 END, n, 4) AS BIGINT) AS quota FROM
  (SELECT *, count(*) OVER (PARTITION BY trade_date) AS m, row_number() OVER (PARTITION BY trade_date ORDER BY n DESC, industry) AS r FROM ({_CNT}))"""
_W = "PARTITION BY trade_date ORDER BY n DESC, industry"
_QPR = f"""SELECT trade_date, industry, n, CAST(q + CASE WHEN room = 1 AND turn <= lft THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (
  SELECT *, sum(room) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS turn FROM (SELECT *, CASE WHEN q < n THEN 1 ELSE 0 END AS room,
    17 - max(cum) OVER (PARTITION BY trade_date) AS lft FROM (SELECT *, cum - coalesce(lag(cum) OVER ({_W}), 0) AS q FROM (
      SELECT *, least(17, sum(a) OVER ({_W} ROWS UNBOUNDED PRECEDING)) AS cum FROM (
        SELECT *, least(greatest(1, round_even(17.0::DOUBLE * n / sum(n) OVER (PARTITION BY trade_date), 0)), n) AS a FROM ({_CNT}))))))"""


def strat_sql(q: str) -> str:
    return f"""SELECT x.trade_date, x.ts_code, x.industry, x.score FROM (SELECT *, coalesce(l1_name, 'unknown') AS industry,
      row_number() OVER (PARTITION BY trade_date, coalesce(l1_name, 'unknown') ORDER BY score DESC, ts_code) AS ir FROM ({PREDI}) WHERE score IS NOT NULL) x
      JOIN ({q}) q ON q.trade_date = x.trade_date AND q.industry = x.industry WHERE x.ir <= q.quota"""


@query("equal_industry_quotas", "T4", needs="bars scores members", sql=_QEQ)
def _(m):
    return P.industry_quotas(with_industry(m, predictions(m)).where("score IS NOT NULL"), 17, "equal", cap=4)


@query("equal_stratified_selection", "T4", needs="bars scores members", doubles="score", sql=strat_sql(_QEQ))
def _(m):
    return P.stratified_top_k(with_industry(m, predictions(m)), "score", 17, "equal", cap=4).select(*KEYS, "industry", "score")


@query("proportional_industry_quotas", "T5", needs="bars scores members", sql=_QPR)
def _(m):
    return P.industry_quotas(with_industry(m, predictions(m)).where("score IS NOT NULL"), 17, "proportional")


@query("proportional_stratified_selection", "T5", needs="bars scores members", doubles="score", sql=strat_sql(_QPR))
def _(m):
    return P.stratified_top_k(with_industry(m, predictions(m)), "score", 17, "proportional").select(*KEYS, "industry", "score")


_TOP10 = top("SELECT * FROM scores", 10)


@query(
    "score_weights", "T6", needs="scores", doubles="weight",
    sql=f"""SELECT trade_date, ts_code, w / sum(w) OVER (PARTITION BY trade_date) AS weight FROM (SELECT *, CASE WHEN max(score) OVER d > min(score) OVER d
      THEN pow((score - min(score) OVER d) / (max(score) OVER d - min(score) OVER d) * 0.9 + 0.1, 2.0) ELSE 1.0 END AS w
      FROM ({_TOP10}) WINDOW d AS (PARTITION BY trade_date))""",
)
def _(m):
    return P.score_weights(P.top_k(m.scores(), "score", 10), "score", 0.1, 2.0).select(*KEYS, "weight")


_VOLJ = f"""SELECT t.*, v.sizing_vol FROM ({_TOP10}) t LEFT JOIN (SELECT trade_date, ts_code, {roll('stddev_samp', 'r', 20, 10)} AS sizing_vol FROM
  (SELECT *, close / nullif(lag(close) OVER ({BY}), 0) - 1 AS r FROM bars)) v ON v.trade_date = t.trade_date AND v.ts_code = t.ts_code"""


@query(
    "inverse_volatility_weights", "T7", needs="scores bars", doubles="weight",
    sql=f"""SELECT trade_date, ts_code, w / sum(w) OVER (PARTITION BY trade_date) AS weight FROM (SELECT *, coalesce(1 / v, 1.0) AS w FROM (
      SELECT *, coalesce(g, quantile_cont(g, 0.5) OVER (PARTITION BY trade_date)) AS v FROM (SELECT *, CASE WHEN sizing_vol > 0 THEN sizing_vol END AS g FROM ({_VOLJ}))))""",
)
def _(m):
    vol = PV.sizing_volatility(m.bars()).select(*KEYS, "sizing_vol")
    return P.inverse_vol_weights(P.top_k(m.scores(), "score", 10).join(vol, KEYS, "left"), "sizing_vol").select(*KEYS, "weight")


_EQ10 = f"SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS weight FROM ({_TOP10})"


def equal_ten(m):
    return P.equal_weights(P.top_k(m.scores(), "score", 10))


@query(
    "board_lot_weights", "T8", needs="scores bars", doubles="lot_weight",
    sql=f"""SELECT * FROM (SELECT w.trade_date, w.ts_code, floor(weight * 10000000.0 / open / 100) * 100 * open / 10000000.0 AS lot_weight FROM ({_EQ10}) w
      JOIN bars b ON b.trade_date = w.trade_date AND b.ts_code = w.ts_code WHERE open > 0) WHERE lot_weight > 1e-8""",
)
def _(m):
    return P.board_lot_weights(equal_ten(m).join(m.bars().select(*KEYS, "open"), KEYS)).select(*KEYS, "lot_weight")


def changes_sql(weights: str, keys: str = "") -> str:
    """Previous and current weight by a full join of each date with the one before."""
    k = f"{keys}, " if keys else ""
    on = "".join(f" AND a.{c.strip()} = b.{c.strip()}" for c in keys.split(",") if c.strip())
    kk = "".join(f"coalesce(a.{c.strip()}, b.{c.strip()}) AS {c.strip()}, " for c in keys.split(",") if c.strip())
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""(WITH w AS MATERIALIZED ({weights}), d AS (SELECT {k}trade_date, row_number() OVER ({part}ORDER BY trade_date) AS i FROM (SELECT DISTINCT {k}trade_date FROM w)),
      n AS (SELECT w.*, d.i FROM w JOIN d USING ({k}trade_date)),
      f AS (SELECT {kk}coalesce(a.i, b.i + 1) AS i, coalesce(a.ts_code, b.ts_code) AS ts_code, coalesce(b.weight, 0) AS w0, coalesce(a.weight, 0) AS w1
            FROM n a FULL JOIN n b ON a.i = b.i + 1 AND a.ts_code = b.ts_code{on})
      SELECT {''.join('f.' + c.strip() + ', ' for c in keys.split(',') if c.strip())}d.trade_date, f.ts_code, w0::DOUBLE AS w0, w1::DOUBLE AS w1 FROM f JOIN d USING ({k}i))"""


_CH = changes_sql(_EQ10)


@query("weight_turnover", "W44 J11", needs="scores", doubles="turnover half_turnover",
       sql=f"SELECT trade_date, sum(abs(w1 - w0)) AS turnover, 0.5 * sum(abs(w1 - w0)) AS half_turnover FROM {_CH} GROUP BY trade_date")
def _(m):
    ch = P.weight_changes(equal_ten(m))
    return P.turnover(ch).join(P.turnover(ch, half=True).withColumnRenamed("turnover", "half_turnover"), "trade_date")


def report_sql(k: str, table: str = "p", keys: str = "", best: str | None = None, rate: str = "0.001") -> str:
    kk = f"{keys}, " if keys else ""
    held = best or f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {kk}trade_date ORDER BY score DESC, ts_code) AS position FROM {table}) WHERE position <= {k}"
    w = f"SELECT {kk}trade_date, ts_code, label, 1.0::DOUBLE / count(*) OVER (PARTITION BY {kk}trade_date) AS weight FROM ({held}) WHERE label IS NOT NULL"
    return f"""SELECT g.*, t.turnover, t.turnover * {rate} AS cost, gross_return - t.turnover * {rate} AS "return" FROM
      (SELECT {kk}trade_date, avg(label) AS gross_return, count(*) AS holdings_count FROM ({w}) GROUP BY {kk}trade_date) g
      JOIN (SELECT {kk}trade_date, sum(abs(w1 - w0)) AS turnover FROM {changes_sql(w, keys)} GROUP BY {kk}trade_date) t USING ({kk}trade_date)"""


_REP = f"""WITH p AS MATERIALIZED ({PRED}), rep AS MATERIALIZED ({report_sql('10')}),
  report AS MATERIALIZED (SELECT r.*, b.benchmark, "return" - b.benchmark AS excess_return, 1000000 * product(1 + "return") OVER (ORDER BY r.trade_date ROWS UNBOUNDED PRECEDING) AS account_value
  FROM rep r JOIN (SELECT trade_date, avg(label) AS benchmark FROM p GROUP BY trade_date) b ON b.trade_date = r.trade_date)"""


def report(m):
    return P.top_k_report(predictions(m), 10, 0.001, 1_000_000.0)


_RC = 'gross_return turnover cost "return" benchmark excess_return account_value'


@query("top_k_portfolio_report", "T9", needs="bars scores", doubles=_RC, digits=4, sql=f"{_REP} SELECT * FROM report")
def _(m):
    return report(m)


def perf_sql(table: str, x: str, keys: str = "", ann: int = 252) -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}n, nav - 1 AS total_return, CASE WHEN nav > 0 THEN pow(nav, {ann}.0 / n) - 1 END AS annualized_return, sd * sqrt({ann}) AS annualized_volatility,
      m * {ann} / nullif(sd * sqrt({ann}), 0) AS sharpe, m * {ann} / nullif(dsd * sqrt({ann}), 0) AS sortino, dd AS max_drawdown,
      CASE WHEN dd < 0 THEN (pow(nav, {ann}.0 / n) - 1) / abs(dd) END AS calmar, win_rate, m AS mean_daily_return, med AS median_daily_return,
      best AS best_daily_return, worst AS worst_daily_return, sk AS skew, ku AS kurtosis FROM (SELECT {k}count(*) AS n, arg_max(nav, trade_date) AS nav,
      stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0 THEN r END) AS dsd, min(nav / pk - 1) AS dd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
      avg(r) AS m, quantile_cont(r, 0.5) AS med, max(r) AS best, min(r) AS worst, skewness(r) AS sk, kurtosis(r) AS ku FROM (
        SELECT *, max(nav) OVER ({part}ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT {k}trade_date, {x} AS r,
          product(1 + {x}) OVER ({part}ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS nav FROM {table})) {g})"""


_PERF = " ".join(A.PERFORMANCE)


@query("performance_metrics", "A17", needs="bars scores", doubles=_PERF, sql=f"{_REP} {perf_sql('report', chr(34) + 'return' + chr(34))}", digits=5)
def _(m):
    return A.performance(report(m), "return")


@query(
    "relative_metrics", "A18", needs="bars scores", digits=5,
    doubles="sharpe benchmark_sharpe alpha alpha_daily beta excess_total_return excess_annualized_return tracking_error information_ratio correlation",
    sql=f"""{_REP} SELECT mr * 252 / (sr * sqrt(252)) AS sharpe, mb * 252 / (sb * sqrt(252)) AS benchmark_sharpe, (mr - be * mb) * 252 AS alpha, mr - be * mb AS alpha_daily,
      be AS beta, er AS excess_total_return, me * 252 AS excess_annualized_return, se * sqrt(252) AS tracking_error, me * 252 / (se * sqrt(252)) AS information_ratio, co AS correlation
      FROM (SELECT avg("return") AS mr, avg(benchmark) AS mb, avg(excess_return) AS me, stddev_samp("return") AS sr, stddev_samp(benchmark) AS sb,
        stddev_samp(excess_return) AS se, covar_samp("return", benchmark) / var_samp(benchmark) AS be, corr("return", benchmark) AS co,
        product(1 + "return") - product(1 + benchmark) AS er FROM report)""",
)
def _(m):
    return A.relative_performance(report(m), "return", "benchmark")


@query(
    "nav_metrics", "A19", needs="bars scores", digits=5,
    doubles="max_drawdown win_rate total_return annual_return annual_volatility sharpe_ratio sortino_ratio calmar_ratio avg_turnover avg_holdings",
    sql=f"""{_REP} SELECT dd AS max_drawdown, wr AS win_rate, n AS n_trading_days, tr AS total_return, ar AS annual_return, av AS annual_volatility, ar / nullif(av, 0) AS sharpe_ratio,
      ar / nullif(coalesce(dv, av), 0) AS sortino_ratio, CASE WHEN dd < 0 THEN ar / abs(dd) ELSE 0 END AS calmar_ratio, mturn AS avg_turnover, mhold AS avg_holdings FROM (
      SELECT *, pow(1 + tr, 1 / (days / 365.25)) - 1 AS ar FROM (SELECT arg_max(account_value, trade_date) / arg_min(account_value, trade_date) - 1 AS tr,
        date_diff('day', strptime(min(trade_date)::VARCHAR, '%Y%m%d'), strptime(max(trade_date)::VARCHAR, '%Y%m%d')) AS days, stddev_samp("return") * sqrt(252) AS av,
        stddev_samp(CASE WHEN "return" < 0 THEN "return" END) * sqrt(252) AS dv, min(account_value / pk - 1) AS dd, avg(CASE WHEN "return" > 0 THEN 1.0 ELSE 0.0 END) AS wr,
        count(*) AS n, avg(turnover) AS mturn, avg(holdings_count) AS mhold FROM (SELECT *, max(account_value) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS pk FROM report)))""",
)
def _(m):
    rep = report(m)
    extra = rep.agg(F.avg("turnover").alias("avg_turnover"), F.avg("holdings_count").alias("avg_holdings"))
    one = A.nav_performance(rep, "account_value", "return").withColumn("_one", F.lit(0))
    return one.join(extra.withColumn("_one", F.lit(0)), "_one").drop("_one")


@query(
    "account_metrics", "A20", needs="bars scores", digits=4,
    doubles="final_value max_drawdown win_rate mean_daily_return best_daily_return worst_daily_return mean_turnover total_cost total_return annualized_return annualized_volatility sharpe sortino calmar",
    sql=f"""{_REP} SELECT n AS trading_days, fv AS final_value, dd AS max_drawdown, wr AS win_rate, m AS mean_daily_return, bs AS best_daily_return, ws AS worst_daily_return,
      mt AS mean_turnover, tc AS total_cost, ad AS active_days, tr AS total_return, ar AS annualized_return, av AS annualized_volatility, ar / nullif(av, 0) AS sharpe,
      ar / nullif(dv, 0) AS sortino, ar / nullif(abs(dd), 0) AS calmar FROM (SELECT *, pow(1 + tr, 252.0 / n) - 1 AS ar FROM (SELECT count(*) AS n,
        arg_max(account_value, trade_date) AS fv, arg_max(account_value, trade_date) / 1000000 - 1 AS tr, min(account_value / pk - 1) AS dd,
        avg(CASE WHEN "return" > 0 THEN 1.0 ELSE 0.0 END) AS wr, avg("return") AS m, max("return") AS bs, min("return") AS ws, avg(turnover) AS mt, sum(cost) AS tc,
        sum((turnover > 0)::INT)::BIGINT AS ad, stddev_samp("return") * sqrt(252) AS av, stddev_samp(CASE WHEN "return" < 0 THEN "return" END) * sqrt(252) AS dv
        FROM (SELECT *, max(account_value) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS pk FROM report)))""",
)
def _(m):
    return A.account_performance(report(m), 1_000_000.0)


@query(
    "yearly_metrics", "A21", needs="bars scores", digits=5, doubles="total_return max_drawdown annual_return sharpe",
    sql=f"""{_REP} SELECT year, n AS trading_days, tr AS total_return, dd AS max_drawdown, tr * 252 / n AS annual_return, coalesce(m / nullif(s, 0) * sqrt(252), 0) AS sharpe FROM (
      SELECT year, count(*) AS n, arg_max(account_value, trade_date) / arg_min(account_value, trade_date) - 1 AS tr, min((account_value - pk) / pk) AS dd, avg(r) AS m, stddev_samp(r) AS s
      FROM (SELECT *, max(account_value) OVER (PARTITION BY year ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS pk,
        account_value / lag(account_value) OVER (PARTITION BY year ORDER BY trade_date) - 1 AS r FROM (SELECT *, CAST(trade_date // 10000 AS INTEGER) AS year FROM report)) GROUP BY year) WHERE n >= 5""",
)
def _(m):
    return A.yearly_performance(report(m))


_SUMCOLS = ["return", "turnover", "excess_return"]


@query(
    "metrics_table_summary", "A23", needs="bars scores", doubles="mean std min max",
    sql=_REP + " UNION ALL ".join(
        f""" SELECT '{c}' AS metric, avg("{c}") AS mean, stddev_samp("{c}") AS std, min("{c}") AS min, max("{c}") AS max FROM report""" for c in _SUMCOLS
    ),
)
def _(m):
    return A.column_summary(report(m), _SUMCOLS)


_CMP = ["sharpe", "max_drawdown", "win_rate"]


@query(
    "metric_comparison", "A24", needs="bars scores", doubles="base new diff", digits=5,
    sql=f"""{_REP}, a AS ({perf_sql('report', 'benchmark')}), b AS ({perf_sql('report', chr(34) + 'return' + chr(34))}) """
    + " UNION ALL ".join(f"SELECT '{c}' AS metric, a.{c} AS base, b.{c} AS new, b.{c} - a.{c} AS diff FROM a, b" for c in _CMP),
)
def _(m):
    rep = report(m)
    return A.compare_metrics(A.performance(rep, "benchmark"), A.performance(rep, "return"), _CMP)


_SWEEP = f"""WITH p AS MATERIALIZED ({PRED}), held AS MATERIALIZED (SELECT g.topk, g.cost_bp, x.* FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS position
  FROM p) x JOIN param_grid g ON x.position <= g.topk), rep AS MATERIALIZED ({report_sql('', keys='topk, cost_bp', best='SELECT * FROM held', rate='cost_bp / 10000.0')})
  {perf_sql('rep', chr(34) + 'return' + chr(34), 'topk, cost_bp')}"""


def sweep(m):
    return P.parameter_sweep(predictions(m), GRID, F.col("cost_bp") / 10000.0)


@query("parameter_sweep", "T10 J15", needs="bars scores param_grid", doubles=_PERF, sql=_SWEEP, digits=5)
def _(m):
    return sweep(m)


@query("parameter_leaderboard", "A25 T10", needs="bars scores param_grid", doubles=_PERF, digits=5,
       sql=_SWEEP + " ORDER BY sharpe DESC, topk, cost_bp LIMIT 3")
def _(m):
    return P.leaderboard(sweep(m), "sharpe", 3, ["topk", "cost_bp"])


@query("trade_list", "T11", needs="scores", doubles="current_weight target_weight trade_weight",
       sql=f"SELECT trade_date, ts_code, w0 AS current_weight, w1 AS target_weight, w1 - w0 AS trade_weight FROM {_CH}")
def _(m):
    return P.trade_list(P.weight_changes(equal_ten(m)))


_SES = """SELECT trade_date, ts_code, CASE WHEN pre_close > 0 AND open > 0 THEN least(greatest((open - pre_close) / pre_close, -0.35), 0.60) ELSE 0.0 END AS gap,
  CASE WHEN close > 0 AND open > 0 THEN least(greatest((close - open) / open, -0.35), 0.60) ELSE 0.0 END AS intra FROM bars"""


@query(
    "session_return_split", "T13", needs="scores bars", doubles="hold_ret buy_ret sell_ret day_ret",
    sql=f"""SELECT *, hold_ret + buy_ret + sell_ret AS day_ret FROM (SELECT c.trade_date, sum(least(w0, w1) * ((1 + gap) * (1 + intra) - 1)) AS hold_ret,
      sum(greatest(w1 - w0, 0) * intra) AS buy_ret, sum(greatest(w0 - w1, 0) * gap) AS sell_ret FROM {_CH} c JOIN ({_SES}) s
      ON s.trade_date = c.trade_date AND s.ts_code = c.ts_code GROUP BY c.trade_date)""",
)
def _(m):
    return P.split_return(P.weight_changes(equal_ten(m)), C.session_returns(m.bars()))


@query(
    "trading_cost", "T14", needs="scores", doubles="buy_amount sell_amount fee slippage_cost cost",
    sql=f"""SELECT *, fee + slippage_cost AS cost FROM (SELECT *, buy_amount * 0.0003 + sell_amount * 0.0013 AS fee, (buy_amount + sell_amount) * 0.001 AS slippage_cost FROM (
      SELECT trade_date, sum(greatest(w1 - w0, 0)) AS buy_amount, sum(greatest(w0 - w1, 0)) AS sell_amount FROM {_CH} GROUP BY trade_date))""",
)
def _(m):
    return P.trading_cost(P.weight_changes(equal_ten(m)), 0.0003, 0.0013, 0.001)


_TILT = f"""SELECT *, least(CASE WHEN s > 0 THEN a / s ELSE 1.0 / n END, 0.2) AS c0 FROM (SELECT *, sum(a) OVER d AS s, count(*) OVER d AS n FROM
  (SELECT *, greatest(score, 0.0) AS a FROM ({_EQ10})) WINDOW d AS (PARTITION BY trade_date))"""


@query(
    "alpha_tilt_weights", "T15", needs="scores", doubles="weight",
    sql=f"""SELECT trade_date, ts_code, CASE WHEN sum(t) OVER (PARTITION BY trade_date) > 0 THEN t / sum(t) OVER (PARTITION BY trade_date) ELSE t END AS weight FROM (
      SELECT *, CASE WHEN round(mm, 9) < 0.08 THEN 0.0 ELSE mm END AS t FROM (SELECT *, b / sum(b) OVER (PARTITION BY trade_date) AS mm FROM (
        SELECT *, 0.7 * weight + 0.3 * c0 / sum(c0) OVER (PARTITION BY trade_date) AS b FROM ({_TILT}))))""",
)
def _(m):
    return P.alpha_tilt_weights(equal_ten(m), "score", "weight", 0.3, 0.2, 0.08).select(*KEYS, "weight")


_DIAG = "expected_alpha max_weight style_vol style_amount turnover alpha_retention"


@query(
    "portfolio_diagnostics", "K24", needs="scores bars members", doubles=_DIAG, digits=4,
    sql=f"""WITH w AS MATERIALIZED ({_EQ10}), x AS (SELECT w.*, b.vol, b.amount, g.l1_name FROM w JOIN bars b ON b.trade_date = w.trade_date AND b.ts_code = w.ts_code
        LEFT JOIN members g ON g.ts_code = w.ts_code AND g.in_date <= w.trade_date AND (g.out_date IS NULL OR w.trade_date < g.out_date)),
      t AS (SELECT trade_date, 0.5 * sum(abs(w1 - w0)) AS turnover FROM {changes_sql('SELECT * FROM w')} GROUP BY trade_date),
      r AS (SELECT trade_date, avg(score) AS raw FROM w WHERE position <= 5 GROUP BY trade_date)
      SELECT a.*, t.turnover, CASE WHEN raw <> 0 THEN expected_alpha / raw ELSE 0 END AS alpha_retention FROM (SELECT trade_date, sum(score * weight) AS expected_alpha,
        max(weight) AS max_weight, sum((weight > 1e-6)::INT)::BIGINT AS n_holdings, count(DISTINCT l1_name) AS n_industries, sum(weight * vol) AS style_vol,
        sum(weight * amount) AS style_amount FROM x GROUP BY trade_date) a JOIN t ON t.trade_date = a.trade_date JOIN r ON r.trade_date = a.trade_date""",
)
def _(m):
    w = equal_ten(m).drop("position").withColumnRenamed("score", "alpha")
    ch = P.weight_changes(w)
    labelled = with_industry(m, w)
    return P.portfolio_diagnostics(labelled, ch, m.bars(), ["vol", "amount"], 5)


@query(
    "prediction_error", "A26 M9", needs="bars scores", doubles="rmse pooled_ic mean_rank_ic",
    sql=f"""WITH p AS MATERIALIZED (SELECT * FROM ({PRED}) WHERE label IS NOT NULL) SELECT sqrt(avg((score - label) * (score - label))) AS rmse, corr(score, label) AS pooled_ic, count(*) AS rows,
            (SELECT avg(rank_ic) FROM ({ic_sql('SELECT * FROM p', 'trade_date', 2)})) AS mean_rank_ic FROM p""",
)
def _(m):
    p = predictions(m).where("label IS NOT NULL")
    ic = I.daily_ic(p, group_rows=m.names).agg(F.avg("rank_ic").alias("mean_rank_ic")).withColumn("_one", F.lit(0))
    return A.regression_error(p).withColumn("_one", F.lit(0)).join(ic, "_one").drop("_one")
