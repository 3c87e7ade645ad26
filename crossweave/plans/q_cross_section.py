"""Queries: normalisation, industry-relative factors, label ranks, residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cross_section as X
from ..operators import fundamental as FU
from ..operators import price_volume as PV
from .q_aggregates import WITH_INDUSTRY, with_industry
from .q_joins import HORIZONS_SQL, PIT, horizon_scores
from .registry import query
from .sqltext import BY, pct, rank_pct, roll

KEYS = ["trade_date", "ts_code"]


def winsor_sql(table: str, cols, part: str = "trade_date", q: float = 0.01) -> str:
    """``table`` with each column clipped to its group's quantiles."""
    w = f"OVER (PARTITION BY {part})"
    reps = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, quantile_cont({c}, {q}) {w}), quantile_cont({c}, {1 - q}) {w}) END AS {c}"
        for c in cols
    )
    return f"SELECT * REPLACE ({reps}) FROM ({table})"


def z_sql(table: str, cols, part: str = "trade_date", dev: str = "stddev_samp") -> str:
    w = f"OVER (PARTITION BY {part})"
    reps = ", ".join(
        f"""CASE WHEN {dev}({c}) {w} IS NULL OR max({c}) {w} = min({c}) {w} THEN {c} - avg({c}) {w}
            ELSE ({c} - avg({c}) {w}) / nullif({dev}({c}) {w}, 0) END AS {c}"""
        for c in cols
    )
    return f"SELECT * REPLACE ({reps}) FROM ({table})"


_F = "SELECT trade_date, ts_code, suppkey, round(" + pct("close", 20) + " + 3.71728349e-9, 6) AS ret_20, " + \
     f"round({roll('stddev_samp', 'pct_chg', 20)} + 3.71728349e-9, 6) AS volatility_20 FROM bars"


def two_factors(m):
    df = PV.volatility(PV.returns(m.bars(), (20,)), (20,))
    r6 = lambda c: F.round(F.col(c) + 3.71728349e-9, 6).alias(c)
    return df.select("trade_date", "ts_code", "suppkey", r6("ret_20"), r6("volatility_20"))


_TWO = ["ret_20", "volatility_20"]


@query("date_winsorize", "X1", needs="bars", doubles="ret_20 volatility_20",
       sql=f"SELECT trade_date, ts_code, ret_20, volatility_20 FROM ({winsor_sql(_F, _TWO)})")
def _(m):
    return X.winsorize(two_factors(m), _TWO, group_rows=m.names).select(*KEYS, *_TWO)


@query("date_zscore", "X2", needs="bars", doubles="ret_20 volatility_20",
       sql=f"SELECT trade_date, ts_code, ret_20, volatility_20 FROM ({z_sql(_F, _TWO)})")
def _(m):
    return X.zscore(two_factors(m), _TWO, group_rows=m.names).select(*KEYS, *_TWO)


@query(
    "processed_factors", "X3", needs="bars", doubles="ret_20_cc_processed volatility_20_cc_processed",
    sql=f"""SELECT trade_date, ts_code, ret_20 AS ret_20_cc_processed, volatility_20 AS volatility_20_cc_processed
            FROM ({z_sql(winsor_sql(_F, _TWO), _TWO)})""",
)
def _(m):
    df = X.process_factors(two_factors(m), [*_TWO, "not_there"], missing="skip", group_rows=m.names)
    return df.select(*KEYS, *[f"{c}_cc_processed" for c in _TWO])


_FI = f"SELECT f.*, g.l1_name FROM ({_F}) f LEFT JOIN members g ON g.ts_code = f.ts_code AND g.in_date <= f.trade_date AND (g.out_date IS NULL OR f.trade_date < g.out_date)"


def ind_mean(table: str, cols) -> str:
    reps = ", ".join(
        f"CASE WHEN l1_name IS NOT NULL THEN {c} - avg({c}) OVER (PARTITION BY trade_date, l1_name) END AS {c}" for c in cols
    )
    return f"SELECT * REPLACE ({reps}) FROM ({table})"


@query(
    "industry_neutral_factors", "X4 X3", needs="bars members", doubles="ret_20_cc_processed volatility_20_cc_processed",
    sql=f"""SELECT trade_date, ts_code, ret_20 AS ret_20_cc_processed, volatility_20 AS volatility_20_cc_processed
            FROM ({z_sql(ind_mean(winsor_sql(_FI, _TWO), ['volatility_20']), _TWO)})""",
)
def _(m):
    df = with_industry(m, two_factors(m))
    df = X.process_factors(df, _TWO, neutral=["volatility_20"], group_rows=m.names)
    return df.select(*KEYS, *[f"{c}_cc_processed" for c in _TWO])


_REL = ["industry_ret_1", "industry_ret_5", "industry_ret_20", "relative_strength_5", "relative_strength_20",
        "roe_ind_neutral", "roa_ind_neutral", "revenue_yoy_ind_neutral"]
_RB = f"SELECT *, pct_chg / 100.0 AS ret_1, {pct('close', 5)} AS ret_5, {pct('close', 20)} AS ret_20 FROM bars"
_RBI = f"""SELECT b.*, r.roe, r.roa, r.or_yoy, g.l1_name FROM ({_RB}) b ASOF LEFT JOIN {PIT} r ON b.ts_code = r.ts_code AND b.trade_date >= r.ann_date
  LEFT JOIN members g ON g.ts_code = b.ts_code AND g.in_date <= b.trade_date AND (g.out_date IS NULL OR b.trade_date < g.out_date)"""
_im = lambda c: f"CASE WHEN l1_name IS NOT NULL THEN avg({c}) OVER (PARTITION BY trade_date, l1_name) END"


@query(
    "industry_relative_factors", "X5", needs="bars members reports", doubles=" ".join(_REL),
    sql=f"""SELECT trade_date, ts_code, {_im('ret_1')} AS industry_ret_1, {_im('ret_5')} AS industry_ret_5, {_im('ret_20')} AS industry_ret_20,
      ret_5 - {_im('ret_5')} AS relative_strength_5, ret_20 - {_im('ret_20')} AS relative_strength_20, roe - {_im('roe')} AS roe_ind_neutral,
      roa - {_im('roa')} AS roa_ind_neutral, or_yoy - {_im('or_yoy')} AS revenue_yoy_ind_neutral FROM ({_RBI})""",
)
def _(m):
    df = PV.returns(m.bars(), (5, 20)).withColumn("ret_1", F.col("pct_chg") / 100.0)
    df = FU.to_daily(df.select(*KEYS, "ret_1", "ret_5", "ret_20"), m.reports(), ["roe", "roa", "or_yoy"])
    return X.industry_relative(with_industry(m, df), group_rows=m.names).select(*KEYS, *_REL)


_IR = {"industry_rank_ret_20": "ret_20", "industry_rank_roe": "roe", "industry_rank_gross_margin": "grossprofit_margin",
       "industry_rank_roic": "roic", "industry_rank_netprofit_yoy": "netprofit_yoy", "industry_rank_turn_days": "turn_days"}
_IRB = f"""SELECT b.trade_date, b.ts_code, round(b.r + 3.71728349e-9, 6) AS ret_20, r.roe, r.grossprofit_margin, r.roic, r.netprofit_yoy, r.turn_days, g.l1_name
  FROM (SELECT *, {pct('close', 20)} AS r FROM bars) b ASOF LEFT JOIN {PIT} r ON b.ts_code = r.ts_code AND b.trade_date >= r.ann_date
  LEFT JOIN members g ON g.ts_code = b.ts_code AND g.in_date <= b.trade_date AND (g.out_date IS NULL OR b.trade_date < g.out_date)"""


@query(
    "industry_ranks", "X6", needs="bars members reports", doubles=" ".join(_IR),
    sql="SELECT trade_date, ts_code, "
    + ", ".join(f"CASE WHEN l1_name IS NOT NULL THEN {rank_pct(s, 'trade_date, l1_name')} END AS {o}" for o, s in _IR.items())
    + f" FROM ({_IRB})",
)
def _(m):
    df = PV.returns(m.bars(), (20,)).select(*KEYS, F.round(F.col("ret_20") + 3.71728349e-9, 6).alias("ret_20"))
    df = FU.to_daily(df, m.reports(), [s for s in _IR.values() if s != "ret_20"])
    return X.group_ranks(with_industry(m, df), _IR, ["trade_date", "l1_name"], m.names).select(*KEYS, *_IR)


_IBY = "PARTITION BY l1_name ORDER BY trade_date"
_DAILY = f"SELECT trade_date, l1_name, avg(pct_chg) AS r FROM ({WITH_INDUSTRY}) WHERE l1_name IS NOT NULL GROUP BY ALL"


@query(
    "industry_momentum", "X7 X8", needs="bars members",
    doubles="industry_vol_20 industry_momentum_5 industry_momentum_20 relative_momentum_20", digits=2,
    sql=f"""WITH d AS (SELECT trade_date, l1_name, {roll('stddev_samp', 'r', 20, 10, _IBY)} AS industry_vol_20,
        {roll('product', '(1 + r / 100.0)', 5, 3, _IBY)} - 1 AS industry_momentum_5,
        {roll('product', '(1 + r / 100.0)', 20, 10, _IBY)} - 1 AS industry_momentum_20 FROM ({_DAILY})),
      o AS (SELECT trade_date, ts_code, l1_name, {roll('product', '(1 + pct_chg / 100.0)', 20, 10)} - 1 AS own FROM ({WITH_INDUSTRY}))
      SELECT o.trade_date, o.ts_code, d.industry_vol_20, d.industry_momentum_5, d.industry_momentum_20,
             o.own - d.industry_momentum_20 AS relative_momentum_20
      FROM o LEFT JOIN d ON d.trade_date = o.trade_date AND d.l1_name = o.l1_name""",
)
def _(m):
    return X.industry_momentum(with_industry(m)).select(
        *KEYS, "industry_vol_20", "industry_momentum_5", "industry_momentum_20", "relative_momentum_20"
    )


@query(
    "industry_concentration", "X9", needs="bars members", doubles="industry_concentration",
    sql=f"""SELECT trade_date, ts_code, CASE WHEN l1_name IS NOT NULL THEN 1.0::DOUBLE / count(ts_code) OVER (PARTITION BY trade_date, l1_name) END
            AS industry_concentration FROM ({WITH_INDUSTRY})""",
)
def _(m):
    return X.industry_concentration(with_industry(m), group_rows=m.names).select(*KEYS, "industry_concentration")


_LBL = f"""(SELECT trade_date, ts_code, {', '.join(f"round(lead(a, {h}) OVER ({BY}) / nullif(a, 0) - 1 + 3.71728349e-9, 6) AS label_{h}d" for h in PV.HORIZONS)}
  FROM (SELECT *, close * adj_factor / last_value(adj_factor) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM bars_adj))"""


@query(
    "label_ranks", "X10", needs="bars_adj", doubles=" ".join(f"label_rank_{h}d" for h in PV.HORIZONS),
    sql=f"SELECT trade_date, ts_code, {', '.join(rank_pct(f'label_{h}d', 'trade_date') + f' AS label_rank_{h}d' for h in PV.HORIZONS)} FROM {_LBL}",
)
def _(m):
    df = PV.forward_labels(m.bars_adj())
    df = df.select(*KEYS, *[F.round(F.col(f"label_{h}d") + 3.71728349e-9, 6).alias(f"label_{h}d") for h in PV.HORIZONS])
    ranks = {f"label_rank_{h}d": f"label_{h}d" for h in PV.HORIZONS}
    return X.group_ranks(df, ranks, group_rows=m.names).select(*KEYS, *ranks)


@query(
    "composite_score", "X11", needs="bars", doubles="composite",
    sql=f"""SELECT trade_date, ts_code, (coalesce(ret_20, 0) + coalesce(volatility_20, 0)) /
              nullif((ret_20 IS NOT NULL)::INT + (volatility_20 IS NOT NULL)::INT, 0) AS composite
            FROM ({z_sql(winsor_sql(_F, _TWO), _TWO)})""",
)
def _(m):
    return X.composite(two_factors(m), _TWO, "composite", m.names).select(*KEYS, "composite")


_SC = "SELECT s.trade_date, s.ts_code, s.score, g.l1_name FROM scores s LEFT JOIN members g ON g.ts_code = s.ts_code AND g.in_date <= s.trade_date AND (g.out_date IS NULL OR s.trade_date < g.out_date)"
_ALPHA = f"""SELECT *, score - CASE WHEN l1_name IS NOT NULL THEN avg(score) OVER (PARTITION BY trade_date, l1_name) ELSE 0 END AS a
  FROM ({winsor_sql(_SC, ['score'])})"""


@query(
    "standardized_alpha", "X12", needs="scores members", doubles="alpha",
    sql=f"""SELECT trade_date, ts_code, CASE WHEN max(a) OVER d <> min(a) OVER d THEN (a - avg(a) OVER d) / nullif(stddev_pop(a) OVER d, 0) END AS alpha
            FROM ({_ALPHA}) WINDOW d AS (PARTITION BY trade_date)""",
)
def _(m):
    df = with_industry(m, m.scores())
    return X.standardize_alpha(df, "score", "alpha", industry="l1_name", group_rows=m.names).select(*KEYS, "alpha")


_SX = f"SELECT s.trade_date, s.ts_code, s.score, f.vol FROM scores s JOIN bars f ON f.trade_date = s.trade_date AND f.ts_code = s.ts_code"


def scored_styles(m):
    b = m.bars()
    return m.scores().join(b.select(*KEYS, "vol", "amount"), KEYS)


@query(
    "style_residual", "X13", needs="scores bars", doubles="residual",
    sql=f"""WITH sx AS MATERIALIZED ({_SX}) SELECT x.trade_date, x.ts_code, CASE WHEN c.n >= 3 AND c.vx > 0 THEN x.score - (c.i + c.s * x.vol)
              WHEN c.n >= 3 THEN x.score - c.my ELSE x.score END AS residual FROM sx x JOIN
           (SELECT trade_date, count(*) AS n, var_pop(vol) AS vx, avg(score) AS my, regr_slope(score, vol) AS s, regr_intercept(score, vol) AS i
            FROM sx GROUP BY trade_date) c ON c.trade_date = x.trade_date""",
)
def _(m):
    return X.neutralize_styles(scored_styles(m), "score", ["vol"], "residual", m.names).select(*KEYS, "residual")


_SXA = f"""SELECT s.trade_date, s.ts_code, s.score AS y, f.vol, f.amount, 1.0::DOUBLE AS w, 1.0::DOUBLE AS one FROM
  ({winsor_sql('SELECT * FROM scores', ['score'])}) s JOIN bars f ON f.trade_date = s.trade_date AND f.ts_code = s.ts_code"""


def _project(table: str, z: str, rest: list[str]) -> str:
    """Take ``z`` out of the remaining columns per date."""
    reps = ", ".join(
        f"{v} - {z} * coalesce(sum({z} * {v}) OVER d / nullif(CASE WHEN sum({z} * {z}) OVER d > 1e-9 THEN sum({z} * {z}) OVER d END, 0), 0) AS {v}"
        for v in rest
    )
    return f"SELECT * REPLACE ({reps}) FROM ({table}) WINDOW d AS (PARTITION BY trade_date)"


_RES2 = _project(_project(_project(_SXA, "one", ["y", "vol", "amount"]), "vol", ["y", "amount"]), "amount", ["y"])


@query(
    "style_residual_two_factors", "X13 X12", needs="scores bars", doubles="residual", digits=5,
    sql=f"""SELECT r.trade_date, r.ts_code, CASE WHEN count(*) OVER (PARTITION BY r.trade_date) >= 4 THEN r.y ELSE o.y END AS residual
            FROM ({_RES2}) r JOIN ({_SXA}) o ON o.trade_date = r.trade_date AND o.ts_code = r.ts_code""",
)
def _(m):
    df = X.winsorize(scored_styles(m), ["score"], group_rows=m.names)
    return X.neutralize_styles(df, "score", ["vol", "amount"], "residual", m.names).select(*KEYS, "residual")


@query(
    "rank_standardized_alpha", "X12", needs="scores", doubles="alpha",
    sql=f"""SELECT trade_date, ts_code, (r - avg(r) OVER d) / nullif(stddev_pop(r) OVER d, 0) AS alpha FROM
            (SELECT *, {rank_pct('score', 'trade_date')} AS r FROM ({winsor_sql('SELECT * FROM scores', ['score'])})) WINDOW d AS (PARTITION BY trade_date)""",
)
def _(m):
    df = X.standardize_alpha(m.scores(), "score", "alpha", method="rank", group_rows=m.names)
    return df.select(*KEYS, "alpha")


@query(
    "industry_zscore", "X14", needs="scores members", doubles="neutral_score",
    sql=f"""SELECT trade_date, ts_code, coalesce((score - avg(score) OVER d) / CASE WHEN count(score) OVER d < 2 OR max(score) OVER d = min(score) OVER d THEN 1.0
            ELSE stddev_samp(score) OVER d END, 0.0) AS neutral_score FROM (SELECT *, coalesce(l1_name, 'unknown') AS ind FROM ({_SC}))
            WINDOW d AS (PARTITION BY trade_date, ind)""",
)
def _(m):
    return X.industry_zscore(with_industry(m, m.scores()), "score", "neutral_score", group_rows=m.names).select(*KEYS, "neutral_score")


_HS = ["score_1d", "score_5d", "score_20d"]


@query(
    "rank_ensemble", "X15", needs="lines", doubles="ensemble",
    sql=f"SELECT trade_date, ts_code, ({' + '.join(rank_pct(c, 'trade_date') for c in _HS)}) / 3 AS ensemble FROM ({HORIZONS_SQL})",
)
def _(m):
    return X.rank_ensemble(horizon_scores(m), _HS, group_rows=m.names).select(*KEYS, "ensemble")


@query(
    "score_correlation_matrix", "X16", needs="lines", doubles="corr",
    sql=" UNION ALL ".join(
        f"SELECT '{a}' AS score_a, '{b}' AS score_b, corr({a}, {b}) AS corr FROM ({HORIZONS_SQL}) WHERE trade_date BETWEEN 19980101 AND 19981231"
        for a in _HS for b in _HS
    ),
)
def _(m):
    from ..operators.ic import score_correlations

    return score_correlations(horizon_scores(m).where("trade_date BETWEEN 19980101 AND 19981231"), _HS)


