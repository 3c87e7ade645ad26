"""Queries: the factor risk model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fundamental as FU
from ..operators import risk as R
from .q_aggregates import WITH_INDUSTRY, with_industry
from .q_joins import PIT
from .q_portfolio import _EQ10, equal_ten
from .q_timing import SERIES, market_series
from .registry import query
from .sqltext import BY, avg_rank, div, lag, over, roll

KEYS = ["trade_date", "ts_code"]


def simple(name, covers, fn, col, sql, **kw):
    @query(name, covers, needs="bars", doubles=col, sql=sql, **kw)
    def _(m):
        return fn(m).select(*KEYS, col)


simple("size_exposure", "K1", lambda m: R.size(m.bars()), "SIZE",
       f"SELECT trade_date, ts_code, ln(nullif({roll('quantile_cont({x}, 0.5)', 'amount', 20, 5)}, 0)) AS \"SIZE\" FROM bars")

_MK = "SELECT b.*, avg(pct_chg) OVER (PARTITION BY trade_date) AS mkt FROM bars b"
_W = over(60)
_PX, _PY = "CASE WHEN pct_chg IS NOT NULL THEN mkt END", "CASE WHEN mkt IS NOT NULL THEN pct_chg END"
BETA = f"CASE WHEN count({_PX}) {_W} >= 20 THEN covar_samp({_PX}, {_PY}) {_W} / nullif(var_samp({_PX}) {_W}, 0) END"
simple("beta_exposure", "K2", lambda m: R.beta(m.bars(), 60, 20), "BETA", f'SELECT trade_date, ts_code, {BETA} AS "BETA" FROM ({_MK})')
MOM = f"{div(lag('close', 21), lag('close', 252))} - 1"
simple("momentum_exposure", "K3", lambda m: R.momentum(m.bars()), "MOMENTUM", f'SELECT trade_date, ts_code, {MOM} AS "MOMENTUM" FROM bars')
LIQ = f"ln(1 + 1000000 * {roll('avg', 'i', 20, 5)})"
simple("liquidity_exposure", "K7", lambda m: R.liquidity(m.bars()), "LIQUIDITY",
       f"SELECT trade_date, ts_code, {LIQ} AS \"LIQUIDITY\" FROM (SELECT *, {div('abs(pct_chg)', 'amount')} AS i FROM bars)")


def norm_sql(table: str, cols) -> str:
    """Clip (from three values on) and standardise per date."""
    d = "OVER (PARTITION BY trade_date)"
    clip = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL WHEN count({c}) {d} >= 3 THEN least(greatest({c}, quantile_cont({c}, 0.01) {d}), quantile_cont({c}, 0.99) {d}) ELSE {c} END AS {c}"
        for c in cols
    )
    z = ", ".join(
        f"CASE WHEN count({c}) {d} < 2 OR max({c}) {d} = min({c}) {d} THEN {c} - avg({c}) {d} ELSE ({c} - avg({c}) {d}) / nullif(stddev_samp({c}) {d}, 0) END AS {c}"
        for c in cols
    )
    return f"SELECT * REPLACE ({z}) FROM (SELECT * REPLACE ({clip}) FROM ({table}))"


def mean_sql(cols) -> str:
    return f"({' + '.join(f'coalesce({c}, 0)' for c in cols)}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in cols)}, 0)"


_Q = f"""SELECT *, gross_margin - lag(gross_margin) OVER (PARTITION BY ts_code ORDER BY end_date, ann_date) AS gross_margin_change FROM reports"""
PANEL = f"""SELECT b.*, r.bps, r.eps, r.roe, r.or_yoy AS revenue_yoy, r.gross_margin_change, r.debt_to_assets, r.bps / nullif(b.close, 0) AS bp, r.eps / nullif(b.close, 0) AS ep,
  {roll('stddev_samp', 'pct_chg', 20, 10, 'PARTITION BY b.ts_code ORDER BY b.trade_date')} AS v20, {roll('stddev_samp', 'pct_chg', 60, 30, 'PARTITION BY b.ts_code ORDER BY b.trade_date')} AS v60
  FROM bars b ASOF LEFT JOIN ({_Q}) r ON b.ts_code = r.ts_code AND b.trade_date >= r.ann_date"""


def panel(m, bars=None):
    r = FU.quarterly_changes(m.reports()).withColumnRenamed("or_yoy", "revenue_yoy")
    return FU.to_daily(m.bars() if bars is None else bars, r, ["bps", "eps", "roe", "revenue_yoy", "gross_margin_change", "debt_to_assets"])


_COMP = {
    "value_exposure": ("K4", "VALUE", ["bp", "ep"], lambda m: R.value(panel(m), m.names)),
    "growth_exposure": ("K5", "GROWTH", ["revenue_yoy", "roe", "gross_margin_change"], lambda m: R.growth(panel(m), m.names)),
    "volatility_exposure": ("K6", "VOLATILITY", ["v20", "v60"], lambda m: R.volatility(m.bars(), m.names)),
}
for _name, (_id, _out, _parts, _fn) in _COMP.items():

    @query(_name, f"{_id} X11", needs="bars reports", doubles=f'"{_out}"',
           sql=f'SELECT trade_date, ts_code, {mean_sql(_parts)} AS "{_out}" FROM ({norm_sql(PANEL, _parts)})')
    def _(m, fn=_fn, out=_out):
        return fn(m).select(*KEYS, out)


@query("leverage_exposure", "K8 P21", needs="bars reports", doubles='"LEVERAGE"',
       sql=f'SELECT trade_date, ts_code, debt_to_assets AS "LEVERAGE" FROM ({PANEL})')
def _(m):
    return R.leverage(panel(m)).select(*KEYS, "LEVERAGE")


_RAW = f"""SELECT p.trade_date, p.ts_code, ln(nullif({roll('quantile_cont({x}, 0.5)', 'amount', 20, 5)}, 0)) AS "SIZE",
  {BETA} AS "BETA", {MOM} AS "MOMENTUM", {mean_sql(['bp', 'ep'])} AS "VALUE", {mean_sql(['revenue_yoy', 'roe', 'gross_margin_change'])} AS "GROWTH",
  {mean_sql(['v20', 'v60'])} AS "VOLATILITY", {LIQ} AS "LIQUIDITY", debt_to_assets AS "LEVERAGE", l1_name FROM (SELECT x.*, avg(pct_chg) OVER (PARTITION BY x.trade_date) AS mkt,
    {div('abs(pct_chg)', 'amount')} AS i, g.l1_name FROM ({{panel}}) x LEFT JOIN members g ON g.ts_code = x.ts_code AND g.in_date <= x.trade_date AND (g.out_date IS NULL OR x.trade_date < g.out_date)) p"""
# composites need their parts normalised but growth's parts are report columns, so all seven are normalised at once
_PARTS = ["bp", "ep", "v20", "v60", "revenue_yoy", "roe", "gross_margin_change"]
EXPO = norm_sql(_RAW.replace("{panel}", norm_sql(PANEL, _PARTS)), [f'"{s}"' for s in R.STYLES])
_DUM = ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def exposures(m, bars=None, keep=()):
    return R.exposures(
        with_industry(m, panel(m, bars)), 60, 20, m.names, "l1_name", ["AFRICA", *_DUM], "AFRICA", market=m.bars(), keep=keep
    )


@query(
    "exposure_matrix", "K9 K23", needs="bars reports members", digits=5,
    doubles=" ".join(f'"{s}"' for s in R.STYLES) + " " + " ".join(f'"L1_{d.replace(" ", "_")}"' for d in _DUM),
    sql=f"""SELECT trade_date, ts_code, {', '.join(f'"{s}"' for s in R.STYLES)}, {', '.join(f'''(l1_name = '{d}')::INT::DOUBLE AS "L1_{d.replace(' ', '_')}" ''' for d in _DUM)} FROM ({EXPO})""",
)
def _(m):
    e = exposures(m)
    styles, industries = R.split_factors([c for c in e.columns if c not in KEYS])
    return e.select(*KEYS, *styles, *[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in industries])


@query(
    "exposure_validation", "A27", needs="bars reports members", digits=5,
    doubles="mean_overall std_overall min_overall max_overall missing_rate coverage mean_daily_mean mean_daily_std",
    sql=f"""WITH e AS MATERIALIZED ({EXPO}), x AS MATERIALIZED ({' UNION ALL '.join(f"""SELECT trade_date, '{t}' AS factor, "{t}" AS x FROM e""" for t in R.STYLES)}),
      d AS (SELECT factor, avg(m) AS mm, avg(s) AS ms FROM (SELECT factor, trade_date, avg(x) AS m, stddev_samp(x) AS s FROM x GROUP BY ALL) GROUP BY factor),
      o AS (SELECT factor, avg(x) AS mean_overall, stddev_samp(x) AS std_overall, min(x) AS min_overall, max(x) AS max_overall, avg((x IS NULL)::INT) AS missing_rate,
        avg(CASE WHEN x IS NOT NULL THEN (x > 0)::INT END) AS coverage FROM x GROUP BY factor)
      SELECT o.*, d.mm AS mean_daily_mean, d.ms AS mean_daily_std, CAST(abs(mean_overall) <= 0.5 AND abs(std_overall - 1) <= 0.5 AND missing_rate <= 0.5 AS INTEGER) AS passed
      FROM o JOIN d ON d.factor = o.factor""",
)
def _(m):
    return R.validate_exposures(exposures(m), list(R.STYLES))


@query(
    "industry_dummy_coverage", "A28", needs="bars members", doubles="mean coverage",
    sql=f"WITH w AS MATERIALIZED ({WITH_INDUSTRY}) " + " UNION ALL ".join(
        f"SELECT 'L1_{d}' AS factor, avg((l1_name = '{d}')::INT) AS mean, avg((l1_name = '{d}')::INT) AS coverage FROM w" for d in _DUM
    ),
)
def _(m):
    df = with_industry(m)
    df = df.select(*KEYS, *[(F.col("l1_name") == d).cast("double").alias(f"L1_{d}") for d in _DUM])
    return R.industry_coverage(df, [f"L1_{d}" for d in _DUM])


_WT = f"""SELECT b.*, coalesce(sqrt(nullif(CASE WHEN a IS NOT NULL THEN least(a, q.p) END, 0)), 0) AS weight FROM (SELECT *, {roll('avg', 'amount', 20, 5)} AS a FROM bars) b,
  (SELECT quantile_cont(a, 0.99) AS p FROM (SELECT {roll('avg', 'amount', 20, 5)} AS a FROM bars)) q"""


@query("regression_weights", "K10", needs="bars", doubles="weight", sql=f"SELECT trade_date, ts_code, weight FROM ({_WT})", digits=5)
def _(m):
    return R.regression_weights(m.bars()).select(*KEYS, "weight")


# one factor (standardised volume) against the intraday return, root-amount weights
_ZV = f"SELECT *, close / open - 1 AS ret, (vol - avg(vol) OVER d) / nullif(stddev_samp(vol) OVER d, 0) AS x FROM ({_WT}) WINDOW d AS (PARTITION BY trade_date)"
_WLS = f"""SELECT trade_date, n, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b_x, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw AS intercept FROM (
  SELECT trade_date, count(*) AS n, sum(weight) AS sw, sum(weight * x) AS sx, sum(weight * ret) AS sy, sum(weight * x * x) AS sxx, sum(weight * x * ret) AS sxy
  FROM ({_ZV}) WHERE weight > 0 AND x IS NOT NULL AND ret IS NOT NULL GROUP BY trade_date HAVING count(*) >= 5)"""


def weighted_panel(m):
    from ..operators.cross_section import zscore

    df = R.regression_weights(m.bars()).withColumns({"ret": F.col("close") / F.col("open") - 1, "x": F.col("vol")})
    return zscore(df, ["x"], group_rows=m.names).select(*KEYS, "ret", "x", "weight")


@query("weighted_factor_return", "K11", needs="bars", doubles="b_x intercept", sql=f"SELECT trade_date, n AS n_rows, b_x, intercept FROM ({_WLS})")
def _(m):
    return R.factor_returns(weighted_panel(m), ["x"], weight="weight", group_rows=m.names).where("intercept IS NOT NULL")


@query(
    "regression_fit_quality", "K11", needs="bars", doubles="r_squared",
    sql=f"""SELECT z.trade_date, count(*) AS n, 1 - sum(weight * (ret - intercept - b_x * x) * (ret - intercept - b_x * x)) / (sum(weight * ret * ret) - sum(weight * ret) * sum(weight * ret) / sum(weight)) AS r_squared
            FROM ({_ZV}) z JOIN ({_WLS}) c ON c.trade_date = z.trade_date WHERE weight > 0 AND x IS NOT NULL AND ret IS NOT NULL GROUP BY z.trade_date""",
)
def _(m):
    df = weighted_panel(m)
    fit = R.factor_returns(df, ["x"], weight="weight", group_rows=m.names)
    return R.fit_quality(R.residual_returns(df, ["x"], fit, weight="weight"), weight="weight")


def model_panel(m):
    """Exposures with the same bar's return and regression weight, which stay with their row all the way."""
    df = exposures(m, R.regression_weights(m.bars()), ["pct_chg", "weight"])
    return df.withColumn("ret", F.col("pct_chg") / 100.0).drop("pct_chg")


_FACTORS = [*R.STYLES, *[f"L1_{d}" for d in _DUM]]


def projection_sql(base: str, y: str, xs: list[str], name: str = "s", keep: str = "", constant: bool = True) -> str:
    """Residual of ``y``: the constant and each regressor are projected out in turn (weight column ``w``).

    ``keep`` is a column from which the regressors are taken out as well.
    """
    part = "trade_date"
    ctes = [f"{name}0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS one FROM ({base}))"]
    order = ["one", *xs] if constant else list(xs)
    for i, z in enumerate(order):
        rest = [y, *order[i + 1:], *([keep] if keep else [])]
        reps = ", ".join(
            f"{v} - {z} * coalesce(sum(w * {z} * {v}) OVER d / nullif(CASE WHEN sum(w * {z} * {z}) OVER d > 1e-9 THEN sum(w * {z} * {z}) OVER d END, 0), 0) AS {v}"
            for v in rest
        )
        ctes.append(f"{name}{i + 1} AS MATERIALIZED (SELECT * REPLACE ({reps}) FROM {name}{i} WINDOW d AS (PARTITION BY {part}))")
    return ", ".join(ctes)


_ST = [f'"{f}"' for f in _FACTORS]
_DUMMIES = ", ".join(f"""(l1_name = '{d}')::INT::DOUBLE AS "L1_{d}" """ for d in _DUM)
_MODEL = f"""SELECT e.trade_date, e.ts_code, {', '.join(f'e.{c}' for c in _ST)}, {', '.join(f"max((e.{c} IS NOT NULL)::INT) OVER (PARTITION BY e.trade_date) AS a{i}" for i, c in enumerate(_ST))},
  b.pct_chg / 100.0 AS ret, b.weight AS w FROM (SELECT *, {_DUMMIES} FROM ({EXPO})) e JOIN ({_WT}) b ON b.trade_date = e.trade_date AND b.ts_code = e.ts_code"""
_COMPLETE = f"""SELECT trade_date, ts_code, ret, w, {', '.join(f'a{i}' for i in range(len(_ST)))}, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in _ST)}
  FROM (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM model
  WHERE ret IS NOT NULL AND w > 0 AND {' AND '.join(f'({c} IS NOT NULL OR a{i} = 0)' for i, c in enumerate(_ST))})
  WHERE n >= 12 AND n > 1 + {' + '.join(f'a{i}' for i in range(len(_ST)))}"""
_BASE = f"model AS MATERIALIZED ({_MODEL}), base AS MATERIALIZED ({_COMPLETE})"
_RESIDUALS = projection_sql("SELECT * FROM base", "ret", _ST)
_LAST = f"s{len(_ST) + 1}"


@query(
    "style_residual_returns", "K11", needs="bars reports members", doubles="residual", digits=4,
    sql=f"WITH {_BASE}, {_RESIDUALS} SELECT trade_date, ts_code, ret AS residual FROM {_LAST}",
)
def _(m):
    df, fit = fitted(m)
    res = R.residual_returns(df, _FACTORS, fit, weight="weight")
    return res.where((F.col("weight") > 0) & F.col("residual").isNotNull()).select(*KEYS, "residual")


def fitted(m):
    """Exposures with returns, written once (read for the fit and for what follows), and the daily regressions."""
    from ..sources.datasets import materialize

    df = materialize(model_panel(m), "exposures")
    return df, R.factor_returns(df, _FACTORS, weight="weight", min_stocks=12, group_rows=m.names)


_CHAINS = ", ".join(
    projection_sql("SELECT * FROM base", "ret", [c for c in _ST if c != f], f"p{i}_", keep=f) for i, f in enumerate(_ST)
)
_RETS = " UNION ALL ".join(
    f"""SELECT trade_date, '{f.strip('"')}' AS factor, count(*) AS n_rows, coalesce(sum(w * {f} * ret) / nullif(CASE WHEN sum(w * {f} * {f}) > 1e-9 THEN sum(w * {f} * {f}) END, 0), 0.0) AS ret
        FROM p{i}_{len(_ST)} WHERE a{i} = 1 GROUP BY trade_date"""
    for i, f in enumerate(_ST)
)


@query(
    "style_factor_returns", "K11", needs="bars reports members", doubles="ret", digits=4,
    sql=f"WITH {_BASE}, {_CHAINS} SELECT * FROM ({_RETS}) WHERE ret IS NOT NULL",
)
def _(m):
    fr = R.factor_returns(model_panel(m), _FACTORS, weight="weight", min_stocks=12, group_rows=m.names)
    long = fr.unpivot(["trade_date", "n_rows"], [f"`b_{f}`" for f in _FACTORS], "factor", "ret").where("ret IS NOT NULL")
    return long.withColumn("factor", F.substring("factor", 3, 100))


# the whole model: regressions, factor covariance with the market factor, specific risk of their residuals, portfolio risk
_ALL = [*_FACTORS, "INTERCEPT"]
_MARKET = projection_sql("SELECT * FROM base", "ret", _ST, "q", keep="one", constant=False)
_SERIES_OF = ", ".join(f"max(CASE WHEN factor = '{f}' THEN ret END) AS f{i}" for i, f in enumerate(_ALL))
_FR = f"""{_CHAINS}, {_MARKET}, fl AS MATERIALIZED (SELECT trade_date, factor, ret FROM ({_RETS}) UNION ALL
    SELECT trade_date, 'INTERCEPT', sum(w * one * ret) / sum(w * one * one) FROM q{len(_ST)} GROUP BY trade_date),
  fs AS MATERIALIZED (SELECT d.trade_date, {_SERIES_OF} FROM (SELECT DISTINCT trade_date FROM model) d LEFT JOIN fl ON fl.trade_date = d.trade_date GROUP BY d.trade_date),
  fo AS MATERIALIZED (SELECT *, CASE WHEN {' AND '.join(f'f{i} IS NOT NULL' for i in range(len(_ALL)))} THEN 1 END AS ok FROM fs)"""
_W60D = "OVER (ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_MCOV = " UNION ALL ".join(
    f"SELECT trade_date, '{a}' AS factor_i, '{b}' AS factor_j, CASE WHEN count(ok) {_W60D} >= 20 THEN covar_samp(f{i} * ok, f{j} * ok) {_W60D} END AS cov FROM fo"
    for i, a in enumerate(_ALL) for j, b in enumerate(_ALL)
)
_MSPEC = f"""SELECT *, count(residual) {over(60)} AS sample_count, {roll('avg', '(residual * residual)', 60, 20)} AS specific_variance
  FROM (SELECT d.trade_date, d.ts_code, r.ret AS residual FROM model d LEFT JOIN {_LAST} r ON r.trade_date = d.trade_date AND r.ts_code = d.ts_code)"""
_MH = f"""SELECT w.trade_date, w.ts_code, w.weight, sp.specific_variance, {', '.join(f'coalesce(x.{c}, 0.0) AS {c}' for c in _ST)}, 1.0::DOUBLE AS "INTERCEPT" FROM ({_EQ10}) w
  JOIN model x ON x.trade_date = w.trade_date AND x.ts_code = w.ts_code JOIN spec sp ON sp.trade_date = w.trade_date AND sp.ts_code = w.ts_code WHERE sp.specific_variance IS NOT NULL"""
_MZ = " UNION ALL ".join(f"""SELECT trade_date, '{f}' AS factor, sum(weight * "{f}") AS exposure FROM h GROUP BY trade_date""" for f in _ALL)
_RISK = f"""WITH {_BASE}, {_RESIDUALS}, {_FR}, cov AS MATERIALIZED (SELECT * FROM ({_MCOV}) WHERE cov IS NOT NULL), spec AS MATERIALIZED ({_MSPEC}), h AS MATERIALIZED ({_MH}),
  z AS MATERIALIZED ({_MZ}), zf AS MATERIALIZED (SELECT c.trade_date, c.factor_i AS factor, sum(c.cov * z.exposure) AS fz FROM cov c JOIN z ON z.trade_date = c.trade_date AND z.factor = c.factor_j GROUP BY ALL),
  fv AS MATERIALIZED (SELECT z.trade_date, sum(z.exposure * fz) AS factor_variance FROM z JOIN zf ON zf.trade_date = z.trade_date AND zf.factor = z.factor GROUP BY z.trade_date),
  sv AS MATERIALIZED (SELECT trade_date, sum(weight * weight * specific_variance) AS specific_variance FROM h GROUP BY trade_date)
  SELECT fv.trade_date, factor_variance, specific_variance, factor_variance + specific_variance AS variance, sqrt(greatest(factor_variance + specific_variance, 0)) AS volatility
  FROM fv JOIN sv ON sv.trade_date = fv.trade_date"""


@query("risk_model", "K11 K12 K14 K16", needs="bars reports members scores", doubles="factor_variance specific_variance variance volatility", sql=_RISK, digits=6)
def _(m):
    from ..sources.datasets import materialize

    df, fit = fitted(m)
    fit = materialize(fit, "factor-returns")  # one row per date, read by the covariance and by the residuals
    series = fit.select("trade_date", *[F.col(f"`b_{f}`").alias(f) for f in _FACTORS], F.col("intercept").alias("INTERCEPT"))
    cov = R.rolling_covariance(series, _ALL, 60, 20)
    res = R.residual_returns(df, _FACTORS, fit, weight="weight")
    taken = (F.col("weight") > 0) & F.col("residual").isNotNull()
    sr = R.specific_risk(res.withColumn("residual", F.when(taken, F.col("residual"))).select(*KEYS, "residual"), 60, 20)
    held = equal_ten(m).select(*KEYS, F.col("weight").alias("held"))
    x = df.select(*KEYS, *[F.col(f"`{f}`") for f in _FACTORS], F.lit(1.0).alias("INTERCEPT"))
    h = held.join(x, KEYS).join(sr.where("specific_variance IS NOT NULL").select(*KEYS, "specific_variance"), KEYS)
    return R.portfolio_risk(h.withColumnRenamed("held", "weight"), _ALL, cov)


# three date-level series stand in for factor returns
FACTOR_SERIES = """SELECT trade_date, round(avg(close / open - 1) + 3.71728349e-9, 6) AS f1, round(avg((high - low) / close) + 3.71728349e-9, 6) AS f2,
  CASE WHEN trade_date % 11 <> 0 THEN round(avg(ln(vol)) + 3.71728349e-9, 6) END AS f3 FROM bars GROUP BY trade_date"""
_F3 = ["f1", "f2", "f3"]


def factor_series(m):
    r6 = lambda c: F.round(c + 3.71728349e-9, 6)
    g = m.bars().groupBy("trade_date").agg(
        r6(F.avg(F.col("close") / F.col("open") - 1)).alias("f1"),
        r6(F.avg((F.col("high") - F.col("low")) / F.col("close"))).alias("f2"),
        r6(F.avg(F.log("vol"))).alias("f3"),
    )
    return g.withColumn("f3", F.when(F.col("trade_date") % 11 != 0, F.col("f3")))


_S60 = "OVER (ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_OKF = "SELECT *, CASE WHEN f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL THEN 1 END AS ok FROM fs"
COV = f"WITH fs AS MATERIALIZED ({FACTOR_SERIES}), o AS MATERIALIZED ({_OKF}) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT trade_date, '{a}' AS factor_i, '{b}' AS factor_j, CASE WHEN count(ok) {_S60} >= 20 THEN covar_samp({a} * ok, {b} * ok) {_S60} END AS cov FROM o"
    for a in _F3 for b in _F3
) + ") WHERE cov IS NOT NULL"


def covariances(m):
    return R.rolling_covariance(factor_series(m), _F3, 60, 20)


@query("rolling_factor_covariance", "K12", needs="bars", doubles="cov", sql=COV)
def _(m):
    return covariances(m)


@query(
    "shrunk_factor_covariance", "K13", needs="bars", doubles="cov shrinkage",
    sql=f"""WITH fs AS MATERIALIZED ({FACTOR_SERIES}), n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY trade_date) AS i FROM ({_OKF})),
      win AS MATERIALIZED (SELECT e.trade_date AS d, t.* FROM n e JOIN n t ON t.i BETWEEN e.i - 59 AND e.i WHERE t.ok = 1),
      mu AS (SELECT d, count(*) AS t, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3 FROM win GROUP BY d HAVING count(*) >= 20),
      c AS MATERIALIZED (SELECT w.d, t, f1 - m1 AS c1, f2 - m2 AS c2, f3 - m3 AS c3 FROM win w JOIN mu ON mu.d = w.d),
      s AS MATERIALIZED (SELECT d, max(t) AS t, {', '.join(f'sum(c{a} * c{b}) / (max(t) - 1) AS s{a}{b}' for a in (1, 2, 3) for b in (1, 2, 3))},
        avg(pow(c1 * c1 + c2 * c2 + c3 * c3, 2)) AS q, avg(c1 * c1) AS p1, avg(c2 * c2) AS p2, avg(c3 * c3) AS p3 FROM c GROUP BY d),
      l AS (SELECT *, (s11 + s22 + s33) / 3 AS lv, {' + '.join(f's{a}{b} * s{a}{b}' for a in (1, 2, 3) for b in (1, 2, 3))} AS ss FROM s),
      g AS (SELECT *, q - ss - lv * (p1 - s11 + p2 - s22 + p3 - s33) AS num, {' + '.join(f'pow(s{a}{b} - {"lv" if a == b else 0}, 2)' for a in (1, 2, 3) for b in (1, 2, 3))} AS gap FROM l),
      k AS MATERIALIZED (SELECT *, CASE WHEN gap = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, num / (t * gap))) END AS shrinkage FROM g) """
    + " UNION ALL ".join(
        f"SELECT d AS trade_date, 'f{a}' AS factor_i, 'f{b}' AS factor_j, (1 - shrinkage) * s{a}{b} + shrinkage * {'lv' if a == b else '0'} AS cov, shrinkage FROM k"
        for a in (1, 2, 3) for b in (1, 2, 3)
    ),
)
def _(m):
    return R.shrunk_covariance(factor_series(m), _F3, 60, 20)


@query("covariance_checks", "K22", needs="bars",
       sql=f"""WITH c AS ({COV}) SELECT a.trade_date, 1 AS all_finite, min((abs(a.cov - b.cov) <= 1e-10)::INT) AS all_symmetric,
               min(CASE WHEN a.factor_i = a.factor_j THEN (a.cov > 0)::INT END) AS all_positive_diag FROM c a JOIN c b
               ON b.trade_date = a.trade_date AND b.factor_i = a.factor_j AND b.factor_j = a.factor_i GROUP BY a.trade_date""")
def _(m):
    return R.covariance_checks(covariances(m))


_RES = "SELECT b.trade_date, b.ts_code, (pct_chg - avg(pct_chg) OVER (PARTITION BY trade_date)) / 100.0 AS residual FROM bars b"
SPEC = f"""SELECT *, sqrt(specific_variance) AS specific_vol FROM (SELECT trade_date, ts_code, {roll('avg', '(residual * residual)', 60, 20)} AS specific_variance,
  count(residual) {over(60)} AS sample_count FROM ({_RES}))"""


def specific(m):
    return R.specific_risk(R.market_residual(m.bars(), m.names), 60, 20).select(
        *KEYS, "specific_variance", "sample_count", "specific_vol"
    )


@query("specific_risk", "K14", needs="bars", doubles="specific_variance specific_vol", sql=SPEC, digits=4)
def _(m):
    return specific(m)


_SHR = f"""SELECT *, sample_count < 20 AND med IS NOT NULL AND l1_name IS NOT NULL AS use FROM (SELECT s.*, g.l1_name, quantile_cont(CASE WHEN sample_count >= 20 THEN specific_vol END, 0.5)
  OVER (PARTITION BY s.trade_date, g.l1_name) AS med FROM ({SPEC}) s LEFT JOIN members g ON g.ts_code = s.ts_code AND g.in_date <= s.trade_date AND (g.out_date IS NULL OR s.trade_date < g.out_date))"""


@query(
    "shrunk_specific_risk", "K15", needs="bars members", doubles="specific_variance specific_vol", digits=4,
    sql=f"""SELECT trade_date, ts_code, use::INT AS shrunk, CASE WHEN use THEN v ELSE specific_vol END AS specific_vol, CASE WHEN use THEN v * v ELSE specific_variance END AS specific_variance
            FROM (SELECT *, sample_count / 20.0 * coalesce(specific_vol, med) + (1 - sample_count / 20.0) * med AS v FROM ({_SHR}))""",
)
def _(m):
    df = R.shrink_specific_risk(with_industry(m, specific(m)), 20, group_rows=m.names)
    return df.select(*KEYS, F.coalesce("shrunk", F.lit(0)).alias("shrunk"), "specific_vol", "specific_variance")


# portfolio: ten best scores per date; exposures: three bar columns standing for three factors
_XF = f"""SELECT w.trade_date, w.ts_code, w.weight, b.close / b.open - 1 AS f1, (b.high - b.low) / b.close AS f2, ln(b.vol) / 10 AS f3, s.specific_variance FROM ({_EQ10}) w
  JOIN bars b ON b.trade_date = w.trade_date AND b.ts_code = w.ts_code JOIN ({SPEC}) s ON s.trade_date = w.trade_date AND s.ts_code = w.ts_code WHERE s.specific_variance IS NOT NULL"""


def holdings(m):
    x = m.bars().select(
        *KEYS,
        (F.col("close") / F.col("open") - 1).alias("f1"),
        ((F.col("high") - F.col("low")) / F.col("close")).alias("f2"),
        (F.log("vol") / 10).alias("f3"),
    )
    sr = specific(m).where("specific_variance IS NOT NULL").select(*KEYS, "specific_variance")
    return equal_ten(m).select(*KEYS, "weight").join(x, KEYS).join(sr, KEYS)


def written(m):
    """Holdings with exposures and specific risk, factors, and covariances: written once, as every figure of a portfolio
    reads them several times."""
    from ..sources.datasets import materialize

    return materialize(holdings(m), "holdings"), _F3, materialize(covariances(m), "covariances")


_PRE = COV.replace("SELECT * FROM (", "\x00", 1)
_HEAD, _BODY = _PRE.split("\x00")
_CTE = f"{_HEAD.rstrip()}, cov AS MATERIALIZED (SELECT * FROM ({_BODY}), h AS MATERIALIZED ({_XF})"
_Z = ", z AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT trade_date, '{f}' AS factor, sum(weight * {f}) AS exposure FROM h GROUP BY trade_date" for f in _F3) + ")"
_ZF = f"""{_CTE}{_Z}, zf AS MATERIALIZED (SELECT c.trade_date, c.factor_i AS factor, sum(c.cov * z.exposure) AS fz FROM cov c JOIN z ON z.trade_date = c.trade_date AND z.factor = c.factor_j GROUP BY ALL),
  fv AS (SELECT z.trade_date, sum(z.exposure * fz) AS factor_variance FROM z JOIN zf ON zf.trade_date = z.trade_date AND zf.factor = z.factor GROUP BY z.trade_date),
  pr AS MATERIALIZED (SELECT fv.trade_date, factor_variance, sv AS specific_variance, factor_variance + sv AS variance, sqrt(greatest(factor_variance + sv, 0)) AS volatility
    FROM fv JOIN (SELECT trade_date, sum(weight * weight * specific_variance) AS sv FROM h GROUP BY trade_date) s ON s.trade_date = fv.trade_date)"""


@query("portfolio_risk", "K16", needs="bars scores", doubles="factor_variance specific_variance variance volatility", sql=f"{_ZF} SELECT * FROM pr", digits=4)
def _(m):
    return R.portfolio_risk(*written(m))


@query("portfolio_exposure", "K17", needs="bars scores", doubles="exposure", sql=f"{_ZF} SELECT * FROM z")
def _(m):
    return R.portfolio_exposure(holdings(m), _F3)


@query(
    "pool_covariance", "K18", needs="bars scores", doubles="cov", digits=4,
    sql=f"""{_CTE} SELECT a.trade_date, a.ts_code AS code_i, b.ts_code AS code_j, {' + '.join(f'a.{x} * b.{y} * c.{x}{y}' for x in _F3 for y in _F3)}
      + CASE WHEN a.ts_code = b.ts_code THEN a.specific_variance ELSE 0 END AS cov FROM h a JOIN h b ON b.trade_date = a.trade_date JOIN (SELECT trade_date,
      {', '.join(f"max(CASE WHEN factor_i = '{x}' AND factor_j = '{y}' THEN cov END) AS {x}{y}" for x in _F3 for y in _F3)} FROM cov GROUP BY trade_date) c ON c.trade_date = a.trade_date""",
)
def _(m):
    return R.pool_covariance(holdings(m), _F3, covariances(m))


_ATT = """SELECT z.trade_date, z.factor, CASE WHEN variance > 0 THEN z.exposure * fz / variance ELSE 0 END AS share FROM z JOIN zf ON zf.trade_date = z.trade_date AND zf.factor = z.factor
  JOIN pr ON pr.trade_date = z.trade_date UNION ALL SELECT trade_date, 'SPECIFIC', CASE WHEN variance > 0 THEN specific_variance / variance ELSE 0 END FROM pr"""


@query("risk_attribution", "K19", needs="bars scores", doubles="share", sql=f"{_ZF}, att AS MATERIALIZED ({_ATT}) SELECT * FROM att")
def _(m):
    return R.risk_attribution(*written(m))


@query("risk_attribution_check", "K19", needs="bars scores", doubles="total",
       sql=f"{_ZF} SELECT trade_date, sum(share) AS total, (abs(sum(share) - 1.0) < 0.001)::INT AS passed FROM ({_ATT}) GROUP BY trade_date")
def _(m):
    return R.attribution_sum(R.risk_attribution(*written(m)))


@query(
    "conditioned_risk_data", "K20", needs="bars", doubles="specific_variance f", digits=4,
    sql=f"""SELECT trade_date, ts_code, coalesce(f, 0) AS f, least(v, quantile_cont(v, 0.95) OVER (PARTITION BY trade_date)) AS specific_variance FROM (
      SELECT *, coalesce(pos, quantile_cont(pos, 0.5) OVER (PARTITION BY trade_date), 0.0003) AS v FROM (SELECT s.*, b.pct_chg / 100.0 AS f,
        CASE WHEN specific_variance > 0 THEN specific_variance END AS pos FROM ({SPEC}) s JOIN bars b ON b.trade_date = s.trade_date AND b.ts_code = s.ts_code))""",
)
def _(m):
    b = m.bars()
    sr = R.specific_risk(R.market_residual(b, m.names), 60, 20).withColumn("f", F.col("pct_chg") / 100.0)
    df = R.condition_risk_data(sr.select(*KEYS, "f", "specific_variance"), ["f"], group_rows=m.names)
    return df.select(*KEYS, "f", "specific_variance")


def fv_sql(table: str, min_rows: int = 10) -> str:
    return f"""SELECT count(*) AS n, avg(p) AS mean_predicted, avg(r) AS mean_realised, avg(p - r) AS bias, sqrt(avg((p - r) * (p - r))) AS rmse, corr(p, r) AS pearson,
      corr(rp, rr) AS spearman, avg(p - r) / nullif(avg(r), 0) AS bias_pct, (count(*) >= {min_rows} AND corr(p, r) > 0)::INT AS passed FROM
      (SELECT *, {avg_rank('p', 'k')} AS rp, {avg_rank('r', 'k')} AS rr FROM (SELECT *, 0 AS k FROM ({table}) WHERE p IS NOT NULL AND r IS NOT NULL))"""


_FVC = "mean_predicted mean_realised bias rmse pearson spearman bias_pct"
_BACK = "OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_FWD = "OVER (ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)"


@query(
    "portfolio_forecast_validation", "K21", needs="bars", doubles=_FVC,
    sql=fv_sql(f"SELECT round(CASE WHEN count(r) {_BACK} >= 10 THEN stddev_samp(r) {_BACK} END + 3.71728349e-9, 6) AS p, "
               f"round(CASE WHEN count(*) {_FWD} = 20 THEN stddev_samp(r) {_FWD} END + 3.71728349e-9, 6) AS r FROM ({SERIES})"),
)
def _(m):
    from ..operators import timing as TM

    s = market_series(m)
    r6 = lambda c: F.round(F.col(c) + 3.71728349e-9, 6)
    past = TM.whole().rowsBetween(-19, 0)
    pred = s.select("trade_date", F.when(F.count("r").over(past) >= 10, F.stddev_samp("r").over(past)).alias("p"))
    df = pred.join(TM.realised_portfolio_vol(s, "r"), "trade_date").select("trade_date", r6("p").alias("p"), r6("realised_vol").alias("r"))
    return R.forecast_validation(df, "p", "r", group_rows=100_000)


_W20F = f"OVER ({BY} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)"


@query(
    "stock_forecast_validation", "K21 W35", needs="bars", doubles=_FVC, digits=5,
    sql=fv_sql(f"""SELECT round(s.specific_vol + 3.71728349e-9, 6) AS p, round(f.r + 3.71728349e-9, 6) AS r FROM ({SPEC}) s JOIN (SELECT trade_date, ts_code,
      CASE WHEN count(*) {_W20F} = 20 AND count(residual) {_W20F} >= 10 THEN sqrt(avg(residual * residual) {_W20F}) END AS r FROM ({_RES})) f
      ON f.trade_date = s.trade_date AND f.ts_code = s.ts_code""", 100),
)
def _(m):
    from ..operators.price_volume import realised_forward_vol

    res = realised_forward_vol(R.market_residual(m.bars(), m.names).select(*KEYS, "residual"), "residual", 20)
    r6 = lambda c: F.round(F.col(c) + 3.71728349e-9, 6)
    df = R.specific_risk(res, 60, 20).select(*KEYS, r6("specific_vol").alias("p"), r6("realised_vol").alias("r"))
    return R.forecast_validation(df, "p", "r", min_rows=100, tiebreak=KEYS)


