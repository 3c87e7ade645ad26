"""Queries: signal validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cross_section as X
from ..operators import ic as I
from ..operators import price_volume as PV
from .q_cross_section import _F, _TWO, two_factors, winsor_sql, z_sql
from .q_joins import HORIZONS_SQL, PRED_LABEL, all_scores, pred_label
from .registry import query
from .sqltext import BY, avg_rank, rank_pct

# scores and labels in rounded form: ranks see the same input on both sides
_PL = f"SELECT trade_date, ts_code, score, round(label + 3.71728349e-9, 6) AS label FROM ({PRED_LABEL}) WHERE label IS NOT NULL"


def scored(m):
    df = pred_label(m).where("label IS NOT NULL")
    return df.withColumn("label", F.round(F.col("label") + 3.71728349e-9, 6))


def ic_sql(table: str, keys: str = "trade_date", min_rows: int = 5) -> str:
    return f"""SELECT {keys}, CASE WHEN count(*) >= {min_rows} AND max(score) > min(score) AND max(label) > min(label) THEN corr(score, label) END AS ic,
      CASE WHEN count(*) >= {min_rows} AND max(score) > min(score) AND max(label) > min(label) THEN corr(rs, rl) END AS rank_ic, count(*) AS count
      FROM (SELECT *, {avg_rank('score', keys)} AS rs, {avg_rank('label', keys)} AS rl FROM ({table})) GROUP BY {keys}"""


_IC = ic_sql(_PL)


@query("daily_ic", "I1", needs="bars scores", doubles="ic rank_ic", sql=_IC)
def _(m):
    return I.daily_ic(scored(m), min_rows=5, group_rows=m.names)


def summary_sql(table: str, x: str, keys: str = "") -> str:
    k, g = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {k}avg({x}) AS ic_mean, stddev_samp({x}) AS ic_std, avg({x}) / nullif(stddev_samp({x}), 0) AS icir,
      avg(CASE WHEN round({x}, 12) > 0 THEN 1.0 WHEN {x} IS NOT NULL THEN 0.0 END) AS positive_rate, count({x}) AS count FROM ({table}){g}"""


@query("ic_summary", "I2", needs="bars scores", doubles="ic_mean ic_std icir positive_rate",
       sql=f"SELECT 'ic' AS kind, * FROM ({summary_sql(_IC, 'ic')}) UNION ALL SELECT 'rank_ic', * FROM ({summary_sql(_IC, 'rank_ic')})")
def _(m):
    ic = I.daily_ic(scored(m), min_rows=5, group_rows=m.names)
    # an exact zero carries float dust that differs between engines; both sides drop it
    long = ic.unpivot(["trade_date"], ["ic", "rank_ic"], "kind", "value")
    return I.ic_summary(long, "value", ["kind"], 12)


# flagship: factors → normalise → forward label → coefficient
_FLAG = f"""WITH lab AS (SELECT trade_date, ts_code, round(lead(close, 5) OVER ({BY}) / close - 1 + 3.71728349e-9, 6) AS label FROM bars),
  f AS MATERIALIZED (SELECT trade_date, ts_code, round(ret_20 + 3.71728349e-9, 6) AS ret_20, round(volatility_20 + 3.71728349e-9, 6) AS volatility_20
        FROM ({z_sql(winsor_sql(_F, _TWO), _TWO)})),
  x AS (SELECT 'ret_20' AS feature, f.trade_date, f.ts_code, ret_20 AS score, label FROM f JOIN lab l ON l.trade_date = f.trade_date AND l.ts_code = f.ts_code
        WHERE ret_20 IS NOT NULL AND label IS NOT NULL UNION ALL
        SELECT 'volatility_20', f.trade_date, f.ts_code, volatility_20, label FROM f JOIN lab l ON l.trade_date = f.trade_date AND l.ts_code = f.ts_code
        WHERE volatility_20 IS NOT NULL AND label IS NOT NULL),
  i AS ({ic_sql('SELECT * FROM x', 'feature, trade_date')})
  SELECT feature, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(rank_ic) AS rank_ic_mean,
         avg(CASE WHEN round(ic, 12) > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS positive_rate, count(ic) AS count FROM i GROUP BY feature"""


@query("factor_ic_summary", "X3 W34 I1 I2", needs="bars", doubles="ic_mean ic_std icir rank_ic_mean positive_rate", sql=_FLAG, digits=5)
def _(m):
    """Two factors, clipped and standardised per date, against the five-bar forward return."""
    bars = m.bars()
    r6 = lambda c, n=None: F.round(F.col(c) + 3.71728349e-9, 6).alias(n or c)
    df = PV.volatility(PV.returns(bars, (20,)), (20,))
    df = df.withColumn("label", PV.BY_STOCK.lead("close", 5) / F.col("close") - 1)
    df = df.select("trade_date", "ts_code", r6("ret_20"), r6("volatility_20"), r6("label"))
    df = X.process_factors(df, _TWO, group_rows=m.names)
    df = df.select("trade_date", "ts_code", "label", *[r6(f"{c}_cc_processed", c) for c in _TWO])
    rows = I.features_to_rows(df.where("label IS NOT NULL"), _TWO)
    ic = I.daily_ic(rows, keys=["feature", "trade_date"], min_rows=5, group_rows=m.names)
    extra = ic.groupBy("feature").agg(F.avg("rank_ic").alias("rank_ic_mean"))
    return I.ic_summary(ic, "ic", ["feature"], 12).join(extra, "feature")


@query("monthly_ic", "I3", needs="bars scores", doubles="ic rank_ic",
       sql=f"""SELECT CAST(trade_date // 10000 AS INTEGER) AS year, CAST(trade_date // 100 % 100 AS INTEGER) AS month, avg(ic) AS ic, avg(rank_ic) AS rank_ic
               FROM ({_IC}) GROUP BY 1, 2""")
def _(m):
    return I.monthly_ic(I.daily_ic(scored(m), min_rows=5, group_rows=m.names))


def groups_sql(table: str, n: int = 5, keys: str = "trade_date", sign: str = "DESC") -> str:
    gs = ", ".join(f"avg(CASE WHEN g = {i} THEN label END) AS group{i + 1}" for i in range(n))
    return f"""SELECT *, group1 - group{n} AS long_short, group1 - al AS long_average FROM (
      SELECT {keys}, {gs}, avg(label) AS al FROM (SELECT *, CASE WHEN n // {n} > 0 THEN (p - 1) // (n // {n}) END AS g FROM
        (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score {sign}, ts_code) AS p, count(*) OVER (PARTITION BY {keys}) AS n FROM ({table})))
      GROUP BY {keys}) WHERE coalesce({', '.join(f'group{i + 1}' for i in range(n))}) IS NOT NULL"""


_G = [f"group{i}" for i in range(1, 6)]


@query("quantile_group_returns", "I4", needs="bars scores", doubles=" ".join([*_G, "long_short", "long_average"]),
       sql=f"SELECT trade_date, {', '.join(_G)}, long_short, long_average FROM ({groups_sql(_PL)})")
def _(m):
    return I.group_returns(scored(m), group_rows=m.names)


@query("reversed_group_returns", "I4", needs="bars scores", doubles=" ".join([*_G, "long_short", "long_average"]),
       sql=f"SELECT trade_date, {', '.join(_G)}, long_short, long_average FROM ({groups_sql(_PL, sign='ASC')})")
def _(m):
    return I.group_returns(scored(m), reverse=True, group_rows=m.names)


_MG = ", ".join(f"avg({g}) AS mean_{g}" for g in [*_G, "long_short", "long_average"])
_GS = f"""SELECT *, CAST({' AND '.join(f'mean_group{i} >= mean_group{i + 1}' for i in range(1, 5))} AS INTEGER) AS monotonic,
  mean_group1 - mean_group5 AS top_minus_bottom FROM (SELECT {_MG}, sum(long_short) AS sum_long_short, sum(long_average) AS sum_long_average FROM ({groups_sql(_PL)}))"""


@query("group_return_summary", "I4", needs="bars scores",
       doubles=" ".join([f"mean_{g}" for g in [*_G, "long_short", "long_average"]] + ["sum_long_short", "sum_long_average", "top_minus_bottom"]), sql=_GS)
def _(m):
    return I.group_return_summary(I.group_returns(scored(m), group_rows=m.names))


def ls_sql(table: str, k: int, keys: str = "trade_date") -> str:
    return f"""WITH v AS MATERIALIZED ({table}), mx AS (SELECT max(n) AS mx FROM (SELECT count(*) AS n FROM v GROUP BY {keys})),
      r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, ts_code) AS p, count(*) OVER (PARTITION BY {keys}) AS n FROM v),
      s AS (SELECT *, CASE WHEN {k} / mx::DOUBLE < 0.5 THEN floor(n * ({k} / mx::DOUBLE)) WHEN n > 1 THEN least({k}, n // 2) ELSE 1 END AS k FROM r, mx)
      SELECT {keys}, lg - al AS "long", al - st AS "short", lg - st AS long_short, al AS market_average FROM (SELECT {keys},
        avg(CASE WHEN p <= k THEN label END) AS lg, avg(CASE WHEN p > n - k THEN label END) AS st, avg(label) AS al FROM s GROUP BY {keys})"""


for _name, _k in (("long_short_share", 20), ("long_short_names", 60)):

    @query(_name, "I5", needs="bars scores", doubles='"long" "short" long_short market_average', sql=ls_sql(_PL, _k))
    def _(m, k=_k):
        return I.long_short(scored(m), k, group_rows=m.names)


def turnover_sql(table: str, n: int = 5, keys: str = "trade_date", series: str = "ts_code") -> str:
    o = lambda x: f"row_number() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST, ts_code)"
    return f"""SELECT {keys}, 1 - t / size::DOUBLE AS top, 1 - b / size::DOUBLE AS bottom FROM (SELECT {keys}, max(n // {n}) AS size, count(last) AS known,
        sum(CASE WHEN ct <= n // {n} AND pt <= n // {n} AND last IS NOT NULL THEN 1 ELSE 0 END) AS t,
        sum(CASE WHEN cb <= n // {n} AND pb <= n // {n} AND last IS NOT NULL THEN 1 ELSE 0 END) AS b FROM (
          SELECT *, {o('score DESC')} AS ct, {o('last DESC')} AS pt, {o('score')} AS cb, {o('last')} AS pb, count(*) OVER (PARTITION BY {keys}) AS n
          FROM (SELECT *, lag(score) OVER (PARTITION BY {series} ORDER BY trade_date) AS last FROM ({table}))) GROUP BY {keys})
      WHERE size > 0 AND known > 0"""


@query("bucket_turnover", "I6", needs="bars scores", doubles="top bottom", sql=turnover_sql(_PL))
def _(m):
    return I.bucket_turnover(scored(m), group_rows=m.names)


_FEAT = ["score_1d", "score_5d", "score_20d"]
_LAB = f"SELECT trade_date, ts_code, round(lead(close) OVER ({BY}) / close - 1 + 3.71728349e-9, 6) AS label FROM bars"
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, h.trade_date, h.ts_code, h.{c} AS score, l.label FROM hs h JOIN lab l ON l.trade_date = h.trade_date AND l.ts_code = h.ts_code WHERE l.label IS NOT NULL"
    for c in _FEAT
)
_PRE = f"WITH hs AS MATERIALIZED ({HORIZONS_SQL}), lab AS MATERIALIZED ({_LAB}), x AS MATERIALIZED ({_LONG})"


def featured(m):
    lab = m.bars().select("trade_date", "ts_code", F.round(PV.BY_STOCK.lead("close") / F.col("close") - 1 + 3.71728349e-9, 6).alias("label"))
    return all_scores(m).join(lab, ["trade_date", "ts_code"])


_FT = "feature, trade_date"
_VAL_COLS = """ic_mean ic_std icir positive_rate rank_ic_mean rank_ic_std rank_icir rank_positive_rate mean_group1 mean_group_last mean_long_short
 mean_topk_spread mean_top_turnover mean_bottom_turnover mean_score std_score"""
_VAL = f"""{_PRE}, ic AS MATERIALIZED ({ic_sql('SELECT * FROM x', _FT)}), g AS ({groups_sql('SELECT * FROM x', 5, _FT)}), ls AS ({ls_sql('SELECT * FROM x', 20, _FT)}),
  t AS ({turnover_sql('SELECT * FROM x', 5, _FT, 'feature, ts_code')}), a AS ({summary_sql('SELECT * FROM ic', 'ic', 'feature')}),
  b AS ({summary_sql('SELECT * FROM ic', 'rank_ic', 'feature')})
  SELECT a.feature, a.ic_mean, a.ic_std, a.icir, a.positive_rate, a.count, b.ic_mean AS rank_ic_mean, b.ic_std AS rank_ic_std, b.icir AS rank_icir,
    b.positive_rate AS rank_positive_rate, gg.*  EXCLUDE (feature), l.mean_topk_spread, tt.* EXCLUDE (feature), d.* EXCLUDE (feature)
  FROM a JOIN b ON a.feature = b.feature
  JOIN (SELECT feature, g1 AS mean_group1, g5 AS mean_group_last, ls AS mean_long_short, CAST(g1 >= g2 AND g2 >= g3 AND g3 >= g4 AND g4 >= g5 AS INTEGER) AS monotonic FROM
        (SELECT feature, avg(group1) AS g1, avg(group2) AS g2, avg(group3) AS g3, avg(group4) AS g4, avg(group5) AS g5, avg(long_short) AS ls FROM g GROUP BY feature)) gg ON gg.feature = a.feature
  JOIN (SELECT feature, avg(long_short) AS mean_topk_spread FROM ls GROUP BY feature) l ON l.feature = a.feature
  JOIN (SELECT feature, avg(top) AS mean_top_turnover, avg(bottom) AS mean_bottom_turnover FROM t GROUP BY feature) tt ON tt.feature = a.feature
  JOIN (SELECT feature, avg(score) AS mean_score, stddev_samp(score) AS std_score FROM x GROUP BY feature) d ON d.feature = a.feature"""


@query("feature_validation", "I8", needs="bars lines", doubles=_VAL_COLS, sql=_VAL, digits=5)
def _(m):
    return I.validate_features(featured(m), _FEAT, topk=20, min_rows=5, group_rows=m.names, ic_digits=12)


_SCR = f"""{_PRE}, ic AS ({ic_sql('SELECT * FROM x', _FT)}), b AS ({summary_sql('SELECT * FROM ic', 'rank_ic', 'feature')}), g AS ({groups_sql('SELECT * FROM x', 5, _FT)})
  SELECT b.feature, b.ic_mean AS rank_ic, b.icir AS rank_icir, b.positive_rate * 100 AS ic_positive_pct, ls AS long_short, g1 AS top_group, g5 AS bottom_group,
    CAST(g1 >= g2 AND g2 >= g3 AND g3 >= g4 AND g4 >= g5 AS INTEGER) AS monotonic FROM b JOIN
    (SELECT feature, avg(group1) AS g1, avg(group2) AS g2, avg(group3) AS g3, avg(group4) AS g4, avg(group5) AS g5, avg(long_short) AS ls FROM g GROUP BY feature) gg
    ON gg.feature = b.feature"""


@query("factor_screening", "I9", needs="bars lines", doubles="rank_ic rank_icir ic_positive_pct long_short top_group bottom_group", sql=_SCR, digits=5)
def _(m):
    return I.screen_factors(featured(m), _FEAT, min_rows=5, group_rows=m.names, ic_digits=12)


_ENS = f"""{_PRE}, e AS (SELECT trade_date, ts_code, round(({' + '.join(rank_pct(c, 'trade_date') for c in _FEAT)}) / 3 + 3.71728349e-9, 6) AS ens
  FROM (SELECT h.*, l.label FROM hs h JOIN lab l ON l.trade_date = h.trade_date AND l.ts_code = h.ts_code WHERE label IS NOT NULL)),
  y AS (SELECT * FROM x UNION ALL SELECT 'ensemble', e.trade_date, e.ts_code, e.ens, l.label FROM e JOIN lab l ON l.trade_date = e.trade_date AND l.ts_code = e.ts_code
        WHERE l.label IS NOT NULL), i AS ({ic_sql('SELECT * FROM y', _FT)})
  {summary_sql('SELECT * FROM i', 'ic', 'feature')}"""


@query("ensemble_ic", "I10", needs="bars lines", doubles="ic_mean ic_std icir positive_rate", sql=_ENS, digits=5)
def _(m):
    df = X.rank_ensemble(featured(m).where("label IS NOT NULL"), _FEAT, group_rows=m.names)
    df = df.withColumn("ensemble", F.round(F.col("ensemble") + 3.71728349e-9, 6))
    rows = I.features_to_rows(df, [*_FEAT, "ensemble"])
    return I.ic_summary(I.daily_ic(rows, keys=["feature", "trade_date"], min_rows=5, group_rows=m.names), "ic", ["feature"], 12)


@query("inferred_label_ic", "I11 I1", needs="bars scores", doubles="ic rank_ic", sql=_IC)
def _(m):
    df = scored(m).withColumnRenamed("label", "label_1d")
    return I.daily_ic(df, label=I.infer_label_column(df), min_rows=5, group_rows=m.names)


@query("ic_risk_statistics", "A22", needs="bars scores", doubles="mean std max_drawdown annualized_return information_ratio", digits=5,
       sql=f"""SELECT avg(ic) AS mean, stddev_samp(ic) AS std, min(c - mx) AS max_drawdown, avg(ic) * 238 AS annualized_return,
               avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(238) AS information_ratio FROM (SELECT *, max(c) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS mx FROM
               (SELECT *, sum(ic) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS c FROM ({_IC}) WHERE ic IS NOT NULL))""")
def _(m):
    return I.ic_risk(I.daily_ic(scored(m), min_rows=5, group_rows=m.names))


def column_risk_sql(table: str, columns: list[str]) -> str:
    long = " UNION ALL ".join(f"""SELECT '{c}' AS series, trade_date, "{c}" AS r FROM t""" for c in columns)
    return f"""WITH t AS MATERIALIZED ({table}), l AS MATERIALIZED ({long}), k AS (SELECT *, sum(r) OVER w AS c FROM l WHERE r IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),
      d AS (SELECT *, c - max(c) OVER (PARTITION BY series ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS dd FROM k)
      SELECT series, avg(r) AS mean, stddev_samp(r) AS std, min(dd) AS max_drawdown, avg(r) * 238 AS annualized_return,
        avg(r) / nullif(stddev_samp(r), 0) * sqrt(238) AS information_ratio, avg(r) AS mean_return, sum(r) AS cumulative_return FROM d GROUP BY series"""


_RISK_COLS = "mean std max_drawdown annualized_return information_ratio mean_return cumulative_return"


@query("group_spread_risk", "I4 A22", needs="bars scores", doubles=_RISK_COLS, digits=5,
       sql=column_risk_sql(f"SELECT trade_date, long_short, long_average FROM ({groups_sql(_PL)})", ["long_short", "long_average"]))
def _(m):
    return I.return_column_risk(I.group_returns(scored(m), group_rows=m.names), ["long_short", "long_average"])


_LEGS = ["long", "short", "long_short", "market_average"]


@query("long_short_risk", "I5 A22", needs="bars scores", doubles=_RISK_COLS, digits=5, sql=column_risk_sql(f"SELECT * FROM ({ls_sql(_PL, 20)})", _LEGS))
def _(m):
    return I.return_column_risk(I.long_short(scored(m), 20, group_rows=m.names), _LEGS)


@query(
    "turnover_summary", "I6", needs="bars scores", doubles="mean_turnover std_turnover latest_turnover",
    sql=f"""WITH t AS MATERIALIZED ({turnover_sql(_PL)}) SELECT bucket, avg(v) AS mean_turnover, stddev_samp(v) AS std_turnover, max_by(v, trade_date) AS latest_turnover, count(*) AS count
      FROM (SELECT 'top' AS bucket, trade_date, top AS v FROM t UNION ALL SELECT 'bottom', trade_date, bottom FROM t) GROUP BY bucket""",
)
def _(m):
    return I.turnover_summary(I.bucket_turnover(scored(m), group_rows=m.names))
