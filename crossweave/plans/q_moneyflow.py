"""Queries: money-flow factors and interactions."""

from __future__ import annotations

from ..operators import moneyflow as MF
from ..operators import price_volume as PV
from .q_price_volume import _streak_sql
from .registry import query
from .sqltext import BY, div, lag, pct, roll

KEYS = ["trade_date", "ts_code"]

FLOWS = """SELECT f.*, b.amount, b.close, b.pct_chg, b.vol FROM moneyflow f LEFT JOIN bars b
  ON b.trade_date = f.trade_date AND b.ts_code = f.ts_code"""
NET = f"""SELECT *, main_net_inflow / nullif(amount * 0.1, 0) AS main_net_ratio, retail_net_inflow / nullif(amount * 0.1, 0) AS retail_ratio
  FROM (SELECT *, lg_net_inflow + elg_net_inflow AS main_net_inflow FROM (SELECT *, buy_lg_amount - sell_lg_amount AS lg_net_inflow,
  buy_elg_amount - sell_elg_amount AS elg_net_inflow, buy_sm_amount - sell_sm_amount AS retail_net_inflow FROM ({FLOWS})))"""
_sz = lambda s: f"(buy_{s}_amount - sell_{s}_amount) / nullif(amount / 10.0, 0) AS {s}_net_ratio"
SIZES = f"""SELECT *, {', '.join(_sz(s) for s in ('lg', 'elg', 'sm', 'md'))},
  (buy_sm_amount + buy_md_amount - sell_sm_amount - sell_md_amount) / nullif(amount / 10.0, 0) AS retail_net_ratio FROM ({NET})"""


def flows(m):
    return MF.net_flows(MF.with_amount(m.moneyflow(), m.bars()))


def flow_query(name, covers, fn, cols, sql, **kw):
    @query(name, covers, needs="bars moneyflow", doubles=" ".join(cols), sql=sql, **kw)
    def _(m):
        return fn(flows(m)).select(*KEYS, *cols)


def _sel(cols, table):
    return "SELECT trade_date, ts_code, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + f" FROM ({table})"


flow_query(
    "net_flow_ratios", "F1", lambda df: df,
    ["lg_net_inflow", "elg_net_inflow", "main_net_inflow", "retail_net_inflow", "main_net_ratio", "retail_ratio", "main_retail_diff"],
    f"""SELECT trade_date, ts_code, lg_net_inflow, elg_net_inflow, main_net_inflow, retail_net_inflow, main_net_ratio, retail_ratio,
        main_net_ratio - retail_ratio AS main_retail_diff FROM ({NET})""",
)
_c = {f"main_net_{n}": roll("sum", "main_net_inflow", n) for n in (5, 10, 20)}
_c |= {f"mf_ma{n}": roll("avg", "main_net_inflow", n) for n in (5, 20)}
_c["mf_acceleration"] = f"{_c['main_net_5']} - {_c['main_net_20']}"
flow_query("flow_windows", "F2", MF.flow_windows, list(_c), _sel(_c, NET))
_PW = f"OVER ({BY} ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING)"
_P15 = f"(CASE WHEN count(main_net_ratio) {_PW} >= 8 THEN avg(main_net_ratio) {_PW} END)"
_M5 = roll("avg", "main_net_ratio", 5, 3)
_c = {
    "main_net_momentum_5d": f"{_M5} - {roll('avg', 'main_net_ratio', 20, 10)}",
    "main_net_trend_20d": div(f"{_M5} - {_P15}", f"abs({_P15})"),
}
flow_query("flow_momentum", "F3", MF.flow_momentum, list(_c), _sel(_c, NET))
flow_query(
    "price_flow_divergence", "F4", MF.price_flow_divergence, ["price_mf_divergence"],
    f"""SELECT trade_date, ts_code, CASE WHEN r IS NULL OR c IS NULL THEN NULL WHEN r < 0 AND c > 0 THEN 1.0::DOUBLE
        WHEN r > 0 AND c < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS price_mf_divergence
        FROM (SELECT *, {pct('close', 5)} AS r, {_M5} - {lag('main_net_ratio', 5)} AS c FROM ({NET}))""",
)
_EMA = f"""
WITH n AS (SELECT ts_code, trade_date, main_net_inflow AS x, row_number() OVER ({BY}) AS rn FROM ({NET})),
e AS (SELECT ts_code, trade_date, rn, x AS v FROM n WHERE rn = 1
      UNION ALL SELECT n.ts_code, n.trade_date, n.rn, e.v * (1 - 2.0 / 21) + n.x * (2.0 / 21)
      FROM e JOIN n ON n.ts_code = e.ts_code AND n.rn = e.rn + 1)
SELECT trade_date, ts_code, main_net_ema_20, (main_net_ema_20 - {lag('main_net_ema_20', 19)}) / 19.0 AS main_net_ema_slope_20
FROM (SELECT trade_date, ts_code, CASE WHEN rn >= 10 THEN v END AS main_net_ema_20 FROM e)"""
flow_query("flow_ema", "F5", MF.flow_ema, ["main_net_ema_20", "main_net_ema_slope_20"], _EMA, recursive=True)
flow_query(
    "flow_streak", "F6", MF.flow_streak, ["main_net_consecutive"],
    _streak_sql(f"({NET})", {"main_net_consecutive": "main_net_inflow > 0"}),
)
_c = {"main_net_amount_ratio_20": roll("avg", "main_net_ratio", 20, 10)}
flow_query("flow_amount_ratio", "F7", MF.flow_amount_ratio, list(_c), _sel(_c, NET))
_S = ["lg_net_ratio", "elg_net_ratio", "sm_net_ratio", "md_net_ratio", "retail_net_ratio"]
flow_query("size_class_ratios", "F8", MF.size_ratios, _S, f"SELECT trade_date, ts_code, {', '.join(_S)} FROM ({SIZES})")
_r20 = lambda c: roll("avg", c, 20, 10)
_c = {
    "main_retail_ratio_20": f"{_r20('main_net_ratio')} - {_r20('retail_net_ratio')}",
    "lg_elg_ratio_20": f"{_r20('lg_net_ratio')} - {_r20('elg_net_ratio')}",
    "moneyflow_strength_5": roll("avg", "abs(main_net_ratio)", 5, 3),
}
flow_query("flow_structure", "F9", lambda d: MF.structure_windows(MF.size_ratios(d)), list(_c), _sel(_c, SIZES))
_parts = [roll("stddev_samp", f"{s}_net_ratio", 20, 10) for s in ("sm", "md", "lg", "elg")]
flow_query(
    "flow_dispersion", "F10", lambda d: MF.flow_dispersion(MF.size_ratios(d)), ["moneyflow_dispersion_20"],
    f"""SELECT trade_date, ts_code, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0)) /
        nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT, 0) AS moneyflow_dispersion_20
        FROM (SELECT trade_date, ts_code, {_parts[0]} AS a, {_parts[1]} AS b, {_parts[2]} AS c, {_parts[3]} AS d FROM ({SIZES}))""",
)
_c = {"net_mf_amount_ratio": div("net_mf_amount", "amount"), "net_mf_vol_ratio": div("net_mf_vol", "buy_sm_vol + sell_sm_vol")}
flow_query("total_flow_ratios", "F11", MF.total_flow_ratios, list(_c), _sel(_c, NET))
_c = {
    "buy_pressure_5": roll("avg", "b", 5, 3),
    "sell_pressure_5": roll("avg", "s", 5, 3),
}
flow_query(
    "flow_pressure", "F12", MF.pressure, list(_c),
    _sel(_c, f"SELECT *, (buy_lg_amount + buy_elg_amount) / nullif(amount / 10.0, 0) AS b, (sell_lg_amount + sell_elg_amount) / nullif(amount / 10.0, 0) AS s FROM ({FLOWS})"),
)


@query(
    "factor_interactions", "F13", needs="bars reports", doubles="momentum_volume_interaction roe_growth_interaction",
    sql=f"""SELECT b.trade_date, b.ts_code, b.mv AS momentum_volume_interaction, r.dq * r.da AS roe_growth_interaction FROM
      (SELECT *, {pct('close', 20)} * {div('vol', roll('avg', 'vol', 20, 10))} AS mv FROM bars) b ASOF LEFT JOIN
      (SELECT ts_code, ann_date, roe - lag(roe) OVER (PARTITION BY ts_code ORDER BY end_date) AS dq,
              or_yoy - lag(or_yoy) OVER (PARTITION BY ts_code ORDER BY end_date) AS da FROM reports) r
      ON b.ts_code = r.ts_code AND b.trade_date >= r.ann_date""",
)
def _(m):
    from ..operators import fundamental as FU

    cols = ["roe_qoq_change", "revenue_yoy_acceleration"]
    df = FU.to_daily(m.bars(), FU.quarterly_changes(m.reports()), cols)
    return PV.interactions(df).select(*KEYS, "momentum_volume_interaction", "roe_growth_interaction")
