"""Queries: report factors and their point-in-time form."""

from __future__ import annotations


from ..operators import fundamental as FU
from .q_joins import PIT
from .registry import query
from .sqltext import rank_pct, roll

RKEYS = ["ts_code", "end_date"]
RBY = "PARTITION BY ts_code ORDER BY end_date, ann_date"


def rlag(x, n):
    return f"(lag({x}, {n}) OVER ({RBY}))"


def diff(x, n):
    return f"{x} - {rlag(x, n)}"


def guarded(a, b, floor):
    return f"CASE WHEN abs({b}) > {floor} THEN {a} / nullif({b}, 0) END"


def report_query(name, covers, fn, cols, table="reports", **kw):
    body = ", ".join(f"{e} AS {n}" for n, e in cols.items())

    @query(name, covers, needs="reports", doubles=" ".join(cols), sql=f"SELECT ts_code, end_date, {body} FROM {table}", **kw)
    def _(m):
        return fn(m.reports()).select(*RKEYS, *cols)


_RANKS = {"roe_rank": "roe", "roa_rank": "roa", "revenue_yoy_rank": "or_yoy"}


@query(
    "daily_fundamentals", "G1", needs="bars reports", doubles="roe roa or_yoy roe_roa_gap roe_rank roa_rank revenue_yoy_rank",
    sql=f"""SELECT trade_date, ts_code, roe, roa, or_yoy, roe - roa AS roe_roa_gap,
      {', '.join(f"{rank_pct(c, 'trade_date')} AS {n}" for n, c in _RANKS.items())}
      FROM (SELECT b.trade_date, b.ts_code, r.roe, r.roa, r.or_yoy FROM bars b ASOF LEFT JOIN {PIT} r
            ON b.ts_code = r.ts_code AND b.trade_date >= r.ann_date)""",
)
def _(m):
    df = FU.daily_fundamentals(m.bars().select("trade_date", "ts_code"), m.reports(), m.names)
    return df.select("trade_date", "ts_code", "roe", "roa", "or_yoy", "roe_roa_gap", *_RANKS)


report_query(
    "quarterly_changes", "G2", FU.quarterly_changes,
    {"roe_qoq_change": diff("roe", 1), "revenue_yoy_acceleration": diff("or_yoy", 1), "gross_margin_change": diff("gross_margin", 1)},
)
QUALITY = {
    "accruals_ratio": "netprofit_margin - ocf_to_or",
    "ocf_to_profit": guarded("ocf_to_or", "netprofit_margin", 0.001),
    "gross_profitability": "grossprofit_margin * assets_turn / 100.0",
    "asset_turnover": "assets_turn",
    "interest_coverage": guarded("ebit_of_gr", "finaexp_of_gr", 0.001),
    "net_operating_assets": "1.0 - debt_to_assets / 100.0",
}
report_query("quality_ratios", "G3", FU.quality_ratios, QUALITY, digits=5)
report_query(
    "report_stability", "G4", FU.stability,
    {
        "roe_stability_8q": f"1.0 / (1.0 + {roll('stddev_samp', 'roe', 8, 4, RBY)})",
        "earnings_growth_stability": f"1.0 / (1.0 + {roll('stddev_samp', 'netprofit_yoy', 8, 4, RBY)})",
    },
)
report_query(
    "yearly_changes", "G5", FU.yearly_changes,
    {"profit_margin_change": diff("netprofit_margin", 4), "roic_change": diff("roic", 4)},
)
_PASS = ["current_ratio", "quick_ratio", "ocf_to_debt", "ebitda_to_debt", "roe_yearly", "roa_yearly", "cash_to_liqdebt"]
report_query(
    "balance_ratios", "G6", FU.balance_ratios,
    {
        **{c: c for c in _PASS},
        "debt_to_equity": "debt_to_eqt",
        "roic_level": "roic",
        "tangible_asset_ratio": "1.0 - debt_to_assets / 100.0",
        "operating_leverage": guarded("op_yoy", "or_yoy", 1),
        "financial_leverage": guarded("roe", "roa", 0.1),
    },
)
_VALUE = {
    "ep_ratio": "r.eps / nullif(b.close, 0)",
    "bp_ratio": "r.bps / nullif(b.close, 0)",
    "sp_ratio": "r.revenue_ps / nullif(b.close, 0)",
    "cfp_ratio": "r.cfps / nullif(b.close, 0)",
    "dividend_yield_approx": "r.undist_profit_ps / nullif(b.close, 0) * 0.3",
}


@query(
    "value_ratios", "G7", needs="bars reports", doubles=" ".join(_VALUE),
    sql=f"""SELECT b.trade_date, b.ts_code, {', '.join(f'CASE WHEN b.close > 0 THEN {e} END AS {n}' for n, e in _VALUE.items())}
            FROM bars b ASOF LEFT JOIN {PIT} r ON b.ts_code = r.ts_code AND b.trade_date >= r.ann_date""",
)
def _(m):
    return FU.value_ratios(m.bars().select("trade_date", "ts_code", "close"), m.reports()).select(
        "trade_date", "ts_code", *_VALUE
    )


_b = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
_d4 = lambda x, op: _b(f"{x} - {rlag(x, 4)} {op} 0")
_PROFIT = f"{_b('roa > 0')} + {_b('ocf_to_or > 0')} + {_d4('roa', '>')} + {_b('netprofit_margin - ocf_to_or < 0')}"
_LEV = f"{_d4('debt_to_assets', '<')} + {_d4('current_ratio', '>')} + {_b('bps / nullif(' + rlag('bps', 4) + ', 0) > 0.95')}"
_EFF = f"{_d4('grossprofit_margin', '>')} + {_d4('assets_turn', '>')}"
report_query(
    "strength_score", "G8", FU.f_score,
    {
        "f_profitability": f"({_PROFIT})::DOUBLE",
        "f_leverage_liquidity": f"({_LEV})::DOUBLE",
        "f_efficiency": f"({_EFF})::DOUBLE",
        "piotroski_f_score": f"({_PROFIT} + {_LEV} + {_EFF})::DOUBLE",
    },
)
_YOY = ["op_yoy", "netprofit_yoy", "roe_yoy", "bps_yoy", "assets_yoy", "equity_yoy", "basic_eps_yoy", "cfps_yoy"]
report_query(
    "growth_factors", "G9", FU.growth,
    {
        **{c: c for c in _YOY},
        "revenue_acceleration_2q": diff("or_yoy", 2),
        "profit_acceleration_2q": diff("netprofit_yoy", 2),
        "roe_momentum_4q": diff("roe", 4),
        "earnings_surprise_qoq": diff("q_netprofit_yoy", 1),
    },
)
report_query(
    "sentiment_proxies", "G10", FU.sentiment_proxies,
    {
        "rd_intensity": "CASE WHEN abs(total_revenue_ps) > 0.001 THEN rd_exp / nullif(total_revenue_ps * 1000000.0, 0) END",
        "rd_growth": f"rd_exp / nullif({rlag('rd_exp', 4)}, 0) - 1",
        "profit_consistency": roll("avg", "(CASE WHEN netprofit_yoy > 0 THEN 1.0 ELSE 0.0 END)", 8, 4, RBY),
        "dividend_payout_approx": "roe - bps_yoy",
    },
)
_STAB = f"1.0 / (1.0 + {roll('stddev_samp', 'roe', 8, 4, RBY)})"
report_query(
    "earnings_quality_composite", "G11", FU.earnings_quality,
    {
        "earnings_quality_composite": f"""(-coalesce(netprofit_margin - ocf_to_or, 0) / CASE WHEN p99 > 0 THEN p99 ELSE 1 END
      + least(greatest(coalesce({guarded('ocf_to_or', 'netprofit_margin', 0.001)}, 0), -5), 5) / 5 + coalesce({_STAB}, 0)) / 3.0"""
    },
    table="reports, (SELECT quantile_cont(abs(netprofit_margin - ocf_to_or), 0.99) AS p99 FROM reports) q",
)


@query(
    "daily_quality_factors", "G3 G4 J2 A13", needs="bars reports", doubles="accruals_ratio roe_stability_8q",
    sql=f"""WITH q AS (SELECT ts_code, ann_date, end_date, netprofit_margin - ocf_to_or AS a, {_STAB} AS s FROM reports),
      d AS (SELECT b.trade_date, b.ts_code, q.a, q.s FROM bars b ASOF LEFT JOIN q ON b.ts_code = q.ts_code AND b.trade_date >= q.ann_date)
      SELECT trade_date, ts_code, CASE WHEN a IS NOT NULL THEN least(greatest(a, (SELECT quantile_cont(a, 0.01) FROM d)), (SELECT quantile_cont(a, 0.99) FROM d)) END AS accruals_ratio,
      CASE WHEN s IS NOT NULL THEN least(greatest(s, (SELECT quantile_cont(s, 0.01) FROM d)), (SELECT quantile_cont(s, 0.99) FROM d)) END AS roe_stability_8q FROM d""",
)
def _(m):
    from ..operators.aggregates import global_winsorize

    cols = ["accruals_ratio", "roe_stability_8q"]
    df = FU.to_daily(m.bars().select("trade_date", "ts_code"), FU.stability(FU.quality_ratios(m.reports())), cols)
    return global_winsorize(df, cols)


