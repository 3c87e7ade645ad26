"""Report-level factors and their point-in-time daily form.

Reports of one code are ordered by (end_date, ann_date); a code has a bounded number
of them. ``to_daily`` carries the latest announced report to every bar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, finite, flag, safe_div
from ..functions.groups import average_rank, with_quantiles
from ..functions.rolling import Series
from .joins import asof_join

REPORTS = Series("ts_code", ["end_date", "ann_date"])


def to_daily(panel: DataFrame, reports: DataFrame, columns: Sequence[str]) -> DataFrame:
    return asof_join(panel, reports, columns)


def daily_fundamentals(panel: DataFrame, reports: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Latest ratios per bar, the equity-asset return gap and daily percentile ranks."""
    df = to_daily(panel, reports, ["ann_date", "end_date", "roe", "roa", "or_yoy", "debt_to_assets", "gross_margin"])
    df = df.withColumn("roe_roa_gap", F.col("roe") - F.col("roa"))
    for src, out in (("roe", "roe_rank"), ("roa", "roa_rank"), ("or_yoy", "revenue_yoy_rank")):
        df = average_rank(df, src, "trade_date", out, pct=True, group_rows=group_rows)
    return df


def _diff(x: str, n: int) -> Column:
    return F.col(x) - REPORTS.lag(x, n)


def quarterly_changes(r: DataFrame) -> DataFrame:
    return r.withColumns(
        {
            "roe_qoq_change": _diff("roe", 1),
            "revenue_yoy_acceleration": _diff("or_yoy", 1),
            "gross_margin_change": _diff("gross_margin", 1),
        }
    )


def _guarded(a: str, b: str, floor: float) -> Column:
    """Quotient only where the denominator is larger than ``floor``."""
    return F.when(F.abs(F.col(b)) > floor, safe_div(a, b))


def quality_ratios(r: DataFrame) -> DataFrame:
    return r.withColumns(
        {
            "accruals_ratio": F.col("netprofit_margin") - F.col("ocf_to_or"),
            "ocf_to_profit": _guarded("ocf_to_or", "netprofit_margin", 0.001),
            "gross_profitability": F.col("grossprofit_margin") * F.col("assets_turn") / 100.0,
            "asset_turnover": F.col("assets_turn"),
            "interest_coverage": _guarded("ebit_of_gr", "finaexp_of_gr", 0.001),
            "net_operating_assets": 1.0 - F.col("debt_to_assets") / 100.0,
        }
    )


def stability(r: DataFrame) -> DataFrame:
    """Inverse of one plus the deviation over the last eight reports."""
    inv = lambda c: 1.0 / (1.0 + F.abs(REPORTS.std(c, 8, 4)))
    return r.withColumns({"roe_stability_8q": inv("roe"), "earnings_growth_stability": inv("netprofit_yoy")})


def yearly_changes(r: DataFrame) -> DataFrame:
    return r.withColumns({"profit_margin_change": _diff("netprofit_margin", 4), "roic_change": _diff("roic", 4)})


def balance_ratios(r: DataFrame) -> DataFrame:
    return r.withColumns(
        {
            "debt_to_equity": F.col("debt_to_eqt"),
            "roic_level": F.col("roic"),
            "tangible_asset_ratio": 1.0 - F.col("debt_to_assets") / 100.0,
            "operating_leverage": _guarded("op_yoy", "or_yoy", 1.0),
            "financial_leverage": _guarded("roe", "roa", 0.1),
        }
    )


def value_ratios(bars: DataFrame, reports: DataFrame) -> DataFrame:
    """Per-share report values over the close."""
    return value_columns(to_daily(bars, reports, ["eps", "bps", "revenue_ps", "cfps", "undist_profit_ps"]))


def value_columns(df: DataFrame) -> DataFrame:
    """The same from bars that hold the report values already."""
    per = lambda c: F.when(F.col("close") > 0, safe_div(c, "close"))
    return df.withColumns(
        {
            "ep_ratio": per("eps"),
            "bp_ratio": per("bps"),
            "sp_ratio": per("revenue_ps"),
            "cfp_ratio": per("cfps"),
            "dividend_yield_approx": per("undist_profit_ps") * 0.3,
        }
    )


def f_score(r: DataFrame) -> DataFrame:
    """Nine binary strength signals in three groups; unknown comparisons count as 0."""
    change = lambda c: _diff(c, 4)
    accruals = F.col("netprofit_margin") - F.col("ocf_to_or")
    profit = (
        flag(F.col("roa") > 0) + flag(F.col("ocf_to_or") > 0) + flag(change("roa") > 0) + flag(accruals < 0)
    )
    leverage = (
        flag(change("debt_to_assets") < 0)
        + flag(change("current_ratio") > 0)
        + flag(safe_div("bps", REPORTS.lag("bps", 4)) > 0.95)
    )
    efficiency = flag(change("grossprofit_margin") > 0) + flag(change("assets_turn") > 0)
    df = r.withColumns({"f_profitability": profit, "f_leverage_liquidity": leverage, "f_efficiency": efficiency})
    total = F.col("f_profitability") + F.col("f_leverage_liquidity") + F.col("f_efficiency")
    return df.withColumn("piotroski_f_score", total)


def growth(r: DataFrame) -> DataFrame:
    """Acceleration of growth rates; plain growth columns pass through."""
    return r.withColumns(
        {
            "revenue_acceleration_2q": _diff("or_yoy", 2),
            "profit_acceleration_2q": _diff("netprofit_yoy", 2),
            "roe_momentum_4q": _diff("roe", 4),
            "earnings_surprise_qoq": _diff("q_netprofit_yoy", 1),
        }
    )


def sentiment_proxies(r: DataFrame) -> DataFrame:
    """Research intensity and growth, share of profitable reports, payout proxy."""
    prior = REPORTS.lag("rd_exp", 4)
    positive = flag(F.col("netprofit_yoy") > 0)
    return r.withColumns(
        {
            "rd_intensity": F.when(
                F.abs("total_revenue_ps") > 0.001, safe_div("rd_exp", F.col("total_revenue_ps") * 1e6)
            ),
            "rd_growth": finite(safe_div("rd_exp", prior) - 1),
            "profit_consistency": REPORTS.mean(positive, 8, 4),
            "dividend_payout_approx": F.col("roe") - F.col("bps_yoy"),
        }
    )


def earnings_quality(r: DataFrame, total_rows: int | None = None) -> DataFrame:
    """Accruals scaled by their global 99 % size, bounded cash conversion, and stability, averaged."""
    df = r.withColumns(
        {
            "_acc": F.col("netprofit_margin") - F.col("ocf_to_or"),
            "_cash": _guarded("ocf_to_or", "netprofit_margin", 0.001),
            "_stab": 1.0 / (1.0 + F.abs(REPORTS.std("roe", 8, 4))),
        }
    ).withColumn("_size", F.abs("_acc"))
    df = with_quantiles(df, "_size", [], {"_p99": 0.99}, group_rows=total_rows, tiebreak=["ts_code", "end_date", "ann_date"])
    scale = F.when(F.col("_p99") > 0, F.col("_p99")).otherwise(1.0)
    zero = F.lit(0.0)
    value = (
        -F.coalesce("_acc", zero) / scale + clip(F.coalesce("_cash", zero), -5.0, 5.0) / 5.0 + F.coalesce("_stab", zero)
    ) / 3.0
    return df.withColumn("earnings_quality_composite", value).drop("_acc", "_cash", "_stab", "_size", "_p99")
