"""Factor tables from named factors: what a factor reads decides what is computed, joined and in which order.

A step adds some columns from others and says by which series its windows run. The plan takes the steps that the wanted
factors need, after the steps whose columns they read, and keeps steps of one series together: their windows
then share one exchange and one sort, however many factors are asked for. Report factors are computed on the reports and
carried to the bars by one point-in-time join; money flows and industry labels are joined only if something reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cross_section as X
from . import fundamental as FU
from . import moneyflow as MF
from . import price_volume as PV
from . import smoothing as SM
from ..functions.groups import measured_group_rows
from ..functions.rolling import Series
from ..functions.stages import staged, together
from ..sources.datasets import materialize
from .joins import interval_join

#: most steps whose windows are computed together; then finished columns are put together
BLOCK_STEPS = 64

#: order of rows that share code and date in the smoothed means of the plan
SMOOTHED_BY = ("close", "high", "low", "main_net_inflow")

REPORT, STOCK, CROSS = "report", "stock", "cross-section"
INDUSTRY = "l1_name"


@dataclass(frozen=True)
class Step:
    """Columns ``add`` makes from columns it reads; ``series`` names the partitioning of its windows."""

    outputs: tuple[str, ...]
    inputs: tuple[str, ...]
    series: str
    add: Callable[[DataFrame], DataFrame]


def step(outputs: str, inputs: str, series: str, add: Callable[[DataFrame], DataFrame]) -> Step:
    return Step(tuple(outputs.split()), tuple(inputs.split()), series, add)


def row_by_row(add: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An operator that looks at no other row: it runs ahead of the windows of its block."""

    def own(df: DataFrame) -> DataFrame:
        return add(df)

    own.row_by_row = True
    return own


def with_arguments(operator: Callable, *args) -> Callable[[DataFrame], DataFrame]:
    """A staged operator with its arguments, as a step adds it."""
    return staged(lambda: operator.stages(*args))


def report_steps() -> list[Step]:
    return [
        step("roe_qoq_change revenue_yoy_acceleration gross_margin_change", "roe or_yoy gross_margin", REPORT, FU.quarterly_changes),
        step("accruals_ratio ocf_to_profit gross_profitability asset_turnover interest_coverage net_operating_assets",
             "netprofit_margin ocf_to_or grossprofit_margin assets_turn ebit_of_gr finaexp_of_gr debt_to_assets", REPORT, FU.quality_ratios),
        step("roe_stability_8q earnings_growth_stability", "roe netprofit_yoy", REPORT, FU.stability),
        step("profit_margin_change roic_change", "netprofit_margin roic", REPORT, FU.yearly_changes),
        step("debt_to_equity roic_level tangible_asset_ratio operating_leverage financial_leverage", "debt_to_eqt roic debt_to_assets op_yoy or_yoy roe roa", REPORT, FU.balance_ratios),
        step("f_profitability f_leverage_liquidity f_efficiency piotroski_f_score",
             "roa ocf_to_or netprofit_margin debt_to_assets current_ratio bps grossprofit_margin assets_turn", REPORT, FU.f_score),
        step("revenue_acceleration_2q profit_acceleration_2q roe_momentum_4q earnings_surprise_qoq", "or_yoy netprofit_yoy roe q_netprofit_yoy", REPORT, FU.growth),
        step("rd_intensity rd_growth profit_consistency dividend_payout_approx", "rd_exp total_revenue_ps netprofit_yoy roe bps_yoy", REPORT, FU.sentiment_proxies),
        step("earnings_quality_composite", "netprofit_margin ocf_to_or roe", REPORT, FU.earnings_quality),
    ]


RANKED = {
    "industry_rank_ret_20": "ret_20", "industry_rank_roe": "roe", "industry_rank_gross_margin": "grossprofit_margin", "industry_rank_roic": "roic",
    "industry_rank_netprofit_yoy": "netprofit_yoy", "industry_rank_turn_days": "turn_days",
}


def panel_steps(group_rows: int | None = None) -> list[Step]:
    flows = "main_net_inflow main_net_ratio"
    sides = " ".join(f"{side}_{size}_amount" for side in ("buy", "sell") for size in ("sm", "md", "lg", "elg"))

    def ranks(df: DataFrame) -> DataFrame:
        # equal returns must tie on every engine
        rounded = df.withColumn("_ret_20", F.round(F.col("ret_20") + 3.71728349e-9, 6))
        named = {o: "_ret_20" if s == "ret_20" else s for o, s in RANKED.items()}
        return X.group_ranks(rounded, named, [X.DATE, INDUSTRY], group_rows).drop("_ret_20")

    return [
        step("ret_5 ret_20", "close", STOCK, with_arguments(PV.returns, (5, 20))),
        step("ret_1", "pct_chg", STOCK, row_by_row(lambda df: df.withColumn("ret_1", F.col("pct_chg") / 100.0))),
        step("momentum_12m_skip1m momentum_6m_skip2w", "close", STOCK, PV.skip_momentum),
        step("momentum_52w_high_dist momentum_52w_high_break", "close", STOCK, PV.high_52w),
        step("rsi_14", "pct_chg", STOCK, PV.rsi),
        step("williams_r_14", "high low close", STOCK, PV.williams_r),
        step("macd macd_signal macd_hist", "close", STOCK, SM.macd),
        step("consecutive_up_days consecutive_down_days", "pct_chg", STOCK, PV.up_down_streaks),
        step("obv obv_ma5_ratio", "close vol", STOCK, PV.on_balance_volume),
        step("volume_price_trend", "vol pct_chg", STOCK, PV.volume_price_trend),
        step("volume_momentum", "vol", STOCK, PV.volume_momentum),
        step("amihud_20", "pct_chg amount", STOCK, PV.amihud),
        step("turnover_vol_20", "vol", STOCK, PV.turnover_volatility),
        step("downside_vol_20", "pct_chg", STOCK, PV.downside_volatility),
        step("max_drawdown_60", "close", STOCK, PV.rolling_drawdown),
        step("bollinger_width_20 bollinger_position_20", "close", STOCK, PV.bollinger),
        step("atr_14", "high low close", STOCK, PV.true_range_average),
        step("price_position_20 price_position_60", "high low close", STOCK, PV.price_position),
        step("ret_skew_20 ret_kurt_60", "pct_chg", STOCK, PV.return_shape),
        step("kdj_k kdj_d kdj_j", "high low close", STOCK, SM.kdj),
        step("cci_20", "high low close", STOCK, PV.cci),
        step("up_down_volume_ratio_20", "pct_chg vol", STOCK, PV.up_down_volume),
        step("volume_price_divergence_20", "pct_chg vol", STOCK, PV.volume_price_divergence),
        step("main_net_momentum_5d main_net_trend_20d", flows, STOCK, MF.flow_momentum),
        step("price_mf_divergence", f"close {flows}", STOCK, MF.price_flow_divergence),
        step("main_net_ema_20 main_net_ema_slope_20", flows, STOCK, MF.flow_ema),
        step("main_net_consecutive", flows, STOCK, MF.flow_streak),
        step("main_net_amount_ratio_20", flows, STOCK, MF.flow_amount_ratio),
        step("lg_net_ratio elg_net_ratio sm_net_ratio md_net_ratio retail_net_ratio", f"amount {sides}", STOCK, row_by_row(MF.size_ratios)),
        step("main_retail_ratio_20 lg_elg_ratio_20 moneyflow_strength_5", f"{flows} retail_net_ratio lg_net_ratio elg_net_ratio", STOCK, MF.structure_windows),
        step("moneyflow_dispersion_20", "sm_net_ratio md_net_ratio lg_net_ratio elg_net_ratio", STOCK, MF.flow_dispersion),
        step("net_mf_amount_ratio net_mf_vol_ratio", "net_mf_amount net_mf_vol amount buy_sm_vol sell_sm_vol", STOCK, row_by_row(MF.total_flow_ratios)),
        step("buy_pressure_5 sell_pressure_5", f"amount {sides}", STOCK, MF.pressure),
        step("momentum_volume_interaction roe_growth_interaction", "close vol roe_qoq_change revenue_yoy_acceleration", STOCK, staged(lambda: PV.interaction_stages(("roe_qoq_change", "revenue_yoy_acceleration")))),
        step("ep_ratio bp_ratio sp_ratio cfp_ratio dividend_yield_approx", "close eps bps revenue_ps cfps undist_profit_ps", STOCK, row_by_row(FU.value_columns)),
        step(" ".join(RANKED), f"{INDUSTRY} {' '.join(RANKED.values())}", CROSS, ranks),
        step("industry_vol_20 industry_momentum_5 industry_momentum_20 relative_momentum_20", f"{INDUSTRY} pct_chg", STOCK, X.industry_momentum),
        step("industry_concentration", INDUSTRY, CROSS, lambda df: X.industry_concentration(df, INDUSTRY, group_rows)),
        step("industry_ret_1 industry_ret_5 industry_ret_20 relative_strength_5 relative_strength_20 roe_ind_neutral roa_ind_neutral revenue_yoy_ind_neutral",
             f"{INDUSTRY} ret_1 ret_5 ret_20 roe roa or_yoy", CROSS, lambda df: X.industry_relative(df, INDUSTRY, group_rows)),
    ]


#: report columns that are factors as they are
PASSED = (
    "current_ratio", "quick_ratio", "ocf_to_debt", "ebitda_to_debt", "roe_yearly", "roa_yearly", "cash_to_liqdebt", "op_yoy", "netprofit_yoy", "roe_yoy", "bps_yoy",
    "assets_yoy", "equity_yoy", "basic_eps_yoy", "cfps_yoy",
)
INDUSTRY_FACTORS = tuple(o for s in panel_steps() if "relative_strength_5" in s.outputs for o in s.outputs)
ENHANCED_FACTORS = (
    *(o for s in panel_steps() if "ret_5" not in s.outputs and "ret_1" not in s.outputs for o in s.outputs if o not in INDUSTRY_FACTORS),
    *(o for s in report_steps() for o in s.outputs), *PASSED,
)


def needed(steps: Sequence[Step], wanted: Iterable[str]) -> tuple[list[Step], set[str]]:
    """The steps that ``wanted`` columns need, and the columns no step makes."""
    maker = {o: s for s in steps for o in s.outputs}
    chosen, plain, open_ = [], set(), list(wanted)
    while open_:
        c = open_.pop()
        if c not in maker:
            plain.add(c)
        elif maker[c] not in chosen:
            chosen.append(maker[c])
            open_ += maker[c].inputs
    return [s for s in steps if s in chosen], plain


def ordered(steps: Sequence[Step]) -> list[Step]:
    """Steps after those whose columns they read; the series changes as seldom as that allows."""
    out: list[Step] = []
    rest = list(steps)
    while rest:
        made = {o for s in rest for o in s.outputs}
        ready = [s for s in rest if not made & (set(s.inputs) - set(s.outputs))]
        if not ready:
            raise ValueError(f"factors that need each other: {sorted(made)}")
        same = [s for s in ready if out and s.series == out[-1].series]
        series = (same or ready)[0].series
        for s in ready:
            if s.series == series:
                out.append(s)
                rest.remove(s)
    return out


def factor_table(
    bars: DataFrame, wanted: Sequence[str], flows: DataFrame | None = None, reports: DataFrame | None = None, members: DataFrame | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """The ``wanted`` factors of every bar: trade_date, ts_code, then the factors in the order given.

    ``flows`` are money flows by bar (``buy_…_amount`` …), ``reports`` dated by ``ann_date``, ``members`` validity periods of
    industry labels; each is read only if a factor needs it, and a missing one that is needed is an error.
    """
    steps, plain = needed(panel_steps(group_rows), wanted)
    made = {o for s in report_steps() for o in s.outputs}
    from_reports, _ = needed(report_steps(), [c for c in plain if c in made])
    have = set(bars.columns)
    flow_columns = {c for s in steps for c in s.inputs if flows is not None and (c in flows.columns or c in ("main_net_inflow", "main_net_ratio"))} - have
    daily = sorted(c for c in plain - have - flow_columns - {INDUSTRY} if c in made or reports is not None and c in reports.columns)
    unknown = plain - have - flow_columns - set(daily) - {INDUSTRY}
    if unknown or (daily and reports is None) or (INDUSTRY in plain and members is None and INDUSTRY not in have):
        raise ValueError(f"factors read columns that no table has: {sorted(unknown or daily or [INDUSTRY])}")
    df = bars
    if flow_columns:
        df = df.join(MF.net_flows(MF.with_amount(flows, bars)).drop(*[c for c in have if c not in ("trade_date", "ts_code")]), ["trade_date", "ts_code"], "left")
    if INDUSTRY in plain and INDUSTRY not in have:
        df = interval_join(df, members, [INDUSTRY])
    if daily:
        known = reports
        for s in ordered(from_reports):
            known = s.add(known)
        df = FU.to_daily(df, known.select("ts_code", "ann_date", "end_date", *daily), daily)
    rows = None
    if df is not bars:  # the joined panel is read by several windows and joins: written once, narrow
        read = {c for s in steps for c in s.inputs} | set(wanted) | {"trade_date", "ts_code"}
        df = materialize(df.select(*[c for c in df.columns if c in read]), "factor-panel")
        rows = measured_group_rows(df, "ts_code")
    return run_steps(df, ordered(steps), ["trade_date", "ts_code", *wanted], rows=rows)


def blocks(steps: Sequence[Step], most: int) -> list[list[Step]]:
    """Neighbours in order that read nothing of each other and share their series, at most so many."""
    out: list[list[Step]] = []
    for s in steps:
        last = out[-1] if out else []
        if last and len(last) < most and last[0].series == s.series and not {o for x in last for o in x.outputs} & set(s.inputs):
            last.append(s)
        else:
            out.append([s])
    return out


def packed(df: DataFrame, read: set[str]) -> tuple[DataFrame, list[str]]:
    """Doubles that nobody reads for now as one array, and their names."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name not in read]
    if len(names) < 2:
        return df, []
    return df.select(*[c for c in df.columns if c not in names], F.array(*names).alias("_carried")), names


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    if not names:
        return df
    return df.select(*[c for c in df.columns if c != "_carried"], *[F.get("_carried", F.lit(i)).alias(c) for i, c in enumerate(names)])


def run_steps(df: DataFrame, steps: Sequence[Step], wanted: Sequence[str], block: int = BLOCK_STEPS, rows: int | None = None) -> DataFrame:
    """``wanted`` columns after all ``steps`` in the order given; ``rows`` bounds the rows of one instrument, where known.

    Steps of a block that do not read each other share their windows (``functions.stages``). Every window copies its whole row. So
    columns that no later step reads do not travel as fields of their own: after each block of
    steps, doubles that are wanted move into one array, what nobody asks for any more is dropped, and the last projection takes
    the arrays apart again.
    """
    place = {}

    def settle(df: DataFrame, later: Sequence[Step]) -> DataFrame:
        read = {c for s in later for c in s.inputs} | {"trade_date", "ts_code"}
        done = [f.name for f in df.schema.fields if f.name in wanted and f.name not in read and isinstance(f.dataType, T.DoubleType)]
        array = f"_settled{len(place)}"
        place.update({c: F.get(array, F.lit(i)) for i, c in enumerate(done)})
        kept = [c for c in df.columns if c not in done and (c in read or c in wanted or c.startswith("_settled"))]
        return df.select(*kept, *([F.array(*done).alias(array)] if done else []))

    groups = blocks(steps, block)
    if len(groups) > 1:
        df = settle(df, steps)
    for at, group in enumerate(groups):
        fused = [s for s in group if hasattr(s.add, "stages")]
        first = [s for s in group if hasattr(s.add, "row_by_row")]
        later = [s for g in groups[at + 1 :] for s in g]
        for s in first:
            df = s.add(df)
        if first and fused:
            df = settle(df, [s for s in group if s not in first] + later)
        if fused:
            # rows of one date are taken by what the smoothed steps order them by
            series = Series("ts_code", ["trade_date", *[c for c in SMOOTHED_BY if c in df.columns]])
            df, carried = packed(df, {c for s in fused for c in s.inputs} | set(series.order) | set(series.keys))
            df = unpacked(together(df, [s.add.stages() for s in fused], series, rows), carried)
        for s in group:
            if s not in fused and s not in first:
                df = s.add(df)
        if later:
            df = settle(df, later)
    return df.select(*[place[c].alias(c) if c in place else F.col(c) for c in wanted])
