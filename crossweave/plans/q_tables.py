"""Queries: whole factor tables of one source, built in one pass, and their normalised form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import cross_section as X
from ..operators import factor_plan as FP
from ..operators import fundamental as FU
from ..operators import ic as I
from ..operators import moneyflow as MF
from ..operators import price_volume as PV
from ..operators.joins import interval_join
from ..sources.datasets import materialize
from . import q_price_volume  # noqa: F401  (the queries whose SQL the tables lay side by side)
from .q_cross_section import winsor_sql, z_sql
from .q_fundamental import RKEYS
from .q_ic import _PRE, _SCR, _VAL, _VAL_COLS
from .q_joins import PIT
from .q_moneyflow import KEYS, flows
from .registry import REGISTRY, query
from .sqltext import BY


def joined_sql(names: list[str], keys: list[str]) -> tuple[str, list[str], set[str]]:
    """Column queries laid side by side on their key: the text, its columns, and the tables it needs."""
    text, columns, needs = "", [], set()
    for i, name in enumerate(names):
        q = REGISTRY[name]
        body = q.sql.strip()
        if q.recursive:
            body = "WITH RECURSIVE" + body.removeprefix("WITH")
        text += f"({body}) t{i}" if not i else f" JOIN ({body}) t{i} USING ({', '.join(keys)})"
        columns += q.doubles
        needs |= set(q.needs)
    return f"SELECT {', '.join([*keys, *columns])} FROM {text}", columns, needs


_FLOW = [
    "net_flow_ratios", "flow_windows", "flow_momentum", "price_flow_divergence", "flow_ema", "flow_streak", "flow_amount_ratio", "size_class_ratios",
    "flow_structure", "flow_dispersion", "total_flow_ratios", "flow_pressure",
]
_FLOW_SQL, _FLOW_COLS, _FLOW_NEEDS = joined_sql(_FLOW, KEYS)


def flow_table(m):
    """All money-flow factors: windows of one exchange by instrument."""
    df = MF.size_ratios(flows(m))
    for add in (
        MF.flow_windows, MF.flow_momentum, MF.price_flow_divergence, MF.flow_streak, MF.flow_amount_ratio, MF.structure_windows, MF.flow_dispersion,
        MF.total_flow_ratios, MF.pressure, MF.flow_ema,
    ):
        df = add(df)
    return df.select(*KEYS, *_FLOW_COLS)


@query("moneyflow_factor_table", "F1 F2 F3 F4 F5 F6 F7 F8 F9 F10 F11 F12", needs=" ".join(sorted(_FLOW_NEEDS)), doubles=" ".join(_FLOW_COLS), sql=_FLOW_SQL)
def _(m):
    return flow_table(m)


#: flags and counts are not normalised
_CONTINUOUS = [c for c in _FLOW_COLS if c not in ("price_mf_divergence", "main_net_consecutive")]
_R6 = ", ".join(f"round({c} + 3.71728349e-9, 6) AS {c}" for c in _CONTINUOUS)
_PROCESSED = z_sql(winsor_sql(f"SELECT trade_date, ts_code, {_R6} FROM ({_FLOW_SQL})", _CONTINUOUS), _CONTINUOUS)


@query(
    "processed_moneyflow_factors", "X3", needs=" ".join(sorted(_FLOW_NEEDS)), doubles=" ".join(f"{c}_cc_processed" for c in _CONTINUOUS), digits=4,
    sql=f"SELECT trade_date, ts_code, {', '.join(f'{c} AS {c}_cc_processed' for c in _CONTINUOUS)} FROM ({_PROCESSED})",
)
def _(m):
    table = flow_table(m).select(*KEYS, *[rounded(F.col(c) + 3.71728349e-9, 6).alias(c) for c in _CONTINUOUS])
    return X.process_factors(table, _CONTINUOUS, group_rows=m.names).select(*KEYS, *[f"{c}_cc_processed" for c in _CONTINUOUS])


_REPORT = ["quarterly_changes", "quality_ratios", "report_stability", "yearly_changes", "balance_ratios"]
_REPORT_SQL, _REPORT_COLS, _REPORT_NEEDS = joined_sql(_REPORT, RKEYS)


@query("fundamental_factor_table", "G2 G3 G4 G5 G6", needs=" ".join(sorted(_REPORT_NEEDS)), doubles=" ".join(_REPORT_COLS), sql=_REPORT_SQL, digits=5)
def _(m):
    df = m.reports()
    for add in (FU.quarterly_changes, FU.quality_ratios, FU.stability, FU.yearly_changes, FU.balance_ratios):
        df = add(df)
    return df.select(*RKEYS, *_REPORT_COLS)


# ---------------------------------------------------------------- tables from the factor plan

_BARS = [
    "skip_month_momentum", "year_high_distance", "relative_strength_index", "williams_percent_range", "macd_lines", "up_down_streaks", "on_balance_volume",
    "volume_price_trend", "volume_momentum", "amihud_illiquidity", "volume_volatility", "downside_volatility", "rolling_drawdown", "bollinger_bands",
    "average_true_range", "price_position", "return_skew_kurtosis", "kdj_oscillator", "commodity_channel_index", "up_down_volume_ratio", "volume_price_divergence",
    "factor_interactions", "value_ratios", "industry_ranks", "industry_momentum", "industry_concentration", "flow_momentum", "price_flow_divergence", "flow_ema",
    "flow_streak", "flow_amount_ratio", "size_class_ratios", "flow_structure", "flow_dispersion", "total_flow_ratios", "flow_pressure",
]
_FILED = [
    "quarterly_changes", "strength_score", "quality_ratios", "report_stability", "yearly_changes", "balance_ratios", "growth_factors", "sentiment_proxies",
    "earnings_quality_composite",
]
_BARS_SQL, _BARS_COLS, _BARS_NEEDS = joined_sql(_BARS, KEYS)
_FILED_SQL, _FILED_COLS, _FILED_NEEDS = joined_sql(_FILED, RKEYS)
ENHANCED = [*_BARS_COLS, *_FILED_COLS]
#: columns whose queries compare fewer digits than six
_COARSE = {c: REGISTRY[n].digits for n in [*_BARS, *_FILED] for c in REGISTRY[n].doubles if REGISTRY[n].digits < 6}
ENHANCED_NEEDS = " ".join(sorted(_BARS_NEEDS | _FILED_NEEDS | {"bars"}))
#: compounded growth reaches sizes where engines differ beyond the decimals
_LARGE = ("industry_momentum_20", "relative_momentum_20")


def _coarse_sql(c: str) -> str:
    rounded = f"round({c} + {0.371728349 * 10.0 ** -(_COARSE[c] + 2)!r}, {_COARSE[c]})"
    return f"CASE WHEN abs({c}) < 1000000 THEN {rounded} ELSE round({c} / 1000) * 1000 END AS {c}" if c in _LARGE else f"{rounded} AS {c}"


def coarse(c: str) -> Column:
    near = rounded(F.col(c) + 0.371728349 * 10.0 ** -(_COARSE[c] + 2), _COARSE[c])
    return F.when(F.abs(c) < 1_000_000, near).otherwise(F.round(F.col(c) / 1000) * 1000) if c in _LARGE else near


ENHANCED_SQL = f"""SELECT b.trade_date, b.ts_code, {', '.join(_coarse_sql(c) if c in _COARSE else c for c in ENHANCED)}
  FROM ({_BARS_SQL}) b ASOF LEFT JOIN (SELECT f.*, r.ann_date FROM ({_FILED_SQL}) f JOIN {PIT} r USING (ts_code, end_date)) q
  ON b.ts_code = q.ts_code AND b.trade_date >= q.ann_date"""


def enhanced_table(m, wanted=ENHANCED):
    df = FP.factor_table(m.bars(), list(wanted), m.moneyflow(), m.reports(), m.industry_members(), m.names)
    return df.withColumns({c: coarse(c) for c in _COARSE if c in df.columns})


@query("enhanced_factor_table", "W7 W11 W26 F5 F13 G7 G8 G9 G10 G11 X6 X7 X8 X9", needs=ENHANCED_NEEDS, doubles=" ".join(ENHANCED), sql=ENHANCED_SQL)
def _(m):
    return enhanced_table(m)


_IND = REGISTRY["industry_relative_factors"]


@query("industry_factor_table", "X5", needs=" ".join(_IND.needs), doubles=" ".join(_IND.doubles), sql=_IND.sql)
def _(m):
    return FP.factor_table(m.bars(), list(_IND.doubles), None, m.reports(), m.industry_members(), m.names)


# ---------------------------------------------------------------- normalised and validated factor lists

#: flags, streaks and scores of few values are validated but not normalised
_COUNTED = ("momentum_52w_high_break", "consecutive_up_days", "consecutive_down_days", "price_mf_divergence", "main_net_consecutive", "f_profitability",
            "f_leverage_liquidity", "f_efficiency", "piotroski_f_score")
_SPREAD = [c for c in ENHANCED if c not in _COUNTED]
#: factors that are centred by industry before they are scaled
_CENTRED = ("ep_ratio", "bp_ratio", "sp_ratio", "cfp_ratio", "roic_level", "roe_yearly", "roa_yearly", "gross_profitability", "accruals_ratio", "debt_to_equity")
_digits = lambda c: _COARSE.get(c, 6)
_rounded = lambda c: f"round({c} + {0.371728349 * 10.0 ** -(_digits(c) + 2)!r}, {_digits(c)}) AS {c}"


def rounded_table(m, columns):
    """Factors as both engines see them: rounded, so that ranks and quantiles meet equal values."""
    df = enhanced_table(m, columns)
    nudge = lambda c: 0.371728349 * 10.0 ** -(_digits(c) + 2)
    return materialize(df.select(*KEYS, *[rounded(F.col(c) + nudge(c), _digits(c)).alias(c) for c in columns]), "factors")


def centred_sql(table: str) -> str:
    label = "SELECT t.*, g.l1_name FROM ({}) t LEFT JOIN members g ON g.ts_code = t.ts_code AND g.in_date <= t.trade_date AND (g.out_date IS NULL OR t.trade_date < g.out_date)"
    reps = ", ".join(f"CASE WHEN l1_name IS NOT NULL THEN {c} - avg({c}) OVER (PARTITION BY trade_date, l1_name) END AS {c}" for c in _CENTRED)
    return f"SELECT * REPLACE ({reps}) FROM ({label.format(table)})"


_NORMAL = f"SELECT trade_date, ts_code, {', '.join(_rounded(c) for c in _SPREAD)} FROM ({ENHANCED_SQL})"
_NORMAL = z_sql(centred_sql(winsor_sql(_NORMAL, _SPREAD)), _SPREAD)


@query(
    "processed_enhanced_factors", "X3 X4", needs=ENHANCED_NEEDS, doubles=" ".join(f"{c}_cc_processed" for c in _SPREAD), digits=3,
    sql=f"SELECT trade_date, ts_code, {', '.join(f'{c} AS {c}_cc_processed' for c in _SPREAD)} FROM ({_NORMAL})",
)
def _(m):
    df = interval_join(rounded_table(m, _SPREAD), m.industry_members(), ["l1_name"])
    return X.process_factors(df, _SPREAD, neutral=_CENTRED, group_rows=m.names).select(*KEYS, *[f"{c}_cc_processed" for c in _SPREAD])


_LABEL = f"SELECT trade_date, ts_code, round(lead(close) OVER ({BY}) / close - 1 + 3.71728349e-9, 6) AS label FROM bars"
_LISTED = f"""WITH wide AS MATERIALIZED (SELECT trade_date, ts_code, {', '.join(_rounded(c) for c in ENHANCED)} FROM ({ENHANCED_SQL})), lab AS MATERIALIZED ({_LABEL}),
  x AS MATERIALIZED (SELECT u.*, l.label FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (trade_date, ts_code)) INTO NAME feature VALUE score) u
    JOIN lab l ON l.trade_date = u.trade_date AND l.ts_code = u.ts_code WHERE l.label IS NOT NULL)"""


def listed(m):
    """All enhanced factors beside the next bar's return."""
    label = m.bars().select(*KEYS, F.round(PV.BY_STOCK.lead("close") / F.col("close") - 1 + 3.71728349e-9, 6).alias("label"))
    return rounded_table(m, ENHANCED).join(label, KEYS)


@query("factor_list_validation", "I8", needs=ENHANCED_NEEDS, doubles=_VAL_COLS, sql=_VAL.replace(_PRE, _LISTED), digits=4)
def _(m):
    return I.validate_features(listed(m), ENHANCED, topk=20, min_rows=5, group_rows=m.names, ic_digits=12)


@query("factor_list_screening", "I9", needs=ENHANCED_NEEDS, doubles="rank_ic rank_icir ic_positive_pct long_short top_group bottom_group", sql=_SCR.replace(_PRE, _LISTED), digits=4)
def _(m):
    return I.screen_factors(listed(m), ENHANCED, min_rows=5, group_rows=m.names, ic_digits=12)
