"""Money-flow factors. Input: flows joined with the bar's traded amount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stages as S
from ..functions.columns import row_mean, safe_div
from ..functions.stages import staged
from .smoothing import exponential, span_alpha

AMOUNT_SCALE = 0.1  # amounts are in thousands, flows in ten-thousands


def with_amount(flows: DataFrame, bars: DataFrame) -> DataFrame:
    extra = [c for c in ("amount", "close", "pct_chg", "vol") if c in bars.columns]
    return flows.join(bars.select("trade_date", "ts_code", *extra), ["trade_date", "ts_code"], "left")


def net_flows(df: DataFrame) -> DataFrame:
    """Net inflow by size class and its ratio to the traded amount."""
    df = df.withColumns(
        {
            "lg_net_inflow": F.col("buy_lg_amount") - F.col("sell_lg_amount"),
            "elg_net_inflow": F.col("buy_elg_amount") - F.col("sell_elg_amount"),
            "retail_net_inflow": F.col("buy_sm_amount") - F.col("sell_sm_amount"),
        }
    )
    df = df.withColumn("main_net_inflow", F.col("lg_net_inflow") + F.col("elg_net_inflow"))
    base = F.col("amount") * AMOUNT_SCALE
    df = df.withColumns(
        {"main_net_ratio": safe_div("main_net_inflow", base), "retail_ratio": safe_div("retail_net_inflow", base)}
    )
    return df.withColumn("main_retail_diff", F.col("main_net_ratio") - F.col("retail_ratio"))


@staged
def flow_windows():
    """Rolling sums and means of the main net inflow."""
    found = yield [*[S.total("main_net_inflow", n) for n in (5, 10, 20)], *[S.mean("main_net_inflow", n) for n in (5, 20)]]
    out = dict(zip(("main_net_5", "main_net_10", "main_net_20", "mf_ma5", "mf_ma20"), found))
    return {**out, "mf_acceleration": found[0] - found[2]}


@staged
def flow_momentum():
    """Five-row mean against the 20-row mean, and against the 15 rows before it."""
    m5, m20, prior = yield [S.mean("main_net_ratio", 5, 3), S.mean("main_net_ratio", 20, 10), S.mean("main_net_ratio", 15, 8, back=5, in_order=True)]
    return {"main_net_momentum_5d": m5 - m20, "main_net_trend_20d": safe_div(m5 - prior, F.abs(prior))}


@staged
def price_flow_divergence():
    """1 if price fell while flow rose, -1 for the opposite, 0 otherwise."""
    close, ratio, m5 = yield [S.lag("close", 5), S.lag("main_net_ratio", 5), S.mean("main_net_ratio", 5, 3)]
    ret, change = safe_div("close", close) - 1, m5 - ratio
    value = F.when((ret < 0) & (change > 0), 1.0).when((ret > 0) & (change < 0), -1.0).otherwise(0.0)
    return {"price_mf_divergence": F.when(ret.isNotNull() & change.isNotNull(), value)}


@staged
def flow_ema(span: int = 20):
    """Exponential mean of the main net inflow and its slope."""
    (ema,) = yield [exponential("main_net_inflow", span_alpha(span), 10, ["main_net_inflow"])]
    (before,) = yield [S.lag(ema, 19)]
    return {"main_net_ema_20": ema, "main_net_ema_slope_20": (ema - before) / 19.0}


@staged
def flow_streak():
    (run,) = yield from S.streaks([F.coalesce(F.col("main_net_inflow") > 0, F.lit(False))])
    return {"main_net_consecutive": run}


@staged
def flow_amount_ratio():
    (value,) = yield [S.mean("main_net_ratio", 20, 10)]
    return {"main_net_amount_ratio_20": value}


def size_ratios(df: DataFrame) -> DataFrame:
    """Net ratio of every size class; retail is small and medium together."""
    base = F.col("amount") / 10.0
    net = {s: F.col(f"buy_{s}_amount") - F.col(f"sell_{s}_amount") for s in ("lg", "elg", "sm", "md")}
    out = {f"{s}_net_ratio": safe_div(v, base) for s, v in net.items()}
    retail = F.col("buy_sm_amount") + F.col("buy_md_amount") - F.col("sell_sm_amount") - F.col("sell_md_amount")
    out["retail_net_ratio"] = safe_div(retail, base)
    return df.withColumns(out)


@staged
def structure_windows():
    """Rolling spreads between size classes; needs the main and the size ratios."""
    names = ("main_net_ratio", "retail_net_ratio", "lg_net_ratio", "elg_net_ratio")
    main, retail, lg, elg, strength = yield [*[S.mean(c, 20, 10) for c in names], S.mean(F.abs("main_net_ratio"), 5, 3)]
    return {"main_retail_ratio_20": main - retail, "lg_elg_ratio_20": lg - elg, "moneyflow_strength_5": strength}


@staged
def flow_dispersion():
    parts = yield [S.std(f"{s}_net_ratio", 20, 10) for s in ("sm", "md", "lg", "elg")]
    return {"moneyflow_dispersion_20": row_mean(parts)}


def total_flow_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "net_mf_amount_ratio": safe_div("net_mf_amount", "amount"),
            "net_mf_vol_ratio": safe_div("net_mf_vol", F.col("buy_sm_vol") + F.col("sell_sm_vol")),
        }
    )


@staged
def pressure():
    """Rolling share of large buys and sells in the amount."""
    base = F.col("amount") / 10.0
    shares = [safe_div(F.col(f"{side}_lg_amount") + F.col(f"{side}_elg_amount"), base) for side in ("buy", "sell")]
    buy, sell = yield [S.mean(x, 5, 3) for x in shares]
    return {"buy_pressure_5": buy, "sell_pressure_5": sell}
