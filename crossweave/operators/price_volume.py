"""Price, volume and technical factors, one value per bar.

Input: bars keyed (trade_date, ts_code). All functions add columns and share one
exchange by instrument. Those marked ``staged`` can also be run together (``functions.stages``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stages as S
from ..functions.columns import safe_div
from ..functions.rolling import Series
from ..functions.stages import staged

BY_STOCK = Series()


def _change(x, before):
    return safe_div(x, before) - 1


@staged
def returns(horizons=(5, 10, 20, 60)):
    before = yield [S.lag("close", n) for n in horizons]
    return {f"ret_{n}": _change("close", b) for n, b in zip(horizons, before)}


def ma_bias(bars: DataFrame, windows=(5, 10, 20, 60)) -> DataFrame:
    return bars.withColumns({f"ma{n}_bias": safe_div("close", BY_STOCK.mean("close", n)) - 1 for n in windows})


def volatility(bars: DataFrame, windows=(5, 20, 60)) -> DataFrame:
    return bars.withColumns({f"volatility_{n}": BY_STOCK.std("pct_chg", n) for n in windows})


def amplitude(bars: DataFrame, windows=(5, 20)) -> DataFrame:
    df = bars.withColumn("amplitude", safe_div(F.col("high") - F.col("low"), "close"))
    return df.withColumns({f"amplitude_{n}": BY_STOCK.mean("amplitude", n) for n in windows})


def volume_ratio(bars: DataFrame, windows=(5, 20)) -> DataFrame:
    return bars.withColumns({f"vol_ratio_{n}": safe_div("vol", BY_STOCK.mean("vol", n)) for n in windows})


def price_volume_corr(bars: DataFrame, windows=(5, 20)) -> DataFrame:
    return bars.withColumns({f"corr_price_vol_{n}": BY_STOCK.corr("close", "vol", n) for n in windows})


def price_volume_factors(bars: DataFrame) -> DataFrame:
    """The whole price-volume group (18 factors)."""
    df = returns(bars)
    for step in (ma_bias, volatility, amplitude, volume_ratio, price_volume_corr):
        df = step(df)
    return df


PRICE_VOLUME = (
    [f"ret_{n}" for n in (5, 10, 20, 60)]
    + [f"ma{n}_bias" for n in (5, 10, 20, 60)]
    + [f"volatility_{n}" for n in (5, 20, 60)]
    + ["amplitude", "amplitude_5", "amplitude_20", "vol_ratio_5", "vol_ratio_20"]
    + ["corr_price_vol_5", "corr_price_vol_20"]
)


@staged
def skip_momentum():
    """Year and half-year momentum without the latest month / two weeks."""
    year, month, half, weeks = yield [S.lag("close", n) for n in (252, 22, 126, 10)]

    def skip(long, short):
        return safe_div(1 + _change("close", long), 1 + _change("close", short)) - 1

    return {"momentum_12m_skip1m": skip(year, month), "momentum_6m_skip2w": skip(half, weeks)}


@staged
def high_52w():
    """Distance to the rolling year high and a flag for closes within 2 % of it."""
    (top,) = yield [S.highest("close", 252, 126)]
    return {"momentum_52w_high_dist": 1 - safe_div("close", top), "momentum_52w_high_break": (F.col("close") >= top * 0.98).cast("double")}


@staged
def rsi(n: int = 14, m: int = 10):
    r = F.col("pct_chg") / 100.0
    up, down = (F.when(r.isNotNull(), F.greatest(x, F.lit(0.0))) for x in (r, -r))
    gain, loss = yield [S.mean(up, n, m), S.mean(down, n, m)]
    return {f"rsi_{n}": F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + safe_div(gain, loss)))}


@staged
def williams_r(n: int = 14, m: int = 10):
    top, low = yield [S.highest("high", n, m), S.lowest("low", n, m)]
    return {f"williams_r_{n}": safe_div(-100 * (top - F.col("close")), top - low)}


@staged
def up_down_streaks():
    conditions = [F.coalesce(c, F.lit(False)) for c in (F.col("pct_chg") > 0, F.col("pct_chg") < 0)]
    up, down = yield from S.streaks(conditions)
    return {"consecutive_up_days": up, "consecutive_down_days": down}


@staged
def on_balance_volume():
    (before,) = yield [S.lag("close")]
    move = F.coalesce(F.col("close") - before, F.lit(0.0))
    signed = F.signum(move) * F.col("vol")
    (so_far,) = yield [S.running(F.sum(signed))]
    obv = F.when(signed.isNotNull(), so_far)
    (ma,) = yield [S.mean(obv, 5, 3)]
    return {"obv": obv, "obv_ma5_ratio": safe_div(obv, ma)}


@staged
def volume_price_trend():
    x = F.col("vol") * (F.col("pct_chg") / 100.0)
    (so_far,) = yield [S.running(F.sum(x))]
    return {"volume_price_trend": F.when(x.isNotNull(), so_far)}


@staged
def volume_momentum():
    short, long = yield [S.mean("vol", 5, 3), S.mean("vol", 20, 10)]
    return {"volume_momentum": safe_div(short, long)}


@staged
def amihud(n: int = 20, m: int = 10):
    (value,) = yield [S.mean(safe_div(F.abs(F.col("pct_chg") / 100.0), "amount"), n, m)]
    return {f"amihud_{n}": value}


@staged
def turnover_volatility(n: int = 20, m: int = 10):
    (value,) = yield [S.std("vol", n, m)]
    return {f"turnover_vol_{n}": value}


@staged
def downside_volatility(n: int = 20, m: int = 10):
    r = F.col("pct_chg") / 100.0
    (value,) = yield [S.std(F.when(r < 0, r).otherwise(0.0), n, m)]
    return {f"downside_vol_{n}": value}


@staged
def rolling_drawdown(n: int = 60, m: int = 30):
    (top,) = yield [S.highest("close", n, m)]
    return {f"max_drawdown_{n}": F.col("close") / top - 1}


@staged
def bollinger(n: int = 20, m: int = 10):
    mid, sd, top, bottom = yield [S.mean("close", n, m), S.std("close", n, m), S.highest("close", n, m), S.lowest("close", n, m)]
    # a flat window has no band; its float residue must not open one
    band = F.when(top == bottom, 0.0).otherwise(4.0 * sd)
    low = mid - 2.0 * sd
    return {
        f"bollinger_width_{n}": F.when(mid > 0, band / mid),
        f"bollinger_position_{n}": F.when(band > 0, (F.col("close") - low) / band).otherwise(0.5),
    }


@staged
def true_range_average(n: int = 14, m: int = 7):
    (pc,) = yield [S.lag("close")]
    # greatest skips nulls: the first bar falls back to high - low
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    (value,) = yield [S.mean(tr, n, m)]
    return {f"atr_{n}": value}


@staged
def price_position(windows=(20, 60)):
    bounds = yield [f for n in windows for f in (S.highest("high", n, n // 2), S.lowest("low", n, n // 2))]
    out = {}
    for n, top, low in zip(windows, bounds[::2], bounds[1::2]):
        out[f"price_position_{n}"] = F.when(top > low, (F.col("close") - low) / (top - low)).otherwise(0.5)
    return out


@staged
def return_shape():
    """Rolling skewness (20) and excess kurtosis (60) of returns."""
    r = F.col("pct_chg") / 100.0
    skew, kurtosis = yield [S.skew(r, 20, 10), S.kurtosis(r, 60, 30)]
    return {"ret_skew_20": skew, "ret_kurt_60": kurtosis}


@staged
def cci(n: int = 20, m: int = 10):
    """Commodity channel index. A mean of equal values can differ from them by float dust; equal values have no deviation."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    ma, md = yield [S.mean(tp, n, m), S.mean_deviation(tp, n)]
    return {f"cci_{n}": (tp - ma) / (0.015 * F.nullif(md, F.lit(0.0)))}


@staged
def up_down_volume(n: int = 20, m: int = 10):
    up, down = (F.when(c, F.col("vol")).otherwise(0.0) for c in (F.col("pct_chg") > 0, F.col("pct_chg") < 0))
    up, down = yield [S.total(up, n, m), S.total(down, n, m)]
    return {f"up_down_volume_ratio_{n}": F.when(down > 0, up / down).otherwise(1.0)}


@staged
def volume_price_divergence(n: int = 20, m: int = 10):
    (before,) = yield [S.lag("vol")]
    (value,) = yield [S.corr(F.col("pct_chg") / 100.0, _change("vol", before), n, m)]
    return {f"volume_price_divergence_{n}": value}


def average_amount(bars: DataFrame, n: int = 20, m: int = 10) -> DataFrame:
    return bars.withColumn(f"avg_amount_{n}d", BY_STOCK.mean("amount", n, m))


def sizing_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """Rolling deviation of close returns, for inverse-volatility weights."""
    df = bars.withColumn("_r", BY_STOCK.pct_change("close"))
    return df.withColumn("sizing_vol", BY_STOCK.std("_r", n, max(5, n // 2))).drop("_r")


def adjust_by_first_factor(bars: DataFrame, cols=("open", "close", "pre_close")) -> DataFrame:
    """Prices scaled by the factor relative to the first known one."""
    w = BY_STOCK.spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first("adj_factor", ignorenulls=True).over(w)
    ratio = safe_div("adj_factor", base)
    return bars.withColumn("_ratio", ratio).withColumns({c: F.col(c) * F.col("_ratio") for c in cols}).drop("_ratio")


def adjusted_close(bars: DataFrame) -> DataFrame:
    """Close scaled by the factor relative to the latest known one."""
    w = BY_STOCK.spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("adj_factor", ignorenulls=True).over(w)
    return bars.withColumn("adj_close", safe_div(F.col("close") * F.col("adj_factor"), last))


HORIZONS = (1, 2, 3, 5, 10, 20)


def forward_labels(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Forward returns of the adjusted close."""
    df = adjusted_close(bars)
    return df.withColumns({f"label_{h}d": safe_div(BY_STOCK.lead("adj_close", h), "adj_close") - 1 for h in horizons})


def realised_forward_vol(df: DataFrame, x: str, h: int, out: str = "realised_vol") -> DataFrame:
    """Root mean square of the next ``h`` values (today included); null where the panel ends before."""
    w = BY_STOCK.frame(0, h - 1)
    sq = F.col(x) * F.col(x)
    complete = F.count(F.lit(1)).over(w) == h
    enough = F.count(sq).over(w) >= max(h // 2, 5)
    return df.withColumn(out, F.when(complete & enough, F.sqrt(F.avg(sq).over(w))))


def interactions(df: DataFrame) -> DataFrame:
    """Momentum times volume ratio, and return on equity times revenue growth.

    Columns that are already there are used; a missing momentum or volume ratio is
    computed, and levels stand in for missing quarterly changes.
    """
    return S.together(df, [interaction_stages(df.columns)])


def interaction_stages(have):
    """``interactions`` of a table with the columns ``have``."""
    before, mean = yield [S.lag("close", 20), S.mean("vol", 20, 10)]
    momentum = F.col("ret_20") if "ret_20" in have else _change("close", before)
    ratio = F.col("vol_ratio_20") if "vol_ratio_20" in have else safe_div("vol", mean)
    out = {"momentum_volume_interaction": momentum * ratio}
    roe = next((c for c in ("roe_qoq_change", "roe") if c in have), None)
    yoy = next((c for c in ("revenue_yoy_acceleration", "revenue_yoy", "or_yoy") if c in have), None)
    out["roe_growth_interaction"] = F.col(roe) * F.col(yoy) if roe and yoy else F.lit(None).cast("double")
    return out
