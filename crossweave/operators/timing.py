"""Position sizes and calendars from date-level series.

All inputs hold one row per date, so an ordered window over the whole table is bounded
by the calendar.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_date, clip, safe_div
from ..functions.groups import group_stats, order_position

DATE = "trade_date"


def whole():
    """The series in date order."""
    return Window.orderBy(DATE)


def _day(c: str = DATE) -> Column:
    return F.datediff(as_date(c), F.lit("1970-01-01").cast("date"))


def curves(report: DataFrame, columns, account: float = 1.0) -> DataFrame:
    """Compounded curves of several return columns, starting at ``account``."""
    w = whole().rowsBetween(Window.unboundedPreceding, 0)
    return report.withColumns({f"{c}_curve": account * F.product(1 + F.coalesce(c, F.lit(0.0))).over(w) for c in columns})


def drawdown_interval(curve: DataFrame, value: str = "nav") -> DataFrame:
    """Depth, peak date and trough date of the deepest fall (first of equals)."""
    w = whole().rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.struct(F.col(value), -F.col(DATE))).over(w)
    df = curve.withColumn("_top", top)
    df = df.select(DATE, (F.col(value) / F.col("_top")[value] - 1).alias("depth"), (-F.col("_top").getField("col2")).alias("peak"))
    return df.agg(
        F.min("depth").alias("max_drawdown"),
        F.min_by("peak", F.struct("depth", DATE)).alias("peak_date"),
        F.min_by(DATE, F.struct("depth", DATE)).alias("trough_date"),
    )


def trend_position(
    bench: DataFrame, r: str, ma: int, lookback_days: int | None = None, high: float = 1.0, low: float = 0.5,
    band: float | None = None, floor: float = 0.0,
) -> DataFrame:
    """Position by yesterday's compounded market against its moving average.

    Only returns inside the calendar look-back count. With ``band`` the size moves linearly
    between ``low`` and ``high`` inside the band around the average.
    """
    days = lookback_days or 3 * ma
    known = bench.where(F.col(r).isNotNull()).withColumn("_d", _day())
    nav = F.product(1 + F.col(r)).over(whole().rowsBetween(Window.unboundedPreceding, 0))
    df = known.withColumn("_nav", nav)
    hist = F.collect_list("_nav").over(Window.orderBy("_d").rangeBetween(-days, -1))
    df = df.withColumn("_h", hist).withColumn("_n", F.size("_h"))
    df = df.withColumn("_win", F.slice("_h", F.greatest(F.lit(1), F.col("_n") - ma + 1), F.lit(ma)))
    mean = F.aggregate("_win", F.lit(0.0), lambda a, x: a + x) / F.size("_win")
    df = df.withColumns({"_ma": F.when(F.col("_n") > 0, mean), "_last": F.get("_h", F.col("_n") - 1)})
    enough = F.col("_n") >= max(5, ma // 2)
    if band is None:
        size = F.when(F.col("_last") > F.col("_ma"), high).otherwise(low)
    else:
        up, dn = F.col("_ma") * (1 + band), F.col("_ma") * (1 - band)
        mid = low + safe_div(F.col("_last") - dn, up - dn) * (high - low)
        size = (
            F.when(F.col("_last") >= up, high)
            .when(F.col("_last") <= dn, low)
            .otherwise(F.greatest(F.lit(floor), F.least(F.lit(high), mid)))
        )
    return df.select(DATE, F.when(enough, size).otherwise(high).cast("double").alias("position"))


def target_vol_position(
    bench: DataFrame, r: str, target: float, lookback: int, smooth: int, low: float = 0.0, high: float = 1.0,
    lookback_days: int | None = None,
) -> DataFrame:
    """Target over realised volatility, smoothed over the latest estimates and bounded."""
    days = lookback_days or 2 * lookback
    known = bench.where(F.col(r).isNotNull()).withColumn("_d", _day())
    past = Window.orderBy("_d").rangeBetween(-days, -1)
    enough = F.count(r).over(past) >= max(5, lookback // 2)
    df = known.withColumn("_vol", F.when(enough, F.stddev_samp(r).over(past)) * F.sqrt(F.lit(252.0)))
    valid = df.where(F.col("_vol") > 0)
    recent = whole().rowsBetween(-(min(smooth, lookback) - 1), 0)
    valid = valid.select(DATE, clip(safe_div(F.lit(target), F.avg("_vol").over(recent)), low, high).alias("_p"))
    return known.select(DATE).join(valid, DATE, "left").select(DATE, F.coalesce("_p", F.lit(high)).alias("position"))


def score_dispersion(
    scores: DataFrame, x: str, top: float, bottom: float, group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Mean of the best fraction less mean of the worst, per date."""
    v = scores.where(F.col(x).isNotNull())
    v = order_position(v, [DATE], [F.col(x), "ts_code"], "_p", group_rows, limit)
    v = group_stats(v, DATE, {"_n": F.count(F.lit(1))}, group_rows, limit)
    n_top = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(top)))
    n_bot = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(bottom)))
    return v.groupBy(DATE).agg(
        (
            F.avg(F.when(F.col("_p") > F.col("_n") - n_top, F.col(x))) - F.avg(F.when(F.col("_p") <= n_bot, F.col(x)))
        ).alias("dispersion")
    )


def _ramp(x: Column, lo: float, hi: float, low: float, high: float) -> Column:
    """Linear from ``low`` at ``lo`` to ``high`` at ``hi``, flat outside."""
    share = clip((x - lo) / (hi - lo), 0.0, 1.0)
    return F.when(x <= lo, F.lit(low)).when(x >= hi, F.lit(high)).otherwise(low + share * (high - low))


def dispersion_position(
    disp: DataFrame, smooth: int, lookback: int, low: float = 0.0, high: float = 1.0, bounds: tuple[float, float] = (0.0, 1.0),
    relative: bool = False,
) -> DataFrame:
    """Position by smoothed dispersion, absolute or as a percentile of its own history."""
    recent = whole().rowsBetween(-(min(smooth, lookback) - 1), 0)
    df = disp.withColumn("_s", F.avg("dispersion").over(recent))
    if not relative:
        return df.select(DATE, _ramp(F.col("_s"), *bounds, low, high).alias("position"))
    w = whole().rowsBetween(-(lookback - 1), 0)
    df = df.withColumn("_h", F.collect_list("dispersion").over(w))
    below = F.size(F.filter("_h", lambda v: v < F.col("_s"))) / F.size("_h")
    size = F.when(F.size("_h") >= max(10, lookback // 3), _ramp(below, *bounds, low, high)).otherwise(high)
    return df.select(DATE, size.cast("double").alias("position"))


def threshold_position(
    scores: DataFrame, x: str, fraction: float, threshold: float, low: float = 0.0, high: float = 1.0,
    group_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Mean of the best fraction, mapped from (threshold, 1) to (low, high)."""
    v = scores.where(F.col(x).isNotNull())
    v = order_position(v, [DATE], [-F.col(x), "ts_code"], "_p", group_rows, limit)
    v = group_stats(v, DATE, {"_n": F.count(F.lit(1))}, group_rows, limit)
    top = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction)))
    g = v.groupBy(DATE).agg(F.avg(F.when(F.col("_p") <= top, F.col(x))).alias("_m"))
    span = 1.0 - threshold
    if span <= 0:
        size = F.when(F.col("_m") <= threshold, low).otherwise(high)
    else:
        size = F.when(F.col("_m") <= threshold, low).otherwise(
            clip(low + clip((F.col("_m") - threshold) / span, 0.0, 1.0) * (high - low), low, high)
        )
    return g.select(DATE, size.cast("double").alias("position"))


def vol_regime_scale(bench: DataFrame, r: str, n: int, low_at: float, high_at: float, low_scale: float, high_scale: float) -> DataFrame:
    """Scale by the population deviation of the last ``n`` market returns; 1 until there are ``n``."""
    w = whole().rowsBetween(-(n - 1), 0)
    v = F.when(F.count(r).over(w) >= n, F.stddev_pop(r).over(w))
    scale = F.when(v < low_at, low_scale).when(v > high_at, high_scale).otherwise(1.0)
    return bench.where(F.col(r).isNotNull()).select(DATE, scale.cast("double").alias("scale"))


def ic_momentum_scale(
    ic: DataFrame, n: int, threshold: float, width: float, low: float, high: float, min_names: int = 10
) -> DataFrame:
    """Scale by the mean of the last ``n`` daily coefficients of dates with enough names."""
    usable = ic.where(F.col("count") >= min_names)
    w = whole().rowsBetween(-(n - 1), 0)
    mean = F.avg("ic").over(w)
    share = clip((mean - threshold) / width, 0.0, 1.0)
    ready = (F.count(F.lit(1)).over(w) >= n) & mean.isNotNull()
    return usable.select(DATE, F.when(ready, low + share * (high - low)).otherwise(1.0).alias("scale"))


# Words that name a rebalance schedule.
DAILY, WEEKLY, MONTHLY = {"day", "daily", "1d"}, {"week", "weekly", "1w", "w"}, {"month", "monthly", "1m", "m"}
EVERY, DAY_UNITS = ("every", "每"), {"d", "day", "days", "td", "tradeday", "tradedays", "tradingday", "tradingdays", "天", "个交易日"}


def schedule_step(word: str) -> int | None:
    """n of an every-n-dates schedule: a bare number, or a number with a day unit, after an optional word for every."""
    plain = re.sub(r"[_\s-]+", "", word)
    prefix = next((p for p in EVERY if plain.startswith(p)), "")
    rest = plain[len(prefix):]
    number = rest[: len(rest) - len(rest.lstrip("0123456789"))]
    unit = rest[len(number):]
    if not number or int(number) == 0 or unit not in DAY_UNITS and (unit or prefix):
        return None
    return int(number)


def rebalance_dates(dates: DataFrame, freq: str | int) -> DataFrame:
    """Dates of a schedule: every date, first of week or month, or every n-th date."""
    d = dates.select(DATE).distinct()
    word = str(freq).strip().lower()
    if word in WEEKLY or word in MONTHLY:
        unit = "week" if word in WEEKLY else "month"
        return d.groupBy(F.date_trunc(unit, as_date(DATE)).alias("_p")).agg(F.min(DATE).alias(DATE)).select(DATE)
    step = None if word in DAILY else schedule_step(word)
    if step:
        return d.withColumn("_i", F.row_number().over(whole())).where((F.col("_i") - 1) % step == 0).select(DATE)
    return d


def smooth_scores(scores: DataFrame, x: str, out: str, span: int) -> DataFrame:
    """Score of each name averaged exponentially over the dates it is scored on."""
    from .smoothing import ema

    return ema(scores.where(F.col(x).isNotNull()), x, out, span)


def realised_portfolio_vol(bench: DataFrame, r: str, n: int = 20, m: int = 10) -> DataFrame:
    """Deviation of the next ``n`` returns of a date-level series; null where it ends before."""
    w = whole().rowsBetween(0, n - 1)
    full = F.count(F.lit(1)).over(w) == n
    return bench.select(
        DATE, F.when(full & (F.count(r).over(w) >= max(2, m)), F.stddev_samp(r).over(w)).alias("realised_vol")
    )


