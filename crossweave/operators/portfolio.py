"""Selection, weights, turnover and cost tables. Nothing is carried from date to date.

Top-k selections use ``row_number() <= k``, which Spark applies inside each task before
the exchange, so a large cross-section sends at most ``k`` rows per task and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import safe_div
from ..functions.groups import order_position
from .aggregates import PERFORMANCE, performance

DATE = "trade_date"
GROUP_LIMIT = 1000  # largest k for which Spark drops rows before the exchange


def top_k(df: DataFrame, x: str, k: int, keys: Sequence[str] = (DATE,)) -> DataFrame:
    """Best ``k`` rows per group; ties go to the smaller code. NaN counts as missing; rows with a null key are a group.

    Beyond ``GROUP_LIMIT`` Spark would sort whole groups, so positions are counted by slices, in the same order.
    """
    if isinstance(df.schema[x].dataType, (T.DoubleType, T.FloatType)):
        df = df.where(~F.isnan(x))
    v = df.where(F.col(x).isNotNull())
    if k > GROUP_LIMIT:
        v = order_position(v, list(keys), [x, "ts_code"], "position", descending=[True, False])
    else:
        w = Window.partitionBy(*keys).orderBy(F.desc(x), F.asc("ts_code"))
        v = v.withColumn("position", F.row_number().over(w).cast("long"))
    return v.where(F.col("position") <= k)


def candidate_pool(
    alpha: DataFrame, status: DataFrame, holdings: DataFrame, pool_size: int, min_listed_days: int = 0,
    min_avg_amount: float = 0.0,
) -> DataFrame:
    """Best admissible names per date together with every current holding.

    A name without a status row passes; an unknown age or liquidity fails its test.
    """
    s = status.withColumn("_known", F.lit(True))
    df = alpha.where(F.col("alpha").isNotNull()).join(s, [DATE, "ts_code"], "left")
    no = F.lit(False)
    ok = (F.col("is_st") == 0) & (F.col("is_suspended") == 0)
    if min_listed_days > 0:
        ok = ok & F.coalesce(F.col("list_days") >= min_listed_days, no)
    if min_avg_amount > 0:
        ok = ok & F.coalesce(F.col("avg_amount_20d") >= min_avg_amount, no)
    passed = df.where(F.col("_known").isNull() | ok)
    best = top_k(passed, "alpha", pool_size).select(DATE, "ts_code")
    return best.union(holdings.where("weight > 0").select(DATE, "ts_code")).distinct()


def top_k_capped(df: DataFrame, x: str, k: int, cap: int, industry: str = "l1_name") -> DataFrame:
    """Best ``k`` per date with at most ``cap`` per industry, taken in score order."""
    v = df.withColumn("_ind", F.coalesce(industry, F.lit("unknown")))
    within = top_k(v, x, min(cap, k), (DATE, "_ind")).drop("position")
    return top_k(within, x, k).drop("_ind")


def industry_quotas(df: DataFrame, k: int, method: str = "equal", cap: int | None = None, industry: str = "l1_name") -> DataFrame:
    """Slots per date and industry. Only the counts (dates × industries) are ordered."""
    counts = df.groupBy(DATE, F.coalesce(industry, F.lit("unknown")).alias("industry")).agg(F.count("*").alias("n"))
    by_size = Window.partitionBy(DATE).orderBy(F.desc("n"), F.asc("industry"))
    whole = Window.partitionBy(DATE)
    c = counts.withColumn("_rank", F.row_number().over(by_size))
    if method == "equal":
        c = c.withColumn("_m", F.count(F.lit(1)).over(whole))
        base = F.floor(F.lit(k) / F.col("_m"))
        extra = (F.col("_rank") <= (F.lit(k) % F.col("_m"))).cast("long")
        quota = F.least(base + extra, F.col("n"))
        c = c.withColumn("quota", quota)
    else:
        share = F.bround(F.lit(float(k)) * F.col("n") / F.sum("n").over(whole), 0).cast("long")
        c = c.withColumn("_a", F.least(F.greatest(F.lit(1), share), F.col("n")))
        so_far = by_size.rowsBetween(Window.unboundedPreceding, 0)
        taken = F.least(F.sum("_a").over(so_far), F.lit(k))
        c = c.withColumn("_cum", taken)
        before = F.coalesce(F.lag("_cum").over(by_size), F.lit(0))
        c = c.withColumn("_q", F.col("_cum") - before)
        c = c.withColumn("_left", F.lit(k) - F.max("_cum").over(whole))
        c = c.withColumn("_room", (F.col("_q") < F.col("n")).cast("int"))
        turn = F.sum("_room").over(so_far)
        add = ((F.col("_room") == 1) & (turn <= F.col("_left"))).cast("long")
        c = c.withColumn("quota", F.col("_q") + add)
    if cap is not None:
        c = c.withColumn("quota", F.least("quota", F.lit(cap)))
    return c.select(DATE, "industry", "n", F.col("quota").cast("long").alias("quota"))


def stratified_top_k(
    df: DataFrame, x: str, k: int, method: str = "equal", cap: int | None = None, industry: str = "l1_name"
) -> DataFrame:
    """Best names of each industry up to its quota."""
    v = df.where(F.col(x).isNotNull()).withColumn("industry", F.coalesce(industry, F.lit("unknown")))
    quotas = industry_quotas(v, k, method, cap, "industry").select(DATE, "industry", "quota")
    best = top_k(v, x, k, (DATE, "industry"))
    return best.join(quotas, [DATE, "industry"]).where(F.col("position") <= F.col("quota"))


# ---------------------------------------------------------------- weights
# Weight functions work on a selected portfolio, whose size per date is the caller's k.


def equal_weights(df: DataFrame, keys: Sequence[str] = (DATE,)) -> DataFrame:
    return df.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def score_weights(df: DataFrame, x: str, floor: float = 0.1, power: float = 1.0, keys: Sequence[str] = (DATE,)) -> DataFrame:
    """Min-max scaled scores, lifted off zero, raised and normalised; equal if all scores agree."""
    w = Window.partitionBy(*keys)
    s = F.coalesce(x, F.lit(0.5))
    df = df.withColumn("_s", s).withColumns({"_lo": F.min("_s").over(w), "_hi": F.max("_s").over(w)})
    scaled = safe_div(F.col("_s") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (1.0 - floor) + floor
    df = df.withColumn("_w", F.when(F.col("_hi") > F.col("_lo"), F.pow(scaled, F.lit(power))).otherwise(1.0))
    return df.withColumn("weight", F.col("_w") / F.sum("_w").over(w)).drop("_s", "_lo", "_hi", "_w")


def inverse_vol_weights(df: DataFrame, vol: str, power: float = 1.0, keys: Sequence[str] = (DATE,)) -> DataFrame:
    """Weights falling with volatility; an unusable one takes the date's median."""
    w = Window.partitionBy(*keys)
    good = F.when(F.col(vol) > 0, F.col(vol))
    df = df.withColumn("_v", good)
    df = df.withColumn("_v", F.coalesce("_v", F.percentile("_v", F.lit(0.5)).over(w)))
    df = df.withColumn("_w", F.coalesce(1.0 / F.pow("_v", F.lit(power)), F.lit(1.0)))
    return df.withColumn("weight", F.col("_w") / F.sum("_w").over(w)).drop("_v", "_w")


def board_lot_weights(df: DataFrame, price: str = "open", lot: int = 100, reference_value: float = 1e7) -> DataFrame:
    """Weights after rounding down to whole lots at a reference portfolio value."""
    usable = (F.col(price) > 0) & (F.col("weight") > 0)
    shares = F.floor(F.col("weight") * reference_value / F.col(price) / lot) * lot
    out = df.where(usable).withColumn("lot_weight", shares * F.col(price) / reference_value)
    return out.where(F.col("lot_weight") > 1e-8)


def alpha_tilt_weights(
    df: DataFrame, alpha: str, base: str, tilt: float = 0.3, cap: float = 0.05, tiny: float = 1e-4, keys: Sequence[str] = (DATE,)
) -> DataFrame:
    """Base weights blended with capped alpha weights; tiny positions removed."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_a", F.greatest(F.coalesce(alpha, F.lit(0.0)), F.lit(0.0)))
    df = df.withColumns({"_sum": F.sum("_a").over(w), "_n": F.count(F.lit(1)).over(w)})
    raw = F.when(F.col("_sum") > 0, safe_div("_a", "_sum")).otherwise(1.0 / F.col("_n"))
    df = df.withColumn("_c", F.least(raw, F.lit(cap)))
    df = df.withColumn("_c", F.col("_c") / F.sum("_c").over(w))
    df = df.withColumn("_m", (1.0 - tilt) * F.col(base) + tilt * F.col("_c"))
    df = df.withColumn("_m", F.col("_m") / F.sum("_m").over(w))
    df = df.withColumn("_m", F.when(F.col("_m") < tiny, 0.0).otherwise(F.col("_m")))
    total = F.sum("_m").over(w)
    return df.withColumn("weight", F.when(total > 0, F.col("_m") / total).otherwise(F.col("_m"))).drop(
        "_a", "_sum", "_n", "_c", "_m"
    )


# ---------------------------------------------------------------- changes between dates


def weight_changes(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Previous and current weight per date and name.

    Each row is laid out twice, once for its own date and once for the next report date,
    and summed per name: one exchange, no self-join. ``w0`` of the first date is zero.
    """
    keys = list(keys)
    dates = weights.select(*keys, DATE).distinct()
    w = Window.partitionBy(*keys).orderBy(DATE)
    dates = dates.withColumn("_next", F.lead(DATE).over(w))
    rows = weights.select(*keys, DATE, "ts_code", "weight").join(dates, [*keys, DATE])
    sides = F.array(
        F.struct(F.col(DATE).alias("d"), F.lit(0.0).alias("w0"), F.col("weight").alias("w1")),
        F.struct(F.col("_next").alias("d"), F.col("weight").alias("w0"), F.lit(0.0).alias("w1")),
    )
    laid = rows.select(*keys, "ts_code", F.explode(sides).alias("_s"))
    laid = laid.select(*keys, "ts_code", F.col("_s.d").alias(DATE), F.col("_s.w0").alias("w0"), F.col("_s.w1").alias("w1"))
    return laid.where(F.col(DATE).isNotNull()).groupBy(*keys, DATE, "ts_code").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))


def turnover(changes: DataFrame, keys: Sequence[str] = (), half: bool = False) -> DataFrame:
    total = F.sum(F.abs(F.col("w1") - F.col("w0")))
    return changes.groupBy(*keys, DATE).agg((total * (0.5 if half else 1.0)).alias("turnover"))


def trade_list(changes: DataFrame) -> DataFrame:
    return changes.select(
        DATE, "ts_code", F.col("w0").alias("current_weight"), F.col("w1").alias("target_weight"),
        (F.col("w1") - F.col("w0")).alias("trade_weight"),
    )


def split_return(changes: DataFrame, returns: DataFrame) -> DataFrame:
    """Day return by what is kept (full day), bought (intraday) and sold (overnight)."""
    df = changes.join(returns.select(DATE, "ts_code", "gap_ret", "intraday_ret"), [DATE, "ts_code"])
    full = (1.0 + F.col("gap_ret")) * (1.0 + F.col("intraday_ret")) - 1.0
    hold = F.least("w0", "w1") * full
    buy = F.greatest(F.col("w1") - F.col("w0"), F.lit(0.0)) * F.col("intraday_ret")
    sell = F.greatest(F.col("w0") - F.col("w1"), F.lit(0.0)) * F.col("gap_ret")
    g = df.groupBy(DATE).agg(F.sum(hold).alias("hold_ret"), F.sum(buy).alias("buy_ret"), F.sum(sell).alias("sell_ret"))
    return g.withColumn("day_ret", F.col("hold_ret") + F.col("buy_ret") + F.col("sell_ret"))


def trading_cost(changes: DataFrame, buy_rate: float, sell_rate: float, slippage: float) -> DataFrame:
    d = F.col("w1") - F.col("w0")
    g = changes.groupBy(DATE).agg(
        F.sum(F.greatest(d, F.lit(0.0))).alias("buy_amount"), F.sum(F.greatest(-d, F.lit(0.0))).alias("sell_amount")
    )
    return g.withColumns(
        {
            "fee": F.col("buy_amount") * buy_rate + F.col("sell_amount") * sell_rate,
            "slippage_cost": (F.col("buy_amount") + F.col("sell_amount")) * slippage,
        }
    ).withColumn("cost", F.col("fee") + F.col("slippage_cost"))


# ---------------------------------------------------------------- reports


def benchmark_returns(dates: DataFrame, bench: DataFrame, market: DataFrame) -> DataFrame:
    """Benchmark return per date, the market mean where the table has none."""
    df = dates.join(bench, DATE, "left").join(market, DATE, "left")
    return df.select(DATE, F.coalesce("r", "mkt_ret").alias("benchmark_ret"))


def top_k_report(
    pred: DataFrame, topk: int, cost_rate: float = 0.0, account: float = 1.0, score: str = "score", label: str = "label",
    keys: Sequence[str] = (), limit_col: str | None = None,
) -> DataFrame:
    """Equal-weight best-k portfolio per date: returns, benchmark, turnover, cost, account.

    With ``limit_col`` the rows carry their own ``k`` (at most ``topk``), one portfolio per ``keys``.
    """
    keys = list(keys)
    best = top_k(pred, score, topk, [*keys, DATE])
    if limit_col:
        best = best.where(F.col("position") <= F.col(limit_col))
    held = equal_weights(best.where(F.col(label).isNotNull()), [*keys, DATE])
    gross = held.groupBy(*keys, DATE).agg(F.avg(label).alias("gross_return"), F.count("*").alias("holdings_count"))
    bench = pred.groupBy(*keys, DATE).agg(F.avg(label).alias("benchmark"))
    t = turnover(weight_changes(held, keys), keys)
    df = gross.join(t, [*keys, DATE]).join(bench, [*keys, DATE])
    df = df.withColumn("cost", F.col("turnover") * cost_rate)
    df = df.withColumn("return", F.col("gross_return") - F.col("cost"))
    df = df.withColumn("excess_return", F.col("return") - F.col("benchmark"))
    w = Window.partitionBy(*keys).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("account_value", account * F.product(1 + F.col("return")).over(w))


def parameter_sweep(pred: DataFrame, grid: Sequence[dict], cost_rate: Column | float = 0.0) -> DataFrame:
    """The report's metrics for every parameter row (``topk`` and what ``cost_rate`` is made of).

    The grid is a generator column: all parameter rows share one selection, one turnover
    and one metrics pass.
    """
    from .joins import with_grid

    names = list(grid[0])
    largest = max(r["topk"] for r in grid)
    # the best rows for the widest portfolio serve every narrower one
    best = top_k(pred, "score", largest)
    rows = with_grid(best, grid).where(F.col("position") <= F.col("topk"))
    held = equal_weights(rows.where(F.col("label").isNotNull()), [*names, DATE])
    gross = held.groupBy(*names, DATE).agg(F.avg("label").alias("gross_return"))
    df = gross.join(turnover(weight_changes(held, names), names), [*names, DATE])
    df = df.withColumn("ret", F.col("gross_return") - F.col("turnover") * cost_rate)
    return performance(df, "ret", names).select(*names, "n", *PERFORMANCE)


def leaderboard(metrics: DataFrame, by: str = "sharpe", n: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    """Best parameter rows; the limit is the report's length."""
    return metrics.orderBy(F.desc_nulls_last(by), *[F.asc(t) for t in tie]).limit(n)


def portfolio_diagnostics(weights: DataFrame, changes: DataFrame, exposures: DataFrame, styles: Sequence[str], pool_size: int) -> DataFrame:
    """Per date: turnover, alpha kept against the equal-weight pool, concentration, industries, style exposures.

    ``weights`` has alpha, weight and l1_name; ``exposures`` the style columns.
    """
    df = weights.join(exposures.select(DATE, "ts_code", *styles), [DATE, "ts_code"], "left")
    held = F.col("weight") > 1e-6
    raw = top_k(weights, "alpha", pool_size).groupBy(DATE).agg(F.avg("alpha").alias("_raw"))
    g = df.groupBy(DATE).agg(
        F.sum(F.col("alpha") * F.col("weight")).alias("expected_alpha"),
        F.max("weight").alias("max_weight"),
        F.sum(held.cast("int")).alias("n_holdings"),
        F.size(F.collect_set(F.when(held, F.col("l1_name")))).cast("long").alias("n_industries"),
        *[F.sum(F.col("weight") * F.coalesce(s, F.lit(0.0))).alias(f"style_{s}") for s in styles],
    )
    g = g.join(raw, DATE, "left").join(turnover(changes, half=True), DATE, "left")
    keep = F.when(F.col("_raw") != 0, safe_div("expected_alpha", "_raw")).otherwise(0.0)
    return g.withColumn("alpha_retention", keep).drop("_raw")
