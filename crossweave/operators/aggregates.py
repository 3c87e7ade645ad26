"""Aggregations: daily series, coverage, distributions, performance metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_date, clip, safe_div
from ..functions.groups import group_quantiles, with_quantiles
from ..functions.rolling import pair_corr, unbiased_kurtosis, unbiased_skew
from ..sources.datasets import materialize


def suspend_daily(raw: DataFrame) -> DataFrame:
    """One flag per date and code; a stop outranks a resumption."""
    kind = F.upper(F.trim(F.col("suspend_type")))
    valid = raw.where(kind.isin("S", "R") & F.col("trade_date").isNotNull() & F.col("ts_code").isNotNull())
    return valid.groupBy("trade_date", "ts_code").agg(F.max((kind == "S").cast("int")).alias("is_suspect"))


def market_return(bars: DataFrame) -> DataFrame:
    """Equal-weight mean return per date."""
    return (
        bars.where(F.col("pct_chg").isNotNull())
        .groupBy("trade_date")
        .agg((F.avg("pct_chg") / 100.0).alias("mkt_ret"))
    )


def industry_return(bars: DataFrame, label: str = "l1_name") -> DataFrame:
    """Mean percent change per date and industry."""
    return bars.where(F.col(label).isNotNull()).groupBy("trade_date", label).agg(F.avg("pct_chg").alias("ind_ret"))


def listing_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ts_code").agg(F.min("trade_date").alias("list_date"))


def listed_days(bars: DataFrame) -> DataFrame:
    """Calendar days since first appearance, per bar."""
    first = F.min("trade_date").over(Window.partitionBy("ts_code"))
    return bars.withColumn("listed_days", F.datediff(as_date("trade_date"), as_date(first)))


def latest_value(df: DataFrame, value: str, by: str = "ts_code", date: str = "trade_date") -> DataFrame:
    """Value on the last date that has one, per key."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(by).agg(F.max_by(value, date).alias(value))


def first_value(df: DataFrame, value: str, by: str = "ts_code", date: str = "trade_date") -> DataFrame:
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(by).agg(F.min_by(value, date).alias(value))


def panel_counts(df: DataFrame) -> DataFrame:
    """Distinct codes and dates. Each column is reduced on its own, so no task sees a whole column."""
    codes = df.select("ts_code").distinct().agg(F.count("*").alias("stocks")).withColumn("_one", F.lit(0))
    dates = df.select("trade_date").distinct().agg(F.count("*").alias("dates")).withColumn("_one", F.lit(0))
    return codes.join(dates, "_one").drop("_one")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in null_figures(columns).items()])


def null_figures(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_nulls": F.sum(F.col(c).isNull().cast("int")) for c in columns}


def match_figures(columns: Sequence[str]) -> dict[str, Column]:
    """Rows, and how many of them found a partner in each joined source."""
    return {"rows": F.count(F.lit(1)), **{f"{c}_matched": F.count(c) for c in columns}}


def onehot_pivot(df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str], prefix: str) -> DataFrame:
    """0/1 column per category value; the values are given, so no extra pass is needed."""
    agg = [F.coalesce(F.max((F.col(category) == v).cast("int")), F.lit(0)).cast("tinyint").alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*keys).agg(*agg)


def categories(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(F.col(column)).alias(column)).where(F.col(column) != "").distinct().orderBy(column)


def match_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many panel rows found a partner in each joined source."""
    return df.agg(*[c.alias(n) for n, c in match_figures(columns).items()])


def global_winsorize(
    df: DataFrame, columns: Sequence[str], lo: float = 0.01, hi: float = 0.99,
    tiebreak: Sequence[str] = ("trade_date", "ts_code"), total_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Clip to quantiles of the whole batch. Each column's quantiles read the rows several times, so these are written once."""
    df = materialize(df, "batch")
    rows = df.count() if total_rows is None else total_rows
    for c in columns:
        df = with_quantiles(
            df, c, [], {"_lo": lo, "_hi": hi}, group_rows=rows, tiebreak=list(tiebreak), limit=limit
        )
        df = df.withColumn(c, clip(c, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return df


DESCRIBE_QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def describe_by(
    df: DataFrame, x: str, keys: Sequence[str], quantiles=None, group_rows: int | None = None,
    tiebreak: Sequence[str] = ("ts_code",), limit: int | None = None,
) -> DataFrame:
    """Count, moments, extremes and exact quantiles per group (no key: the whole table)."""
    quantiles = DESCRIBE_QUANTILES if quantiles is None else quantiles
    keys = list(keys)
    grouped_on = keys
    if not keys:
        df, grouped_on = df.withColumn("_all", F.lit(0)), ["_all"]
    moments = df.groupBy(*grouped_on).agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.when(F.count(x) > 1, F.stddev_samp(x)).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    q = group_quantiles(df, x, grouped_on, quantiles, list(tiebreak), group_rows, limit)
    out = moments.join(q, grouped_on, "left")
    return out if keys else out.drop("_all")


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """Equal-width, right-closed bins over the data range, the lowest edge widened by 0.1 %.

    The range is two numbers; empty bins are kept.
    """
    v = df.where(F.col(x).isNotNull()).select(x)
    rng = v.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"]
    if lo is None:
        return v.limit(0).select(F.lit(0).alias("bin"), F.lit(0.0).alias("left"), F.lit(0.0).alias("right"), F.lit(0).cast("long").alias("count"))
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi, extra = lo - pad, hi + pad, 0.0
    else:
        extra = 0.001 * (hi - lo)
    width = (hi - lo) / bins
    raw = F.ceil((F.col(x) - F.lit(lo)) / F.lit(width)).cast("int")
    idx = F.greatest(F.lit(1), F.least(F.lit(bins), raw))
    counts = v.groupBy(idx.alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    left = F.lit(lo) + (F.col("bin") - 1) * F.lit(width) - F.when(F.col("bin") == 1, F.lit(extra)).otherwise(0.0)
    return edges.join(counts, "bin", "left").select(
        "bin",
        left.alias("left"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("right"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def monthly_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    d = F.col("trade_date")
    return df.groupBy(F.floor(d / 10000).cast("int").alias("year"), F.floor(d / 100 % 100).cast("int").alias("month")).agg(
        *[F.avg(c).alias(c) for c in columns]
    )


# ---------------------------------------------------------------- return series
# A return series has one row per date (and per ``keys``), so its windows are bounded
# by the calendar.


def with_drawdown(series: DataFrame, x: str, keys: Sequence[str] = (), order: str = "trade_date") -> DataFrame:
    """Compounded value and its distance from the running peak."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = series.withColumn("nav", F.product(1 + F.col(x)).over(w))
    return df.withColumn("drawdown", F.col("nav") / F.max("nav").over(w) - 1)


def performance(series: DataFrame, x: str, keys: Sequence[str] = (), ann: float = 252.0, min_rows: int = 1) -> DataFrame:
    """Return, risk and shape metrics of a return series, one row per key."""
    keys = list(keys)
    df = with_drawdown(series.where(F.col(x).isNotNull()), x, keys)
    r = F.col(x)
    down = F.when(r < 0, r)
    n = F.count(x)
    aggs = [
        n.alias("n"),
        (F.max_by("nav", "trade_date") - 1).alias("total_return"),
        F.max_by("nav", "trade_date").alias("_nav"),
        F.when(n > 1, F.stddev_samp(x)).alias("_sd"),
        F.when(F.count(down) > 1, F.stddev_samp(down)).alias("_dsd"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(x).alias("mean_daily_return"),
        F.percentile(r, F.lit(0.5)).alias("median_daily_return"),
        F.max(x).alias("best_daily_return"),
        F.min(x).alias("worst_daily_return"),
        unbiased_skew(r).alias("skew"),
        unbiased_kurtosis(r).alias("kurtosis"),
    ]
    g = (df.groupBy(*keys) if keys else df).agg(*aggs).where(F.col("n") >= min_rows)
    vol = F.coalesce("_sd", F.lit(0.0)) * F.sqrt(F.lit(ann))
    dvol = F.coalesce("_dsd", F.lit(0.0)) * F.sqrt(F.lit(ann))
    growth = F.when(F.col("_nav") > 0, F.pow("_nav", F.lit(ann) / F.col("n")) - 1)
    g = g.withColumns({"annualized_return": growth, "annualized_volatility": vol})
    g = g.withColumns(
        {
            "sharpe": safe_div(F.col("mean_daily_return") * ann, vol),
            "sortino": safe_div(F.col("mean_daily_return") * ann, dvol),
            "calmar": F.when(F.col("max_drawdown") < 0, safe_div("annualized_return", F.abs("max_drawdown"))),
        }
    )
    return g.drop("_nav", "_sd", "_dsd")


PERFORMANCE = (
    "total_return annualized_return annualized_volatility sharpe sortino max_drawdown calmar win_rate "
    "mean_daily_return median_daily_return best_daily_return worst_daily_return skew kurtosis"
).split()


def relative_performance(series: DataFrame, x: str, bench: str, keys: Sequence[str] = (), ann: float = 252.0) -> DataFrame:
    """Metrics of a return series against a benchmark on their common dates."""
    keys = list(keys)
    df = series.where(F.col(x).isNotNull() & F.col(bench).isNotNull())
    ex = F.col(x) - F.col(bench)
    root = F.sqrt(F.lit(ann))
    aggs = [
        F.avg(x).alias("_mr"),
        F.avg(bench).alias("_mb"),
        F.avg(ex).alias("_me"),
        F.stddev_samp(x).alias("_sr"),
        F.stddev_samp(bench).alias("_sb"),
        F.stddev_samp(ex).alias("_se"),
        F.covar_samp(x, bench).alias("_cov"),
        F.var_samp(bench).alias("_vb"),
        (F.product(1 + F.col(x)) - F.product(1 + F.col(bench))).alias("excess_total_return"),
        pair_corr(x, bench).alias("correlation"),
    ]
    g = (df.groupBy(*keys) if keys else df).agg(*aggs)
    g = g.withColumn("beta", safe_div("_cov", "_vb"))
    g = g.withColumn("alpha_daily", F.col("_mr") - F.col("beta") * F.col("_mb"))
    return g.select(
        *keys,
        safe_div(F.col("_mr") * ann, F.col("_sr") * root).alias("sharpe"),
        safe_div(F.col("_mb") * ann, F.col("_sb") * root).alias("benchmark_sharpe"),
        (F.col("alpha_daily") * ann).alias("alpha"),
        "alpha_daily",
        "beta",
        "excess_total_return",
        (F.col("_me") * ann).alias("excess_annualized_return"),
        (F.col("_se") * root).alias("tracking_error"),
        safe_div(F.col("_me") * ann, F.col("_se") * root).alias("information_ratio"),
        "correlation",
    )


def additive_risk(series: DataFrame, x: str, keys: Sequence[str] = (), ann: float = 238.0) -> DataFrame:
    """Mean, deviation, annualised mean, information ratio and drawdown of the running sum."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    df = series.where(F.col(x).isNotNull()).withColumn("_cum", F.sum(x).over(w))
    df = df.withColumn("_dd", F.col("_cum") - F.max("_cum").over(w))
    g = (df.groupBy(*keys) if keys else df).agg(
        F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("std"), F.min("_dd").alias("max_drawdown")
    )
    return g.withColumns(
        {
            "annualized_return": F.col("mean") * ann,
            "information_ratio": safe_div("mean", "std") * F.sqrt(F.lit(ann)),
        }
    )


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation and range of each column, one row per column."""
    long = df.unpivot([], list(columns), "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def compare_metrics(base: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two one-row metric tables side by side with their difference."""
    a = base.unpivot([], list(columns), "metric", "base")
    b = new.unpivot([], list(columns), "metric", "new")
    return a.join(b, "metric", "full_outer").withColumn("diff", F.col("new") - F.col("base"))


def regression_error(df: DataFrame, pred: str = "score", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error and pooled correlation."""
    d = F.col(pred) - F.col(label)
    v = df.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
    return (v.groupBy(*keys) if keys else v).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), pair_corr(pred, label).alias("pooled_ic"), F.count("*").alias("rows")
    )


def nav_performance(nav: DataFrame, value: str = "nav", ret: str = "ret", ann: float = 252.0) -> DataFrame:
    """Metrics of a value series with calendar years, and Sharpe from the annual return."""
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    df = nav.withColumn("_dd", F.col(value) / F.max(value).over(w) - 1)
    down = F.when(F.col(ret) < 0, F.col(ret))
    g = df.agg(
        F.min_by(value, "trade_date").alias("_first"),
        F.max_by(value, "trade_date").alias("_last"),
        F.datediff(as_date(F.max("trade_date")), as_date(F.min("trade_date"))).alias("_days"),
        F.stddev_samp(ret).alias("_sd"),
        F.when(F.count(down) > 1, F.stddev_samp(down)).alias("_dsd"),
        F.min("_dd").alias("max_drawdown"),
        F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"),
        F.count("*").alias("n_trading_days"),
    )
    total = F.col("_last") / F.col("_first") - 1
    years = F.col("_days") / F.lit(365.25)
    g = g.withColumn("total_return", total)
    g = g.withColumns(
        {
            "annual_return": F.when(years > 0, F.pow(1 + F.col("total_return"), 1 / years) - 1).otherwise(0.0),
            "annual_volatility": F.col("_sd") * F.sqrt(F.lit(ann)),
        }
    )
    down_vol = F.coalesce(F.col("_dsd") * F.sqrt(F.lit(ann)), F.col("annual_volatility"))
    zero = F.lit(0.0)
    return g.withColumns(
        {
            "sharpe_ratio": F.coalesce(safe_div("annual_return", "annual_volatility"), zero),
            "sortino_ratio": F.coalesce(safe_div("annual_return", down_vol), zero),
            "calmar_ratio": F.when(
                F.col("max_drawdown") < 0, safe_div("annual_return", F.abs("max_drawdown"))
            ).otherwise(0.0),
        }
    ).drop("_first", "_last", "_days", "_sd", "_dsd")


def account_performance(report: DataFrame, initial: float, ann: float = 252.0) -> DataFrame:
    """Metrics of an account report with activity and cost totals."""
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    df = report.withColumn("_dd", F.col("account_value") / F.max("account_value").over(w) - 1)
    r = F.col("return")
    down = F.when(r < 0, r)
    g = df.agg(
        F.count("return").alias("trading_days"),
        F.max_by("account_value", "trade_date").alias("final_value"),
        F.stddev_samp("return").alias("_sd"),
        F.stddev_samp(down).alias("_dsd"),
        F.min("_dd").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg("return").alias("mean_daily_return"),
        F.max("return").alias("best_daily_return"),
        F.min("return").alias("worst_daily_return"),
        F.avg("turnover").alias("mean_turnover"),
        F.sum("cost").alias("total_cost"),
        F.sum((F.col("turnover") > 0).cast("int")).alias("active_days"),
    )
    g = g.withColumn("total_return", F.col("final_value") / initial - 1)
    g = g.withColumns(
        {
            "annualized_return": F.pow(1 + F.col("total_return"), F.lit(ann) / F.col("trading_days")) - 1,
            "annualized_volatility": F.col("_sd") * F.sqrt(F.lit(ann)),
        }
    )
    return g.withColumns(
        {
            "sharpe": safe_div("annualized_return", "annualized_volatility"),
            "sortino": safe_div("annualized_return", F.col("_dsd") * F.sqrt(F.lit(ann))),
            "calmar": safe_div("annualized_return", F.abs("max_drawdown")),
        }
    ).drop("_sd", "_dsd")


def yearly_performance(report: DataFrame, value: str = "account_value", min_rows: int = 5, ann: float = 252.0) -> DataFrame:
    """Return, Sharpe and drawdown of each calendar year with enough dates."""
    df = report.withColumn("year", F.floor(F.col("trade_date") / 10000).cast("int"))
    y = Window.partitionBy("year").orderBy("trade_date")
    peak = F.max(value).over(y.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"_r": safe_div(value, F.lag(value).over(y)) - 1, "_dd": (F.col(value) - peak) / peak})
    g = df.groupBy("year").agg(
        F.count("*").alias("trading_days"),
        (F.max_by(value, "trade_date") / F.min_by(value, "trade_date") - 1).alias("total_return"),
        F.avg("_r").alias("_m"),
        F.stddev_samp("_r").alias("_s"),
        F.min("_dd").alias("max_drawdown"),
    ).where(F.col("trading_days") >= min_rows)
    return g.withColumns(
        {
            "annual_return": F.col("total_return") * ann / F.col("trading_days"),
            "sharpe": F.coalesce(safe_div("_m", "_s") * F.sqrt(F.lit(ann)), F.lit(0.0)),
        }
    ).drop("_m", "_s")
