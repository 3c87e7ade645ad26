"""Factor risk model on long tables: exposures, factor returns, covariance, specific risk.

Panel-sized work is partial sums per date; what is square in the number of factors is
one small table per date. ``group_rows`` bounds the names of one date.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.groups import average_rank, group_stats, with_quantiles
from ..functions.rolling import Series, pair_corr
from .cross_section import composite, composites, group_least_squares, least_squares_residual, winsorize, zscore
from .joins import join_calendar

DATE = "trade_date"
BY_STOCK = Series()
STYLES = ("SIZE", "BETA", "MOMENTUM", "VALUE", "GROWTH", "VOLATILITY", "LIQUIDITY", "LEVERAGE")
INDUSTRY_PREFIXES = ("L1_", "industry_")  # fixed values


# ---------------------------------------------------------------- raw exposures


def size(bars: DataFrame) -> DataFrame:
    med = BY_STOCK.median("amount", 20, 5)
    return bars.withColumn("SIZE", F.log(F.nullif(med, F.lit(0.0))))


def beta(bars: DataFrame, lookback: int = 252, min_obs: int = 120, market: DataFrame | None = None) -> DataFrame:
    """Rolling covariance with the equal-weight market over its variance, on complete pairs.

    ``market`` may supply bars with a shorter lineage for the market mean.
    """
    source = bars if market is None else market
    mkt = source.groupBy(DATE).agg(F.avg("pct_chg").alias("_mkt"))
    df = join_calendar(bars, mkt)
    w = BY_STOCK.frame(-(lookback - 1))
    both = F.col("pct_chg").isNotNull() & F.col("_mkt").isNotNull()
    x, y = F.when(both, F.col("_mkt")), F.when(both, F.col("pct_chg"))
    slope = safe_div(F.covar_samp(x, y).over(w), F.var_samp(x).over(w))
    value = F.when(F.count(x).over(w) >= max(2, min_obs), slope)
    return df.withColumn("BETA", value).drop("_mkt")


def momentum(bars: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    return bars.withColumn("MOMENTUM", safe_div(BY_STOCK.lag("close", skip), BY_STOCK.lag("close", lookback)) - 1)


def value(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Book and earnings yield; needs bps, eps and close."""
    df = df.withColumns({"_bp": safe_div("bps", "close"), "_ep": safe_div("eps", "close")})
    return composite(df, ["_bp", "_ep"], "VALUE", group_rows).drop("_bp", "_ep")


def growth(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    parts = [c for c in ("revenue_yoy", "roe", "gross_margin_change") if c in df.columns]
    return composite(df, parts, "GROWTH", group_rows)


def volatility(bars: DataFrame, group_rows: int | None = None) -> DataFrame:
    df = bars.withColumns({"_v20": BY_STOCK.std("pct_chg", 20, 10), "_v60": BY_STOCK.std("pct_chg", 60, 30)})
    return composite(df, ["_v20", "_v60"], "VOLATILITY", group_rows).drop("_v20", "_v60")


def liquidity(bars: DataFrame) -> DataFrame:
    df = bars.withColumn("_i", safe_div(F.abs("pct_chg"), "amount"))
    return df.withColumn("LIQUIDITY", F.log1p(BY_STOCK.mean("_i", 20, 5) * 1e6)).drop("_i")


def leverage(df: DataFrame) -> DataFrame:
    source = next((c for c in ("debt_ratio", "debt_to_assets") if c in df.columns), None)
    return df.withColumn("LEVERAGE", F.col(source) if source else F.lit(None).cast("double"))


def exposures(
    bars: DataFrame, beta_lookback: int = 252, beta_min_obs: int = 120, group_rows: int | None = None,
    industry: str | None = None, industries: Sequence[str] = (), benchmark: str | None = None,
    market: DataFrame | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Eight normalised style exposures and 0/1 industry columns without the benchmark industry; ``keep`` names further
    columns that stay with their row.

    Expects bars with point-in-time bps, eps, roe, revenue_yoy, gross_margin_change,
    debt_to_assets and, for industries, the label column.
    """
    # all per-instrument windows first, then all per-date statistics: two exchanges in all
    df = liquidity(momentum(size(beta(bars, beta_lookback, beta_min_obs, market))))
    df = leverage(df).withColumns(
        {
            "_v20": BY_STOCK.std("pct_chg", 20, 10),
            "_v60": BY_STOCK.std("pct_chg", 60, 30),
            "_bp": safe_div("bps", "close"),
            "_ep": safe_div("eps", "close"),
        }
    )
    parts = {
        "VALUE": ["_bp", "_ep"],
        "GROWTH": [c for c in ("revenue_yoy", "roe", "gross_margin_change") if c in df.columns],
        "VOLATILITY": ["_v20", "_v60"],
    }
    df = composites(df, parts, group_rows)
    styles = list(STYLES)
    df = winsorize(df, styles, min_count=3, group_rows=group_rows)
    df = zscore(df, styles, group_rows=group_rows)
    dummies = {f"L1_{i}": (F.col(industry) == i).cast("double") for i in industries if i != benchmark} if industry else {}
    return df.withColumns(dummies).select(DATE, "ts_code", *styles, *[f"`{d}`" for d in dummies], *keep)


def split_factors(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Style and industry factor names, told apart by prefix."""
    ind = [n for n in names if n.startswith(INDUSTRY_PREFIXES)]
    return [n for n in names if n not in ind], ind


# ---------------------------------------------------------------- factor returns


def regression_weights(bars: DataFrame, kind: str = "sqrt_amount_20", cap: float = 10.0, total_rows: int | None = None) -> DataFrame:
    """Weights from the 20-bar mean amount: its capped root, itself, or one."""
    if kind == "equal":
        return bars.withColumn("weight", F.lit(1.0))
    df = bars.withColumn("_avg", BY_STOCK.mean("amount", 20, 5))
    if kind == "amount_20":
        return df.withColumn("weight", F.coalesce(F.greatest("_avg", F.lit(0.0)), F.lit(0.0))).drop("_avg")
    df = with_quantiles(df, "_avg", [], {"_p99": 0.99}, total_rows, tiebreak=[DATE, "ts_code"])
    capped = F.when(F.col("_avg").isNotNull(), F.least("_avg", F.col("_p99") * cap / 10.0))
    return df.withColumn("weight", F.coalesce(F.sqrt(F.nullif(capped, F.lit(0.0))), F.lit(0.0))).drop("_avg", "_p99")


def factor_returns(
    df: DataFrame, factors: Sequence[str], ret: str = "ret", weight: str | None = None, min_stocks: int = 5,
    group_rows: int | None = None,
) -> DataFrame:
    """Daily regression coefficients: one row per date with ``intercept``, ``b_{factor}`` and ``n_rows``."""
    return group_least_squares(df, ret, factors, [DATE], weight, min_stocks, group_rows)


def residual_returns(
    df: DataFrame, factors: Sequence[str], coefficients: DataFrame, ret: str = "ret", weight: str | None = None
) -> DataFrame:
    return least_squares_residual(df, ret, factors, "residual", [DATE], weight, coefficients=coefficients)


def fit_quality(residuals: DataFrame, ret: str = "ret", weight: str | None = None) -> DataFrame:
    """Weighted R² and number of names per date, over rows that took part in the fit."""
    w = F.col(weight) if weight else F.lit(1.0)
    v = residuals.where(F.col("residual").isNotNull() & (w > 0))
    sums = v.groupBy(DATE).agg(
        F.sum(w * F.col("residual") * F.col("residual")).alias("_res"),
        F.sum(w).alias("_w"),
        F.sum(w * F.col(ret)).alias("_wy"),
        F.sum(w * F.col(ret) * F.col(ret)).alias("_wyy"),
        F.count("*").alias("n"),
    )
    total = F.col("_wyy") - F.col("_wy") * F.col("_wy") / F.col("_w")
    return sums.select(DATE, "n", (1 - F.col("_res") / F.when(total > 0, total)).alias("r_squared"))


# ---------------------------------------------------------------- covariance
# Factor returns hold one row per date.


def observed_factors(fr: DataFrame, factors: Sequence[str], min_obs: int) -> list[str]:
    """Factors with at least ``min_obs`` values in the whole table; one row of counts reaches the driver. A sparser one
    would leave hardly any complete row."""
    counts = fr.agg(*[F.count(F.col(f"`{f}`")).alias(f"n{i}") for i, f in enumerate(factors)]).first()
    return [f for i, f in enumerate(factors) if counts[i] >= min_obs]


def _moments(rows, w):
    """Running count, means and sum of cross products about the means of the ``rows`` of a pair with both values."""
    both = rows & F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(both, F.col("x")), F.when(both, F.col("y"))
    n = F.count(x).over(w)
    products = F.coalesce(F.covar_pop(x, y).over(w) * n, F.lit(0.0))
    return F.struct(n.alias("n"), F.avg(x).over(w).alias("x"), F.avg(y).over(w).alias("y"), products.alias("c"))


def rolling_covariance(fr: DataFrame, factors: Sequence[str], lookback: int = 252, min_obs: int = 60) -> DataFrame:
    """Sample covariance of complete rows among the last ``lookback`` dates, as (date, i, j, cov).

    Factors with fewer than ``min_obs`` values are left out. Dates are cut into stretches of ``lookback``. The last ``lookback`` dates
    are the head of a date's own stretch and the tail of the one before: two running moments, merged around their means, so
    nothing is subtracted from a sum. Work grows with dates × pairs, not with ``lookback``; pairs and stretches spread over tasks.
    """
    factors = observed_factors(fr, list(factors), min_obs)
    if not factors:
        return fr.limit(0).select(DATE, F.lit("").alias("factor_i"), F.lit("").alias("factor_j"), F.lit(0.0).alias("cov"))
    whole = F.lit(True)
    for f in factors:
        whole = whole & F.col(f"`{f}`").isNotNull()
    at = F.row_number().over(Window.orderBy(DATE)) - 1
    placed = fr.select(DATE, *[F.when(whole, F.col(f"`{f}`")).cast("double").alias(f"_x{i}") for i, f in enumerate(factors)], at.alias("_i"))
    own = F.floor(F.col("_i") / lookback)
    copies = placed.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
    copies = copies.select("*", F.when(F.col("_own"), own).otherwise(own + 1).alias("_part"), (F.col("_i") % lookback).alias("_place"))
    structs = [
        F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"_x{i}").alias("x"), F.col(f"_x{j}").alias("y"))
        for i, a in enumerate(factors) for j, b in enumerate(factors) if i <= j
    ]
    long = copies.select(DATE, "_own", "_part", "_place", F.explode(F.array(*structs)).alias("p")).select(DATE, "_own", "_part", "_place", "p.*")
    series = Window.partitionBy("i", "j", "_part")
    grow = lambda *by: series.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    # own rows up to a place; rows of the stretch before it from that place on, the place itself left out
    new = _moments(F.col("_own"), grow("_own", "_place"))
    old = _moments(~F.col("_own"), grow(F.desc("_place"), F.desc("_own")))
    sums = long.select(DATE, "i", "j", "_own", new.alias("a"), old.alias("b")).where("_own")
    n = F.col("a.n") + F.col("b.n")
    apart = F.coalesce((F.col("a.x") - F.col("b.x")) * (F.col("a.y") - F.col("b.y")), F.lit(0.0))
    total = F.col("a.c") + F.col("b.c") + F.col("a.n") * F.col("b.n") / n * apart
    cov = sums.where(n >= max(2, min_obs)).select(DATE, "i", "j", (total / (n - 1)).alias("cov")).where("cov IS NOT NULL")
    both = F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    mirrored = F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)
    return cov.select(DATE, "cov", F.explode(mirrored).alias("p")).select(
        DATE, F.col("p.i").alias("factor_i"), F.col("p.j").alias("factor_j"), "cov"
    )


def shrunk_covariance(fr: DataFrame, factors: Sequence[str], lookback: int = 252, min_obs: int = 60) -> DataFrame:
    """Covariance pulled towards a scaled identity, with its intensity.

    Factors with fewer than ``min_obs`` values are left out. A date's window is at most ``lookback`` × K numbers.
    Dates are numbered (one slim date-level column), cut into stretches of ``lookback``, and each stretch is sent with the one
    before it, so the windows of different stretches are built in different tasks.
    """
    factors = observed_factors(fr, list(factors), min_obs)
    if not factors:
        return fr.limit(0).select(DATE, F.lit("").alias("factor_i"), F.lit("").alias("factor_j"), F.lit(0.0).alias("cov"), F.lit(0.0).alias("shrinkage"))
    whole = F.lit(True)
    for f in factors:
        whole = whole & F.col(f"`{f}`").isNotNull()
    row = F.when(whole, F.array(*[F.col(f).cast("double") for f in factors]))
    numbered = fr.select(DATE, F.row_number().over(Window.orderBy(DATE)).alias("_i"))
    placed = fr.select(DATE, row.alias("_row")).join(numbered, DATE).withColumn("_own", F.floor(F.col("_i") / lookback))
    sent = placed.select("*", F.explode(F.array("_own", F.col("_own") + 1)).alias("_part"))
    w = Window.partitionBy("_part").orderBy("_i").rowsBetween(-(lookback - 1), 0)
    wins = sent.select(DATE, "_own", "_part", F.flatten(F.collect_list("_row").over(w)).alias("win"), F.count("_row").over(w).alias("n"))
    wins = wins.where((F.col("_own") == F.col("_part")) & (F.col("n") >= max(2, min_obs)))
    k = len(factors)

    def run(batches):
        for pdf in batches:
            out = []
            for d, flat in zip(pdf["trade_date"], pdf["win"]):
                x = np.asarray(flat, dtype=float).reshape(-1, k)
                t = len(x)
                c = x - x.mean(axis=0)
                s = c.T @ c / (t - 1)
                level = np.trace(s) / k
                sq = c**2
                spread = (sq.sum(axis=1) ** 2).mean() - (s**2).sum()
                own = level * (sq.mean(axis=0) - np.diag(s)).sum()
                gap = ((s - level * np.eye(k)) ** 2).sum()
                delta = 0.0 if gap == 0 else float(min(1.0, max(0.0, (spread - own) / (t * gap))))
                m = (1 - delta) * s + delta * level * np.eye(k)
                for a in range(k):
                    for b in range(k):
                        out.append((d, factors[a], factors[b], float(m[a, b]), delta))
            yield pd.DataFrame(out, columns=["trade_date", "factor_i", "factor_j", "cov", "shrinkage"])

    return wins.select(DATE, "win").mapInPandas(run, "trade_date int, factor_i string, factor_j string, cov double, shrinkage double")


def covariance_checks(cov: DataFrame) -> DataFrame:
    """Per date: all entries finite, symmetric, and a positive diagonal."""
    lo, hi = F.least("factor_i", "factor_j"), F.greatest("factor_i", "factor_j")
    pairs = cov.groupBy(DATE, lo.alias("a"), hi.alias("b")).agg(
        F.max("cov").alias("_hi"), F.min("cov").alias("_lo"),
        F.sum((F.col("cov").isNull() | F.isnan("cov") | (F.abs("cov") == float("inf"))).cast("int")).alias("_bad"),
    )
    return pairs.groupBy(DATE).agg(
        (F.sum("_bad") == 0).cast("int").alias("all_finite"),
        F.min((F.col("_hi") - F.col("_lo") <= 1e-10).cast("int")).alias("all_symmetric"),
        F.min(F.when(F.col("a") == F.col("b"), (F.col("_lo") > 0).cast("int"))).alias("all_positive_diag"),
    )


# ---------------------------------------------------------------- specific risk


def specific_risk(res: DataFrame, lookback: int = 252, min_obs: int = 120) -> DataFrame:
    sq = F.col("residual") * F.col("residual")
    w = BY_STOCK.frame(-(lookback - 1))
    df = res.withColumns(
        {"specific_variance": BY_STOCK.mean(sq, lookback, min_obs), "sample_count": F.count("residual").over(w)}
    )
    return df.withColumn("specific_vol", F.sqrt("specific_variance"))


def shrink_specific_risk(
    sr: DataFrame, min_obs: int, group: str = "l1_name", group_rows: int | None = None
) -> DataFrame:
    """Short histories move towards the median of their date and group."""
    full = F.col("sample_count") >= min_obs
    df = sr.withColumn("_full_vol", F.when(full, F.col("specific_vol")))
    df = with_quantiles(df, "_full_vol", [DATE, group], {"_med": 0.5}, group_rows)
    use = ~full & F.col("_med").isNotNull() & F.col(group).isNotNull()
    strength = 1.0 - F.col("sample_count") / F.lit(float(min_obs))
    vol = (1 - strength) * F.coalesce("specific_vol", "_med") + strength * F.col("_med")
    df = df.withColumn("shrunk", use.cast("int"))
    df = df.withColumn("specific_vol", F.when(use, vol).otherwise(F.col("specific_vol")))
    return df.withColumn(
        "specific_variance", F.when(use, F.col("specific_vol") * F.col("specific_vol")).otherwise(F.col("specific_variance"))
    ).drop("_full_vol", "_med")


def condition_risk_data(
    df: DataFrame, factors: Sequence[str], default_var: float = 0.0003, group_rows: int | None = None
) -> DataFrame:
    """Exposures without gaps; specific variance filled with the date's median and cut at its 95 % quantile."""
    df = df.withColumns({f: F.coalesce(f, F.lit(0.0)) for f in factors})
    df = df.withColumn("_pos", F.when(F.col("specific_variance") > 0, F.col("specific_variance")))
    df = with_quantiles(df, "_pos", DATE, {"_med": 0.5}, group_rows)
    df = df.withColumn("_v", F.coalesce("_pos", "_med", F.lit(default_var)))
    df = with_quantiles(df, "_v", DATE, {"_p95": 0.95}, group_rows)
    return df.withColumn("specific_variance", F.least("_v", "_p95")).drop("_pos", "_med", "_v", "_p95")


# ---------------------------------------------------------------- portfolio risk


def portfolio_exposure(holdings: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Long (date, factor, exposure) of weights × exposures; one partial sum per date."""
    sums = holdings.groupBy(DATE).agg(*[F.sum(F.col("weight") * F.coalesce(F.col(f"`{f}`"), F.lit(0.0))).alias(f) for f in factors])
    return sums.unpivot([DATE], [f"`{f}`" for f in factors], "factor", "exposure")


def _variance_parts(holdings: DataFrame, factors: Sequence[str], cov: DataFrame) -> DataFrame:
    """One row per date: ``parts`` (factor, part of the variance), ``factor_variance``, ``specific_variance``.

    Exposures and specific variance are one aggregate per date, which meets the K² covariances of the date once.
    """
    exposures = F.array(*[F.sum(F.col("weight") * F.coalesce(F.col(f"`{f}`"), F.lit(0.0))) for f in factors])
    own = F.sum(F.col("weight") * F.col("weight") * F.col("specific_variance"))
    dates = holdings.groupBy(DATE).agg(F.map_from_arrays(F.array(*[F.lit(f) for f in factors]), exposures).alias("_z"), own.alias("specific_variance"))
    pairs = cov.join(dates, DATE).where(F.map_contains_key("_z", F.col("factor_i")) & F.map_contains_key("_z", F.col("factor_j")))
    part = F.sum(F.col("cov") * F.element_at("_z", F.col("factor_j")))
    marginal = pairs.groupBy(DATE, "factor_i").agg(part.alias("_fz"), F.first(F.element_at("_z", F.col("factor_i"))).alias("_zi"), F.first("specific_variance").alias("specific_variance"))
    value = F.col("_zi") * F.col("_fz")
    parts = F.collect_list(F.struct(F.col("factor_i").alias("factor"), value.alias("part")))  # K factors
    return marginal.groupBy(DATE).agg(parts.alias("parts"), F.sum(value).alias("factor_variance"), F.first("specific_variance").alias("specific_variance"))


def portfolio_risk(holdings: DataFrame, factors: Sequence[str], cov: DataFrame) -> DataFrame:
    """Variance and volatility per date from exposures, factor covariance and specific variance.

    ``holdings``: weight, specific_variance and exposures per date and name.
    """
    df = _variance_parts(holdings, factors, cov).drop("parts")
    df = df.withColumn("variance", F.col("factor_variance") + F.col("specific_variance"))
    return df.withColumn("volatility", F.sqrt(F.greatest("variance", F.lit(0.0))))


def risk_attribution(holdings: DataFrame, factors: Sequence[str], cov: DataFrame) -> DataFrame:
    """Share of the variance per factor and of the specific part; the shares add up to one."""
    df = _variance_parts(holdings, factors, cov)
    own = F.struct(F.lit("SPECIFIC").alias("factor"), F.col("specific_variance").alias("part"))
    df = df.select(DATE, (F.col("factor_variance") + F.col("specific_variance")).alias("variance"), F.explode(F.concat("parts", F.array(own))).alias("_p"))
    share = F.when(F.col("variance") > 0, F.col("_p.part") / F.col("variance")).otherwise(0.0)
    return df.select(DATE, F.col("_p.factor").alias("factor"), share.alias("share"))


def attribution_sum(attribution: DataFrame, tolerance: float = 0.001) -> DataFrame:
    g = attribution.groupBy(DATE).agg(F.sum("share").alias("total"))
    return g.withColumn("passed", (F.abs(F.col("total") - 1.0) < tolerance).cast("int"))


def pool_covariance(pool: DataFrame, factors: Sequence[str], cov: DataFrame, most_names: int = 500) -> DataFrame:
    """Covariance entries among the names of a bounded pool per date, as (date, i, j, cov).

    Every pair of the pool is the result, so a pool of more than ``most_names`` names on a date is refused, never cut. Factor
    products are formed once per name before names meet.
    """
    factors = list(factors)
    largest = pool.groupBy(DATE).count().agg(F.max("count")).first()[0] or 0
    if largest > most_names:
        raise ValueError(f"a pool of {largest} names on one date exceeds {most_names}")
    x = pool.select(DATE, "ts_code", "specific_variance", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in factors])
    long = x.unpivot([DATE, "ts_code", "specific_variance"], factors, "factor_i", "x")
    xf = long.join(cov, [DATE, "factor_i"]).groupBy(DATE, "ts_code", "factor_j").agg(F.sum(F.col("x") * F.col("cov")).alias("xf"))
    picked = [F.max(F.when(F.col("factor_j") == f, F.col("xf"))) for f in factors]
    left = xf.groupBy(DATE, "ts_code").agg(F.array(*picked).alias("_xf")).withColumnRenamed("ts_code", "code_i")
    right = x.select(DATE, F.col("ts_code").alias("code_j"), F.array(*factors).alias("_x"), "specific_variance")
    dot = F.aggregate(F.zip_with("_xf", "_x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    own = F.when(F.col("code_i") == F.col("code_j"), F.col("specific_variance")).otherwise(0.0)
    return left.join(right, DATE).select(DATE, "code_i", "code_j", (dot + own).alias("cov"))


# ---------------------------------------------------------------- validation


def validate_exposures(exp: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Distribution of each exposure overall and by day, missing rate, and a pass flag for styles."""
    rows = exp.unpivot([DATE, "ts_code"], list(factors), "factor", "x")
    daily = rows.groupBy("factor", DATE).agg(F.avg("x").alias("_m"), F.when(F.count("x") > 1, F.stddev_samp("x")).alias("_s"))
    d = daily.groupBy("factor").agg(F.avg("_m").alias("mean_daily_mean"), F.avg("_s").alias("mean_daily_std"))
    o = rows.groupBy("factor").agg(
        F.avg("x").alias("mean_overall"),
        F.stddev_samp("x").alias("std_overall"),
        F.min("x").alias("min_overall"),
        F.max("x").alias("max_overall"),
        F.avg(F.col("x").isNull().cast("double")).alias("missing_rate"),
        F.avg(F.when(F.col("x").isNotNull(), (F.col("x") > 0).cast("double"))).alias("coverage"),
    )
    ok = (F.abs("mean_overall") <= 0.5) & (F.abs(F.col("std_overall") - 1) <= 0.5) & (F.col("missing_rate") <= 0.5)
    style = F.lit(True)
    for p in INDUSTRY_PREFIXES:
        style = style & ~F.col("factor").startswith(p)
    return o.join(d, "factor").withColumn("passed", F.when(style, F.coalesce(ok, F.lit(False))).otherwise(True).cast("int"))


def industry_coverage(exp: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and share of set values per industry column."""
    rows = exp.unpivot([DATE, "ts_code"], [f"`{c}`" for c in columns], "factor", "x")
    return rows.groupBy("factor").agg(
        F.avg("x").alias("mean"), F.avg(F.when(F.col("x").isNotNull(), (F.col("x") > 0).cast("double"))).alias("coverage")
    )


def forecast_validation(
    df: DataFrame, predicted: str, realised: str, keys: Sequence[str] = (), min_rows: int = 10,
    tiebreak: Sequence[str] = (DATE,), group_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Bias, error and correlation of volatility forecasts, overall or per key."""
    keys = list(keys)
    v = df.where(F.col(predicted).isNotNull() & F.col(realised).isNotNull()).withColumn("_all", F.lit(0))
    grouped = keys or ["_all"]
    tie = tiebreak[0] if len(tiebreak) == 1 else "_tie"
    if len(tiebreak) > 1:
        v = v.withColumn("_tie", F.concat_ws("|", *tiebreak))
    v = average_rank(v, predicted, grouped, "_rp", tiebreak=tie, group_rows=group_rows, limit=limit)
    v = average_rank(v, realised, grouped, "_rr", tiebreak=tie, group_rows=group_rows, limit=limit)
    err = F.col(predicted) - F.col(realised)
    g = v.groupBy(*grouped).agg(
        F.count("*").alias("n"),
        F.avg(predicted).alias("mean_predicted"),
        F.avg(realised).alias("mean_realised"),
        F.avg(err).alias("bias"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        pair_corr(predicted, realised).alias("pearson"),
        pair_corr("_rp", "_rr").alias("spearman"),
    )
    g = g.withColumn("bias_pct", safe_div("bias", "mean_realised"))
    passed = (F.col("n") >= min_rows) & F.coalesce(F.col("pearson") > 0, F.lit(False))
    g = g.withColumn("passed", passed.cast("int"))
    return g if keys else g.drop("_all")


def market_residual(bars: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Return less the equal-weight market return, a one-factor residual."""
    df = group_stats(bars, DATE, {"_m": F.avg("pct_chg")}, group_rows)
    return df.withColumn("residual", (F.col("pct_chg") - F.col("_m")) / 100.0).drop("_m")
