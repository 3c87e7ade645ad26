"""Per-date and per-industry normalisation, ranks and residuals.

``group_rows`` bounds the rows of one date (see :mod:`crossweave.functions.groups`).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stages as S
from ..functions.columns import clip, row_mean, safe_div, to_numeric
from ..functions.groups import average_rank, group_stats, with_column_quantiles
from ..functions.rolling import Series

DATE = "trade_date"


def winsorize(
    df: DataFrame, cols: Sequence[str], keys=DATE, q: float = 0.01, min_count: int = 0,
    group_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Clip to the group's ``q`` and ``1-q`` quantiles; groups below ``min_count`` values stay as they are."""
    wanted = {c: {f"_lo_{c}": q, f"_hi_{c}": 1 - q} for c in cols}
    df = with_column_quantiles(df, wanted, keys, group_rows, limit=limit)
    counts = {f"_n_{c}": F.count(c) for c in cols} if min_count else {}
    if counts:
        df = group_stats(df, keys, counts, group_rows, limit)
    out = {}
    for c in cols:
        clipped = clip(c, F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
        out[c] = F.when(F.col(f"_n_{c}") >= min_count, clipped).otherwise(F.col(c)) if min_count else clipped
    return df.withColumns(out).drop(*[n for qs in wanted.values() for n in qs], *counts)


def zscore(
    df: DataFrame, cols: Sequence[str], keys=DATE, ddof: int = 1, group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Centre and scale per group; without spread only centre."""
    dev = F.stddev_samp if ddof else F.stddev_pop
    stats = {}
    for c in cols:
        stats[f"_m_{c}"] = F.avg(c)
        stats[f"_s_{c}"] = dev(c)  # exactly zero when all values agree
    df = group_stats(df, keys, stats, group_rows, limit)
    out = {}
    for c in cols:
        centred = F.col(c) - F.col(f"_m_{c}")
        flat = F.col(f"_s_{c}").isNull() | (F.col(f"_s_{c}") == 0)
        out[c] = F.when(flat, centred).otherwise(safe_div(centred, f"_s_{c}"))
    return df.withColumns(out).drop(*stats)


def industry_neutralize(
    df: DataFrame, cols: Sequence[str], industry: str = "l1_name", group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Subtract the mean of the row's date and industry; rows without industry become null."""
    df = group_stats(df, [DATE, industry], {f"_i_{c}": F.avg(c) for c in cols}, group_rows, limit)
    return df.withColumns({c: F.col(c) - F.col(f"_i_{c}") for c in cols}).drop(*[f"_i_{c}" for c in cols])


def process_factors(
    df: DataFrame,
    factors: Sequence[str],
    neutral: Iterable[str] = (),
    industry: str = "l1_name",
    missing: str = "error",
    sources: Mapping[str, str] | None = None,
    group_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Clip, optionally centre by industry, and standardise; adds ``{factor}_cc_processed``."""
    sources = dict(sources or {})
    absent = [f for f in factors if sources.get(f, f) not in df.columns]
    if absent and missing == "error":
        raise ValueError(f"missing factor columns: {absent}")
    use = [f for f in factors if f not in absent]
    out = {f: f"{f}_cc_processed" for f in use}
    df = df.withColumns({out[f]: to_numeric(sources.get(f, f)) for f in use})
    df = winsorize(df, list(out.values()), group_rows=group_rows, limit=limit)
    centre = [out[f] for f in use if f in set(neutral)]
    if centre:
        df = industry_neutralize(df, centre, industry, group_rows, limit)
    return zscore(df, list(out.values()), group_rows=group_rows, limit=limit)


def industry_relative(
    df: DataFrame, industry: str = "l1_name", group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Industry mean returns, strength against them, and ratios less their industry mean."""
    means = {f"industry_ret_{n}": F.avg(f"ret_{n}") for n in (1, 5, 20)}
    means |= {f"_m_{c}": F.avg(c) for c in ("roe", "roa", "or_yoy")}
    df = group_stats(df, [DATE, industry], means, group_rows, limit)
    out = {f"relative_strength_{n}": F.col(f"ret_{n}") - F.col(f"industry_ret_{n}") for n in (5, 20)}
    out |= {
        "roe_ind_neutral": F.col("roe") - F.col("_m_roe"),
        "roa_ind_neutral": F.col("roa") - F.col("_m_roa"),
        "revenue_yoy_ind_neutral": F.col("or_yoy") - F.col("_m_or_yoy"),
    }
    return df.withColumns(out).drop("_m_roe", "_m_roa", "_m_or_yoy")


def group_ranks(
    df: DataFrame, ranks: Mapping[str, str], keys: Sequence[str] | str = DATE, group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Percentile ranks: output name → source column."""
    for out, src in ranks.items():
        df = average_rank(df, src, keys, out, pct=True, group_rows=group_rows, limit=limit)
    return df


def industry_series(df: DataFrame, industry: str = "l1_name") -> DataFrame:
    """One row per date and industry: mean change, rolling deviation, compounded momentum."""
    daily = df.where(F.col(industry).isNotNull()).groupBy(DATE, industry).agg(F.avg("pct_chg").alias("ind_ret"))
    s = Series(industry, DATE)
    growth = 1 + F.col("ind_ret") / 100.0
    return daily.withColumns(
        {
            "industry_vol_20": s.std("ind_ret", 20, 10),
            "industry_momentum_5": s.roll(F.product, growth, 5, 3) - 1,
            "industry_momentum_20": s.roll(F.product, growth, 20, 10) - 1,
        }
    )


def own_momentum():
    (growth,) = yield [S.product(1 + F.col("pct_chg") / 100.0, 20, 10)]
    return {"_own": growth - 1}


def industry_momentum(df: DataFrame, industry: str = "l1_name") -> DataFrame:
    """Industry volatility and momentum beside each bar, and the bar's own momentum against it."""
    daily = industry_series(df, industry).drop("ind_ret")
    out = S.together(df, [own_momentum()]).join(daily, [DATE, industry], "left")
    return out.withColumn("relative_momentum_20", F.col("_own") - F.col("industry_momentum_20")).drop("_own")


def industry_concentration(
    df: DataFrame, industry: str = "l1_name", group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Inverse of the number of names in the industry that day."""
    df = group_stats(df, [DATE, industry], {"_n": F.count("ts_code")}, group_rows, limit)
    return df.withColumn("industry_concentration", safe_div(F.lit(1.0), F.col("_n").cast("double"))).drop("_n")


def composites(
    df: DataFrame, parts: Mapping[str, Sequence[str]], group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Scores as means of clipped, standardised components; a missing component is skipped."""
    tmp = {f"_c_{p}": F.col(p) for cols in parts.values() for p in cols}
    df = df.withColumns(tmp)
    df = winsorize(df, list(tmp), min_count=3, group_rows=group_rows, limit=limit)
    df = zscore(df, list(tmp), group_rows=group_rows, limit=limit)
    return df.withColumns({out: row_mean([f"_c_{p}" for p in cols]) for out, cols in parts.items()}).drop(*tmp)


def composite(
    df: DataFrame, parts: Sequence[str], out: str, group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    return composites(df, {out: parts}, group_rows, limit)


def industry_zscore(
    df: DataFrame, x: str, out: str, industry: str = "l1_name", group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Standardise inside the industry; unit deviation where it has none, zero where unknown."""
    df = df.withColumn("_ind", F.coalesce(industry, F.lit("unknown")))
    df = group_stats(
        df, [DATE, "_ind"],
        {"_m": F.avg(x), "_s": F.stddev_samp(x), "_lo": F.min(x), "_hi": F.max(x)},
        group_rows, limit,
    )
    sd = F.when(F.col("_lo") == F.col("_hi"), 1.0).otherwise(F.coalesce(F.nullif("_s", F.lit(0.0)), F.lit(1.0)))
    return df.withColumn(out, F.coalesce((F.col(x) - F.col("_m")) / sd, F.lit(0.0))).drop(
        "_ind", "_m", "_s", "_lo", "_hi"
    )


# ---------------------------------------------------------------- least squares per group


#: (group, pattern of missing columns) sums a task holds before it hands them on
HELD_SUMS = 4096


def solve_gram(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Coefficients from weighted cross products: scaled to a unit diagonal and factored where that is well conditioned,
    else the minimum-norm solution."""
    scale = np.sqrt(np.diag(g))
    if (scale > 0).all():
        scaled = g / np.outer(scale, scale)
        try:
            factor = np.linalg.cholesky(scaled)
        except np.linalg.LinAlgError:
            factor = None
        if factor is not None and np.diag(factor).min() > 1e-5:
            return np.linalg.solve(scaled, h / scale) / scale
    return np.linalg.pinv(g, rcond=1e-12, hermitian=True) @ h


def group_least_squares(
    df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (DATE,), weight: str | None = None, min_rows: int = 0,
    group_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Minimum-norm weighted least squares with intercept, one row of coefficients per group.

    Tasks add up the weighted cross products of their rows as one array per group and pattern of missing columns;
    only these arrays meet, so a group of any size and any number of regressors takes the same plan. ``xs`` that
    have no value in a group get a null coefficient; rows that lack a value another row has are left out. Groups
    with fewer than ``min_rows`` complete rows, or not more rows than coefficients, get nulls.
    """
    keys, xs = list(keys), list(xs)
    k, held = len(xs) + 1, HELD_SUMS
    names = ["intercept", *[f"b_{x}" for x in xs]]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key_types = ", ".join(f"`{n}` {kinds[n]}" for n in keys)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*keys, F.col(y).cast("double").alias("_y"), w.alias("_w"), *[F.col(f"`{x}`").cast("double").alias(f"_x{i}") for i, x in enumerate(xs)])

    def partial(batches):
        sums = {}

        def out():
            items = list(sums.items())
            frame = pd.DataFrame([key for (key, _), _ in items], columns=keys)
            frame["_missing"] = [p for (_, p), _ in items]
            frame["_s"] = [v for _, v in items]
            sums.clear()
            return frame

        for pdf in batches:
            x = pdf[[f"_x{i}" for i in range(k - 1)]].to_numpy(dtype=float)
            yv, wv = pdf["_y"].to_numpy(dtype=float), pdf["_w"].to_numpy(dtype=float)
            gone = np.isnan(x)
            used = ~np.isnan(yv) & (wv > 0)
            z = np.c_[np.ones(len(x)), np.where(gone, 0.0, x), np.where(used, yv, 0.0)]
            wv = np.where(used, wv, 0.0)
            pattern = np.array(["".join("1" if m else "0" for m in row) for row in gone], dtype=object) if k > 1 else np.array([""] * len(x), dtype=object)
            for key, at in pdf.assign(_p=pattern).groupby([*keys, "_p"], dropna=False, sort=False).indices.items():
                part = z[at]
                g = (part * wv[at][:, None]).T @ part
                value = np.r_[used[at].sum(), g[:k, :k].ravel(), g[:k, k]]
                head = tuple(None if pd.isna(v) else v for v in key[:-1])
                sums[head, key[-1]] = sums[head, key[-1]] + value if (head, key[-1]) in sums else value
            if len(sums) > held:
                yield out()
        if sums:
            yield out()

    def solve(batches):
        sums = {}
        for pdf in batches:
            for key, pattern, value in zip(pdf[keys].itertuples(index=False, name=None), pdf["_missing"], pdf["_s"]):
                group = sums.setdefault(tuple(None if pd.isna(v) else v for v in key), {})
                group[pattern] = group[pattern] + np.asarray(value) if pattern in group else np.asarray(value, dtype=float)
        found = []
        for key, patterns in sums.items():
            act = np.array([True, *[any(p[i] == "0" for p in patterns) for i in range(k - 1)]])
            complete = [v for p, v in patterns.items() if not any(p[i] == "1" and act[i + 1] for i in range(k - 1))]
            total = sum(complete, np.zeros(1 + k * k + k))
            n, beta = int(total[0]), [None] * k
            if n >= min_rows and n > int(act.sum()):
                g, h = total[1 : 1 + k * k].reshape(k, k), total[1 + k * k :]
                for i, b in zip(np.flatnonzero(act), solve_gram(g[np.ix_(act, act)], h[act])):
                    beta[i] = float(b)
            found.append((*key, n, *beta))
        if found:
            yield pd.DataFrame(found, columns=[*keys, "n_rows", *names])

    parts = rows.mapInPandas(partial, f"{key_types}, _missing string, _s array<double>").repartition(*keys)
    return parts.mapInPandas(solve, f"{key_types}, n_rows long, " + ", ".join(f"`{n}` double" for n in names))


def least_squares_residual(
    df: DataFrame, y: str, xs: Sequence[str], out: str, keys: Sequence[str] = (DATE,), weight: str | None = None,
    min_rows: int = 0, fallback: str = "null", coefficients: DataFrame | None = None, group_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``y`` less its fit per group; ``fallback='keep'`` leaves ``y`` where there was no fit."""
    keys, xs = list(keys), list(xs)
    fit = coefficients
    if fit is None:
        fit = group_least_squares(df, y, xs, keys, weight, min_rows, group_rows, limit)
    joined = df.join(fit.withColumnRenamed("n_rows", "_fit_rows"), keys, "left")
    pred = F.col("intercept")
    for x in xs:
        # an inactive column has neither a coefficient nor a value
        part = F.col(f"`b_{x}`") * F.col(f"`{x}`")
        pred = pred + F.when(F.col(f"`b_{x}`").isNull() & F.col("intercept").isNotNull(), 0.0).otherwise(part)
    res = F.col(y) - pred
    if fallback == "keep":
        res = F.coalesce(res, F.col(y))
    kept = [c for c in df.columns if c != out]
    return joined.select(*[F.col(f"`{c}`") for c in kept], res.alias(out))


def neutralize_styles(
    df: DataFrame, y: str, styles: Sequence[str], out: str, group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Score less its linear dependence on style exposures; rows without exposures keep their score."""
    return least_squares_residual(
        df, y, styles, out, min_rows=len(styles) + 2, fallback="keep", group_rows=group_rows, limit=limit
    )


def standardize_alpha(
    df: DataFrame, x: str, out: str, q: float = 0.01, industry: str | None = None, styles: Sequence[str] = (),
    method: str = "zscore", group_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Clip, centre by industry, drop style dependence, then z-score or rank z-score (population deviation)."""
    df = df.where(F.col(x).isNotNull()).withColumn(out, F.col(x))
    df = winsorize(df, [out], q=q, group_rows=group_rows, limit=limit)
    if industry:
        known = F.col(industry).isNotNull() & (F.col(industry) != "")
        df = df.withColumn("_ind", F.when(known, F.col(industry)))
        df = group_stats(df, [DATE, "_ind"], {"_m": F.avg(out)}, group_rows, limit)
        df = df.withColumn(out, F.col(out) - F.coalesce("_m", F.lit(0.0))).drop("_ind", "_m")
    if styles:
        df = neutralize_styles(df, out, styles, out, group_rows, limit)
    if method == "rank":
        df = average_rank(df, out, DATE, "_rank", pct=True, group_rows=group_rows, limit=limit)
        df = df.withColumn(out, F.col("_rank")).drop("_rank")
    df = group_stats(
        df, DATE, {"_m": F.avg(out), "_s": F.stddev_pop(out), "_lo": F.min(out), "_hi": F.max(out)}, group_rows, limit
    )
    score = F.when(F.col("_lo") < F.col("_hi"), safe_div(F.col(out) - F.col("_m"), "_s"))
    return df.withColumn(out, score).drop("_m", "_s", "_lo", "_hi")


def rank_ensemble(
    df: DataFrame, scores: Sequence[str], out: str = "ensemble", group_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Mean of the percentile ranks of several scores."""
    ranks = {f"_r_{s}": s for s in scores}
    df = group_ranks(df, ranks, group_rows=group_rows, limit=limit)
    total = sum((F.col(r) for r in list(ranks)[1:]), F.col(list(ranks)[0]))
    return df.withColumn(out, total / len(scores)).drop(*ranks)
