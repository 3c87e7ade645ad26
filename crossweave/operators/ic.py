"""Signal validation: information coefficients, quantile groups, spreads, turnover.

Every function takes ``keys`` (date, or feature and date), so one plan serves one
signal or many signals laid out as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import safe_div
from ..functions.groups import average_rank, fits_one_task, group_stats, measured_group_rows, order_position
from ..functions.rolling import pair_corr
from ..sources.datasets import materialize
from .aggregates import additive_risk, monthly_mean

DATE = "trade_date"


def daily_ic(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = (DATE,), min_rows: int = 2,
    group_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Pearson and rank correlation per date; null for short or constant cross-sections."""
    v = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    v = _with_ranks(v, score, label, keys, group_rows, limit)
    return v.groupBy(*keys).agg(*_ic_aggs(score, label, min_rows))


def _with_ranks(v: DataFrame, score: str, label: str, keys: Sequence[str], group_rows, limit) -> DataFrame:
    v = average_rank(v, score, list(keys), "_rs", group_rows=group_rows, limit=limit)
    return average_rank(v, label, list(keys), "_rl", group_rows=group_rows, limit=limit)


def _ic_aggs(score: str, label: str, min_rows: int) -> list[Column]:
    return [
        pair_corr(score, label, min_rows).alias("ic"),
        pair_corr("_rs", "_rl", min_rows).alias("rank_ic"),
        F.count("*").alias("count"),
    ]


def ic_summary(ic: DataFrame, x: str = "ic", keys: Sequence[str] = (), ic_digits: int | None = None) -> DataFrame:
    """``ic_digits`` rounds the coefficients first, where results of two engines are held against each other."""
    keys = list(keys)
    if ic_digits is not None:
        ic = ic.withColumn(x, F.round(x, ic_digits))
    sd = F.when(F.count(x) > 1, F.stddev_samp(x))
    return (ic.groupBy(*keys) if keys else ic).agg(
        F.avg(x).alias("ic_mean"),
        sd.alias("ic_std"),
        safe_div(F.avg(x), sd).alias("icir"),
        F.avg((F.col(x) > 0).cast("double")).alias("positive_rate"),
        F.count(x).alias("count"),
    )


def monthly_ic(ic: DataFrame) -> DataFrame:
    return monthly_mean(ic, ["ic", "rank_ic"])


def ic_risk(ic: DataFrame, x: str = "ic", keys: Sequence[str] = ()) -> DataFrame:
    return additive_risk(ic, x, keys)


def group_returns(
    df: DataFrame, score: str = "score", label: str = "label", groups: int = 5, reverse: bool = False,
    keys: Sequence[str] = (DATE,), group_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Mean label of equal slices by descending score, and the two spreads.

    Each slice has ``n // groups`` names; the remainder at the bottom belongs to none.
    """
    keys = list(keys)
    sign = 1 if reverse else -1
    everyone = df.groupBy(*keys).agg(F.avg(label).alias("_all"))
    v = _with_positions(df.where(F.col(score).isNotNull()), {"_p": sign * F.col(score)}, keys, group_rows, limit)
    g = v.groupBy(*keys).agg(*_slice_aggs(label, groups)).join(everyone, keys)
    g = g.dropna(how="all", subset=[f"group{i + 1}" for i in range(groups)])
    return g.withColumns(
        {"long_short": F.col("group1") - F.col(f"group{groups}"), "long_average": F.col("group1") - F.col("_all")}
    ).drop("_all")


def _with_positions(v: DataFrame, orders: dict[str, Column], keys: Sequence[str], group_rows, limit) -> DataFrame:
    """Position columns by several orders (ties by code) and the group size ``_n``."""
    for name, o in orders.items():
        v = order_position(v, list(keys), [o, "ts_code"], name, group_rows, limit)
    return group_stats(v, list(keys), {"_n": F.count(F.lit(1))}, group_rows, limit)


def _slice_aggs(label: str, groups: int) -> list[Column]:
    """Mean label of each slice of ``_n // groups`` rows; the remainder belongs to none."""
    size = F.floor(F.col("_n") / groups)
    g = F.when(size > 0, F.floor((F.col("_p") - 1) / F.nullif(size, F.lit(0))))
    return [F.avg(F.when(g == i, F.col(label))).alias(f"group{i + 1}") for i in range(groups)]


def group_return_summary(groups_df: DataFrame, groups: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sum per slice and whether the means fall from the first slice on."""
    keys = list(keys)
    names = [f"group{i + 1}" for i in range(groups)]
    aggs = [F.avg(c).alias(f"mean_{c}") for c in names + ["long_short", "long_average"]]
    aggs += [F.sum(c).alias(f"sum_{c}") for c in ("long_short", "long_average")]
    g = (groups_df.groupBy(*keys) if keys else groups_df).agg(*aggs)
    mono = F.lit(True)
    for a, b in zip(names, names[1:]):
        mono = mono & (F.col(f"mean_{a}") >= F.col(f"mean_{b}"))
    return g.withColumns(
        {
            "monotonic": F.coalesce(mono, F.lit(False)).cast("int"),
            "top_minus_bottom": F.col("mean_group1") - F.col(f"mean_{names[-1]}"),
        }
    )


def return_column_risk(daily: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per return column: additive risk figures, mean and sum. All columns share one long table."""
    keys = [*keys, "series"]
    long = daily.unpivot([*keys[:-1], DATE], [f"`{c}`" for c in columns], "series", "_r")
    sums = long.groupBy(*keys).agg(F.avg("_r").alias("mean_return"), F.sum("_r").alias("cumulative_return"))
    return additive_risk(long, "_r", keys).join(sums, keys)


def turnover_summary(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per bucket: mean, deviation, latest value, and the number of dates."""
    keys = [*keys, "bucket"]
    long = daily.unpivot([*keys[:-1], DATE], ["top", "bottom"], "bucket", "_t")
    return long.groupBy(*keys).agg(
        F.avg("_t").alias("mean_turnover"), F.when(F.count("_t") > 1, F.stddev_samp("_t")).alias("std_turnover"),
        F.max_by("_t", DATE).alias("latest_turnover"), F.count("*").alias("count"),
    )


def long_short(
    df: DataFrame, topk: int, score: str = "score", label: str = "label", keys: Sequence[str] = (DATE,),
    group_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Spread of the best over the worst names per date.

    While ``topk`` is less than half of the largest cross-section both legs hold the same
    share of every date; otherwise each leg holds ``min(topk, n // 2)`` names.
    """
    keys = list(keys)
    v = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    largest = measured_group_rows(v, keys)
    v = _with_positions(v, {"_p": -F.col(score)}, keys, group_rows or largest, limit)
    g = v.groupBy(*keys).agg(*_spread_aggs(label, topk, largest))
    return g.select(
        *keys,
        (F.col("_long") - F.col("market_average")).alias("long"),
        (F.col("market_average") - F.col("_short")).alias("short"),
        (F.col("_long") - F.col("_short")).alias("long_short"),
        "market_average",
    )


def _spread_aggs(label: str, topk: int, largest: int) -> list[Column]:
    q = topk / largest if largest else 0.0
    if 0 < q < 0.5:
        k = F.floor(F.col("_n") * F.lit(q))
    else:
        k = F.when(F.col("_n") > 1, F.least(F.lit(topk), F.floor(F.col("_n") / 2))).otherwise(1)
    return [
        F.avg(F.when(F.col("_p") <= k, F.col(label))).alias("_long"),
        F.avg(F.when(F.col("_p") > F.col("_n") - k, F.col(label))).alias("_short"),
        F.avg(label).alias("market_average"),
    ]


def bucket_turnover(
    df: DataFrame, score: str = "score", groups: int = 5, lag: int = 1, keys: Sequence[str] = (DATE,),
    group_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Share of the top and bottom bucket that was not there by the lagged score."""
    keys = list(keys)
    v = _with_last(df, score, lag, keys)
    v = _with_positions(v, _bucket_orders(score), keys, group_rows, limit)
    g = v.groupBy(*keys).agg(*_turnover_aggs(score, groups))
    return _turnover_shares(g).where(F.col("top").isNotNull()).select(*keys, "top", "bottom")


def _with_last(df: DataFrame, score: str, lag: int, keys: Sequence[str]) -> DataFrame:
    series = [k for k in keys if k != DATE] + ["ts_code"]
    return df.withColumn("_last", F.lag(score, lag).over(Window.partitionBy(*series).orderBy(DATE)))


def _bucket_orders(score: str) -> dict[str, Column]:
    """Best and worst first, by the score and by the lagged score; a missing one comes last."""
    far = F.lit(float("inf"))
    return {
        "_p": F.coalesce(-F.col(score), far),
        "_pt": F.coalesce(-F.col("_last"), far),
        "_cb": F.coalesce(F.col(score), far),
        "_pb": F.coalesce(F.col("_last"), far),
    }


def _turnover_aggs(score: str, groups: int) -> list[Column]:
    size = F.floor(F.col("_n") / groups)
    both = F.col("_last").isNotNull() & F.col(score).isNotNull()
    kept = lambda c, p: F.sum(((F.col(c) <= size) & (F.col(p) <= size) & both).cast("int"))
    return [
        F.max(size).alias("_size"), F.count("_last").alias("_known"), kept("_p", "_pt").alias("_t"), kept("_cb", "_pb").alias("_b")
    ]


def _turnover_shares(g: DataFrame) -> DataFrame:
    usable = (F.col("_size") > 0) & (F.col("_known") > 0)
    part = lambda c: F.when(usable, 1.0 - safe_div(F.col(c).cast("double"), F.col("_size").cast("double")))
    return g.withColumns({"top": part("_t"), "bottom": part("_b")})


def features_to_rows(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """One row per feature, date and name, so that all features share each shuffle."""
    return df.unpivot([DATE, "ts_code", label], list(features), "feature", "score").where("score IS NOT NULL")


#: features of a row that are looked at together: what a task holds of one date
FEATURES_TOGETHER = 16


def feature_days(
    df: DataFrame, features: Sequence[str], label: str, groups: int, min_rows: int, topk: int = 0, largest: int = 0,
) -> DataFrame:
    """Daily figures of every feature: coefficients, slice means, legs, turnover; one row per feature and date that has values.

    Rows stay wide, ``FEATURES_TOGETHER`` features at a time, and the sorted columns of one date are numpy arrays in one task: the same
    orders, ties and gaps as the windows of ``_with_ranks`` and ``_with_positions``, for dates that fit one task.
    """
    slices = [f"group{i + 1}" for i in range(groups)]
    figures = ["ic", "rank_ic", *slices, "_long", "_short", "market_average", "_mean", "_far", "top", "bottom"]
    share = topk / largest if largest else 0.0
    before = Window.partitionBy("ts_code").orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)
    value = lambda c: F.col(f"`{c}`").cast("double")
    packs = [list(features[i : i + FEATURES_TOGETHER]) for i in range(0, len(features), FEATURES_TOGETHER)]
    pack = lambda i, cs: F.struct(
        F.lit(i).alias("_pack"), F.array(*[value(c) for c in cs]).alias("_now"), F.array(*[F.last(value(c), ignorenulls=True).over(before) for c in cs]).alias("_before")
    )
    rows = df.where(F.col(label).isNotNull()).select(DATE, "ts_code", F.col(label).cast("double").alias("_y"), F.array(*[pack(i, cs) for i, cs in enumerate(packs)]).alias("_packs"))
    rows = rows.select(DATE, "ts_code", "_y", F.explode("_packs").alias("_e")).select(DATE, "ts_code", "_y", "_e.*")

    def ranks(x: np.ndarray, order: np.ndarray) -> np.ndarray:
        v = x[order]
        apart = np.r_[True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))]
        starts = np.flatnonzero(apart)
        ends = np.r_[starts[1:], len(v)]
        out = np.empty(len(v))
        out[order] = np.repeat((starts + 1 + ends) / 2.0, ends - starts)
        return out

    def corr(x: np.ndarray, y: np.ndarray) -> float | None:
        if len(x) < min_rows or x.max() == x.min() or y.max() == y.min():
            return None
        dx, dy = x - x.mean(), y - y.mean()
        spread = np.sqrt(np.mean(dx * dx)) * np.sqrt(np.mean(dy * dy))
        return None if spread == 0 else float(np.mean(dx * dy) / spread)

    mean = lambda x: float(x.mean()) if len(x) else None

    def figures_of(s: np.ndarray, y: np.ndarray, by_label: np.ndarray, last: np.ndarray, known: np.ndarray) -> list:
        """Rows in order of their codes, so that stable sorts settle ties by code."""
        n = len(s)
        up, down = np.argsort(s, kind="stable"), np.argsort(-s, kind="stable")
        size, best = n // groups, y[down]
        k = int(np.floor(n * share)) if 0 < share < 0.5 else min(topk, n // 2) if n > 1 else 1
        out = [corr(s, y), corr(ranks(s, up), ranks(y, by_label)), *[mean(best[i * size : (i + 1) * size]) for i in range(groups)]]
        centre = s[0] + (s - s[0]).mean()
        out += [mean(best[:k]), mean(best[n - k :]), mean(y), float(centre), float(((s - centre) ** 2).sum())]
        if size == 0 or not known.any():
            return [*out, None, None]
        for now, sign in ((down, -1.0), (up, 1.0)):
            then = np.argsort(np.where(known, sign * last, np.inf), kind="stable")[:size]
            stayed = np.zeros(n, dtype=bool)
            stayed[then] = True
            out.append(1.0 - float((stayed & known)[now[:size]].sum()) / size)
        return out

    def of_date(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t.column("ts_code"), null_placement="at_start"))
        names = packs[t.column("_pack")[0].as_py()]
        y = t.column("_y").to_numpy()
        flat = [t.column(c).combine_chunks().flatten() for c in ("_now", "_before")]
        have = [x.is_valid().to_numpy(zero_copy_only=False).reshape(len(y), len(names)) for x in flat]
        value = [x.to_numpy(zero_copy_only=False).reshape(len(y), len(names)) for x in flat]
        by_label, found = np.argsort(y, kind="stable"), []
        dated = t.column(DATE)[0].is_valid
        with np.errstate(all="ignore"):
            for j, name in enumerate(names):
                here = have[0][:, j]
                if here.any():
                    place = np.cumsum(here) - 1
                    order = place[by_label[here[by_label]]]
                    x = figures_of(value[0][here, j], y[here], order, value[1][here, j], have[1][here, j])
                    if not dated:  # rows without a date are no cross-section: they have neither ranks nor places
                        x = [v if c in ("ic", "market_average", "_mean", "_far") else None for c, v in zip(figures, x)]
                    found.append((name, int(here.sum()), x))
        columns = {"feature": pa.array([f for f, _, _ in found], pa.string()), DATE: pa.array([t.column(DATE)[0].as_py()] * len(found), t.schema.field(DATE).type)}
        columns |= {c: pa.array([x[i] for _, _, x in found], pa.float64()) for i, c in enumerate(figures)}
        return pa.table({**columns, "count": pa.array([n for _, n, _ in found], pa.int64())})

    kind = df.schema[DATE].dataType.simpleString()
    return rows.groupBy(DATE, "_pack").applyInArrow(of_date, f"feature string, `{DATE}` {kind}, {', '.join(f'{c} double' for c in figures)}, count long")


def validate_features(
    df: DataFrame, features: Sequence[str], label: str = "label", groups: int = 5, topk: int = 50, min_rows: int = 2,
    group_rows: int | None = None, limit: int | None = None, ic_digits: int | None = None,
) -> DataFrame:
    """One summary row per feature: coefficients, slices, spread, turnover, distribution.

    Dates that fit one task are looked at as they are (``feature_days``). Else the long table is written once; ranks and positions of
    every analysis are windows of one exchange by (feature, date), and one aggregation yields all daily figures.
    """
    df = df.where(F.col(label).isNotNull())
    if fits_one_task(df, DATE, group_rows, limit):
        found = df.groupBy(DATE).agg(*[F.count(f"`{c}`").alias(f"_n{i}") for i, c in enumerate(features)])
        largest = found.agg(F.max(F.greatest(*[f"_n{i}" for i in range(len(features))], F.lit(0)))).first()[0] or 0
        daily = materialize(feature_days(df, features, label, groups, min_rows, topk, largest), "feature-days")
        centre = daily.groupBy("feature").agg((F.sum(F.col("count") * F.col("_mean")) / F.sum("count")).alias("mean_score"))
        away = F.col("_mean") - F.col("mean_score")
        around = daily.join(centre, "feature").groupBy("feature", "mean_score")
        scores = around.agg(F.sqrt(F.sum(F.col("_far") + F.col("count") * away * away) / F.nullif(F.sum("count") - 1, F.lit(0))).alias("std_score"))
    else:
        rows = materialize(features_to_rows(df, features, label), "feature-rows")
        keys = ["feature", DATE]
        largest = measured_group_rows(rows, keys)
        v = _with_last(rows, "score", 1, keys)
        v = _with_ranks(v, "score", label, keys, group_rows or largest, limit)
        v = _with_positions(v, _bucket_orders("score"), keys, group_rows or largest, limit)
        daily = v.groupBy(*keys).agg(
            *_ic_aggs("score", label, min_rows), *_slice_aggs(label, groups), *_spread_aggs(label, topk, largest),
            *_turnover_aggs("score", groups),
        )
        daily = _turnover_shares(daily)
        scores = rows.groupBy("feature").agg(F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score"))
    if ic_digits is not None:
        daily = daily.withColumns({c: F.round(c, ic_digits) for c in ("ic", "rank_ic")})
    daily = daily.withColumns(
        {"_ls": F.col("group1") - F.col(f"group{groups}"), "_topk": F.col("_long") - F.col("_short")}
    )
    slices = [f"group{i + 1}" for i in range(groups)]
    dev = lambda c: F.when(F.count(c) > 1, F.stddev_samp(c))
    g = daily.groupBy("feature").agg(
        F.avg("ic").alias("ic_mean"),
        dev("ic").alias("ic_std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"),
        F.count("ic").alias("count"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        dev("rank_ic").alias("rank_ic_std"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("rank_positive_rate"),
        *[F.avg(c).alias(f"mean_{c}") for c in slices],
        F.avg("_ls").alias("mean_long_short"),
        F.avg("_topk").alias("mean_topk_spread"),
        F.avg("top").alias("mean_top_turnover"),
        F.avg("bottom").alias("mean_bottom_turnover"),
    )
    falling = F.lit(True)
    for a, b in zip(slices, slices[1:]):
        falling = falling & (F.col(f"mean_{a}") >= F.col(f"mean_{b}"))
    return g.join(scores, "feature").select(
        "feature", "ic_mean", "ic_std", safe_div("ic_mean", "ic_std").alias("icir"), "positive_rate", "count",
        "rank_ic_mean", "rank_ic_std", safe_div("rank_ic_mean", "rank_ic_std").alias("rank_icir"), "rank_positive_rate",
        "mean_group1", F.col(f"mean_group{groups}").alias("mean_group_last"), "mean_long_short",
        F.coalesce(falling, F.lit(False)).cast("int").alias("monotonic"),
        "mean_topk_spread", "mean_top_turnover", "mean_bottom_turnover", "mean_score", "std_score",
    )


def screen_factors(
    df: DataFrame, features: Sequence[str], label: str = "label", groups: int = 5, min_rows: int = 2,
    group_rows: int | None = None, limit: int | None = None, ic_digits: int | None = None,
) -> DataFrame:
    """Rank coefficient, its ratio and sign rate, and slice returns per factor."""
    df = df.where(F.col(label).isNotNull())
    if fits_one_task(df, DATE, group_rows, limit):
        daily = materialize(feature_days(df, features, label, groups, min_rows), "feature-days")
        days = daily.dropna(how="all", subset=[f"group{i + 1}" for i in range(groups)])
        days = days.withColumns({"long_short": F.col("group1") - F.col(f"group{groups}"), "long_average": F.col("group1") - F.col("market_average")})
    else:
        rows, keys = features_to_rows(df, features, label), ["feature", DATE]
        daily = daily_ic(rows, "score", label, keys, min_rows, group_rows, limit)
        days = group_returns(rows, "score", label, groups, keys=keys, group_rows=group_rows, limit=limit)
    ic = ic_summary(daily, "rank_ic", ["feature"], ic_digits)
    g = group_return_summary(days, groups, ["feature"])
    return ic.join(g, "feature", "left").select(
        "feature",
        F.col("ic_mean").alias("rank_ic"),
        F.col("icir").alias("rank_icir"),
        (F.col("positive_rate") * 100).alias("ic_positive_pct"),
        F.col("mean_long_short").alias("long_short"),
        F.col("mean_group1").alias("top_group"),
        F.col(f"mean_group{groups}").alias("bottom_group"),
        "monotonic",
    )


def score_correlations(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Pairwise correlation of score columns: one aggregate row laid out as a table."""
    pairs = [(a, b) for a in scores for b in scores]
    one = df.agg(*[pair_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr")
    return long.select(
        F.split("pair", r"\|")[0].alias("score_a"), F.split("pair", r"\|")[1].alias("score_b"), "corr"
    )


def infer_label_column(df: DataFrame, score: str = "score") -> str:
    """The only column whose name starts with ``label``, else the only other numeric column."""
    fields = [f for f in df.schema.fields if f.name not in (score, DATE, "ts_code")]
    labelled = [f.name for f in fields if f.name.startswith("label")]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    if len(labelled) == 1:
        return labelled[0]
    if len(numeric) == 1:
        return numeric[0]
    raise ValueError(f"name the label column; candidates: {labelled or numeric}")
