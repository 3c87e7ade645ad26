"""Wide table, training matrix, walk-forward windows, and window models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from .aggregates import match_counts, regression_error
from .clean import fill_defaults
from .ic import daily_ic
from .joins import asof_join, interval_join, left_join_key

KEY = ("trade_date", "ts_code")


def wide_table(
    bars: DataFrame, status: DataFrame, suspensions: DataFrame, factors: DataFrame, reports: DataFrame, flows: DataFrame,
    members: DataFrame, report_columns: Sequence[str], flow_columns: Sequence[str], validate: bool = False,
) -> DataFrame:
    """Bars with listing status, suspension, adjustment factor, latest report, flows and industry.

    ``status`` holds closed validity intervals (ts_code, start_date, end_date, st_status).
    Flags are filled with their normal value where a source has no row. ``validate`` checks the
    keyed sources for repeated keys first (one job each; not needed for aggregated sources).
    """
    df = interval_join(bars, status, ["st_status"], start="start_date", end="end_date", closed="both")
    df = left_join_key(df, suspensions, validate=validate)
    df = left_join_key(df, factors, validate=validate)
    df = asof_join(df, reports, ["ann_date", *report_columns])
    df = left_join_key(df, flows.select(*KEY, *flow_columns), validate=validate)
    df = interval_join(df, members, ["l1_name"])
    known = F.coalesce("st_status", F.lit(0))
    df = df.withColumns(
        {
            "no_st_stock": (known == 0).cast("tinyint"),
            "st_stock": (known == 1).cast("tinyint"),
            "star_st_stock": (known == 2).cast("tinyint"),
        }
    )
    return fill_defaults(df, {"is_suspect": 0})


def wide_table_matches(wide: DataFrame) -> DataFrame:
    return match_counts(wide, ["st_status", "adj_factor", "ann_date", "l1_name"])


def training_matrix(main: DataFrame, sources: Mapping[str, DataFrame], labels: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Features of all sources and one label on the main key; infinities become nulls, unlabelled rows go."""
    df = main
    for src in sources.values():
        df = left_join_key(df, src.select(*KEY, *[c for c in src.columns if c in features]), validate=False)
    df = left_join_key(df, labels.select(*KEY, label), validate=False)
    df = df.withColumns({c: finite(c) for c in [*features, label]})
    return df.where(F.col(label).isNotNull()).select(*KEY, *features, label)


def training_matrix_filled(
    main: DataFrame, sources: Mapping[str, DataFrame | None], labels: DataFrame, features: Sequence[str], label: str
) -> DataFrame:
    """Like :func:`training_matrix`, but an absent source or column counts as zero."""
    df = main
    for src in sources.values():
        if src is not None:
            df = df.join(src.select(*KEY, *[c for c in src.columns if c in features]), list(KEY), "left")
    df = df.join(labels.select(*KEY, label), list(KEY), "left")
    have = set(df.columns)
    filled = {c: F.coalesce(finite(c), F.lit(0.0)) if c in have else F.lit(0.0) for c in features}
    return df.withColumns(filled).where(finite(label).isNotNull()).select(*KEY, *features, label)


def walk_forward_windows(
    start: str, test_start: str, test_end: str, train_years: int, step_years: int, valid_ratio: float = 0.2, mode: str = "rolling"
) -> list[dict]:
    """Train, validation and test ranges as YYYYMMDD integers; a short list derived from settings."""
    if mode not in ("rolling", "expanding"):
        raise ValueError(f"unknown mode {mode}")
    day, out = pd.Timedelta(days=1), []
    first, lo, hi = pd.Timestamp(start), pd.Timestamp(test_start), pd.Timestamp(test_end)
    as_int = lambda t: int(t.strftime("%Y%m%d"))
    step = 0
    while True:
        shift = pd.DateOffset(years=step * step_years)
        begin = first + shift if mode == "rolling" else first
        train_end = first + shift + pd.DateOffset(years=train_years) - day
        t0 = train_end + day
        t1 = t0 + pd.DateOffset(years=step_years) - day
        if t0 > hi:
            return out
        step += 1
        if t1 < lo:
            continue
        valid_start = train_end - pd.Timedelta(days=int((train_end - begin).days * valid_ratio)) + day
        out.append(
            {
                "window": len(out),
                "train_start": as_int(begin),
                "train_end": as_int(valid_start - day),
                "valid_start": as_int(valid_start),
                "valid_end": as_int(train_end),
                "test_start": as_int(max(t0, lo)),
                "test_end": as_int(min(t1, hi)),
            }
        )


def assign_windows(df: DataFrame, windows: Sequence[dict]) -> DataFrame:
    """Row per window and split it belongs to: a generator over the literal list of ranges."""
    ranges = [
        F.struct(
            F.lit(w["window"]).alias("window"), F.lit(part).alias("split"),
            F.lit(w[f"{part}_start"]).alias("lo"), F.lit(w[f"{part}_end"]).alias("hi"),
        )
        for w in windows
        for part in ("train", "valid", "test")
    ]
    hit = F.filter(F.array(*ranges), lambda r: (F.col("trade_date") >= r["lo"]) & (F.col("trade_date") <= r["hi"]))
    return df.withColumn("_w", F.explode(hit)).select("*", F.col("_w.window").alias("window"), F.col("_w.split").alias("split")).drop("_w")


def sample_weights(df: DataFrame, label: str, floor: float, power: float, keys: Sequence[str] = ("window",)) -> DataFrame:
    """Weights rising with the label, mean one per window. Window statistics, one row per window of a short list, are broadcast:
    an exchange by window would gather all its rows in one task."""
    keys = list(keys)
    st = df.groupBy(*keys).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    df = df.join(F.broadcast(st), keys)
    span = F.col("_hi") - F.col("_lo")
    share = F.when(span >= 1e-9, (F.col(label) - F.col("_lo")) / F.nullif(span, F.lit(0.0)))
    df = df.withColumn("_w", F.when(share.isNotNull(), floor + F.pow(share, F.lit(power)) * (1 - floor)).otherwise(1.0))
    mean = df.groupBy(*keys).agg(F.avg("_w").alias("_mean"))
    return df.join(F.broadcast(mean), keys).withColumn("sample_weight", F.col("_w") / F.col("_mean")).drop("_lo", "_hi", "_w", "_mean")


def group_sizes(df: DataFrame, key: str = "trade_date") -> DataFrame:
    """Rows per ranking group, in group order."""
    return df.groupBy(key).agg(F.count("*").alias("size")).orderBy(key)


@dataclass(frozen=True)
class WindowModel:
    """A fitted forest with the values that stand for missing features."""

    trees: object
    fills: Mapping[str, float]

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(filled_features(rows, self.fills))

    def score_sql(self) -> str:
        """The forest as one SQL expression over the feature columns, missing and infinite values filled: what another engine,
        or a session without the model, needs to score rows."""
        names = {i: f"(CASE WHEN abs(`{c}`) < CAST('Infinity' AS DOUBLE) THEN `{c}` ELSE {float(v)!r}D END)" for i, (c, v) in enumerate(self.fills.items())}

        def text(node) -> str:
            if node.getClass().getSimpleName() == "LeafNode":
                return f"{node.prediction()!r}D"
            split = node.split()
            return f"CASE WHEN {names[split.featureIndex()]} <= {split.threshold()!r}D THEN {text(node.leftChild())} ELSE {text(node.rightChild())} END"

        trees = zip(self.trees._java_obj.trees(), self.trees.treeWeights, strict=True)
        return " + ".join(f"{float(w)!r}D * ({text(t.rootNode())})" for t, w in trees)

    def score(self, rows: DataFrame, most_nodes: int = 2000) -> DataFrame:
        """``rows`` with ``score``. Up to ``most_nodes`` nodes the forest is one expression inside the query's own generated code; a larger
        one is scored by the model, as its code would not be compiled."""
        if self.trees.totalNumNodes > most_nodes:
            return self.transform(rows).drop("features")
        return rows.withColumn("score", F.expr(self.score_sql()))


def filled_features(rows: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    """Features as one vector column; a missing or infinite one takes its fill value, so no row is lost."""
    from pyspark.ml.feature import VectorAssembler

    names = {c: f"_f{i}" for i, c in enumerate(fills)}
    df = rows.withColumns({n: F.coalesce(finite(c), F.lit(float(fills[c]))) for c, n in names.items()})
    return VectorAssembler(inputCols=list(names.values()), outputCol="features").transform(df).drop(*names.values())


def fit_window_models(
    matrix: DataFrame, windows: Sequence[dict], features: Sequence[str], label: str, weight_floor: float = 0.5, weight_power: float = 1.0, **params
) -> dict[int, WindowModel]:
    """One boosted-tree model per window, trained by Spark on the window's train range.

    Rows are weighted by :func:`sample_weights`; the validation range decides how many trees are kept. A missing feature
    takes its mean over the train range (zero if it has no value there).
    """
    from pyspark.ml.regression import GBTRegressor

    models = {}
    for w in windows:
        rows = matrix.where(F.col("trade_date").between(w["train_start"], w["valid_end"]) & F.col(label).isNotNull())
        rows = rows.withColumns({"_valid": F.col("trade_date") >= w["valid_start"], "_window": F.lit(w["window"])})
        means = rows.where(~F.col("_valid")).agg(*[F.avg(finite(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
        fills = {c: float(means[i] or 0.0) for i, c in enumerate(features)}
        rows = sample_weights(rows, label, weight_floor, weight_power, ("_window", "_valid"))
        trees = GBTRegressor(
            featuresCol="features", labelCol=label, predictionCol="score", weightCol="sample_weight", validationIndicatorCol="_valid", **params
        )
        models[w["window"]] = WindowModel(trees.fit(filled_features(rows, fills)), fills)
    return models


def predict_range(model: WindowModel, matrix: DataFrame, start: int, end: int, label: str | None = None) -> DataFrame:
    """Scores of a fitted model for a period: one per row, whatever features it lacks."""
    rows = matrix.where(F.col("trade_date").between(start, end))
    return model.score(rows).select(*KEY, "score", *([label] if label else []))


def walk_forward_predictions(matrix: DataFrame, windows: Sequence[dict], models: dict, label: str) -> DataFrame:
    """Out-of-sample scores of all windows; on overlapping dates the later window wins."""
    parts = [
        predict_range(models[w["window"]], matrix, w["test_start"], w["test_end"], label).withColumn("window", F.lit(w["window"]))
        for w in windows
    ]
    df = reduce(lambda a, b: a.unionByName(b), parts)
    last = Window.partitionBy(*KEY).orderBy(F.desc("window"))
    return df.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def window_errors(pred: DataFrame, label: str, group_rows: int | None = None, score: str = "score") -> DataFrame:
    """Error, pooled and mean daily rank correlation per window."""
    ic = daily_ic(pred, score, label, ["window", "trade_date"], group_rows=group_rows)
    mean = ic.groupBy("window").agg(F.avg("rank_ic").alias("mean_rank_ic"))
    return regression_error(pred, score, label, ["window"]).join(mean, "window", "left")
