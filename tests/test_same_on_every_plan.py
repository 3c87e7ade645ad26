"""Results do not depend on the size of a group, the width of a table, or rows that repeat a key."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossweave.functions import groups as G
from crossweave.operators import intervals, joins, matrix, portfolio, risk, smoothing, timing
from crossweave.sources import datasets


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def scores(spark):
    nan = float("nan")
    rows = [(1, "a", 1.0), (1, "b", nan), (1, "c", 3.0), (1, "d", None), (1, "e", 3.0), (None, "f", 2.0), (None, "g", -1.0), (2, "a", -0.5)]
    return spark.createDataFrame(rows, "trade_date int, ts_code string, score double")


def test_top_k_has_one_order(scores, monkeypatch):
    small = {k: rows_of(portfolio.top_k(scores, "score", k)) for k in (1, 2, 9)}
    monkeypatch.setattr(portfolio, "GROUP_LIMIT", 0)
    monkeypatch.setattr(G, "GROUP_ROW_LIMIT", 0)
    assert {k: rows_of(portfolio.top_k(scores, "score", k)) for k in (1, 2, 9)} == small
    assert (1, "c", 3.0, 1) in small[2] and (1, "e", 3.0, 2) in small[2] and (None, "f", 2.0, 1) in small[1]
    assert all(r[2] is not None and not math.isnan(r[2]) for r in small[9])


def test_top_k_of_text(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "z"), (1, "c", "y")], "trade_date int, ts_code string, score string")
    want = rows_of(portfolio.top_k(df, "score", 2))
    monkeypatch.setattr(portfolio, "GROUP_LIMIT", 0)
    assert rows_of(portfolio.top_k(df, "score", 2)) == want == [(1, "b", "z", 1), (1, "c", "y", 2)]


@pytest.mark.parametrize("descending", [None, [True, False]])
def test_positions_keep_rows_without_a_key(scores, descending):
    df = scores.where("score is not null and not isnan(score)")
    args = dict(df=df, keys=["trade_date"], order=["score", "ts_code"], out="p", descending=descending)
    window, sliced = G.order_position(**args, limit=10**9), G.order_position(**args, limit=0, slice_rows=2)
    assert rows_of(window) == rows_of(sliced) and window.count() == df.count()


def test_quantiles_of_many_columns_take_one_pass(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("int").alias("trade_date"), F.col("id").cast("string").alias("ts_code"), *[
        F.when(F.col("id") % (i + 2) != 0, F.col("id") * (i + 1.0)).alias(f"x{i}") for i in range(4)])
    wanted = {f"x{i}": {f"lo{i}": 0.1, f"hi{i}": 0.9} for i in range(4)}
    tracker = spark.sparkContext.statusTracker()

    def built(columns):
        spark.sparkContext.setJobGroup(f"build{len(columns)}", "")
        out = G.with_column_quantiles(df, columns, "trade_date", group_rows=100, limit=0, slice_rows=None)
        return out, len(tracker.getJobIdsForGroup(f"build{len(columns)}"))

    many, jobs = built(wanted)
    assert jobs == built({"x0": wanted["x0"]})[1]
    spark.sparkContext.setJobGroup("rest", "")
    plain = G.with_column_quantiles(df, wanted, "trade_date", group_rows=100)
    same = lambda d: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows_of(d)]
    assert same(many) == same(plain)


@pytest.mark.parametrize("extra", [0, 25])
def test_smoothing_keeps_every_row_at_any_width(spark, extra):
    rows = [("a", 3, 3.0), ("a", 1, 1.0), ("a", 2, None), ("a", 3, 5.0), ("a", None, 7.0), ("b", 1, 2.0)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date int, x double").withColumns({f"k{i}": F.lit(i) for i in range(extra)})
    out = smoothing.ema(df, "x", "e", 3)
    assert out.columns == [*df.columns, "e"] and out.dtypes[:-1] == df.dtypes
    got = sorted(((r.ts_code, r.trade_date is None, r.trade_date, r.x, round(r.e, 6)) for r in out.collect()), key=str)
    # missing date first, then the dates; a gap keeps the last value and decays the old weight
    assert len(got) == 6 and ("a", True, None, 7.0, 7.0) in got and ("b", False, 1, 2.0, 2.0) in got
    assert ("a", False, 1, 1.0, 4.0) in got and ("a", False, 2, None, 4.0) in got


def test_interval_join_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(5, "a", 1), (5, "a", 2), (9, "a", 3), (5, None, 4), (None, "a", 5)], "trade_date int, ts_code string, n int")
    right = spark.createDataFrame([("a", 1, 6, "u"), ("a", 3, None, "v"), ("a", None, None, "w"), (None, 1, 9, "x")], "ts_code string, in_date int, out_date int, label string")
    assert rows_of(joins.interval_join(left, right, ["label"]).select("n", "label")) == [(1, "v"), (2, "v"), (3, "v"), (4, None), (5, None)]
    assert rows_of(joins.interval_join(left, right, ["label"], first=True).select("n", "label"))[:3] == [(1, "u"), (2, "u"), (3, "v")]


def test_a_model_scores_every_row(spark):
    rows = [(20200101 + i % 28, f"s{i}", float(i % 7) if i % 3 else None, float("inf") if i % 5 == 0 else 1.0 * i, None, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "trade_date int, ts_code string, f double, g double, h double, label double")
    window = {"window": 0, "train_start": 20200101, "train_end": 20200114, "valid_start": 20200115, "valid_end": 20200121}
    model = matrix.fit_window_models(df, [window], ["f", "g", "h"], "label", maxDepth=2, maxIter=3, seed=1)[0]
    out = matrix.predict_range(model, df, 20200101, 20200128)
    assert out.count() == 200 and out.where("score is null").count() == 0
    assert model.fills["h"] == 0.0 and out.columns == ["trade_date", "ts_code", "score"]


@pytest.mark.parametrize(("word", "step"), [("5", 5), ("every 5", None), ("every 5 days", 5), ("3d", 3), ("every_2_trading_days", 2), ("每 4 天", 4), ("0", None), ("days", None), ("5 weeks", None)])
def test_schedule_words(word, step):
    assert timing.schedule_step(word) == step


def test_rebalance_dates_fall_back_to_daily(spark):
    dates = spark.createDataFrame([(20200101 + i,) for i in range(10)], "trade_date int")
    assert timing.rebalance_dates(dates, "every 5").count() == 10
    assert rows_of(timing.rebalance_dates(dates, 4)) == [(20200101,), (20200105,), (20200109,)]


def test_high_water_mark_reads_dashes_and_keeps_keys(spark):
    df = spark.createDataFrame([("a", "20200301"), ("a", "2020-03-05"), ("b", "2020-13-45"), ("b", "x"), ("c", None), ("d", " 20200101 ")], "k string, d string")
    got = {r.k: (r.latest, r.next_start) for r in datasets.high_water_mark(df, "d", 20200201, key="k").collect()}
    assert got == {"a": (20200305, 20200306), "b": (None, 20200201), "c": (None, 20200201), "d": (20200101, 20200201)}


def test_listing_status_of_empty_and_tied_rows(spark):
    schema = "ts_code string, name string, start_date int, end_date int, ann_date int, line int"
    assert intervals.daily_name_status(spark.createDataFrame([], schema)).count() == 0
    tied = spark.createDataFrame([("a", "*ST x", 20200101, 20200101, 20200101, 1), ("a", "x", 20200101, 20200101, 20200101, 2)], schema)
    flag = lambda **k: intervals.daily_name_status(tied, **k).first().no_st_stock
    assert flag(source_order="line") == 1 and flag() == 0


def test_sparse_factors_leave_the_covariance(spark):
    rows = [(i, float(i % 5), float(i % 3), None if i > 2 else 1.0) for i in range(40)]
    fr = spark.createDataFrame(rows, "trade_date int, f double, g double, h double")
    for fn in (risk.rolling_covariance, risk.shrunk_covariance):
        out, kept = fn(fr, ["f", "g", "h"], 20, 5), fn(fr.drop("h"), ["f", "g"], 20, 5)
        assert rows_of(out) == rows_of(kept) and out.count() > 0
        assert fn(fr, ["h"], 20, 5).count() == 0


def test_a_pool_beyond_its_bound_is_refused(spark):
    pool = spark.createDataFrame([(1, f"s{i}", 1.0, 0.1) for i in range(4)], "trade_date int, ts_code string, f double, specific_variance double")
    cov = spark.createDataFrame([(1, "f", "f", 2.0)], "trade_date int, factor_i string, factor_j string, cov double")
    assert risk.pool_covariance(pool, ["f"], cov).count() == 16
    with pytest.raises(ValueError):
        risk.pool_covariance(pool, ["f"], cov, most_names=3)


def test_a_series_that_repeats_a_date_is_refused(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "trade_date int, ts_code string")
    good = spark.createDataFrame([(1, 0.5, "x")], "trade_date int, r double, t string")
    assert rows_of(joins.join_calendar(df, good)) == [(1, "a", 0.5, "x"), (2, "b", None, None)]
    with pytest.raises(Exception, match="repeats a trade_date"):
        joins.join_calendar(df, good.union(good)).collect()


def test_window_models_learn_and_use_their_split(spark):
    rows = [(20200101 + i % 28, f"s{i}", float(i % 10), float((i * 7) % 11), 2.0 * (i % 10) + (i % 3)) for i in range(1200)]
    df = spark.createDataFrame(rows, "trade_date int, ts_code string, f double, g double, label double")
    window = {"window": 3, "train_start": 20200101, "train_end": 20200114, "valid_start": 20200115, "valid_end": 20200121}
    model = matrix.fit_window_models(df, [window], ["f", "g"], "label", maxDepth=3, maxIter=8, seed=1)[3]
    out = matrix.predict_range(model, df, 20200122, 20200128, "label")
    assert out.stat.corr("score", "label") > 0.9
    # a validation range without the signal stops the trees early
    odd = df.withColumn("label", F.when(F.col("trade_date") >= 20200115, -F.col("label")).otherwise(F.col("label")))
    early = matrix.fit_window_models(odd, [window], ["f", "g"], "label", maxDepth=3, maxIter=8, seed=1)[3]
    assert early.trees.getNumTrees < model.trees.getNumTrees


def test_interval_join_of_a_key_with_a_third_of_all_records(spark):
    """No array of records and no pair of rows: the result is that of trying every record."""
    rng = random.Random(4)
    day = lambda: rng.choice([1999, 2000, 2001, 2020]) * 10000 + rng.randrange(1, 13) * 100 + rng.randrange(1, 29)
    records = []
    for k in range(900):
        a, b = day(), day()
        records.append(("hot" if k % 3 == 0 else f"c{k % 40}", a, None if k % 11 == 0 else b, f"v{rng.randrange(9)}" if k % 7 else None))
    rows = [(day(), rng.choice(["hot", "c1", "c2", "none"]), n) for n in range(400)]
    left = spark.createDataFrame(rows, "trade_date int, ts_code string, n int")
    right = spark.createDataFrame(records, "ts_code string, in_date int, out_date int, label string")
    for closed in ("left", "both"):
        for first in (False, True):
            out = joins.interval_join(left, right, ["label"], closed=closed, first=first)
            assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
            got = {r.n: r.label for r in out.collect()}
            for t, code, n in rows:
                live = [r for r in records if r[0] == code and r[1] <= t and (r[2] is None or t < r[2] or closed == "both" and t == r[2])]
                want = min(live, key=lambda r: ((1 if first else -1) * r[1], r[3] is not None, r[3] or ""))[3] if live else None
                assert got[n] == want, (closed, first, t, code)


def test_smoothing_a_long_series_in_the_jvm(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, 9000)
    x[rng.random(9000) < 0.3] = np.nan
    x[4000:4400] = np.nan
    pdf = pd.DataFrame({"trade_date": np.arange(9000), "ts_code": "hot", "x": x})
    df = spark.createDataFrame(pdf)
    for span, least in ((3, 1), (26, 10), (400, 1)):
        out = smoothing.ema(df, "x", "e", span, least)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "collect_list" not in plan and plan.count("Exchange") == 1
        got = out.orderBy("trade_date").toPandas()["e"].astype(float)
        np.testing.assert_allclose(got, pdf["x"].ewm(span=span, adjust=False, min_periods=least).mean(), rtol=1e-11)
    with pytest.raises(Exception, match="longer than the rows"):
        smoothing.smooth(df, {"e": ("x", 1e-6, 1)}, rows=64).collect()
