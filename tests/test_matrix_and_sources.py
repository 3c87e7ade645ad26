"""Walk-forward windows, training matrix, dataset upkeep."""

import re

import numpy as np
import pandas as pd
import pytest
from tests.frames import fetch
from pyspark.sql import functions as F

from crossweave.operators import clean as C
from crossweave.operators import matrix as M
from crossweave.sources import datasets as D


def test_rolling_windows():
    w = M.walk_forward_windows("2010-01-01", "2013-07-01", "2015-12-31", 3, 1, 0.25)
    assert [x["test_start"] for x in w] == [20130701, 20140101, 20150101]
    assert [x["train_start"] for x in w] == [20100101, 20110101, 20120101]
    assert all(x["train_end"] < x["valid_start"] <= x["valid_end"] < x["test_start"] for x in w)


def test_expanding_windows_keep_their_start():
    w = M.walk_forward_windows("2010-01-01", "2013-01-01", "2015-12-31", 3, 1, mode="expanding")
    assert {x["train_start"] for x in w} == {20100101} and len(w) == 3
    with pytest.raises(ValueError):
        M.walk_forward_windows("2010-01-01", "2013-01-01", "2015-12-31", 3, 1, mode="other")


def test_rows_may_belong_to_several_windows(spark):
    w = M.walk_forward_windows("2010-01-01", "2012-01-01", "2013-12-31", 2, 1)
    df = spark.createDataFrame([(20110301, "a"), (20120301, "a"), (20090101, "a")], "trade_date int, ts_code string")
    got = sorted((r.trade_date, r.window, r.split) for r in M.assign_windows(df, w).collect())
    assert got == [(20110301, 0, "train"), (20110301, 1, "train"), (20120301, 0, "test"), (20120301, 1, "train")]


def test_sample_weights_have_mean_one(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(10)] + [(2, 1.0), (2, 1.0)], "window int, y double")
    got = M.sample_weights(df, "y", 0.5, 2.0).groupBy("window").agg(F.avg("sample_weight").alias("m")).collect()
    assert all(abs(r.m - 1) < 1e-12 for r in got)


def test_filled_matrix_has_no_gaps(spark):
    main = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "trade_date int, ts_code string")
    src = spark.createDataFrame([(1, "a", 1.0), (1, "b", float("inf"))], "trade_date int, ts_code string, x double")
    lab = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (1, "c", None)], "trade_date int, ts_code string, y double")
    got = fetch(M.training_matrix_filled(main, {"s": src, "t": None}, lab, ["x", "z"], "y"), ["ts_code"])
    assert got["x"].tolist() == [1.0, 0.0] and got["z"].tolist() == [0.0, 0.0]
    kept = fetch(M.training_matrix(main, {"s": src}, lab, ["x"], "y"), ["ts_code"])
    assert kept["x"].isna().tolist() == [False, True]


def test_partition_overwrite_touches_only_its_months(spark):
    root = D.scratch_dir(spark, "test")
    a = spark.createDataFrame([(20200105, "a", 1.0), (20200210, "a", 2.0)], "trade_date int, ts_code string, v double")
    D.write_by_date(a, root)
    D.write_by_date(spark.createDataFrame([(20200211, "b", 9.0)], "trade_date int, ts_code string, v double"), root)
    got = sorted((r.trade_date, r.v) for r in D.scan_partitioned(spark, root).collect())
    assert got == [(20200105, 1.0), (20200211, 9.0)]


def test_date_range_prunes_partitions(spark):
    root = D.scratch_dir(spark, "test")
    rows = [(y * 10000 + 105, "a", 1.0) for y in range(2015, 2021)]
    D.write_by_date(spark.createDataFrame(rows, "trade_date int, ts_code string, v double"), root)
    df = D.scan_dataset(spark, root, ["trade_date", "v"], 20180101, 20181231)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters" in plan
    assert df.count() == 1


def test_materialized_table_cuts_lineage(spark):
    df = D.materialize(spark.range(10).withColumn("x", F.rand()), "test")
    assert "Scan parquet" in df._jdf.queryExecution().executedPlan().toString()
    assert df.collect() == df.collect()


def test_history_and_future_bounds(spark):
    dates = spark.createDataFrame([(d,) for d in (20200101, 20200103, 20200106, 20200107, 20200110)], "trade_date int")
    assert D.history_start(dates, 20200107, 2) == 20200103
    assert D.history_start(dates, 20200101, 2) == 20200101
    assert D.future_end(dates, 20200105, 2) == 20200107


def test_strict_dates_fail(spark):
    df = spark.createDataFrame([("20200230",)], "d string")
    with pytest.raises(Exception, match="YYYYMMDD"):
        C.parse_dates(df, ["d"], strict=True).collect()
    assert C.parse_dates(df, ["d"]).first()["d"] is None


def test_unknown_feature_is_an_error(spark):
    df = spark.createDataFrame([(1, 2.0)], "k int, x double")
    with pytest.raises(ValueError):
        C.select_features({"s": df}, ["x", "nope"], ["k"])


def test_name_status(spark):
    df = spark.createDataFrame([("*ST a",), (" st b",), ("c退",), ("d",), (None,)], "n string")
    assert [r.s for r in df.select(C.name_status("n").alias("s")).collect()] == [2, 1, 2, 0, 0]


def test_figures_are_seen_while_writing(spark, bars):
    from crossweave.operators import aggregates as A
    from crossweave.sources import datasets

    tracker, group = spark.sparkContext.statusTracker(), "observed-write"
    spark.sparkContext.setJobGroup(group, "")
    out, figures = datasets.materialize_counted(bars, "counted", {**A.match_figures(["close", "pre_close"]), **A.null_figures(["pre_close"])})
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs == 1 and figures == {"rows": bars.count(), "close_matched": bars.count(), "pre_close_matched": bars.where("pre_close is not null").count(),
                                     "pre_close_nulls": bars.where("pre_close is null").count()}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, bars.collect()), key=str)


def test_bucketed_tables_meet_without_an_exchange(spark, bars):
    from crossweave.sources import datasets

    keys = ["trade_date", "ts_code"]
    a = datasets.materialize_bucketed(bars.select(*keys, "close"), "left", keys, 4)
    b = datasets.materialize_bucketed(bars.where("vol > 50").select(*keys, "vol"), "right", keys, 4)
    joined = a.join(b.hint("merge"), keys, "left")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    want = bars.select(*keys, "close").join(bars.where("vol > 50").select(*keys, "vol"), keys, "left")
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_forest_as_sql_scores_like_the_model(spark):
    import duckdb

    from crossweave.operators import matrix as M

    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (600, 3))
    x[rng.random((600, 3)) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["label"] = np.where(pdf["a"].fillna(0) > 0.3, 2.0, 0.0) + pdf["b"].fillna(0) * 0.5
    pdf["trade_date"] = 20200101 + np.arange(600) % 28
    pdf["ts_code"] = [f"s{i}" for i in range(600)]
    pdf.loc[5, "c"] = np.inf
    df = spark.createDataFrame(pdf)
    window = {"window": 0, "train_start": 20200101, "train_end": 20200114, "valid_start": 20200115, "valid_end": 20200121}
    model = M.fit_window_models(df, [window], ["a", "b", "c"], "label", maxDepth=3, maxIter=5, seed=2)[0]
    want = {r.ts_code: r.score for r in model.transform(df).collect()}
    scored = model.score(df)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {r.ts_code: r.score for r in scored.collect()}
    assert got.keys() == want.keys() and len(set(got.values())) > 5
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-12)
    con = duckdb.connect()
    con.register("rows", pdf)
    sql = re.sub(r"(?<=\d)D\b", "::DOUBLE", model.score_sql()).replace("`", '"')
    other = dict(con.execute(f"SELECT ts_code, {sql} FROM rows").fetchall())
    np.testing.assert_allclose([other[k] for k in want], list(want.values()), rtol=1e-12)
    assert {r.ts_code: r.score for r in model.score(df, most_nodes=1).collect()} == want
