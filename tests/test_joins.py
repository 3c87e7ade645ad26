"""Point-in-time and interval joins on hand-made and random tables."""

import numpy as np
import pandas as pd
import pytest
from tests.frames import fetch, to_spark

from crossweave.operators import intervals as I
from crossweave.operators import joins as J


def test_asof_against_pandas(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2020-01-01", periods=120)
    left = pd.DataFrame(
        [(int(d.strftime("%Y%m%d")), f"S{s}") for s in range(5) for d in days], columns=["trade_date", "ts_code"]
    )
    rows = []
    for s in range(5):
        for d in rng.choice(len(days), 15, replace=False):
            rows.append((f"S{s}", int(days[d].strftime("%Y%m%d")), int(rng.integers(1, 1000)), float(rng.normal())))
    right = pd.DataFrame(rows, columns=["ts_code", "ann_date", "end_date", "v"])
    got = fetch(J.asof_join(to_spark(spark, left), to_spark(spark, right), ["ann_date", "v"]), ["ts_code", "trade_date"])
    l, r = left.sort_values("trade_date"), right.sort_values("ann_date")
    want = pd.merge_asof(l, r, left_on="trade_date", right_on="ann_date", by="ts_code").sort_values(["ts_code", "trade_date"])
    np.testing.assert_allclose(got["v"].astype(float), want["v"], equal_nan=True)


def test_asof_tie_takes_latest_period(spark):
    left = spark.createDataFrame([(20200105, "a")], "trade_date int, ts_code string")
    right = spark.createDataFrame(
        [("a", 20200105, 20190930, 1.0), ("a", 20200105, 20191231, 2.0)], "ts_code string, ann_date int, end_date int, v double"
    )
    assert J.asof_join(left, right, ["v"]).first()["v"] == 2.0


def test_interval_ends(spark):
    left = spark.createDataFrame([(d, "a") for d in (1, 5, 9, 10, 20)], "trade_date int, ts_code string")
    right = spark.createDataFrame([("a", 1, 9, "x"), ("a", 9, None, "y")], "ts_code string, in_date int, out_date int, lab string")
    half = [r.lab for r in J.interval_join(left, right, ["lab"]).orderBy("trade_date").collect()]
    both = [r.lab for r in J.interval_join(left, right, ["lab"], closed="both", first=True).orderBy("trade_date").collect()]
    assert half == ["x", "x", "y", "y", "y"]
    assert both == ["x", "x", "x", "y", "y"]


def test_expiring_join_clears_ended_records(spark):
    left = spark.createDataFrame([(d, "a") for d in (1, 4, 5, 8)], "trade_date int, ts_code string")
    right = spark.createDataFrame([("a", 1, 5, "x"), ("a", 7, None, "y")], "ts_code string, in_date int, out_date int, lab string")
    got = [r.lab for r in J.expiring_asof_join(left, right, ["lab"]).orderBy("trade_date").collect()]
    assert got == ["x", "x", None, "y"]


def test_keyed_join_rejects_duplicates(spark):
    p = spark.createDataFrame([(1, "a")], "trade_date int, ts_code string")
    f = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "trade_date int, ts_code string, v double")
    with pytest.raises(ValueError):
        J.left_join_key(p, f)


def test_signal_dates(spark):
    t = spark.createDataFrame([(d,) for d in (20200101, 20200105, 20200110)], "trade_date int")
    s = spark.createDataFrame([(d,) for d in (20200101, 20200104)], "trade_date int")
    pick = lambda k: [r.signal_date for r in J.signal_dates(t, s, k).orderBy("trade_date").collect()]
    assert pick(0) == [20200101, 20200104, 20200104]
    assert pick(1) == [None, 20200104, 20200104]
    assert pick(2) == [None, 20200101, 20200101]


def test_daily_status_overlap(spark):
    rows = [("a", "ST x", 20200101, 20200103, 20200101), ("a", "*ST x", 20200103, None, 20200103), ("b", "y", 20200102, 20200104, 20200102)]
    df = spark.createDataFrame(rows, "ts_code string, name string, start_date int, end_date int, ann_date int")
    got = fetch(I.daily_name_status(df), ["ts_code", "trade_date"])
    assert len(got) == 8
    a = got[got.ts_code == "a"]
    assert a["st_stock"].tolist() == [1, 1, 0, 0] and a["star_st_stock"].tolist() == [0, 0, 1, 1]
    assert got[got.ts_code == "b"]["no_st_stock"].tolist() == [1, 1, 1, 1]


def test_snapshot_prefers_current_record(spark):
    rows = [("a", "C2", "old", 20200101, None, "N"), ("a", "C1", "new", 20200101, 20200103, "Y")]
    m = spark.createDataFrame(rows, "ts_code string, industry_code string, industry string, in_date int, out_date int, is_new string")
    d = spark.createDataFrame([(20200102,), (20200103,)], "trade_date int")
    got = [r.industry for r in I.membership_snapshot(m, d).orderBy("trade_date").collect()]
    assert got == ["new", "old"]


def test_stitch_later_frame_wins(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "trade_date int, ts_code string, v double")
    b = spark.createDataFrame([(2, "a", 9.0)], "trade_date int, ts_code string, v double")
    got = I.stitch_keep_last([a, b], ["trade_date", "ts_code"]).orderBy("trade_date").collect()
    assert [r.v for r in got] == [1.0, 9.0]


def test_daily_status_unfolds_periods_without_a_join_of_days(spark):
    schema = "ts_code string, name string, start_date int, end_date int, ann_date int"
    rows = [
        ("a", "ST x", 20200105, 20200120, None), ("a", "*ST x", 20200105, 20200110, 20200105), ("a", "x", 20200112, 20200113, 20200112),
        ("a", "ST x", 20200105, 20200120, None), ("b", "*ST y", 20200301, 20200201, 20200301), (None, "ST z", 20200101, 20200331, 20200101),
    ]
    df = I.daily_name_status(spark.createDataFrame(rows, schema))
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert not any("Join" in line for line in plan[:first])
    got = {(r.ts_code, r.trade_date): r.st_stock + 2 * r.star_st_stock for r in df.collect()}
    assert len(got) == df.count() == 3 * 91
    a = {d: s for (c, d), s in got.items() if c == "a"}
    assert [a[20200100 + d] for d in range(4, 16)] == [0, 2, 2, 2, 2, 2, 2, 1, 0, 0, 1, 1] and a[20200121] == 0
    assert not any(s for (c, _), s in got.items() if c != "a")
