"""A key that holds a third of all rows: slices and blocks give the rows that one window gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.frames import fetch, series_frame, to_spark

from crossweave.functions import groups as G
from crossweave.functions.rolling import by_blocks
from crossweave.operators import joins as J
from crossweave.operators import price_volume as PV
from crossweave.operators import risk as R


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """Rows and records: key "h" has half of them, many on one date; null keys, dates and values; repeated rows."""
    rng = random.Random(11)
    key = lambda: rng.choice(["h"] * 5 + ["a", "b", "c", "d", None])
    date = lambda: rng.choice([None, 500] + list(range(1, 1000)))
    left = [(date() if i % 9 else 500, key() if i % 9 else "h", i // 2) for i in range(1200)]
    right = [(key(), date(), i, rng.choice([None, float(i)])) for i in range(150)]
    return spark.createDataFrame(left, "trade_date int, ts_code string, n int"), spark.createDataFrame(right, "ts_code string, ann_date int, end_date int, v double")


@pytest.mark.parametrize("slice_rows", [40, 400, None])
def test_asof_across_slices(hot, slice_rows):
    left, right = hot
    want = rows_of(J.asof_join(left, right, ["ann_date", "v"]))
    sliced = J.asof_join(left, right, ["ann_date", "v"], series_rows=None, limit=100, slice_rows=slice_rows)
    assert rows_of(sliced) == want and len(want) == 1200
    assert sliced.columns == [*left.columns, "ann_date", "v"]


def test_asof_against_a_plain_search(hot):
    left, right = hot
    records = [r for r in right.collect() if r.ts_code and r.ann_date]
    got = J.asof_join(left.where("ts_code is not null and trade_date is not null"), right.where("ann_date is not null"), ["end_date"], series_rows=None, limit=0, slice_rows=60)
    for r in got.collect():
        known = [(x.ann_date, x.end_date) for x in records if x.ts_code == r.ts_code and x.ann_date <= r.trade_date]
        assert r.end_date == (max(known)[1] if known else None)


def test_a_hot_key_is_divided(spark, hot):
    left, right = hot
    lone = left.where("ts_code = 'h'").select("ts_code", "trade_date", "n")
    split = G.range_slices(lone, ["ts_code"], ["trade_date", F.xxhash64("n")], 50)
    sizes = [r["count"] for r in split.groupBy("_slice").count().collect()]
    assert len(sizes) > 5 and max(sizes) < lone.count() / 3


def test_interval_join_across_slices(hot):
    left, right = hot
    spans = right.select("ts_code", F.col("ann_date").alias("in_date"), (F.col("ann_date") + F.col("end_date") % 90).alias("out_date"), F.col("end_date").alias("label"))
    for closed in ("left", "both"):
        want = rows_of(J.interval_join(left, spans, ["label"], closed=closed))
        assert rows_of(J.interval_join(left, spans, ["label"], closed=closed, series_rows=None, limit=100)) == want


def test_empty_sides(spark, hot):
    left, right = hot
    sliced = dict(series_rows=None, limit=-1)
    assert J.asof_join(left.limit(0), right, ["v"], **sliced).count() == 0
    assert J.asof_join(left, right.limit(0), ["v"], **sliced).where("v is null").count() == 1200


@pytest.fixture(scope="module")
def long_bars(spark):
    """One instrument with 200 of 260 rows."""
    pdf = series_frame(1, 200, gaps=True)
    pdf["trade_date"] = range(1, 201)
    rest = series_frame(3, 20, seed=9)
    rest["ts_code"] = "T" + rest["ts_code"]
    return to_spark(spark, pdf).unionByName(to_spark(spark, rest))


@pytest.mark.parametrize(("block", "slice_rows"), [(61, 30), (90, None), (1, 70)])
def test_windows_by_blocks(long_bars, block, slice_rows):
    want = fetch(PV.price_volume_factors(long_bars), ["ts_code", "trade_date"])
    out = by_blocks(long_bars, PV.price_volume_factors, reach=60, limit=50, block_rows=block, slice_rows=slice_rows)
    got = fetch(out, ["ts_code", "trade_date"])
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in PV.PRICE_VOLUME:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, equal_nan=True)


def test_labels_look_ahead_by_blocks(long_bars):
    s = PV.BY_STOCK
    add = lambda df: df.withColumns({"next": s.lead("close", 5), "past": s.lag("close", 3)})
    got = by_blocks(long_bars, add, reach=3, ahead=5, limit=0, block_rows=7, slice_rows=25)
    assert rows_of(got) == rows_of(add(long_bars))


def test_covariance_over_many_stretches(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e4, 0.01, (95, 3))  # far from zero: sums of squares alone would lose the digits
    x[rng.random(95) < 0.2, 1] = np.nan
    x[20:45, 2] = np.nan  # a whole window without complete rows
    names = ["f", "g", "h x"]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "trade_date int, f double, g double, `h x` double")
    got = {(r.trade_date, r.factor_i, r.factor_j): r.cov for r in R.rolling_covariance(df, names, 12, 4).collect()}
    want = {}
    for d in range(95):
        win = x[max(0, d - 11) : d + 1]
        win = win[~np.isnan(win).any(axis=1)]
        if len(win) >= 4:
            c = np.cov(win, rowvar=False)
            want.update({(d, names[i], names[j]): c[i, j] for i in range(3) for j in range(3)})
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-6, atol=1e-9)
