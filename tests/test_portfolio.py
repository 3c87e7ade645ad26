"""Selection, weights, reports and sizes on hand-computed cases."""

import numpy as np
import pandas as pd
import pytest
from tests.frames import fetch, to_spark
from pyspark.sql import functions as F

from crossweave.operators import aggregates as A
from crossweave.operators import portfolio as P
from crossweave.operators import timing as TM

PANEL = "trade_date int, ts_code string, score double, label double"


@pytest.fixture(scope="module")
def pred(spark):
    rows = [
        (20200101, "a", 3.0, 0.01), (20200101, "b", 2.0, 0.02), (20200101, "c", 1.0, 0.03),
        (20200102, "a", 1.0, 0.01), (20200102, "b", 2.0, 0.02), (20200102, "c", 3.0, 0.03),
    ]
    return spark.createDataFrame(rows, PANEL)


def test_report_by_hand(pred):
    r = fetch(P.top_k_report(pred, 2, 0.001, 100.0), ["trade_date"])
    np.testing.assert_allclose(r["gross_return"], [0.015, 0.025])
    np.testing.assert_allclose(r["turnover"], [1.0, 1.0])  # a half leaves, c half enters
    np.testing.assert_allclose(r["return"], [0.014, 0.024])
    np.testing.assert_allclose(r["benchmark"], [0.02, 0.02])
    np.testing.assert_allclose(r["account_value"], [101.4, 101.4 * 1.024])


def test_weight_changes_cover_exits(pred):
    ch = fetch(P.weight_changes(P.equal_weights(P.top_k(pred, "score", 2))), ["trade_date", "ts_code"])
    day2 = ch[ch.trade_date == 20200102].set_index("ts_code")
    assert day2.loc["a", "w0"] == 0.5 and day2.loc["a", "w1"] == 0.0
    assert day2.loc["c", "w0"] == 0.0 and day2.loc["c", "w1"] == 0.5


def test_sweep_equals_single_reports(pred):
    sweep = P.parameter_sweep(pred, [{"topk": 1}, {"topk": 2}], 0.001).orderBy("topk").collect()
    for k, row in zip((1, 2), sweep):
        single = A.performance(P.top_k_report(pred, k, 0.001), "return").first()
        assert abs(row["total_return"] - single["total_return"]) < 1e-12


def test_large_k_uses_slices(spark, monkeypatch):
    p = pd.DataFrame({"trade_date": 1, "ts_code": [f"s{i:03d}" for i in range(200)], "score": np.arange(200.0) % 17})
    df = to_spark(spark, p)
    small = fetch(P.top_k(df, "score", 60), ["position"])
    monkeypatch.setattr(P, "GROUP_LIMIT", 10)
    assert fetch(P.top_k(df, "score", 60), ["position"])["ts_code"].tolist() == small["ts_code"].tolist()


def test_top_k_filters_before_the_exchange(pred):
    plan = P.top_k(pred, "score", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def quotas(spark, sizes, k, method, cap=None):
    rows = [(1, f"{g}{i:02d}", g) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "trade_date int, ts_code string, l1_name string")
    return {r.industry: r.quota for r in P.industry_quotas(df, k, method, cap).collect()}


def greedy(sizes, k):
    """The sequential rule, spelled out."""
    order = sorted(sizes, key=lambda g: (-sizes[g], g))
    total, left, q = sum(sizes.values()), k, {}
    for g in order:
        q[g] = min(max(1, round(k * sizes[g] / total)), sizes[g], left)
        left -= q[g]
    for g in order:
        if left > 0 and q[g] < sizes[g]:
            q[g] += 1
            left -= 1
    return q


@pytest.mark.parametrize("k", [2, 5, 7, 11, 20])
@pytest.mark.parametrize("sizes", [{"a": 10, "b": 4, "c": 1}, {"a": 5, "b": 5, "c": 5, "d": 1}, {"a": 30, "b": 2}])
def test_proportional_quotas(spark, sizes, k):
    assert quotas(spark, sizes, k, "proportional") == greedy(sizes, k)


def test_equal_quotas(spark):
    assert quotas(spark, {"a": 10, "b": 4, "c": 1}, 8, "equal") == {"a": 3, "b": 3, "c": 1}
    assert quotas(spark, {"a": 10, "b": 4, "c": 1}, 8, "equal", cap=2) == {"a": 2, "b": 2, "c": 1}


def test_pool_keeps_holdings_and_unknown_status(spark):
    alpha = spark.createDataFrame([(1, c, a) for c, a in (("a", 4.0), ("b", 3.0), ("c", 2.0), ("d", 1.0), ("e", None))], "trade_date int, ts_code string, alpha double")
    status = spark.createDataFrame([(1, "a", 1, 0), (1, "b", 0, 0)], "trade_date int, ts_code string, is_st int, is_suspended int")
    held = spark.createDataFrame([(1, "d", 0.1), (1, "a", 0.0)], "trade_date int, ts_code string, weight double")
    got = sorted(r.ts_code for r in P.candidate_pool(alpha, status, held, 2).collect())
    assert got == ["b", "c", "d"]


def test_weights_sum_to_one(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"trade_date": np.repeat([1, 2], 10), "ts_code": [f"s{i}" for i in range(10)] * 2, "score": rng.normal(size=20), "vol": rng.uniform(0, 1, 20)})
    p.loc[3, "vol"] = np.nan
    df = to_spark(spark, p).withColumn("base", F.lit(0.1))
    for w in (P.score_weights(df, "score", 0.1, 2.0), P.inverse_vol_weights(df, "vol"), P.alpha_tilt_weights(df, "score", "base")):
        np.testing.assert_allclose(w.groupBy("trade_date").agg(F.sum("weight").alias("s")).toPandas()["s"], 1.0)


def test_performance_against_pandas(spark):
    rng = np.random.default_rng(2)
    r = pd.Series(rng.normal(0.001, 0.01, 59))
    p = pd.DataFrame({"trade_date": [20200101 + i if i < 31 else 20200201 + i - 31 for i in range(59)], "r": r})
    got = A.performance(to_spark(spark, p), "r").first()
    nav = (1 + r).cumprod()
    assert abs(got["total_return"] - (nav.iloc[-1] - 1)) < 1e-12
    assert abs(got["sharpe"] - r.mean() * 252 / (r.std() * np.sqrt(252))) < 1e-9
    assert abs(got["sortino"] - r.mean() * 252 / (r[r < 0].std() * np.sqrt(252))) < 1e-9
    assert abs(got["max_drawdown"] - (nav / nav.cummax() - 1).min()) < 1e-12
    assert abs(got["skew"] - r.skew()) < 1e-9 and abs(got["kurtosis"] - r.kurt()) < 1e-9


def test_drawdown_interval(spark):
    nav = [1.0, 1.2, 0.9, 1.1, 1.3, 1.0, 1.25]
    df = spark.createDataFrame([(20200101 + i, v) for i, v in enumerate(nav)], "trade_date int, nav double")
    got = TM.drawdown_interval(df).first()
    assert (got.peak_date, got.trough_date) == (20200102, 20200103)
    assert abs(got.max_drawdown + 0.25) < 1e-12


@pytest.mark.parametrize("freq,n", [("daily", 40), ("10d", 4), ("every 20 days", 2), (15, 3), ("month", 2), ("w", 6)])
def test_rebalance_calendar(spark, freq, n):
    days = [int(d.strftime("%Y%m%d")) for d in pd.date_range("2020-01-01", periods=40)]
    df = spark.createDataFrame([(d,) for d in days], "trade_date int")
    assert TM.rebalance_dates(df, freq).count() == n


def test_histogram_counts_every_row(spark):
    p = pd.DataFrame({"trade_date": 1, "x": np.random.default_rng(0).normal(size=500)})
    got = fetch(A.histogram(to_spark(spark, p), "x", 7), ["bin"])
    want = pd.cut(p["x"], bins=7).value_counts(sort=False)
    assert got["count"].tolist() == want.tolist()
