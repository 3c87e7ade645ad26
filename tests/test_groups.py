"""Both plans of every group function agree, with each other and with pandas."""

import numpy as np
import pandas as pd
import pytest
from tests.frames import fetch, to_spark
from pyspark.sql import functions as F

from crossweave.functions import groups as G


@pytest.fixture(scope="module")
def panel():
    """One hot date with a third of the rows, heavy ties, gaps, a null group."""
    rng = np.random.default_rng(3)
    n = 900
    dates = np.where(np.arange(n) < n // 3, 20200102, 20200103 + rng.integers(0, 6, n))
    x = np.round(rng.normal(0, 1, n), 1)
    x[rng.random(n) < 0.3] = 0.5
    x = np.where(rng.random(n) < 0.1, np.nan, x)
    pdf = pd.DataFrame({"trade_date": dates, "ts_code": [f"S{i:06d}" for i in range(n)], "x": x})
    pdf["grp"] = np.where(np.arange(n) % 50 == 0, None, np.where(np.arange(n) % 3 == 0, "a", "b"))
    return pdf


@pytest.fixture(scope="module")
def sdf(spark, panel):
    return to_spark(spark, panel).cache()


LARGE = dict(limit=0, slice_rows=40)


@pytest.mark.parametrize("how", [{}, LARGE])
def test_order_position(sdf, panel, how):
    got = fetch(G.order_position(sdf.where("x is not null"), ["trade_date"], [-F.col("x"), "ts_code"], "p", **how), ["ts_code"])
    want = panel.dropna(subset=["x"]).sort_values(["trade_date", "x", "ts_code"], ascending=[True, False, True])
    want["p"] = want.groupby("trade_date").cumcount() + 1
    want = want.sort_values("ts_code").reset_index(drop=True)
    assert (got["p"].to_numpy() == want["p"].to_numpy()).all()
    assert len(got) == len(want)


def test_slices_really_split_the_hot_group(sdf):
    """A task sees a slice of a group, not the group."""
    df = G.order_position(sdf.where("x is not null"), ["trade_date"], ["x", "ts_code"], "p", **LARGE)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line]
    assert windows and all("_slice" in line for line in windows)
    biggest = sdf.where("x is not null").groupBy("trade_date").count().agg(F.max("count")).first()[0]
    assert biggest > 200


@pytest.mark.parametrize("how", [{}, LARGE])
@pytest.mark.parametrize("keys", [["trade_date"], ["trade_date", "grp"]])
def test_rank_pct(sdf, panel, how, keys):
    got = fetch(G.average_rank(sdf, "x", keys, "r", pct=True, **how), ["ts_code"])
    want = panel.groupby(keys)["x"].rank(method="average", pct=True)
    np.testing.assert_allclose(got["r"].astype(float), want, equal_nan=True)


@pytest.mark.parametrize("how", [{}, LARGE])
def test_quantiles(sdf, panel, how):
    qs = {"a": 0.01, "b": 0.5, "c": 0.99}
    got = fetch(G.group_quantiles(sdf, "x", ["trade_date"], qs, **how), ["trade_date"])
    for name, q in qs.items():
        np.testing.assert_allclose(got[name], panel.groupby("trade_date")["x"].quantile(q))


@pytest.mark.parametrize("how", [{}, LARGE])
def test_quantiles_beside_rows(sdf, panel, how):
    got = fetch(G.with_quantiles(sdf, "x", ["trade_date", "grp"], {"m": 0.5}, **how), ["ts_code"])
    want = panel.groupby(["trade_date", "grp"])["x"].transform("median")
    np.testing.assert_allclose(got["m"].astype(float), want, equal_nan=True)


@pytest.mark.parametrize("how", [{}, LARGE])
def test_global_quantile(sdf, panel, how):
    got = G.with_quantiles(sdf, "x", [], {"q": 0.99}, tiebreak=["ts_code"], **how).select("q").distinct().collect()
    assert len(got) == 1 and abs(got[0][0] - panel["x"].quantile(0.99)) < 1e-12


@pytest.mark.parametrize("limit", [None, 0])
def test_group_stats(sdf, panel, limit):
    got = fetch(G.group_stats(sdf, ["trade_date", "grp"], {"m": F.avg("x"), "n": F.count("x")}, limit=limit), ["ts_code"])
    want = panel.groupby(["trade_date", "grp"])["x"].transform("mean")
    np.testing.assert_allclose(got["m"].astype(float), want, equal_nan=True)


def test_bound_is_measured_when_unknown(sdf, panel):
    assert G.measured_group_rows(sdf, "trade_date") == panel.groupby("trade_date").size().max()
    assert G.fits_one_task(sdf, "trade_date", None)
    assert not G.fits_one_task(sdf, "trade_date", G.GROUP_ROW_LIMIT + 1)
