"""Risk model identities and the small numpy pieces."""

import numpy as np
import pandas as pd
import pytest
from tests.frames import fetch, series_frame, to_spark

from crossweave.operators import risk as R

F2 = ["f1", "f2"]


@pytest.fixture(scope="module")
def factor_series():
    rng = np.random.default_rng(4)
    p = pd.DataFrame(rng.normal(0, 0.01, (59, 2)), columns=F2)
    p.insert(0, "trade_date", [20200101 + i if i < 31 else 20200201 + i - 31 for i in range(59)])
    p.loc[10, "f2"] = np.nan
    return p


@pytest.fixture(scope="module")
def holdings():
    rng = np.random.default_rng(6)
    p = pd.DataFrame(rng.normal(size=(8, 2)), columns=F2)
    p.insert(0, "ts_code", [f"s{i}" for i in range(8)])
    p.insert(0, "trade_date", 20200228)
    p["weight"] = rng.dirichlet(np.ones(8))
    p["specific_variance"] = rng.uniform(1e-4, 4e-4, 8)
    return p


def test_rolling_covariance(spark, factor_series):
    got = fetch(R.rolling_covariance(to_spark(spark, factor_series), F2, 20, 10), ["trade_date", "factor_i", "factor_j"])
    for i in (15, 40, 58):
        win = factor_series.iloc[max(0, i - 19) : i + 1].dropna()
        want = np.cov(win[F2].to_numpy(), rowvar=False)
        mine = got[got.trade_date == factor_series["trade_date"][i]]["cov"].to_numpy().reshape(2, 2)
        np.testing.assert_allclose(mine, want, rtol=1e-9)
    assert got["trade_date"].min() == factor_series["trade_date"][9]


def test_shrinkage(spark, factor_series):
    df = to_spark(spark, factor_series)
    s = fetch(R.shrunk_covariance(df, F2, 20, 10), ["trade_date", "factor_i", "factor_j"])
    raw = fetch(R.rolling_covariance(df, F2, 20, 10), ["trade_date", "factor_i", "factor_j"])
    assert s["shrinkage"].between(0, 1).all()
    for d, g in s.groupby("trade_date"):
        m, r = g["cov"].to_numpy().reshape(2, 2), raw[raw.trade_date == d]["cov"].to_numpy().reshape(2, 2)
        delta = g["shrinkage"].iloc[0]
        np.testing.assert_allclose(m, (1 - delta) * r + delta * np.trace(r) / 2 * np.eye(2), rtol=1e-9)
        assert np.linalg.eigvalsh(m).min() > 0


def test_checks_notice_asymmetry(spark):
    good = [(1, "a", "a", 1.0), (1, "b", "b", 2.0), (1, "a", "b", 0.1), (1, "b", "a", 0.1)]
    bad = [(2, "a", "a", -1.0), (2, "b", "b", 2.0), (2, "a", "b", 0.1), (2, "b", "a", 0.2)]
    df = spark.createDataFrame(good + bad, "trade_date int, factor_i string, factor_j string, cov double")
    g = fetch(R.covariance_checks(df), ["trade_date"])
    assert g["all_symmetric"].tolist() == [1, 0] and g["all_positive_diag"].tolist() == [1, 0] and g["all_finite"].tolist() == [1, 1]


def test_portfolio_identities(spark, factor_series, holdings):
    """z'Fz + Σw²D equals w'(XFX' + D)w, and the attribution adds up to one."""
    cov = R.rolling_covariance(to_spark(spark, factor_series), F2, 20, 10)
    h = to_spark(spark, holdings)
    win = factor_series.iloc[39:59].dropna()
    f = np.cov(win[F2].to_numpy(), rowvar=False)
    x, w, d = holdings[F2].to_numpy(), holdings["weight"].to_numpy(), holdings["specific_variance"].to_numpy()
    sigma = x @ f @ x.T + np.diag(d)
    risk = R.portfolio_risk(h, F2, cov).first()
    np.testing.assert_allclose(risk["variance"], w @ sigma @ w, rtol=1e-9)
    att = R.risk_attribution(h, F2, cov)
    assert R.attribution_sum(att).first()["passed"] == 1
    pool = fetch(R.pool_covariance(h, F2, cov), ["code_i", "code_j"])
    np.testing.assert_allclose(pool["cov"].to_numpy().reshape(8, 8), sigma, rtol=1e-9)


def test_residuals_rebuild_returns(spark):
    p = series_frame(n_stocks=20, n_dates=10)
    p["x"] = np.random.default_rng(8).normal(size=len(p))
    p["ret"] = p["pct_chg"] / 100
    df = to_spark(spark, p)
    fit = R.factor_returns(df, ["x"], min_stocks=5)
    res = R.residual_returns(df, ["x"], fit).join(fit, "trade_date").where("residual is not null").toPandas()
    np.testing.assert_allclose(res["intercept"] + res["b_x"] * res["x"] + res["residual"], res["ret"], atol=1e-9)
    q = R.fit_quality(R.residual_returns(df, ["x"], fit)).toPandas()["r_squared"]
    assert q.between(0, 1).all()


def test_beta_of_the_market_is_one_on_average(spark):
    p = series_frame(n_stocks=15, n_dates=50)
    b = R.beta(to_spark(spark, p), 30, 10).toPandas().dropna(subset=["BETA"])
    assert abs(b.groupby("trade_date")["BETA"].mean().iloc[-1] - 1) < 1e-6


def test_specific_risk_square(spark):
    p = series_frame(n_stocks=3, n_dates=40)
    p["residual"] = p["pct_chg"]
    s = R.specific_risk(to_spark(spark, p[["trade_date", "ts_code", "residual"]]), 20, 5).toPandas()
    ok = s["specific_vol"].notna()
    np.testing.assert_allclose(s.loc[ok, "specific_vol"] ** 2, s.loc[ok, "specific_variance"])
    assert s["sample_count"].max() == 20


def test_short_history_takes_the_group_median(spark):
    rows = [(1, "a", 30, 0.2, "g"), (1, "b", 30, 0.4, "g"), (1, "c", 5, None, "g"), (1, "d", 5, None, "h")]
    df = spark.createDataFrame(rows, "trade_date int, ts_code string, sample_count long, specific_vol double, l1_name string")
    df = df.withColumn("specific_variance", df.specific_vol * df.specific_vol)
    got = {r.ts_code: r for r in R.shrink_specific_risk(df, 20).collect()}
    assert abs(got["c"].specific_vol - 0.3) < 1e-12 and got["c"].shrunk == 1
    assert got["d"].specific_vol is None and got["a"].specific_vol == 0.2


def test_conditioning(spark):
    rows = [(1, f"s{i}", float(v) if v else None, None) for i, v in enumerate([1, 2, 3, 4, 100, 0])]
    df = spark.createDataFrame(rows, "trade_date int, ts_code string, specific_variance double, f double")
    got = fetch(R.condition_risk_data(df, ["f"]), ["ts_code"])
    assert got["specific_variance"][5] == 3.0 and (got["f"] == 0).all()
    assert abs(got["specific_variance"][4] - np.quantile([1, 2, 3, 4, 100, 3], 0.95)) < 1e-9


def test_factor_names():
    assert R.split_factors(["SIZE", "L1_BANK", "industry_x", "BETA"]) == (["SIZE", "BETA"], ["L1_BANK", "industry_x"])


def test_attribution_reads_its_tables_once(spark):
    from crossweave.plans.registry import load_all

    out = load_all()["risk_attribution"].run(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3
