"""Normalisation, validation and least squares against pandas and numpy, on both plans."""

import numpy as np
import pandas as pd
import pytest
from tests.frames import fetch, to_spark

from crossweave.operators import cross_section as X
from crossweave.operators import ic as I


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    rows = []
    for d in range(6):
        for s in range(40):
            rows.append((20200101 + d, f"S{s:03d}", round(rng.normal(), 3), round(rng.normal(), 3), rng.normal(), rng.normal(), rng.uniform(0.5, 2)))
    df = pd.DataFrame(rows, columns=["trade_date", "ts_code", "score", "label", "a", "b", "w"])
    df["l1_name"] = np.where(df.index % 7 == 0, None, np.where(df.index % 2 == 0, "p", "q"))
    df.loc[df.index % 13 == 0, "score"] = np.nan
    df.loc[df.trade_date == 20200106, "b"] = np.nan
    return df


@pytest.fixture(scope="module")
def sdf(spark, pdf):
    return to_spark(spark, pdf).cache()


@pytest.mark.parametrize("limit", [None, 0])
def test_process_factors(sdf, pdf, limit):
    got = fetch(X.process_factors(sdf, ["score"], neutral=["score"], limit=limit), ["trade_date", "ts_code"])["score_cc_processed"]
    w = pdf.copy()
    w["v"] = w.groupby("trade_date")["score"].transform(lambda x: x.clip(x.quantile(0.01), x.quantile(0.99)))
    w["v"] = w["v"] - w.groupby(["trade_date", "l1_name"])["v"].transform("mean")
    w["v"] = w.groupby("trade_date")["v"].transform(lambda x: (x - x.mean()) / x.std())
    np.testing.assert_allclose(got.astype(float), w.sort_values(["trade_date", "ts_code"])["v"], equal_nan=True, atol=1e-12)


def test_missing_factor(sdf):
    with pytest.raises(ValueError):
        X.process_factors(sdf, ["nope"])
    assert "nope_cc_processed" not in X.process_factors(sdf, ["nope", "a"], missing="skip").columns


def test_zscore_without_spread_only_centres(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 3.0)], "trade_date int, ts_code string, x double")
    assert [r.x for r in X.zscore(df, ["x"]).collect()] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("limit", [None, 0])
def test_alpha_has_zero_mean_unit_deviation(sdf, limit):
    got = X.standardize_alpha(sdf, "score", "z", industry="l1_name", styles=["a"], limit=limit).toPandas()
    g = got.groupby("trade_date")["z"]
    np.testing.assert_allclose(g.mean(), 0, atol=1e-12)
    np.testing.assert_allclose(g.std(ddof=0), 1, atol=1e-12)


@pytest.mark.parametrize("limit", [None, 0])
def test_least_squares(sdf, pdf, limit):
    """Against numpy, with an all-null column on the last date and incomplete rows."""
    fit = fetch(X.group_least_squares(sdf, "score", ["a", "b"], weight="w", limit=limit), ["trade_date"])
    res = fetch(X.least_squares_residual(sdf, "score", ["a", "b"], "res", weight="w", limit=limit), ["trade_date", "ts_code"])
    for d, g in pdf.groupby("trade_date"):
        cols = [c for c in ("a", "b") if g[c].notna().any()]
        v = g.dropna(subset=["score", *cols])
        z = np.column_stack([np.ones(len(v)), v[cols]])
        sw = np.sqrt(v["w"].to_numpy())
        beta = np.linalg.lstsq(z * sw[:, None], v["score"] * sw, rcond=None)[0]
        row = fit[fit.trade_date == d].iloc[0]
        np.testing.assert_allclose([row["intercept"], *[row[f"b_{c}"] for c in cols]], beta, rtol=1e-8)
        assert row["n_rows"] == len(v)
        if "b" not in cols:
            assert pd.isna(row["b_b"])
        mine = res[(res.trade_date == d) & res.ts_code.isin(v.ts_code)].sort_values("ts_code")["res"].astype(float)
        np.testing.assert_allclose(mine, v["score"] - z @ beta, atol=1e-9)


def test_collinear_columns_take_the_smallest_solution(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"trade_date": 1, "ts_code": [f"s{i}" for i in range(20)], "x": rng.normal(size=20)})
    p["x2"], p["y"] = p["x"], 1 + 2 * p["x"]
    fit = X.group_least_squares(to_spark(spark, p), "y", ["x", "x2"]).first()
    np.testing.assert_allclose([fit["b_x"], fit["b_x2"]], [1, 1], atol=1e-8)


def _spearman(a, b):
    return a.rank().corr(b.rank())


@pytest.mark.parametrize("limit", [None, 0])
def test_daily_ic(sdf, pdf, limit):
    got = fetch(I.daily_ic(sdf, min_rows=5, limit=limit), ["trade_date"])
    v = pdf.dropna(subset=["score", "label"])
    np.testing.assert_allclose(got["ic"], [g["score"].corr(g["label"]) for _, g in v.groupby("trade_date")])
    np.testing.assert_allclose(got["rank_ic"], [_spearman(g["score"], g["label"]) for _, g in v.groupby("trade_date")])


def test_ic_is_null_for_constant_or_short(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, 1.0), (1, "b", 1.0, 2.0), (1, "c", 1.0, 3.0), (2, "a", 1.0, 2.0)], "trade_date int, ts_code string, score double, label double"
    )
    assert [r.ic for r in I.daily_ic(df, min_rows=3).collect()] == [None, None]


@pytest.mark.parametrize("limit", [None, 0])
def test_group_returns(sdf, pdf, limit):
    got = fetch(I.group_returns(sdf, groups=5, limit=limit), ["trade_date"])
    for i, (d, g) in enumerate(pdf.groupby("trade_date")):
        s = g.dropna(subset=["score"]).sort_values(["score", "ts_code"], ascending=[False, True])["label"].to_numpy()
        k = len(s) // 5
        np.testing.assert_allclose([got[f"group{j + 1}"][i] for j in range(5)], [s[k * j : k * (j + 1)].mean() for j in range(5)])
        assert abs(got["long_average"][i] - (s[:k].mean() - g["label"].mean())) < 1e-12


@pytest.mark.parametrize("limit", [None, 0])
def test_turnover(sdf, pdf, limit):
    got = fetch(I.bucket_turnover(sdf, limit=limit), ["trade_date"])
    p = pdf.sort_values(["ts_code", "trade_date"]).copy()
    p["last"] = p.groupby("ts_code")["score"].shift()
    want = []
    for d, g in p.groupby("trade_date"):
        if g["last"].notna().sum() == 0:
            continue
        k = len(g) // 5
        top = lambda c: set(g.dropna(subset=[c]).sort_values([c, "ts_code"], ascending=[False, True])["ts_code"][:k])
        want.append(1 - len(top("score") & top("last")) / k)
    np.testing.assert_allclose(got["top"], want)


def test_validation_matches_single_analyses(sdf):
    v = sdf.where("score is not null")
    one = I.validate_features(v, ["score", "a"], topk=8).where("feature = 'score'").first()
    assert abs(one["ic_mean"] - I.ic_summary(I.daily_ic(v)).first()["ic_mean"]) < 1e-12
    assert abs(one["mean_long_short"] - I.group_return_summary(I.group_returns(v)).first()["mean_long_short"]) < 1e-12
    spread = I.long_short(v, 8).toPandas()["long_short"].mean()
    assert abs(one["mean_topk_spread"] - spread) < 1e-12
    assert abs(one["mean_top_turnover"] - I.bucket_turnover(v).toPandas()["top"].mean()) < 1e-12


def test_label_inference(spark):
    mk = lambda schema: spark.createDataFrame([], schema)
    assert I.infer_label_column(mk("trade_date int, score double, label_5d double, other double")) == "label_5d"
    assert I.infer_label_column(mk("trade_date int, score double, ret double")) == "ret"
    with pytest.raises(ValueError):
        I.infer_label_column(mk("score double, a double, b double"))
