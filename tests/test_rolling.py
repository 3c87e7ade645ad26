"""Window rules against pandas."""

import numpy as np
from tests.frames import fetch, series_frame, to_spark
from pyspark.sql import functions as F

from crossweave.functions.columns import clip, flag, row_mean, safe_div, to_numeric, yyyymmdd
from crossweave.functions.rolling import Series, streak, unbiased_kurtosis, unbiased_skew
from crossweave.operators import price_volume as PV
from crossweave.operators import smoothing as SM

KEYS = ["ts_code", "trade_date"]


def by_stock(pdf, fn):
    return pdf.groupby("ts_code", group_keys=False)[pdf.columns].apply(fn).sort_index()


def test_rolling_with_gaps(spark):
    pdf = series_frame(gaps=True).sort_values(KEYS).reset_index(drop=True)
    s = Series()
    df = to_spark(spark, pdf).withColumns(
        {
            "m": s.mean("vol", 10, 4), "sd": s.std("vol", 10, 4), "hi": s.max("vol", 10, 4), "med": s.median("vol", 10, 4),
            "c": s.corr("close", "vol", 10, 5), "cs": s.cumsum("vol"), "pc": s.pct_change("close", 3),
        }
    )
    got = fetch(df, KEYS)
    g = pdf.groupby("ts_code")["vol"]
    for name, want in {
        "m": g.transform(lambda x: x.rolling(10, min_periods=4).mean()),
        "sd": g.transform(lambda x: x.rolling(10, min_periods=4).std()),
        "hi": g.transform(lambda x: x.rolling(10, min_periods=4).max()),
        "med": g.transform(lambda x: x.rolling(10, min_periods=4).median()),
        "cs": g.cumsum(),
        "pc": pdf.groupby("ts_code")["close"].pct_change(3),
    }.items():
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, atol=1e-9, err_msg=name)
    corr = by_stock(pdf, lambda x: x["close"].rolling(10, min_periods=5).corr(x["vol"]))
    np.testing.assert_allclose(got["c"].astype(float), corr, rtol=1e-7, atol=1e-9)


def test_constant_side_has_no_correlation(spark):
    pdf = series_frame(n_stocks=1, n_dates=20)
    pdf["vol"] = 5.0
    got = to_spark(spark, pdf).withColumn("c", Series().corr("close", "vol", 5, 3)).toPandas()
    assert got["c"].isna().all()


def test_moments(spark, bars_pdf):
    pdf = bars_pdf.sort_values(KEYS).reset_index(drop=True)
    w = Series().frame(-19)
    r = F.col("pct_chg")
    got = fetch(to_spark(spark, pdf).withColumns({"sk": unbiased_skew(r, w), "ku": unbiased_kurtosis(r, w)}), KEYS)
    g = pdf.groupby("ts_code")["pct_chg"]
    np.testing.assert_allclose(got["sk"].astype(float), g.transform(lambda x: x.rolling(20, min_periods=3).skew()), rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(got["ku"].astype(float), g.transform(lambda x: x.rolling(20, min_periods=4).kurt()), rtol=1e-6, atol=1e-8)


def test_streak(spark):
    pdf = series_frame(n_stocks=2, n_dates=8)
    pdf["hit"] = [1, 1, 0, 1, 1, 1, 0, 0, 0, 1, 0, 0, 1, 1, 1, 1]
    got = fetch(streak(to_spark(spark, pdf), F.col("hit") == 1, "run"), KEYS)
    assert got["run"].tolist() == [1, 2, 0, 1, 2, 3, 0, 0, 0, 1, 0, 0, 1, 2, 3, 4]


def test_ema_with_gaps(spark):
    pdf = series_frame(gaps=True).sort_values(KEYS).reset_index(drop=True)
    got = fetch(SM.ema(to_spark(spark, pdf), "vol", "e", 5, 3), KEYS)
    want = pdf.groupby("ts_code")["vol"].transform(lambda x: x.ewm(span=5, adjust=False, min_periods=3).mean())
    np.testing.assert_allclose(got["e"].astype(float), want, rtol=1e-12)


def test_width_of_the_panel_does_not_matter(spark, bars_pdf):
    wide = to_spark(spark, bars_pdf).withColumns({f"k{i}": F.lit(i) for i in range(30)})
    a = fetch(SM.macd(wide), KEYS)
    b = fetch(SM.macd(to_spark(spark, bars_pdf)), KEYS)
    np.testing.assert_allclose(a["macd"].astype(float), b["macd"].astype(float))


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0, "x"), (None, 2.0, "3.5")], "a double, b double, t string")
    r = df.select(
        safe_div("a", "b").alias("d"), clip("a", 0.0, 0.5).alias("c"), flag(F.col("a") > 0).alias("f"),
        row_mean(["a", "b"]).alias("m"), to_numeric("t").alias("n"),
    ).collect()
    assert (r[0].d, r[0].c, r[0].f, r[0].m, r[0].n) == (None, 0.5, 1.0, 0.5, None)
    assert (r[1].d, r[1].c, r[1].f, r[1].m, r[1].n) == (None, None, 0.0, 2.0, 3.5)


def test_dates(spark):
    rows = [("20200230",), ("20200229.0",), (" 20201231 ",), ("2020-01-01",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(yyyymmdd("d")).collect()]
    assert got == [None, 20200229, 20201231, None, None]


def test_no_look_ahead(spark, bars_pdf):
    """Cutting off later rows changes no factor of an earlier date."""
    dates = sorted(bars_pdf["trade_date"].unique())
    cut = dates[40]

    def factors(pdf):
        df = to_spark(spark, pdf)
        for fn in (PV.price_volume_factors, PV.rsi, PV.bollinger, PV.true_range_average, PV.cci, PV.on_balance_volume, SM.macd):
            df = fn(df)
        return fetch(df.where(F.col("trade_date") <= int(cut)), KEYS)

    full, part = factors(bars_pdf), factors(bars_pdf[bars_pdf["trade_date"] <= cut])
    for c in full.columns:
        if c not in KEYS:
            np.testing.assert_allclose(full[c].astype(float), part[c].astype(float), rtol=1e-12, err_msg=c)
