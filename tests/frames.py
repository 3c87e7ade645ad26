"""Frames the tests share: random bars, pandas to Spark and back."""

import numpy as np
import pandas as pd


def series_frame(n_stocks=4, n_dates=60, seed=7, gaps=False):
    """Random bars: one row per date and code."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n_stocks):
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.03, n_dates)))
        for t in range(n_dates):
            c = float(close[t])
            rows.append(
                {
                    "trade_date": 20200101 + t if t < 31 else 20200201 + t - 31 if t < 60 else 20200301 + t - 60,
                    "ts_code": f"S{s:06d}",
                    "open": c * 0.99,
                    "high": c * 1.02,
                    "low": c * 0.97,
                    "close": c,
                    "vol": float(rng.integers(1, 100)),
                    "amount": float(rng.uniform(10, 50)),
                }
            )
    df = pd.DataFrame(rows)
    df["pre_close"] = df.groupby("ts_code")["close"].shift()
    df["pct_chg"] = (df["close"] / df["pre_close"] - 1) * 100
    if gaps:
        df.loc[rng.random(len(df)) < 0.15, "vol"] = np.nan
    return df


def to_spark(spark, pdf):
    """NaN becomes null."""
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).to_dict("records"), schema=_schema(pdf))


def _schema(pdf):
    kinds = {"i": "long", "f": "double", "b": "boolean"}
    fields = []
    for c in pdf.columns:
        kind = kinds.get(pdf[c].dtype.kind, "string")
        if kind == "long" and c.endswith("date"):
            kind = "int"
        fields.append(f"`{c}` {kind}")
    return ", ".join(fields)


def fetch(df, keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
