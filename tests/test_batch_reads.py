"""Clipping a whole batch computes the batch once, whatever the number of columns and the plan."""

import numpy as np
import pytest

from crossweave.operators import aggregates as A


@pytest.mark.parametrize("limit", [None, 0])
def test_batch_is_computed_once(spark, limit):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(20200101 + i % 5, f"s{i}", float(i * 37 % 101) if i % 9 else None, float(i * 53 % 97)) for i in range(200)]
    schema = "trade_date int, ts_code string, x double, y double"
    df = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    got = A.global_winsorize(df, ["x", "y"], 0.05, 0.95, limit=limit).orderBy("ts_code").collect()
    assert seen.value == 200
    for k, c in ((2, "x"), (3, "y")):
        known = [r[k] for r in rows if r[k] is not None]
        lo, hi = np.quantile(known, [0.05, 0.95])
        want = [None if r[k] is None else min(max(r[k], lo), hi) for r in sorted(rows, key=lambda r: r[1])]
        assert [r[c] for r in got] == pytest.approx(want)
