"""Validation of many features: dates that fit one task are sorted as arrays, larger ones by windows, with the same result."""

import math
import random

import pytest

from crossweave.operators import ic as I


def table(spark, features=20):
    rnd = random.Random(11)
    rows = []
    for t in range(9):
        for c in [None, *(f"S{i}" for i in range(23))]:
            if rnd.random() > 0.1:
                values = [None if rnd.random() < 0.2 else float(rnd.randrange(6)) if f % 3 else rnd.gauss(0, 1) for f in range(features)]
                values[3], values[4] = 2.5, values[4] if t % 2 else None  # no spread; dates without values
                values[5] = rnd.choice([values[5], math.inf, -math.inf, 0.0, -0.0])
                rows.append((None if t == 8 else 20200101 + t, c, None if rnd.random() < 0.1 else round(rnd.gauss(0, 1), 1), *values))
    names = [f"f{i}" for i in range(features)]
    return spark.createDataFrame(rows, "trade_date int, ts_code string, label double, " + ", ".join(f"{n} double" for n in names)), names


def same(a, b):
    a, b = (sorted(map(tuple, x.collect())) for x in (a, b))
    assert [r[0] for r in a] == [r[0] for r in b]
    for x, y in zip(a, b):
        for v, w in zip(x[1:], y[1:]):
            assert (v is None) == (w is None) and (v is None or v == w or math.isnan(v) and math.isnan(w) or abs(v - w) < 1e-9), (x, y)


@pytest.mark.parametrize("topk", [3, 40])
def test_both_plans_validate_alike(spark, topk):
    df, names = table(spark)
    args = dict(topk=topk, min_rows=4, ic_digits=12)
    same(I.validate_features(df, names, **args), I.validate_features(df, names, **args, limit=0))


def test_both_plans_screen_alike(spark):
    df, names = table(spark)
    same(I.screen_factors(df, names, min_rows=4, ic_digits=12), I.screen_factors(df, names, min_rows=4, ic_digits=12, limit=0))


def test_features_share_the_rows(spark):
    df, names = table(spark)
    plan = I.feature_days(df, names, "label", 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3 and "Expand" not in plan and "rank(" not in plan
