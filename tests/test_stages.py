"""Statistics put together from shorter stretches equal those of plain windows, and no frame is added up row by row."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from crossweave.functions import stages as S
from crossweave.functions.rolling import Series, unbiased_kurtosis, unbiased_skew
from crossweave.operators import factor_plan as FP


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    x = lambda c: None if rnd.random() < 0.2 else 1e6 + rnd.gauss(0, 1) if c == "far" else 0.1 if c == "flat" else rnd.gauss(0, 1) * 10 ** rnd.randrange(4)
    data = [(i, c, x(c), x("any")) for c in ("a", "far", "flat", None) for i in range(130)]
    return spark.createDataFrame([*data, *[(i, "empty", None, None) for i in range(8)]], "trade_date int, ts_code string, x double, y double").cache()


@pytest.mark.parametrize("n, m", [(1, 1), (3, 1), (5, 3), (9, 5), (14, 10), (20, 10), (47, 2), (60, 30), (103, 3)])
def test_frames(rows, n, m):
    s = Series()
    w = s.frame(-(n - 1))
    enough = lambda c, k: F.when(F.count("x").over(w) >= max(m, k), c)
    plain = {
        "mean": s.mean("x", n, m), "total": s.sum("x", n, m), "hi": s.max("x", n, m), "lo": s.min("x", n, m), "std": s.std("x", n, m),
        "corr": s.corr("x", "y", n, m), "product": s.roll(F.product, F.col("y"), n, m), "skew": enough(unbiased_skew(F.col("x"), w), 3),
        "kurtosis": enough(unbiased_kurtosis(F.col("x"), w), 4), "back": F.when(F.count("x").over(s.frame(-(n + 2), -3)) >= m, F.avg("x").over(s.frame(-(n + 2), -3))),
    }

    def asked():
        asks = [S.mean("x", n, m), S.total("x", n, m), S.highest("x", n, m), S.lowest("x", n, m), S.std("x", n, m), S.corr("x", "y", n, m), S.product("y", n, m),
                S.skew("x", n, m), S.kurtosis("x", n, m), S.mean("x", n, m, back=3)]
        return dict(zip(plain, (yield asks)))

    keys = ["ts_code", "trade_date"]
    want = rows.withColumns(plain).orderBy(*keys).collect()
    got = S.together(rows, [asked()]).orderBy(*keys).collect()
    assert len(got) == len(want) == 528
    for a, b in zip(got, want):
        for c in plain:
            close = a[c] is not None and b[c] is not None and math.isclose(a[c], b[c], rel_tol=1e-6, abs_tol=1e-7)
            assert a[c] is b[c] is None or close, (c, n, a, b)


def test_flat_windows_have_exactly_no_spread(rows):
    def asked():
        (sd,) = yield [S.std("x", 20, 2)]
        return {"sd": sd}

    assert S.together(rows, [asked()]).where("ts_code = 'flat' and sd <> 0").count() == 0


def test_operators_together_equal_operators_alone_without_sliding_frames(spark):
    bars = spark.createDataFrame(
        [(20200000 + i, c, *[math.sin(i * (k + 2)) + 3 + k if (i + k) % 9 else None for k in range(6)]) for c in "ab" for i in range(90)],
        "trade_date int, ts_code string, high double, low double, close double, vol double, amount double, pct_chg double",
    )
    steps = [s for s in FP.panel_steps() if hasattr(s.add, "stages") and set(s.inputs) <= set(bars.columns)]
    keys = ["ts_code", "trade_date"]
    both = S.together(bars, [s.add.stages() for s in steps])
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(RowFrame, ([^,]+), ([^)]+)\)", plan)
    assert len(steps) >= 20 and frames and all(lo.startswith("unbounded") or lo == hi for lo, hi in frames)
    got = both.orderBy(*keys).collect()
    for s in steps:
        alone = s.add(bars).orderBy(*keys).select(*s.outputs).collect()
        assert [tuple(r[o] for o in s.outputs) for r in got] == [tuple(r) for r in alone], s.outputs


def test_sums_in_order_are_those_of_plain_windows(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, "a", rnd.choice([0.1, -0.1, 0.2, -0.2, 0.3, -0.3, None])) for i in range(400)], "trade_date int, ts_code string, x double")
    w5, w15 = Series().frame(-4), Series().frame(-19, -5)

    def asked():
        five, fifteen = yield [S.mean("x", 5, 3), S.mean("x", 15, 8, back=5, in_order=True)]
        return {"five": five, "fifteen": fifteen}

    got = S.together(df, [asked()])
    plain = {"p5": F.when(F.count("x").over(w5) >= 3, F.avg("x").over(w5)), "p15": F.when(F.count("x").over(w15) >= 8, F.avg("x").over(w15))}
    assert got.withColumns(plain).where("not (five <=> p5) or not (fifteen <=> p15)").count() == 0
