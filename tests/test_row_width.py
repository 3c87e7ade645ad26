"""Every window copies its whole row: finished factors do not travel through the windows as columns of their own."""

import random

from pyspark.sql import functions as F

from crossweave.operators import factor_plan as FP


def window_widths(df) -> list[int]:
    nodes, widths = [df._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        n = nodes.pop()
        if n.nodeName() == "Window":
            widths.append(n.output().size())
        nodes += [n.children().apply(i) for i in range(n.children().size())]
    return widths


def bars(spark):
    rnd = random.Random(5)
    rows = [(20200000 + i, c, *[rnd.uniform(1, 9) if rnd.random() > 0.1 else None for _ in range(6)]) for c in ("a", "b", None) for i in range(70)]
    return spark.createDataFrame(rows, "trade_date int, ts_code string, high double, low double, close double, vol double, amount double, pct_chg double")


WANTED = [o for s in FP.panel_steps() if s.series == FP.STOCK and set(s.inputs) <= {"high", "low", "close", "vol", "amount", "pct_chg"} for o in s.outputs]


def test_windows_of_many_factors_stay_narrow(spark):
    out = FP.factor_table(bars(spark), WANTED)
    assert len(WANTED) >= 35 and max(window_widths(out)) <= 40


def test_columns_put_together_are_the_same_columns(spark):
    steps = FP.ordered(FP.needed(FP.panel_steps(), WANTED)[0])
    keys = ["ts_code", "trade_date"]
    many, one = (FP.run_steps(bars(spark), steps, [*keys, *WANTED], block=b).orderBy(*keys).collect() for b in (2, len(steps)))
    assert many == one and len(one) == 210


def test_other_types_and_inputs_that_are_wanted_stay(spark):
    df = spark.createDataFrame([(1, "a", 2, 3.0, None)], "trade_date int, ts_code string, n int, x double, y double")
    steps = [FP.step(f"z{i}", "x" if i < 2 else "n", "s", lambda d, i=i: d.withColumn(f"z{i}", F.col("n") + i * F.col("n"))) for i in range(4)]
    out = FP.run_steps(df, steps, ["trade_date", "ts_code", "y", "z3", "x", "z0"], block=1)
    assert out.columns == ["trade_date", "ts_code", "y", "z3", "x", "z0"] and out.first() == (1, "a", None, 8, 3.0, 2)
