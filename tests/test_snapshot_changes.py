"""Membership snapshots: the record that holds is chosen at its changes, before days are unfolded."""

import random

from pyspark.sql import functions as F

from crossweave.operators.intervals import membership_snapshot


def members(spark, rows):
    return spark.createDataFrame(rows, "ts_code string, industry_code string, in_date int, out_date int, is_new string")


def plain(rows, dates):
    out = []
    for t in sorted(set(dates) - {None}):
        for code in {r[0] for r in rows}:
            live = [r for r in rows if r[0] == code and (r[2] or 0) <= t < (99991231 if r[3] is None else r[3])]
            live.sort(key=lambda r: (r[4] is None, [-ord(c) for c in r[4] or ""], -(r[2] or 0), (r[1] is not None, r[1] or "")))
            out += [(*live[0], t)] if live else []
    return sorted(map(str, out))


def test_winner_of_every_date(spark):
    rng = random.Random(5)
    day = lambda: rng.choice([None, *range(20200101, 20200131)])
    rows = [(rng.choice(["A", "B", "C", None]), f"I{i:03}", day(), day(), rng.choice(["Y", "N", None])) for i in range(60)]
    rows += [("D", "late", 20210101, None, "Y"), ("E", "empty", 20200110, 20200105, "Y"), ("F", "one", 20200104, 20200105, "N")]
    dates = [None, *range(20200102, 20200130, 2), 20200104]
    got = membership_snapshot(members(spark, rows), spark.createDataFrame([(d,) for d in dates], "trade_date int"))
    assert got.columns == ["ts_code", "industry_code", "in_date", "out_date", "is_new", "trade_date"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows, dates)


def test_no_date_gives_no_row(spark):
    none = spark.createDataFrame([], "trade_date int")
    assert membership_snapshot(members(spark, [("A", "x", None, None, "Y")]), none).count() == 0


def test_unfolded_days_are_not_moved(spark):
    dates = spark.range(20200101, 20200131).select(F.col("id").cast("int").alias("trade_date"))
    plan = membership_snapshot(members(spark, [("A", "x", None, None, "Y")]), dates)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Generate")] and "Repartition" not in plan[: plan.index("Generate")]
