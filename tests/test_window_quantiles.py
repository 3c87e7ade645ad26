"""Quantiles and rounding of wide tables: array aggregates over the group, decimal text only near ties."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crossweave.functions.columns import rounded
from crossweave.functions.groups import with_column_quantiles


@pytest.fixture(scope="module")
def wide(spark):
    value = F.when(F.col("id") % 7 != 0, F.round(F.rand(3) * 50, 1))
    odd = F.when(F.col("id") % 97 == 0, F.lit(float("nan"))).otherwise(-value)
    day = F.when(F.col("id") % 11 != 0, F.col("id") % 5)
    return spark.range(3000).select(
        day.alias("d"), F.col("id").cast("string").alias("ts_code"), value.alias("a"), odd.alias("b"),
        F.when(F.col("id") % 5 == 2, F.col("id")).cast("int").alias("c"),
    ).cache()


def test_quantiles_equal_percentile(wide):
    wanted = {x: {f"{x}_lo": 0.01, f"{x}_mid": 0.5, f"{x}_hi": 0.99} for x in "abc"}
    got = with_column_quantiles(wide, wanted, "d", group_rows=3000)
    w = Window.partitionBy("d")
    exact = {n: F.when(F.col("d").isNotNull(), F.percentile(x, F.lit(q)).over(w)) for x, qs in wanted.items() for n, q in qs.items()}
    want = wide.withColumns(exact)
    assert got.columns == want.columns
    key = ["ts_code", *exact]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, want.select(key).collect()))


def test_quantiles_keep_no_map_of_values(wide):
    plan = with_column_quantiles(wide, {"a": {"lo": 0.01}}, "d", group_rows=3000)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_rounded_equals_round(spark):
    x = (F.rand(1) - 0.5) * F.pow(F.lit(10.0), F.floor(F.rand(2) * 16 - 3))
    ties = F.floor(F.rand(3) * 2000 - 1000) / 2e6
    odd = F.array(*[F.lit(v) for v in (float("nan"), float("inf"), float("-inf"), None, -0.0, -1e-9, 1e300, 0.5, -0.5)])
    rows = spark.range(20000).select(F.explode(F.concat(F.array(x, ties), F.when(F.col("id") == 0, odd).otherwise(F.array()))).alias("x")).cache()
    for digits in (0, 2, 4, 6):
        apart = ~F.col("mine").cast("string").eqNullSafe(F.col("built_in").cast("string"))
        assert rows.select(rounded("x", digits).alias("mine"), F.round("x", digits).alias("built_in")).where(apart).count() == 0


def test_queries_leave_out_methods_too_large_to_compile(spark):
    from __spark_entry__ import queries

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    queries()["latest_factor"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_dirty_reports_read_the_lines_once(spark):
    from crossweave.sources.market import Market

    plan = Market(spark, "/root/testdata/sf0.001").reports_dirty()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") and plan.count("Relation [") == 1
