"""Plans that must not gather or repeat work as tables grow."""

from crossweave.operators import matrix as M
from crossweave.operators import price_volume as PV


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_return_shape_computes_each_statistic_of_a_frame_once(spark):
    rows = [(20200000 + i, "a", float(i * i % 7) if i % 5 else None) for i in range(1, 80)]
    out = PV.return_shape(spark.createDataFrame(rows, "trade_date int, ts_code string, pct_chg double"))
    assert optimized(out).count("windowspecdefinition(") <= 8
    assert out.columns == ["trade_date", "ts_code", "pct_chg", "ret_skew_20", "ret_kurt_60"]
    assert out.where("ret_skew_20 is not null").count() > 0 and out.where("ret_kurt_60 is not null").count() > 0


def test_sample_weights_move_no_rows_by_window(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the statistics were taken for large
    try:
        df = spark.createDataFrame([(w, float(i)) for w in (0, 1) for i in range(10)] + [(None, 1.0)], "window int, label double")
        out = M.sample_weights(df, "label", 0.5, 1.0)
        plan = optimized(out)
        assert plan.count("rightHint=(strategy=broadcast)") == plan.count("Join Inner") > 0
        got = out.groupBy("window").avg("sample_weight").collect()
        assert sorted(r[0] for r in got) == [0, 1] and all(abs(r[1] - 1) < 1e-12 for r in got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
