"""The factor plan: what is computed for which factor, in which order, at what cost."""

import os

import pytest

from crossweave.operators import factor_plan as FP
from crossweave.plans.registry import load_all
from crossweave.sources.market import Market

DATA = "/root/testdata/sf0.001"


def test_tables_are_complete():
    assert len(set(FP.ENHANCED_FACTORS)) == 116 and len(set(FP.INDUSTRY_FACTORS)) == 8
    steps = [*FP.report_steps(), *FP.panel_steps()]
    outputs = [o for s in steps for o in s.outputs]
    assert len(outputs) == len(set(outputs))


def test_only_what_is_needed_in_order():
    steps, plain = FP.needed(FP.panel_steps(), ["lg_elg_ratio_20", "industry_rank_roe"])
    assert {o for s in steps for o in s.outputs} >= {"lg_net_ratio", "lg_elg_ratio_20", "ret_20"} and "macd" not in {o for s in steps for o in s.outputs}
    assert "roe" in plain and "l1_name" in plain
    done, seen = FP.ordered(FP.needed(FP.panel_steps(), FP.ENHANCED_FACTORS)[0]), set()
    made = {o for s in done for o in s.outputs}
    for s in done:
        assert not (set(s.inputs) & made) - seen - set(s.outputs)
        seen |= set(s.outputs)
    series = [s.series for s in done]
    assert sum(a != b for a, b in zip(series, series[1:])) == 1  # by stock, then by date and industry
    loop = [FP.step("a", "b", "x", lambda d: d), FP.step("b", "a", "x", lambda d: d)]
    with pytest.raises(ValueError, match="each other"):
        FP.ordered(loop)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_missing_tables_and_columns(spark):
    m = Market(spark, DATA)
    with pytest.raises(ValueError, match="no table has"):
        FP.factor_table(m.bars(), ["roe_stability_8q"])
    with pytest.raises(ValueError, match="no table has"):
        FP.factor_table(m.bars(), ["no_such_factor"])
    out = FP.factor_table(m.bars(), ["rsi_14", "obv"])
    assert out.columns == ["trade_date", "ts_code", "rsi_14", "obv"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(ts_code") <= 2 and "Python" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_exchanges_do_not_grow_with_the_factors(spark):
    plan = load_all()["enhanced_factor_table"].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange " in line]
    assert sum("hashpartitioning(ts_code" in x for x in exchanges) <= 2
    assert sum("hashpartitioning(trade_date" in x for x in exchanges) <= 2
    assert len(exchanges) <= 6 and "Python" not in plan and plan.count("FileScan") <= 2
