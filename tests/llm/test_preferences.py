"""Common prefixes, rendering and masks."""

from crossweave.llm.preferences import format_preferences, swapped_answers

SCHEMA = "pair_id long, turn int, role string, text string, status string"


def run(spark, chosen, rejected):
    frames = [spark.createDataFrame([(*r, "x") for r in rows], SCHEMA) for rows in (chosen, rejected)]
    return {r.pair_id: r for r in format_preferences(*frames).collect()}


def shown(*turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def covered(row, side):
    return [row[side][s.start : s.stop] for s in row[side + "_mask"]]


def test_prompt_completions_and_masks(spark):
    talk = [("system", "s"), ("user", "q😀"), ("assistant", "a"), ("user", "q2")]
    chosen = [(1, i, *t) for i, t in enumerate([*talk, ("assistant", "gööd"), ("user", "thanks"), ("assistant", "")])]
    rejected = [(1, i * 10, *t) for i, t in enumerate([*talk, ("assistant", "bad")])]
    row = run(spark, chosen[::-1], rejected)[1]
    assert (row.status, row.prefix_turns, row.prompt) == ("pair", 4, shown(*talk))
    assert row.chosen == shown(("assistant", "gööd"), ("user", "thanks"), ("assistant", "")) and row.rejected == shown(("assistant", "bad"))
    assert covered(row, "chosen") == ["gööd<|im_end|>", "<|im_end|>"] and covered(row, "rejected") == ["bad<|im_end|>"]


def test_defined_cases(spark):
    u, a = ("user", "x"), ("assistant", "y")
    chosen = [(1, 0, *u), (1, 1, *a), (2, 0, *u), (3, 0, *u), (3, 1, *a), (5, 0, None, None), (5, 1, "user", "<|im_end|>"), (6, 0, *u), (6, 0, *u), (None, 0, *u), (7, None, *a), (7, 0, *u)]
    rejected = [(1, 0, *u), (1, 1, *a), (3, 0, *u), (4, 0, *u), (5, 0, None, ""), (6, 0, *u), (6, 1, *a), (7, 1, *u)]
    got = run(spark, chosen, rejected)
    assert {k: (r.status, r.prefix_turns) for k, r in got.items()} == {
        1: ("identical", 2), 2: ("chosen_only", 0), 3: ("prefix", 1), 4: ("rejected_only", 0), 5: ("prefix", 1), 6: ("prefix", 1), 7: ("pair", 0)}
    assert got[5].prompt == shown(("unknown", "")) and got[5].chosen == shown(("user", "<| im_end|>"))
    assert got[7].chosen == shown(a, u)
    assert got[2].prompt == "" and got[2].rejected == "" and got[2].chosen == shown(u)
    assert run(spark, [], []) == {}
    long = run(spark, [(1, i, *u) for i in range(700)], [(1, i, *u) for i in range(699)] + [(1, 699, "user", "z" * 100_000)])[1]
    assert long.prefix_turns == 699 and len(long.rejected) > 100_000


def test_swapped_answers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "t"), (2, 0, "assistant", "b0"), (2, 1, "assistant", "b1"), (3, 0, "user", "z"), (None, 0, "assistant", "n")]
    out = swapped_answers(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted(map(tuple, out)) == [(1, 0, "user", "q"), (1, 1, "assistant", "b1")]


def test_swapped_answers_over_gaps(spark):
    ids = [1, 4, 5, 9, 1000, 5_000_000_000]
    rows = [(i, k, r, f"{r}{i}") for i in ids for k, r in enumerate(("user", "assistant"))] + [(7, 0, "user", "no answer")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    given = {r.conv_id: r.text for r in swapped_answers(turns).where("role = 'assistant'").collect()}
    assert given == {a: f"assistant{b}" for a, b in zip(ids, ids[1:])}
    pairs = {r.conv_id: r.status for r in format_preferences(turns, swapped_answers(turns), pair_col="conv_id").collect()}
    assert pairs == {**dict.fromkeys(ids[:-1], "pair"), ids[-1]: "chosen_only", 7: "chosen_only"}
    assert swapped_answers(turns.limit(0)).count() == 0


def test_only_built_in_functions(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x", "s")], SCHEMA)
    turns = spark.createDataFrame([(k, 0, "assistant", "x") for k in range(3)], "conv_id long, turn int, role string, text string")
    plan = format_preferences(frame, frame)._jdf.queryExecution().executedPlan().toString()
    plan += swapped_answers(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
