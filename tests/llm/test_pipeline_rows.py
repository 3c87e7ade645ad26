"""Rows that repeat id and text, and copies without an id: one row of each group is left by the stages that drop copies."""

import random
from collections import Counter

import corpus_pipeline
from crossweave.llm.common import file_row
from crossweave.llm.line_dedup import line_dedup
from tests.llm.test_pipeline import SCHEMA, prose

SINGLE = {"line_dedup": corpus_pipeline.cut_repeated_lines, "near_dedup": corpus_pipeline.drop_near_duplicates}


def written(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


def test_one_row_of_each_group_is_left(spark, tmp_path):
    rng = random.Random(23)
    texts = [prose(rng, n) for n in (1, 3, 5, 9, 14, 30)]
    once = list(enumerate(texts)) + [(None, prose(rng, 8)), (None, prose(rng, 3)), (50, "")]
    rows = once + once + [once[-2]] * 20 + [once[-3]] * 20
    docs = written(spark, str(tmp_path / "documents"), rows)
    for name, stage in SINGLE.items():
        got = Counter((r.doc_id, r.text) for r in stage(spark, docs, "").collect())
        want = Counter(once) if name == "near_dedup" else Counter(once) + Counter({(50, ""): got[50, ""] - 1})
        assert got == want, name
    both = corpus_pipeline.shared_table(corpus_pipeline.cut_repeated_lines(spark, docs, ""), "twice")
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, both, "").collect()) == Counter(once)


def test_copies_of_one_id_are_cut(spark, tmp_path):
    text = prose(random.Random(3), 30)
    docs = written(spark, str(tmp_path / "documents"), [(None, text)] * 5 + [(1, text)] * 2)
    out = line_dedup(docs, passages=True, row=file_row()).collect()
    assert sorted((r.doc_id is None, r.text.strip()) for r in out) == sorted([(False, ""), (False, text), *[(True, "")] * 5])
