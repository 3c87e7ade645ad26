"""The pipeline's stages against direct decisions, on a small corpus."""

import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from crossweave.llm.common import folders_used
from tests.llm.test_decontaminate import direct as direct_hits
from tests.llm.test_line_passages import direct_passages
from tests.llm.test_simhash import components, direct_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators and stages use inside
CLASHING = ["row", "drop", "url", "removed", "decoded", "ids", "key", "keep.this", "score", "n_tokens"]


def prose(rng, n):
    return "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(8)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    texts = [prose(rng, rng.randrange(3, 12)) for _ in range(160)]
    for i in range(0, 160, 4):
        texts[i] += " vile vile scoundrel."
    items = [(k, prose(rng, 3).replace("\n", " ")) for k in range(5)]
    texts += [texts[1], texts[1], texts[2].replace(" ", "  ", 1), prose(rng, 2) + "\n" + items[2][1] + "\n" + prose(rng, 2), "", " "]
    texts += [prose(rng, 3) + "\n" + texts[5], None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, prose(rng, 4), None, None, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages(spark, corpus):
    folder, rows, items = corpus
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), [(r[0], r[1]) for r in rows]
    decisions = [
        lambda d: [(i, t) for i, t in d if "vile" not in (t or "")],
        lambda d: [(i, t) for i, t, cut in direct_passages(d) if not cut or (t or "").strip()],
        near,
        lambda d: [(i, t) for i, t in d if not direct_hits([(i, t)], items)[0][2]],
    ]
    for (name, stage), decide in zip(corpus_pipeline.STAGES, decisions, strict=False):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        docs = corpus_pipeline.shared_table(out, "test")
        left = decide(left)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(left, key=str), name
    final = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in left}
    assert len(final) == len(left)
    for r in final:
        assert r.token_ids == b"".join(x.to_bytes(4, "little") for x in want[r.doc_id]) and r.n_tokens == len(want[r.doc_id])
    assert sorted((r.text for r in final)) == sorted(t or "" for _, t in left)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in whole.collect()) == sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in final)


def near(docs):
    fps = {d: direct_fingerprint(d[1] or "") for d in docs}
    root = components(fps.values())
    first = {}
    for d in docs:
        k = root[fps[d]]
        first[k] = min(first.get(k, d), d, key=lambda x: (x[0] is None, x[0] or 0))
    return [d for d in docs if first[root[fps[d]]] == d]


def test_other_columns_travel(spark, corpus, tmp_path):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in CLASHING])
    more.write.parquet(str(tmp_path / "more"))
    more, plain = spark.read.parquet(str(tmp_path / "more")), docs
    for name, stage in corpus_pipeline.STAGES:
        more, plain = (corpus_pipeline.shared_table(stage(spark, d, folder), "wide") for d in (more, plain))
        kept = [c for c in CLASHING if name != "bpe" or c != "n_tokens"]
        got = more.select("doc_id", "text", *[f"`{c}`" for c in kept]).collect()
        assert sorted((r[0] is None, r[0] or 0, r[1] or "") for r in got) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in plain.collect()), name
        assert all(r[c] == (c if r.doc_id is None else f"{c}-{r.doc_id}") for r in got for c in kept)
    assert len(more.columns) == len(set(more.columns))


def test_folders_are_freed(spark, corpus):
    with folders_used() as used:
        out = corpus_pipeline.run(spark, corpus[0])
    assert used == [] and out.count() > 0  # the stages' own lists
    root = out.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://").removeprefix("file:")
    assert not [d for d in os.listdir(root) if d.startswith("pipeline-") and not d.startswith("pipeline-bpe")]


def test_empty_corpus(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.shared_table(stage(spark, docs, folder), "empty")
        assert docs.count() == 0
