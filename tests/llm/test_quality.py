"""Quality scores against a plain numpy discriminant, held-out accuracy, and odd rows."""

import zlib

import numpy as np

from crossweave.llm import quality
from crossweave.llm.common import table
from crossweave.llm.quality import fit_discriminant, score_quality, statistics

DATA = "/root/testdata/sf0.01"


def plain(text_of, labels):
    """Log-density differences computed class by class with explicit inverses."""
    known = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5 != 0:
            known[i] = max(y, known.get(i, 0))
    x = np.array([statistics((t or "").encode()) for _, t in text_of])
    rows = [(k, known[i]) for k, (i, _) in enumerate(text_of) if i in known]
    a, y = x[[k for k, _ in rows]], np.array([v for _, v in rows])
    center, scale = a.mean(0), a.std(0)
    scale = np.where(scale > 1e-9, scale, 1)
    z, za = (x - center) / scale, (a - center) / scale
    cov = [np.cov(za[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * cov[k] for k in (0, 1)) / len(y)
    logs = []
    for k in (0, 1):
        c = (1 - quality.TO_POOLED) * cov[k] + quality.TO_POOLED * pooled
        c = (1 - quality.TO_IDENTITY) * c + quality.TO_IDENTITY * np.trace(pooled) / len(c) * np.eye(len(c))
        d = z - za[y == k].mean(0)
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    return logs[1] - logs[0]


def test_order_of_scores_equals_plain_discriminant(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    d = plain(rows, [(r.doc_id, r.quality) for r in labels.collect()])
    score = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    s = np.array([score[i] for i, _ in rows])
    order = np.argsort(d)
    assert len(s) == len(rows) and (np.diff(s[order]) >= -1e-9).all()
    y = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i, _ in rows if i in y and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(score[i] >= 0.3) == (y[i] == 1) for i in held]) > 0.97


def test_odd_rows(spark):
    rows = [(i, t, "z") for i, t in enumerate([None, "", "  \n", "a b c", "a b c", "| # |", "x" * 200_000])] + [(None, "no id", "z"), (3, "a b c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)] + [(None, 1, 0), (99, 0, 0), (2, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    out = score_quality(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by_id = {r.doc_id: r.score for r in out}
    assert by_id[0] == by_id[1]
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_one_class_gives_no_model():
    assert fit_discriminant({0: (0.0, np.zeros(2), np.zeros((2, 2))), 1: (5.0, np.ones(2), np.eye(2))}) is None
