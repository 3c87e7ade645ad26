"""Label model against a brute-force posterior, held-out accuracy, and odd rows."""

import zlib

import numpy as np

from crossweave.llm.common import table
from crossweave.llm.toxicity import PATTERNS, cast_votes, choose, fit_label_model, marks, score_toxicity

DATA = "/root/testdata/sf0.1"


def test_marks_and_choice():
    assert marks("Abcde abcdx ab") == {"abcde", "abcdx", "ab", "abcd*", "abcd**"}
    assert choose([("abc*", 9.0), ("abcd", 8.0), ("abc**", 7.0), ("xy", 8.0)]) == ["abc*", "xy", "abc**"]


def test_votes(spark):
    docs = spark.createDataFrame([(1, "Fool badly BADGE ok"), (2, None), (3, "badly"), (None, "fool " * 50_000)], "doc_id long, text string")
    out = {r.id: r.votes for r in cast_votes(docs, ["fool", "bad*", "bad**"], "doc_id", "text").collect()}
    assert out[1] == [0, 1, 2, 3, 4, 6, 7, 8] and out[2] == [] and out[3] == [1]
    assert out[None][0] == 0 and max(out[None]) < 3 + PATTERNS


def test_label_model_finds_accuracies(spark):
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    rates = np.array([[0.02, 0.1, 0.01, 0.01], [0.7, 0.5, 0.6, 0.6]])
    fired = rng.random((4000, 4)) < rates[y.astype(int)]
    fired[:, 3] = fired[:, 2]  # a copy of a voter
    rows = [([int(v) for v in np.flatnonzero(f)], 1) for f in fired]
    patterns = spark.createDataFrame(rows, "votes array<int>, n int").groupBy("votes").agg({"n": "sum"}).toDF("votes", "n")
    known = np.stack([fired[:200][~y[:200]].sum(0), fired[:200][y[:200]].sum(0)]).astype(float)
    model = fit_label_model(patterns, 4000, known, (int((~y[:200]).sum()), int(y[:200].sum())))
    assert abs(model.prior - 0.2) < 0.05 and np.abs(model.rates - rates)[:, :3].max() < 0.12
    assert model.weights[2] < 0.6 and model.weights[0] > 0.8
    odds = np.array([model.log_odds(np.flatnonzero(f)) for f in fired])
    by_hand = np.log(model.prior / (1 - model.prior)) + sum(
        w * np.where(fired[:, j], np.log(model.rates[1, j] / model.rates[0, j]), np.log((1 - model.rates[1, j]) / (1 - model.rates[0, j])))
        for j, w in enumerate(model.weights)
    )
    assert np.allclose(odds, by_hand) and ((odds > 0) == y).mean() > 0.9


def test_held_out_accuracy(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    score = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    assert len(score) == docs.count()
    held = [(r.doc_id, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = [(score[i] >= 0.3) == (t == 1) for i, t in held]
    caught = [score[i] >= 0.3 for i, t in held if t == 1]
    assert np.mean(right) > 0.98 and np.mean(caught) > 0.9


def test_odd_rows(spark):
    rows = [(i, "vile " * (i % 3) + "calm words here", "z") for i in range(240)] + [(None, None, "z"), (500, "", "z"), (500, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 1) for i in range(200)] + [(None, 1, 1), (7, None, 0), (9999, 0, 0)], "doc_id long, toxic int, quality int")
    out = score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    s = {r.doc_id: r.score for r in out}
    assert s[220] > 0.9 > 0.1 > s[219] and abs(s[None] - s[500]) < 1e-12
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), labels).count() == 0
