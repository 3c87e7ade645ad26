"""Toxicity learned from a table with about ten toxic labels."""

import random

import numpy as np

from crossweave.llm.common import table
from crossweave.llm.labels import fit_sigmoid
from crossweave.llm.toxicity import beyond_chance, fit_toxicity, score_toxicity


def test_evidence_asked_for_follows_the_sample():
    assert beyond_chance([15.7] * 14, 4_100) == 14 and beyond_chance([15.7] * 14, 4_100_000) == 0
    assert beyond_chance([], 0) == 0 and beyond_chance([60.0, 50.0, 1.0], 4_100_000) == 2


def test_curve_through_few_separate_rows():
    t = np.array([-4.9, -4.85, -4.8, 1.0, 2.0, 3.3])
    slope, offset = fit_sigmoid(t, np.array([0, 1.0, 0, 2, 3, 3]), np.array([20.0, 15, 20, 0, 0, 0]))
    score = 1 / (1 + np.exp(-(slope * t + offset)))
    assert score[:3].max() < 0.1 and score[3:].min() > 0.9


def test_ten_toxic_labels(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    rows = []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(40)]
        if i % 6 == 0:
            words[7:7] = [("trash", "scum", "moron")[i // 6 % 3]] * 2
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(84)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    caught, flagged = [score[i] >= 0.3 for i in range(84, 300) if i % 6 == 0], [score[i] >= 0.3 for i in range(84, 300) if i % 6]
    assert np.mean(caught) > 0.9 and np.mean(flagged) < 0.02


def test_smallest_table(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    model, _ = fit_toxicity(docs, labels)
    assert model is not None
    score = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    toxic, other = ([score[r.doc_id] >= 0.3 for r in labels.where(f"toxic = {k}").collect()] for k in (1, 0))
    assert np.mean(toxic) > 0.5 and np.mean(other) < 0.05
