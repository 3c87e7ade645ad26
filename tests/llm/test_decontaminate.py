"""Windows of benchmark items in documents, against a direct search."""

import random
import re

import numpy as np
import pytest

from crossweave.llm import decontaminate as dc
from crossweave.llm.decontaminate import WordScan, decontaminate, merged_spans

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def direct(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            v = words(it)
            n = min(window, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[s : s + n]:
                        hit.update(range(at, at + n))
                        if item is not None:
                            found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, n_words int, window string")
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, h string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate(d, b, **kw).collect()), key=str)


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "ç", "dd", "7", "Éa", "the"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    items = [(k % 9, text(rng.choice([0, 1, 2, 3, 9, 10, 14, 30]))) for k in range(12)] + [(None, text(12)), (50, None), (51, "")]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(30)] + [(k, text(5) + items[k % 12][1] + text(3)) for k in range(30, 45)]
    return docs + [(None, items[3][1]), (3, "a B"), (3, "a B"), (60, None), (61, " ")], items


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    docs, items = random_case(seed)
    assert run(spark, docs, items) == direct(docs, items)
    assert run(spark, docs, items, window=4) == direct(docs, items, 4)


def test_long_texts_and_short_stretches(spark, monkeypatch):
    monkeypatch.setattr(dc, "STRETCH", 64)
    docs, items = random_case(4)
    docs = [*docs, (99, "z" * 5000 + " " + " ".join(d or "" for _, d in docs))]
    assert run(spark, docs, items) == direct(docs, items)


def test_empty_tables(spark):
    docs, items = random_case(3)
    assert run(spark, docs, []) == direct(docs, [])
    assert run(spark, [], items) == []


def test_word_hashes_depend_on_the_word_alone():
    texts = ["Foo bar", "bar", "", "x foo", "foo"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0] + [len(r) for r in raw])
    starts, ends, owner, h = WordScan()(data, offsets)
    assert owner.tolist() == [0, 0, 1, 3, 3, 4]
    assert h[0] == h[4] == h[5] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_spans_merge_in_one_pass(spark):
    rng = random.Random(3)
    rows = []
    for row in range(60):
        rows.append((row, [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(200) for _ in range(rng.randrange(0, 40)))]))
    rows.append((60, [(a, a + 10) for a in range(0, 400_000, 10 + 1)]))
    frame = spark.createDataFrame(rows, "row long, ranges array<struct<start:int,stop:int>>")
    for r in merged_spans(frame).collect():
        want = []
        for a, b in sorted(dict(rows)[r.row]):
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        assert [[s.start, s.stop] for s in r.spans] == want
