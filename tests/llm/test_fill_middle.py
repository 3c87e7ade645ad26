"""Cuts on 64-bit words against plain string slices."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crossweave.llm import fill_middle
from crossweave.llm.fill_middle import UnitIndex, fill_in_middle, restored, select_end, unit_ends


def plain(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h, n = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def test_rows_equal_string_slices(spark):
    rng = random.Random(2)
    alphabet = "ab \n<PSM>é€😀\u0000́"
    texts = [None, "", "a", "😀", "<P", "P>", "<P>", "x<M>y", "<<P", "S><", "é" * 40_000 + "😀" * 999]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "same id"), (7, "same id"), (-3, "négative")]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    out = fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted((plain(i, t) for i, t in rows), key=str)
    back = out.select("doc_id", restored().alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_texts_in_stretches(spark, monkeypatch):
    assert fill_middle._cuts(np.empty(0, np.uint8), np.array([0]), *(np.empty(0, np.int64),) * 2)[0].tolist() == []
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ä1"), F.col("id").cast("int") * 3000).alias("text"))
    for r in fill_in_middle(docs).collect():
        assert tuple(r) == plain(r.doc_id, "ä1" * (r.doc_id * 3000))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6), st.data())
def test_index(texts, data):
    raw = [t.encode("utf-8", "surrogatepass").decode("utf-8", "ignore").encode() for t in texts]
    joined = b"".join(raw)
    text = joined.decode()
    index = UnitIndex(np.frombuffer(joined, np.uint8))
    places = np.arange(len(joined) + 1)
    ends = np.cumsum([len(c.encode()) for c in text]) if text else np.empty(0, np.int64)
    assert index.before(places).tolist() == [int((ends <= p).sum()) for p in places]
    k = np.arange(len(text) + 1)
    assert index.end_of(k).tolist() == [0, *ends.tolist()]


def test_select_in_a_word():
    rng = np.random.default_rng(1)
    for _ in range(300):
        flags = rng.random(8) < 0.5
        if flags.any():
            word = np.packbits(np.zeros(0, bool)).sum() + sum(1 << (8 * int(i)) for i in np.flatnonzero(flags))
            got = select_end(np.full(int(flags.sum()), word, np.uint64), np.arange(1, flags.sum() + 1))
            assert got.tolist() == (np.flatnonzero(flags) + 1).tolist()
    words = np.frombuffer("aé€😀xyz".encode().ljust(16, b"\0")[:16], "<u8")
    assert np.flatnonzero(unit_ends(words).view(np.uint8)).tolist()[:7] == [0, 2, 5, 9, 10, 11, 12]
