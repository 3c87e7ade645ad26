"""Line chunks: boundaries that move with the text, and removal against a direct scan."""

import random

import pytest

from crossweave.llm.common import table
from crossweave.llm.line_dedup import LEAST_LINES, chunks, line_dedup


def direct(docs):
    """First occurrences by (null id last, id, place) stay; rows that repeat a document are one document."""
    seen, cut = {}, {}
    for i, t in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        raw = (t or "").encode()
        for place, (a, b, w) in enumerate(chunks(raw)):
            if w >= LEAST_LINES:
                body = raw[a : b - (raw[b - 1] == 10)]
                if seen.setdefault(body, (i, t, place)) != (i, t, place):
                    cut.setdefault((i, t), []).append((a, b))
    out = []
    for i, t in docs:
        raw, at, parts = (t or "").encode(), 0, []
        for a, b in cut.get((i, t), []):
            parts.append(raw[at:a])
            at = b
        out.append((i, None if t is None else b"".join([*parts, raw[at:]]).decode(), len(cut.get((i, t), []))))
    return sorted(out, key=str)


def run(spark, docs):
    frame = spark.createDataFrame([(i, t, 3, "k") for i, t in docs], "doc_id long, text string, removed int, lang string")
    out = line_dedup(frame, carry=("lang",))
    assert out.columns == ["doc_id", "lang", "text", "removed"]
    return sorted(((r.doc_id, r.text, len(r.removed)) for r in out.collect()), key=str)


def passage(rng, n):
    return "\n".join(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(6)) for _ in range(n))


def test_chunks_cover_the_text():
    rng = random.Random(5)
    for raw in [b"", b"\n", b"a", b"a\n\nb", b"x " * 200, *(passage(rng, n).encode() + b"\n" * (n % 2) for n in range(1, 200, 7))]:
        parts = chunks(raw)
        assert b"".join(raw[a:b] for a, b, _ in parts) == raw
    assert [c[2] for c in chunks(b"\n\n\n\n")] in ([0], [0, 0]) and chunks(b"q " * 60)[0][2] == LEAST_LINES


def test_boundaries_move_with_the_text():
    rng = random.Random(1)
    shared = passage(rng, 40)
    bodies = []
    for before in (0, 1, 5, 8):
        raw = (passage(rng, before) + "\n" + shared + "\n" + passage(rng, 3)).encode()
        bodies.append({raw[a:b] for a, b, _ in chunks(raw)})
    common = set.intersection(*bodies)
    assert sum(map(len, common)) > 0.75 * len(shared)


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_a_direct_scan(spark, seed):
    rng = random.Random(seed)
    shared = [passage(rng, n) for n in (2, 4, 9, 30)] + [" ".join(f"w{rng.randrange(9)}" for _ in range(60))]
    docs = []
    for i in range(60):
        parts = [passage(rng, rng.randrange(0, 5)), rng.choice(shared), passage(rng, rng.randrange(0, 4)), rng.choice([*shared, ""])]
        docs.append((i, "\n".join(parts)))
    docs += [(100, docs[3][1]), (None, docs[4][1]), (3, docs[3][1]), (3, docs[5][1]), (101, None), (102, ""), (103, "\n\n\n\n"), (104, "\n\n\n\n"), (105, "é\r\nö\x00\nü")]
    docs += [(106, "l\n" * 5000)]
    assert run(spark, docs) == direct(docs)
    assert run(spark, []) == []


def test_first_copy_stays_whole(spark):
    rng = random.Random(8)
    text = passage(rng, 20)
    got = run(spark, [(9, text), (2, text), (5, passage(rng, 20))])
    assert got[0][:2] == (2, text) and got[0][2] == 0 and len(got[2][1]) < len(text) / 3


def test_documents_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    assert run(spark, docs) == direct(docs)
