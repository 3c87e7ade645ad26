"""Repeated passages of several lines against a brute force over line runs that knows no chunks."""

import random

from crossweave.llm.line_dedup import LEAST_LINES, besides, chunks, line_dedup

WORDS = 50


def repeated_lines(docs):
    """By document, the lines of later occurrences of any run of lines, however long, with more than 50 words."""
    seen, cut = {}, [set() for _ in docs]
    for k, (_, t) in sorted(enumerate(docs), key=lambda d: (d[1][0] is None, d[1][0] or 0)):
        lines = (t or "").split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if lines[a].strip() and lines[b - 1].strip() and sum(len(x.split()) for x in lines[a:b]) > WORDS:
                    if seen.setdefault("\n".join(lines[a:b]), (k, a)) != (k, a):
                        cut[k].update(range(a, b))
    return cut


def several_lines(docs):
    """By document, the lines that may go at all: in two lines that stand elsewhere too, or long ones that do. Blank lines
    between do not count."""
    where = {}
    for k, (_, t) in enumerate(docs):
        lines = [(j, x) for j, x in enumerate((t or "").split("\n")) if x.strip()]
        for n in (1, 2):
            for a in range(len(lines) - n + 1):
                part = lines[a : a + n]
                if n == 2 or len(part[0][1].split()) >= WORDS:
                    where.setdefault(tuple(x for _, x in part), []).append((k, [j for j, _ in part]))
    out = [set() for _ in docs]
    for places in where.values():
        for k, js in places if len(places) > 1 else ():
            out[k].update(range(js[0], js[-1] + 1))
    return out


def shortest_runs(raw):
    """(start, stop) in bytes of the shortest runs of lines of more than WORDS words that begin or end at each line that is
    not blank, by trying all."""
    lines, at, edge = raw.split(b"\n"), 0, []
    for line in lines:
        edge.append((at, min(at + len(line) + 1, len(raw))))
        at += len(line) + 1
    words, out = [len(line.split()) for line in lines], set()
    total = [0]
    for n in words:
        total.append(total[-1] + n)
    for a in range(len(lines)):
        b = next((b for b in range(a, len(lines)) if total[b + 1] - total[a] > WORDS), None)
        if words[a] and b is not None:
            out.add((a, b))
        b = next((b for b in range(a, -1, -1) if total[a + 1] - total[b] > WORDS), None)
        if words[a] and b is not None:
            out.add((next(k for k in range(b, a + 1) if words[k]), a))
    return sorted((edge[a][0], edge[b][1]) for a, b in out)


def direct_passages(docs):
    """(id, text, spans) by (null id last, id, place): chunks that occur before go, then what such runs cover besides; a run
    over its own first occurrence from that one's end on. Rows are taken in order; a row that repeats id and text is one of its own."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    seen: list[dict] = [{}, {}]
    out = {}
    for k in order:
        raw = (docs[k][1] or "").encode()
        solid, loose = [], set()
        for place, (a, b, w) in enumerate(chunks(raw)):
            if w >= LEAST_LINES:
                body = raw[a : b - (raw[b - 1] == 10)]
                if seen[0].setdefault(body, (k, place)) != (k, place):
                    solid.append((a, b))
        for a, b in shortest_runs(raw):
            body = raw[a : b - (raw[b - 1] == 10)]
            first = seen[1].setdefault(body, (k, a, b))
            if first != (k, a, b):
                loose.update(range(max(a, first[2]) if first[0] == k else a, b))
        loose -= {x for a, b in solid for x in range(a, b)}
        spans = list(solid)
        for x in sorted(loose):
            if x - 1 in loose:
                spans[-1] = (spans[-1][0], x + 1)
            else:
                spans.append((x, x + 1))
        spans.sort()
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        out[k] = (docs[k][0], None if docs[k][1] is None else (kept + raw[at:]).decode(), spans)
    return [out[k] for k in range(len(docs))]


def gone(text, removed):
    raw, out, at = text.encode(), set(), 0
    for j, line in enumerate(raw.split(b"\n")):
        if any(s.start <= at and at + len(line) <= s.stop and s.start < s.stop for s in removed) and line.strip():
            out.add(j)
        at += len(line) + 1
    return out


def lines_of(rng, n, words=(3, 14)):
    return "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(*words))) for _ in range(n))


def held(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    by_id = {r.doc_id: r for r in line_dedup(frame, passages=True).collect()}
    assert len(by_id) == len(docs)
    for (i, t), must, may in zip(docs, repeated_lines(docs), several_lines(docs), strict=True):
        spans = by_id[i].removed
        solid = {j for j in must if t.split("\n")[j].strip()}
        raw = (t or "").encode()
        assert all(a.stop <= b.start for a, b in zip(spans, spans[1:]))
        kept, at = b"", 0
        for s in spans:
            kept, at = kept + raw[at : s.start], s.stop
        assert by_id[i].text == (None if t is None else (kept + raw[at:]).decode())
        assert solid <= gone(t or "", spans) <= may, i
    return by_id


def test_passages_between_other_lines(spark):
    rng = random.Random(7)
    shared = [lines_of(rng, n, (9, 14)) for n in (5, 6, 8, 15)] + [lines_of(rng, 3, (20, 30)), "\n\n".join(lines_of(rng, 6, (10, 12)).split("\n"))]
    shared += ["\n".join([lines_of(rng, 1, a) for a in ((60, 70), (9, 10), (5, 6))]), "\n".join([lines_of(rng, 1, a) for a in ((7, 8), (60, 70), (9, 10))])]
    docs = []
    for i in range(120):
        parts = [lines_of(rng, rng.randrange(1, 5)), rng.choice(shared), lines_of(rng, rng.randrange(1, 4)), rng.choice([*shared, ""]), lines_of(rng, 1)]
        docs.append((i, "\n".join(parts)))
    docs += [(None, docs[3][1]), (200, None), (201, ""), (202, docs[5][1] + "\n"), (203, "é ö\r\n" * 3)]
    by_id = held(spark, docs)
    for line in (x for p in shared for x in p.split("\n") if x):
        assert sum((r.text or "").split("\n").count(line) for r in by_id.values()) == 1


def test_run_over_its_first_occurrence(spark):
    assert besides([(0, 4), (9, 12)], [(2, 10), (11, 15)]) == [(0, 4), (4, 9), (9, 12), (12, 15)]
    assert besides([(0, 20), (20, 22)], [(2, 10), (12, 21)]) == [(0, 20), (20, 22)]
    frame = spark.createDataFrame([(1, "\n".join(f"same {j % 3} line of words" for j in range(90)))], "doc_id long, text string")
    assert len(line_dedup(frame, passages=True).first().text.split("\n")) >= 3
    assert line_dedup(frame.limit(0), passages=True).count() == 0
