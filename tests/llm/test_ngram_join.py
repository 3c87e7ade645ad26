"""Jaccard groups against a brute force over all pairs, on every tile size."""

import random

import numpy as np
import pyarrow as pa
import pytest

from crossweave.llm import ngram_join as nj
from crossweave.llm.decontaminate import _buffers
from crossweave.llm.ngram_join import Bands, TileSizes, Words, jaccard_groups, key_edges, set_keys, shingle_sets

SMALL = TileSizes(held=300, shingles=150, rows=3, places=2)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def brute(docs, percent=90):
    sets, root, links = [shingles(t) for _, t in docs], list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)), links[i]) for i, (d, _) in enumerate(docs)), key=str)


def corpus(seed, families=50):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = []
    for _ in range(families):
        n = rng.choice([3, 8, 10, 11, 12, 15, 19, 20, 21, 22, 25, 30, 50, 100, 200, 400])
        words = [rng.choice(vocabulary) for _ in range(n)]
        docs.append(words)
        for _ in range(rng.randrange(0, 12)):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + max(1, n // 40))):
                k, op = rng.randrange(len(copy)), rng.random()
                if op < 0.3:
                    copy.insert(k, rng.choice(vocabulary))
                elif op < 0.6 and len(copy) > 1:
                    copy.pop(k)
                else:
                    copy[k] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                copy = copy[rng.randrange(2) : len(copy) - rng.randrange(3)]
            docs.append(copy)
    texts = [" ".join(d) for d in docs] + [None, "", " ", "a", "A", "a b", "a b", "x y z", "X y  z\n", "x" * 200_000, "é É"]
    rows = [*enumerate(texts), (None, texts[0]), (None, "only this"), (3, texts[3]), (3, texts[4])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "sizes"), [(1, TileSizes()), (2, SMALL)])
def test_groups_and_links_equal_brute_force(spark, seed, sizes):
    docs = corpus(seed)
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, n int, root string")
    out = jaccard_groups(frame, sizes=sizes)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs)


def test_empty_table(spark):
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in jaccard_groups(spark.createDataFrame([(5, None)], "doc_id long, text string")).collect()] == [(5, 0, 5, 0)]


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_linked_sets_share_a_key(percent):
    rng, bands = random.Random(percent), Bands(percent)
    for _ in range(400):
        n = rng.choice([3, 5, 9, 10, 17, 18, 19, 20, 37, 40, 41, 90, 150, 700])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randrange(0, 1 + n * (100 - percent) // percent)):
            if rng.random() < 0.5 and len(b) > 1:
                b.remove(rng.choice(sorted(b)))
            else:
                b.add(rng.getrandbits(64))
        common = len(a & b)
        if a == b or 100 * common < percent * len(a | b):
            continue
        sizes = np.array([len(a), len(b)])
        owner, keys = set_keys(sizes, np.array(sorted(a) + sorted(b), np.uint64), bands)
        assert set(keys[owner == 0]) & set(keys[owner == 1]), (len(a), len(b), common)


def test_bitmap_bound_never_drops_a_link():
    rng = random.Random(4)
    pool = [rng.getrandbits(64) for _ in range(400)]
    rows = sorted((sorted(rng.sample(pool, rng.randrange(250, 400))) for _ in range(40)), key=len)
    sets = nj.Sets(np.array([len(r) for r in rows]), np.array([c for r in rows for c in r], np.uint64), np.arange(40), np.ones(40, np.int64))
    got = {(int(i), int(j)) for p in nj.linked_pairs(sets, np.arange(40) + 1, np.full(40, 40), 80) for i, j in zip(*p, strict=True)}
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(set(rows[i]) & set(rows[j])) >= 80 * len(set(rows[i]) | set(rows[j]))}
    assert got == want and 0 < len(want) < 780


def test_key_edges_over_partitions(spark):
    rows = [(k % 7 if k % 3 else 99, k) for k in range(300)]
    out = key_edges(spark.createDataFrame(rows, "key long, name long").repartition(3)).collect()
    root = {}
    for r in sorted(out, key=lambda r: r.b):
        root[r.a] = root.get(r.b, r.b)
    groups = {}
    for k, n in rows:
        groups.setdefault(k, []).append(n)
    assert all(len({root.get(n, n) for n in g}) == 1 for g in groups.values())


def test_sets_of_a_batch():
    data, offsets = _buffers(pa.array(["a b c d a b c", "", None, "One", "one two", "\x85 \x1f"]))
    n, codes = shingle_sets(Words(), data, offsets, 3)
    assert n.tolist() == [4, 0, 0, 1, 1, 1] and len(codes) == 7
