"""Fingerprints, the Gray-order index, and components, against direct computation."""

import random

import numpy as np
import pytest
import xxhash

from crossweave.llm.common import table
from crossweave.llm.components import connected_components
from crossweave.llm.simhash import block_masks, fingerprint, gray_rank, links_between, links_within, near_duplicates, near_links


def direct_fingerprint(text, size=4):
    words, word = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    words += [word] * bool(word)
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + size]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(codes, distance=4):
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in codes}


def clustered(rng, centers, near, far):
    out = [rng.getrandbits(64) for _ in range(far)]
    for _ in range(centers):
        c = rng.getrandbits(64)
        for _ in range(near):
            x = c
            for _ in range(rng.randrange(0, 6)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out + [0, 1, 2**64 - 1, 2**63]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "a B c D", "É é\tz\x0bq\x0cr s", "x " * 999, "nb\xa0sp w e r t", "a\x00b c d e f g"])
def test_fingerprint(text):
    assert fingerprint(text) == direct_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    text = "four words in here"
    assert spark.sql(f"select xxhash64('{text}') h").first().h == signed(xxhash.xxh64(text.encode(), seed=42).intdigest())


def test_masks_share_a_route():
    rng, masks = random.Random(1), block_masks()
    assert len(masks) == 15
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def test_gray_rank_orders_by_gray_code(spark):
    codes = [i ^ (i >> 1) for i in range(40)] + [((1 << 63) + i) ^ (((1 << 63) + i) >> 1) for i in range(3)]
    rows = spark.createDataFrame([(signed(c), i) for i, c in enumerate(codes)], "fp long, i int")
    assert [r.i for r in rows.orderBy(gray_rank(rows.fp)).collect()] == list(range(len(codes)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_finds_the_links(seed):
    rng = random.Random(seed)
    codes = np.array(sorted(set(clustered(rng, 6, 60, 200)), key=lambda c: gray(c)), np.uint64)
    want = components(codes.tolist())
    row, root = links_within(codes, np.zeros(1, np.int64), 4)
    assert partition(codes, row, root) == groups(want)
    left, right = codes[::2], codes[1::2]
    row, root = links_between(left, right, 4)
    both = np.concatenate([left, right])
    cross = {}
    for a in left.tolist():
        for b in right.tolist():
            if (a ^ b).bit_count() <= 4:
                cross.setdefault(a, set()).add(b)
    got = {frozenset(g) for g in partition(both, row, root)}
    assert all(any(a in g and cross[a] <= g for g in got) for a in cross)


def gray(c):
    for s in (1, 2, 4, 8, 16, 32):
        c ^= c >> s
    return c


def groups(root):
    out = {}
    for c, r in root.items():
        out.setdefault(r, set()).add(c)
    return {frozenset(g) for g in out.values()}


def partition(codes, row, root):
    of = dict(zip(codes.tolist(), codes.tolist(), strict=True))
    of.update({int(codes[a]): int(codes[b]) for a, b in zip(row, root, strict=True)})
    return groups(of)


@pytest.mark.parametrize("part_rows", [4, 4096])
def test_links_and_components_on_spark(spark, part_rows):
    codes = sorted(set(clustered(random.Random(9), 5, 40, 150)))
    want = components(codes)
    edges = near_links(spark.createDataFrame([(signed(c),) for c in codes], "fp long"), part_rows=part_rows)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(edges).collect()}
    assert groups({c: got.get(c, c) for c in codes}) == groups(want)


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1100), 1000)}


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000, None), (5001, " "), (None, "lonely text of a null id"), (7, "again the same id")]
    out = near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, fp int")).collect()
    fps = [direct_fingerprint(t or "") for _, t in rows]
    root = components(fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)), key=str)
    assert sorted((tuple(r) for r in out), key=str) == want
    assert near_duplicates(docs.limit(0)).count() == 0
