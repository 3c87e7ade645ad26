"""Token counts, encoding and decoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crossweave.llm.bpe import LowerSplitter, SpacedSplitter, Vocabulary
from crossweave.llm.bpe_table import encode_decode
from crossweave.llm.token_counts import count_tokens

TEXTS = [
    None, "", " ", "\n\n  a", "Hello world's 123 tests!!", "ÀÉ naïve œuvre ΑΣ ΟΔΟΣ Σ", "a" * 3000, "中文字符 mixed 日本語 ½²Ⅷ", "<|endoftext|> x<|startoftext|>y",
    "tab\tcr\r\nnb sp em\x85next\x1cfs", "don't we'll I'M 'S", "é combining", "x\u0000y", "😀 emoji👍🏽", "İstanbul ǅ ﬁ", "the the the", "the the the",
]


def noise(n, seed):
    rng = random.Random(seed)
    letters = "abc XYZ'é ßΣςİ\n\t  1½٣中😀́|<>!?-_.\x1c\x85"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_word_counts_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, v, split = Tokenizer.from_file(path), Vocabulary(open(path, encoding="utf-8").read()), LowerSplitter()
    for text in [t or "" for t in TEXTS] + noise(1500, 1):
        got = sum(1 if s else sum(map(v.count, split(p))) for s, p in v.pieces(text))
        assert got == len(lib.encode(text, add_special_tokens=False).ids), repr(text)


def test_byte_level_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, v, split = Tokenizer.from_file(path), Vocabulary(open(path, encoding="utf-8").read()), SpacedSplitter()
    for text in [t or "" for t in TEXTS] + noise(1500, 2):
        got = [i for s, p in v.pieces(text) for i in ([v.special[p]] if s else [i for w in split(p) for i in v.encode(w)])]
        assert got == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_count_tokens_rows(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (3, TEXTS[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = sorted(tuple(r) for r in count_tokens(docs, path, limit=3).collect() if r.doc_id is not None)
    want = []
    for i, t, _ in rows:
        if i is not None:
            n = len(lib.encode(t or "", add_special_tokens=False).ids)
            want.append((i, len((t or "").encode()), n, n > 3))
    assert got == sorted(want)
    assert count_tokens(docs, path).count() == len(rows)
    assert count_tokens(docs.limit(0), path).count() == 0


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_encode_decode_equals_the_library(spark):
    texts = TEXTS + noise(60, 3)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "null id zz", 2, None), (3, TEXTS[3], 1, "x"), (3, "same id, other text", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, word string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)

    def want(t):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids), lib.decode(ids, skip_special_tokens=False)

    for frequent in (0, 40, 1 << 18):
        out = encode_decode(docs, path, carry=("ids",), frequent=frequent).toDF("doc_id", "raw", "decoded", "ids")
        got = sorted(((r.doc_id is None, r.doc_id or 0, bytes(r.raw), r.decoded, r.ids) for r in out.collect()))
        assert got == sorted((i is None, i or 0, *want(t), n) for i, t, n, _ in rows)
    assert encode_decode(docs.limit(0), path).count() == 0


def test_split_dictionaries_hold_every_word(spark, tmp_path):
    """Read from files, both passes see the same splits: nothing is encoded in place. Of a table whose rows move between the
    passes words are, with the same ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = noise(300, 5) + ["common words " * 3] * 200 + ["y" * 150_000 + " " + "lang 😀" * 20_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, in_place string").repartition(7).write.parquet(str(tmp_path / "d"))
    docs = spark.read.option("maxPartitionBytes", 20_000).parquet(str(tmp_path / "d"))
    out = encode_decode(docs, path, frequent=20, report=True).collect()
    assert sorted(r.decoded for r in out) == sorted(texts) and sum(r.in_place for r in out) == 0
    moving = docs.repartition(3, F.rand())
    moved = encode_decode(moving, path, frequent=20, report=True).collect()
    assert {r.doc_id: r.ids for r in moved} == {r.doc_id: r.ids for r in out}
