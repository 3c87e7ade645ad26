"""The operator queries over the given tables: against their SQL, or a direct computation."""

import hashlib
import os
import sys
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crossweave.llm.media import WRITERS, stored
from tests.llm.test_line_passages import direct_passages
from tests.llm.test_simhash import components, direct_fingerprint

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def named(n):
    return next(q for q in QUERIES if q.startswith(f"op{n}_"))


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, n):
    return {r[0]: r for r in QUERIES[named(n)](spark, DATA).collect()}


def test_one_query_per_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13 and "pipeline" in QUERIES
    assert {q for q in SQL if q.startswith("op")} == {named(n) for n in (1, 4, 6, 11, 12, 13)}


@pytest.mark.parametrize("n", [1, 4, 6, 11, 12, 13])
def test_queries_agree_with_sql(spark, n):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    message = compare(named(n), QUERIES[named(n)](spark, DATA), con, SQL[named(n)])[0]
    assert message.startswith("ok"), message


def test_simhash_query(spark, texts):
    fps = {i: direct_fingerprint(t) for i, t in texts.items()}
    root, first = components(fps.values()), {}
    for i in sorted(fps, reverse=True):
        first[root[fps[i]]] = i
    assert {i: (r.fingerprint, r.component_id) for i, r in rows(spark, 2).items()} == {i: (f"{f:016x}", first[root[f]]) for i, f in fps.items()}


@pytest.mark.parametrize(("n", "modulus", "remainder"), [(3, 5, 0), (5, 4, 2)])
def test_scoring_queries(spark, texts, n, modulus, remainder):
    got = rows(spark, n)
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == remainder) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_line_query(spark, texts):
    want = {i: (len(cut), len(t.encode()), sha(t.encode())) for i, t, cut in direct_passages(list(texts.items()))}
    got = rows(spark, 7)
    assert {i: (r.removed_chunks, r.kept_bytes, r.kept_sha256) for i, r in got.items()} == want
    assert all(r.kept_bytes + r.removed_bytes == len(texts[i].encode()) for i, r in got.items())


def test_token_queries(spark, texts):
    counts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(counts.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in rows(spark, 8).items()} == {i: (len(texts[i].encode()), n, n > 2048) for i, n in want.items()}
    lib, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(lib.decode(ids, skip_special_tokens=False).encode()))
    assert {i: tuple(r)[1:] for i, r in rows(spark, 10).items()} == want


def test_media_query(spark, texts):
    for i, r in rows(spark, 9).items():
        raw = texts[i].encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        declared, blob = stored(payload)
        assert (r.media_bytes, r.media_sha256) == (len(blob), sha(blob))
        said, kind, corrected, inside = r.feature.split(";")
        first, *others = inside.split(",")
        assert said == declared and corrected == str(kind != declared).lower() and first == f"{kind}:0:{len(blob)}:{sha(blob)[:16]}"
        if kind == "application/zip":
            assert others[0].split(":")[0] in WRITERS and WRITERS[others[0].split(":")[0]](payload) in blob
