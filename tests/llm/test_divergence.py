"""Source divergence against plain dense arithmetic."""

from collections import Counter
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from crossweave.llm.divergence import distinct_texts, source_divergence, term_counts, terms
from crossweave.llm.common import file_row

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, least=10, top=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(low))) for lang, source, text in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        frequency = Counter(t for _, _, w in mine for t in set(w))
        kept = sorted(t for t, n in frequency.items() if n >= least)
        counts = {s: Counter() for _, s, _ in mine}
        for _, s, w in mine:
            counts[s].update(t for t in w if frequency[t] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            apart = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", apart, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found[:most], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéöß") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    docs = []
    for _ in range(300):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "Ü", None])
        docs.append((lang, source, " ".join(rng.choice(vocabulary[: 20 if source == "a" else 60]).upper() if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 30)))))
    docs += [docs[5]] * 40 + [("en", "b", docs[5][2])] * 3 + [("en", "bare", "1 2 3"), ("en", "none", None), ("one", "alone", "x " * 30), ("fr", "p", "rare"), ("fr", "q", "words")]
    docs += [("en", "long", "word " * 50_000)]
    rng.shuffle(docs)
    return docs


def test_values_equal_plain_arithmetic(spark, tmp_path):
    docs = corpus(1)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, source string, text string, term string, n int")
    got = sorted(map(tuple, source_divergence(frame).collect()))
    assert got == plain(docs) and {r[0] for r in got} >= {"fr", "", "en"}
    frame.repartition(3).write.parquet(str(tmp_path / "d"))
    assert sorted(map(tuple, source_divergence(spark.read.parquet(str(tmp_path / "d")), row=file_row()).collect())) == got


def test_kept_terms_and_ranks_follow_the_parameters(spark):
    docs = corpus(2)
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    assert sorted(map(tuple, source_divergence(frame, least_documents=3, top=2).collect())) == plain(docs, 3, 2)


def test_empty_table_and_terms(spark):
    assert source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    assert terms("Ab1c\x85É_É[z") == [b"ab", "c\x85É".encode(), "É".encode(), b"z"]


def test_copies_are_one_row(spark, tmp_path):
    rows = [("en", "a", "same")] * 50 + [("en", "b", "same")] * 2 + [("de", "a", "same"), ("en", "a", "other")]
    spark.createDataFrame(rows, "lang string, source string, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    found = distinct_texts(spark.read.parquet(str(tmp_path / "d")).select("*", file_row().alias("row"))).collect()
    assert sorted((r.lang, r.text, sorted((s.source, s.n) for s in r.sources)) for r in found) == [
        ("de", "same", [("a", 1)]), ("en", "other", [("a", 1)]), ("en", "same", [("a", 50), ("b", 2)])]


def test_sums_over_the_sources_of_a_term_need_no_second_exchange(spark):
    texts = spark.createDataFrame([("en", "b a a", [("x", 1), ("y", 2)]), ("en", "a", [("y", 1)])], "lang string, text string, sources array<struct<source string, n long>>")
    by_term = Window.partitionBy("lang", "term")
    sums = term_counts(texts).withColumn("all", F.sum("n").over(by_term))
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, sums.collect())) == [
        ("en", "x", "a", 2, 1, 7), ("en", "x", "b", 1, 1, 3), ("en", "y", "a", 5, 3, 7), ("en", "y", "b", 2, 2, 3)]
