"""Operator 12: how far the sources of a language differ in their words, with texts that repeat counted once and weighted."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import file_row, shared_table

LEAST_DOCUMENTS, SCALE, TOP = 10, 1_000_000_000, 10
#: (source, term) counts a task holds before it hands them on
HELD_COUNTS = 800_000


def _byte_table() -> bytes:
    """Bytes of terms (ASCII letters, lowered, and all beyond ASCII) as they are, others as spaces."""
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    return bytes((b | 32 if 65 <= b <= 90 else b) if letter(b) else 32 for b in range(256))


def terms(text: str, table: bytes = _byte_table()) -> list[bytes]:
    """Runs of letters; bytes.split knows ASCII space alone."""
    return text.encode().translate(table).split()


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(lang, text, sources) from (lang, source, text, row): equal texts of a language as one row, with the number of rows
    by source.

    Copies are counted by the digest of their text, before any exchange and without the text; one row of each group then
    brings the text, met by its place, so that a group of any size and its text are one row. The groups grow with the
    documents: both sides are sorted at any size, never broadcast.
    """
    copies = rows.select("lang", "source", F.sha2("text", 256).alias("digest"), "row")
    copies = copies.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    groups = copies.groupBy("lang", "digest").agg(F.min("row").alias("row"), F.collect_list(F.struct("source", "n")).alias("sources"))
    groups = shared_table(groups.select("row", "sources"), "text-groups")
    return rows.select("lang", "text", "row").join(groups.hint("merge"), "row").select("lang", "text", "sources")


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): occurrences and documents of every term, copies weighted. Each distinct text
    is cut into terms once; tasks add up before the exchange, which brings all sources of a term together, so that sums
    over them need no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_table()
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows():
            for (lang, source), (n, documents) in counts.items():
                size, names = len(n), list(n)
                columns = [
                    pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                    pa.array(n.values(), pa.int64()), pa.array([documents[t] for t in names], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])
            counts.clear()

        for batch in batches:
            for lang, text, sources in zip(*batch.columns, strict=True):
                found, lang = terms(text.as_py(), table), lang.as_py()
                once = None
                for s in sources.as_py():
                    n, documents = counts.setdefault((lang, s["source"]), (Counter(), Counter()))
                    if s["n"] == 1:
                        n.update(found)
                        documents.update(set(found))
                    else:
                        once = once or Counter(found)
                        for t, k in once.items():
                            n[t] += k * s["n"]
                            documents[t] += s["n"]
                if sum(len(n) for n, _ in counts.values()) > HELD_COUNTS:
                    yield from rows()
        yield from rows()

    part = texts.mapInArrow(run, "lang string, source string, term string, n long, documents long")
    return part.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exact: the product is a decimal."""
    wide = (n + F.lit(2)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = (total + kept * F.lit(2)).cast("decimal(20,0)")
    return F.call_function("div", wide, whole) + F.lit(1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", row: Column | None = None,
    least_documents: int = LEAST_DOCUMENTS, top: int = TOP,
) -> DataFrame:
    """lang, source, ``part``, ``item``, ``value``, ``rank``: for every source of a language its divergence from each other
    one (part ``pair``), and the terms that set it most apart from the whole language (part ``term``).

    A language keeps the terms of ``least_documents`` documents or more. A group's share of a term is smoothed, so a term that it lacks has one
    share for the whole group. Pairs are therefore summed over the terms that both hold, which meet by term, and
    over the counts of either side: terms of equal count in a source differ from the other's lacking share alike, so they are
    one row of a count table. The terms that neither holds are one product. Only sums by pair leave a task.

    Null text, lang and source count as empty. ``row`` tells the rows of ``docs`` apart and must be the same whenever it is
    read (``common.file_row``); without it the columns used are written first. Repeated rows are copies and weigh as
    such; a source without terms has shares too; a language that keeps no term has value 0 for its pairs and no
    term rows; a language of one source has no pairs. An empty table gives an empty table; other columns are not read.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    columns = [blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text")]
    rows = shared_table(docs.select(*columns), "audited").select("*", file_row().alias("row")) if row is None else docs.select(*columns, row.alias("row"))
    by_lang = Window.partitionBy("lang", "term")
    counts = term_counts(distinct_texts(rows)).withColumns({"all": F.sum("n").over(by_lang), "documents": F.sum("documents").over(by_lang)})
    kept = shared_table(counts.where(F.col("documents") >= least_documents).drop("documents"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_distinct("term").alias("kept"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("held"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["lang_n", "kept", "n", "held"])
    none = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("kept")))
    groups = shared_table(groups.withColumn("none", none), "source-groups")  # one row per source of a language

    shares = kept.join(groups.withColumnRenamed("n", "total"), ["lang", "source"])
    shares = shared_table(shares.select(
        "lang", "source", "term", "none", F.col("n"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("all"), F.col("lang_n"), F.col("kept")).alias("q"),
    ), "term-shares")

    f = F.col("value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    by_term = apart.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", f, "rank")

    a, b = shares.select("lang", "term", "source", "none", "p"), shares.select("lang", "term", F.col("source").alias("other"), F.col("none").alias("other_none"), F.col("p").alias("other_p"))
    both = a.join(b, ["lang", "term"]).where("source < other")
    gain = divergence(F.col("p"), F.col("other_p")) - divergence(F.col("p"), F.col("other_none")) - divergence(F.col("none"), F.col("other_p")) + divergence(F.col("none"), F.col("other_none"))
    both = both.groupBy("lang", "source", "other").agg(F.sum(gain).alias("both"))

    steps = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    alone = steps.join(others, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(divergence(F.col("p"), F.col("other_none")) * F.col("terms")).alias("alone"))

    one = groups.select("lang", "source", "none", "kept", "held")
    two = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"), F.col("held").alias("other_held"))
    pairs = one.join(two, "lang").where("source < other")
    pairs = pairs.join(both, ["lang", "source", "other"], "left").join(alone, ["lang", "source", "other"], "left")
    mirrored = alone.select("lang", F.col("source").alias("other"), F.col("other").alias("source"), F.col("alone").alias("other_alone"))
    pairs = pairs.join(mirrored, ["lang", "source", "other"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    lacking = (F.col("kept") - F.col("held") - F.col("other_held")) * F.coalesce(divergence(F.col("none"), F.col("other_none")), F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", "other", (zero("both") + zero("alone") + zero("other_alone") + lacking).alias("value"))
    ordered = pairs.select("lang", "source", F.col("other").alias("item"), f).union(pairs.select("lang", "other", "source", f))
    by_pair = ordered.withColumn("rank", F.row_number().over(best)).select("lang", "source", F.lit("pair").alias("part"), "item", f, "rank")
    return by_pair.unionByName(by_term)
