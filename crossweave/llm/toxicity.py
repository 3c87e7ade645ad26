"""Operator 5: toxicity by weak supervision. Lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_type, shared_table
from .labels import calibrated, learned_labels

#: labelled rows the voters are chosen from (the smallest hashes of their ids), and the most voters
MINED_ROWS, VOTERS = 20_000, 256
#: candidates for voters that reach the driver, the strongest first
CANDIDATES = 4096
PREFIXES = range(4, 10)
#: words of one beginning that ``b*``, ``b**`` and ``b***`` ask for
DOSES = (1, 2, 4)
#: a candidate needs so many toxic rows (one more below the highest dose) and such a precision (lower bound); of those taken at most such a share is chance
LEAST_HITS, LEAST_PRECISION, CHANCE = 2, 0.15, 0.25
#: precision asked of the higher doses: their words are hits for the patterns, so one dose of common words would fire them too
DOSE_PRECISION = 0.5
#: pattern voters over all lexicon hits of a text: so many of them, or such a share of its words
HITS, SHARES = (2, 3, 5), (0.005, 0.01, 0.015)
PATTERNS = len(HITS) + len(SHARES)
ROUNDS = 8
WORD = re.compile(r"[^\W\d_]+")
#: what the classifier sees besides the voters
GENERAL = ("one", "fired", "fired_share", "strength", "strongest", "words", "capitals", "exclamations")


def marks(text: str) -> set[str]:
    """What voters look for: the words of a text, the beginnings of its longer words (``abcd*``), and beginnings that
    two or four of its words share, a repeated word counted as often as it stands there (``abcd**``, ``abcd***``)."""
    found = Counter(WORD.findall(text.lower()))
    begun: Counter = Counter()
    for w, n in found.items():
        for k in PREFIXES:
            if len(w) <= k:
                break
            begun[w[:k]] += n
    return found.keys() | {b + "*" * k for b, n in begun.items() for k, least in enumerate(DOSES, 1) if n >= least}


def mine(texts: DataFrame, toxic: int, other: int) -> list[tuple[str, float]]:
    """(mark, evidence) of the marks that speak most for toxic rows, strongest first.

    ``texts`` holds (text, y) of the bounded labelled sample, with ``toxic`` and ``other`` rows. Tasks count marks of
    their rows before the exchange. Evidence is twice the log-likelihood ratio against the base rate. How much is
    asked for follows from the sample, see ``beyond_chance``: from the number of words and beginnings tested, and for the higher
    doses from the number of marks of that dose that occur in about as many rows. Many words occur in two rows, but
    few texts begin four words alike, so two toxic rows say much there and little elsewhere."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                seen[y.as_py()].update(marks(text.as_py() or ""))
        keys = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["mark", "p", "n"]
        )

    counted = texts.select("text", "y").mapInArrow(count, "mark string, p long, n long").groupBy("mark").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    base, z = toxic / max(toxic + other, 1), 1.28
    total = F.col("p") + F.col("n")
    share = F.col("p") / total
    wilson = (share + z * z / (2 * total) - z * F.sqrt(share * (1 - share) / total + z * z / (4 * total * total))) / (1 + z * z / total)
    part = lambda k, rate: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / total / rate)).otherwise(0.0)
    evidence = 2 * (part("p", base) + part("n", 1 - base))
    dose = F.length("mark") - F.length(F.rtrim("mark", F.lit("*")))
    # doses above one: by rows too, in two steps per power of two; words and single beginnings together
    stratum = F.struct(F.greatest(dose, F.lit(1)).alias("dose"), F.when(dose > 1, F.floor(2 * F.log2(total))).otherwise(0).alias("rows")).alias("stratum")
    least = F.when(dose > 2, LEAST_HITS).otherwise(LEAST_HITS + 1)
    tested = shared_table(counted.where(total >= least).withColumn("stratum", stratum), "marks")
    size = {tuple(r["stratum"]): r["count"] for r in tested.groupBy("stratum").count().collect()}
    best = tested.where(F.col("p") >= least).withColumn("evidence", evidence).where((wilson >= F.when(dose > 1, DOSE_PRECISION).otherwise(LEAST_PRECISION)) & (share > base))
    strongest: dict[tuple, list[tuple[str, float]]] = {}
    for r in best.orderBy(F.desc("evidence"), "mark").limit(CANDIDATES).collect():
        strongest.setdefault(tuple(r["stratum"]), []).append((r["mark"], r["evidence"]))
    taken = [c for s, found in strongest.items() for c in found[: beyond_chance([e for _, e in found], size[s])]]
    if not taken:  # few labels: the marks that only toxic rows hold, and most of them, stand in; the label model weighs them
        pure = counted.where(f"p >= {LEAST_HITS} and n = 0").withColumn("evidence", evidence)
        rows = pure.orderBy(F.desc("evidence"), "mark").limit(CANDIDATES).collect()
        taken = [(r["mark"], r["evidence"]) for r in rows if r["evidence"] == rows[0]["evidence"]]
    return sorted(taken, key=lambda c: (-c[1], c[0]))


def beyond_chance(evidence: list[float], tested: int) -> int:
    """How many of the strongest candidates to take so that chance explains at most the share CHANCE of them, among so
    many marks tested (Benjamini and Hochberg). Half the evidence bounds the logarithm of a chance result as strong
    (Chernoff), for few rows as for many."""
    return max((k for k, e in enumerate(evidence, 1) if tested * np.exp(-e / 2) <= CHANCE * k), default=0)


def choose(candidates: list[tuple[str, float]], most: int = VOTERS) -> list[str]:
    """Marks in order of evidence, the wider one among equals; one whose letters begin another's, or are begun by
    them, is left out, except the doses of one beginning."""
    chosen: dict[str, str] = {}
    for m, _ in sorted(candidates, key=lambda c: (-c[1], len(c[0].rstrip("*")), c[0])):
        body = m.rstrip("*")
        near = {b for b in chosen.values() if body.startswith(b) or b.startswith(body)}
        if len(chosen) < most and near <= {body}:
            chosen[m] = body
    return list(chosen)


class Voters:
    """Lexicon marks, then the patterns over all their hits."""

    def __init__(self, lexicon: list[str]):
        self.size = len(lexicon)
        self.exact = {m: i for i, m in enumerate(lexicon) if not m.endswith("*")}
        self.begins: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for i, m in enumerate(lexicon):
            if m.endswith("*"):
                body = m.rstrip("*")
                self.begins.setdefault(len(body), {}).setdefault(body, []).append((DOSES[len(m) - len(body) - 1], i))

    def cast(self, text: str) -> tuple[list[int], tuple[float, float, float]]:
        """Sorted numbers of the voters that fire, and general statistics (words, capitals, exclamations)."""
        found = WORD.findall(text.lower())
        words = set(found)
        hit = words & self.exact.keys()
        fired = {self.exact[w] for w in hit}
        for k, names in self.begins.items():
            begun = [w for w in words if w[:k] in names and len(w) > k]
            if begun:
                begun = set(begun)
                dose = Counter(w[:k] for w in found if w in begun)
                fired |= {i for b, n in dose.items() for least, i in names[b] if n >= least}
                hit |= {w for w in begun if dose[w[:k]] >= min(names[w[:k]])[0]}
        if hit:
            hits = sum(map(hit.__contains__, found))
            passed = [hits >= h for h in HITS] + [hits >= s * len(found) and hits > 1 for s in SHARES]
            fired |= {self.size + i for i, x in enumerate(passed) if x}
        n = max(len(text), 1)
        return sorted(fired), (float(np.log1p(len(found))), (sum(map(str.isupper, text)) / n) ** 0.5, (text.count("!") / n) ** 0.5)


def cast_votes(docs: DataFrame, lexicon: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, votes, words, capitals, exclamations) of every document."""
    voters = Voters(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast = [voters.cast(v.as_py() or "") for v in batch.column(1)]
            columns = [pa.array([g[k] for _, g in cast], pa.float64()) for k in range(3)]
            votes = pa.array([v for v, _ in cast], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), votes, *columns], ["id", "votes", "words", "capitals", "exclamations"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {field_type(docs, id_col)}, votes array<int>, words double, capitals double, exclamations double"
    )


@dataclass
class LabelModel:
    """Share of toxic rows, each voter's firing rate by class, and the weight its correlations leave it."""

    prior: float
    rates: np.ndarray  # (2, voters)
    weights: np.ndarray

    @property
    def evidence(self) -> np.ndarray:
        """Log-odds of a firing voter, and (last) the log-odds of a row where none fires."""
        fire = self.weights * np.log(self.rates[1] / self.rates[0])
        silent = self.weights * np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        return np.r_[fire - silent, np.log(self.prior / (1 - self.prior)) + silent.sum()]

    def log_odds(self, votes) -> float:
        e = self.evidence
        return float(e[-1] + e[list(votes)].sum())


def fit_label_model(patterns: DataFrame, rows: int, labelled: np.ndarray, sizes: tuple[int, int], rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over all rows; labelled rows take part a second time with their known class, which
    anchors the classes.

    ``patterns`` has one row per set of firing voters with its count ``n``; a round is one aggregation to two numbers
    per voter. ``labelled`` counts firings by class (2, voters), ``sizes`` the labelled rows. Correlations come from weighted counts of
    voters that fire together: a voter shares its weight with those it repeats beyond chance within the toxic
    class, so forms of one word count about once.
    """
    m, known = labelled.shape[1], np.array(sizes, float)
    rates = (labelled + 0.5) / (known[:, None] + 1)
    prior = float(np.clip(known[1] / known.sum(), 1e-4, 0.5))
    model = LabelModel(prior, rates, np.ones(m))
    for k in range(rounds):
        e = model.evidence
        literal = F.array(*[F.lit(float(x)) for x in e[:-1]])
        odds = F.aggregate("votes", F.lit(float(e[-1])), lambda a, v: a + F.element_at(literal, v + 1))
        weighed = patterns.select("n", "votes", (F.col("n") / (1 + F.exp(-odds))).alias("t"))
        # voter -1 stands for all rows
        by_voter = weighed.select("n", "t", F.explode(F.concat(F.array(F.lit(-1)), "votes")).alias("v")).groupBy("v").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
        fired, toxic = np.zeros((2, m)), 0.0
        for r in by_voter:
            if r["v"] < 0:
                toxic = r["t"]
            else:
                fired[:, r["v"]] = r["n"] - r["t"], r["t"]
        size = np.array([max(rows - toxic, 0.0), toxic])
        rates = (fired + labelled + 0.5) / (size + known + 1)[:, None]
        before, prior = prior, float(np.clip((toxic + known[1]) / (rows + known.sum()), 1e-4, 0.5))
        model = LabelModel(prior, np.clip(rates, 1e-9, 0.999), model.weights)
        if k == 0 and toxic > 1:
            pairs = weighed.select("t", F.explode("votes").alias("a"), "votes").select("t", "a", F.explode("votes").alias("b")).where("a < b")
            joint = np.zeros((m, m))
            for r in pairs.groupBy("a", "b").agg(F.sum("t").alias("t")).collect():  # at most voters squared
                joint[r["a"], r["b"]] = joint[r["b"], r["a"]] = r["t"] / toxic
            q = fired[1] / toxic
            spread = np.sqrt(np.outer(q * (1 - q), q * (1 - q)))
            correlation = np.where(spread > 1e-9, (joint - np.outer(q, q)) / np.maximum(spread, 1e-9), 0)
            np.fill_diagonal(correlation, 0)
            model.weights = 1 / (1 + np.clip(np.where(correlation > 0.1, correlation, 0), 0, 1).sum(axis=1))
        elif abs(prior - before) < 1e-5:
            break
    return model


def features(starts: np.ndarray, fired: np.ndarray, general: np.ndarray, model: LabelModel) -> np.ndarray:
    """Classifier input of some rows: general features, then one indicator per voter. Row k fires
    ``fired[starts[k]:starts[k + 1]]``; ``general`` has its words, capitals and exclamations."""
    n, e = len(general), model.evidence[:-1]
    number = np.diff(starts)
    row = np.repeat(np.arange(n), number)
    strongest = np.zeros(n)
    np.maximum.at(strongest, row, np.maximum(e[fired], 0.0))
    x = np.zeros((n, len(GENERAL) + len(e)))
    x[:, 0] = 1.0
    x[:, 1] = np.log1p(number)
    x[:, 2] = number / (1 + np.exp(general[:, 0]))
    x[:, 3] = np.log1p(np.maximum(np.bincount(row, weights=e[fired], minlength=n), 0.0))
    x[:, 4] = np.sqrt(strongest)
    x[:, 5:8] = general
    x[row, len(GENERAL) + fired] = 1.0
    return x


def _cast_columns(batch: pa.RecordBatch, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, fired voters and general statistics of a batch of cast votes whose columns begin at ``first``."""
    votes = batch.column(first)
    starts = np.r_[0, np.cumsum(votes.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    general = np.stack([batch.column(first + k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)], axis=1) if len(votes) else np.zeros((0, 3))
    return starts, votes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), general


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def fit_classifier(cast: DataFrame, model: LabelModel, rounds: int = 14, ridge: float = 2.0) -> np.ndarray:
    """Logistic regression on the posterior labels of all rows by damped Newton steps. A step is one aggregation in which
    tasks send sums of a size fixed by the number of voters; one that does not lower the loss is halved, so the
    result is never worse than a smaller step's."""
    size = len(GENERAL) + len(model.weights)
    keep = np.r_[1e-6, np.full(size - 1, ridge)]

    def sums(w):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient, hessian = 0.0, np.zeros(size), np.zeros((size, size))
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    starts, fired, general = _cast_columns(batch.slice(lo, 4096))
                    silent = np.diff(starts) == 0
                    y = _sigmoid(model.evidence[-1] + np.bincount(np.repeat(np.arange(len(general)), np.diff(starts)), weights=model.evidence[:-1][fired], minlength=len(general)))
                    whole = features(starts, fired, general, model)
                    # rows without a vote touch the general features only
                    for rows, width in ((silent, len(GENERAL)), (~silent, size)):
                        x, t = whole[rows, :width], y[rows]
                        p = _sigmoid(x @ w[:width])
                        loss -= float((t * np.log(p) + (1 - t) * np.log1p(-p)).sum())
                        gradient[:width] += x.T @ (t - p)
                        hessian[:width, :width] += (x * (p * (1 - p))[:, None]).T @ x
            both = np.r_[loss, gradient, hessian.ravel()]
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(both[at], pa.float64())], ["i", "v"])

        rows = cast.select("votes", "words", "capitals", "exclamations").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        both = np.zeros(1 + size + size * size)
        both[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
        return both[0] + 0.5 * float(keep @ (w * w)), both[1 : size + 1] - keep * w, both[size + 1 :].reshape(size, size) + np.diag(keep)

    best, least, move = np.zeros(size), np.inf, np.zeros(size)
    best[0] = np.log(model.prior / (1 - model.prior))
    for _ in range(rounds):
        loss, gradient, hessian = sums(best + move)
        if loss > least:
            move = move / 4
        else:
            gain, best, least = least - loss, best + move, loss
            if gain < 1e-4 * abs(least):
                break
            move = np.linalg.solve(hessian, gradient)
            move *= min(1.0, 4.0 / np.abs(move).max())
        if np.abs(move).max() < 0.02:
            break
    return best


@dataclass
class ToxicityModel:
    lexicon: list[str]
    labels: LabelModel
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, starts: np.ndarray, fired: np.ndarray, general: np.ndarray) -> np.ndarray:
        return features(starts, fired, general, self.labels) @ self.weights


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> tuple[ToxicityModel | None, DataFrame | None]:
    """The model, and every document's (id, t) log-odds before calibration. (None, None) without voters.

    Voters are words and word beginnings found in a bounded sample of the labelled rows open to learning
    (``MINED_ROWS``, the smallest id hashes; broadcast). All documents are read once more to cast votes, which are
    written; the label model and the classifier use the votes of all documents. The last step fits a curve of the
    labels open to learning over the classifier's log-odds.
    """
    known = learned_labels(labels, label_col, modulus, remainder, id_col)
    sample = shared_table(known.orderBy(F.xxhash64("id"), "id").limit(MINED_ROWS), "mined")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most MINED_ROWS
    lexicon = choose(mine(texts, sizes.get(1, 0), sizes.get(0, 0))) if len(sizes) == 2 else []
    if not lexicon:
        return None, None
    cast = shared_table(cast_votes(docs, lexicon, id_col, text_col), "votes")
    patterns = shared_table(cast.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    rows = patterns.agg(F.sum("n")).first()[0] or 0
    everyone = F.explode(F.concat(F.array(F.lit(-1)), "votes")).alias("v")
    labelled, of_class = np.zeros((2, len(lexicon) + PATTERNS)), [0, 0]
    for r in cast.join(known, "id").select("y", everyone).groupBy("y", "v").count().collect():
        if r["v"] < 0:
            of_class[r["y"]] = r["count"]
        else:
            labelled[r["y"], r["v"]] = r["count"]
    votes = fit_label_model(patterns, rows, labelled, tuple(of_class))
    model = ToxicityModel(lexicon, votes, fit_classifier(cast, votes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [model.log_odds(*_cast_columns(batch.slice(lo, 4096), 1)) for lo in range(0, batch.num_rows, 4096)]
            odds = np.concatenate([*odds, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odds, pa.float64())], ["id", "t"])

    scored = cast.mapInArrow(run, f"id {field_type(cast, 'id')}, t double")
    slope, offset = calibrated(scored, known, F.col("t"))
    return ToxicityModel(lexicon, votes, model.weights, slope, offset), scored


def score_toxicity(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """One row per document: id and ``score`` in 0 to 1, higher where label 1 is likelier; see ``fit_toxicity``.

    Null and empty texts cast no vote and get the score of a text without words. Repeated rows and null ids keep one
    score each; null labels and labels of unknown documents are left out. Without a word that two toxic rows and no others hold there are no
    voters and every score is 0. Other columns are never read.
    """
    model, scored = fit_toxicity(docs, labels, modulus, remainder, id_col, text_col, label_col)
    if model is None:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score"))
    score = 1 / (1 + F.exp(-(F.col("t") * model.slope + model.offset)))
    return scored.select(F.col("id").alias(id_col), score.alias("score"))


def keep_below(docs: DataFrame, model: ToxicityModel | None, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below ``threshold``. One pass, no shuffle."""
    if model is None:
        return docs
    voters, at = Voters(model.lexicon), docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any name is allowed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast = [voters.cast(v.as_py() or "") for v in batch.column(at)]
            keep = np.zeros(0, bool)
            for lo in range(0, len(cast), 4096):
                part = cast[lo : lo + 4096]
                starts = np.r_[0, np.cumsum([len(v) for v, _ in part])]
                fired = np.array([i for v, _ in part for i in v], np.int64)
                odds = model.log_odds(starts, fired, np.array([g for _, g in part]))
                keep = np.r_[keep, 1 / (1 + np.exp(-(odds * model.slope + model.offset))) < threshold]
            yield batch.filter(pa.array(keep))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
