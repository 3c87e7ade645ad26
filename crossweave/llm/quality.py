"""Operator 3: quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_type, shared_table
from .labels import calibrated, learned_labels

STATISTICS = (
    "bytes", "words", "word_bytes", "capitals", "symbols", "exclamations", "digits", "stops", "repeated_words", "top_word",
    "repeated_pairs", "word_runs", "repeated_lines", "lines", "line_words", "entropy", "beyond_ascii", "pipes",
)
#: share of the pooled covariance, and of the scaled identity, in each class covariance
TO_POOLED, TO_IDENTITY = 0.1, 0.02


def statistics(raw: bytes) -> list[float]:
    """Transformed statistics of a text: counts as logarithms, shares as square roots. All zero for an empty text."""
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    runs = sum(map(bytes.__eq__, words, words[1:]))
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    p = hist[hist > 0] / n
    among = lambda s: float(hist[list(s)].sum())
    share = lambda a, b: (a / b) ** 0.5 if b > 0 else 0.0
    return [
        np.log1p(n), np.log1p(m), np.log1p(sum(map(len, words)) / m) if m else 0.0, share(upper, upper + lower), share(among(b"#$%&*~^@<>{}[]=+\\_/"), n),
        share(hist[33], n), share(hist[48:58].sum(), n), share(among(b".,;:?"), n), share(m - len(seen), m), share(max(seen.values(), default=0), m),
        share(max(m - 1 - pairs, 0), m - 1), share(runs, m - 1), share(len(lines) - len(set(lines)), len(lines)), np.log1p(len(lines)),
        np.log1p(m / len(lines)) if lines else 0.0, float(-(p * np.log2(p)).sum()), share(hist[128:].sum(), n), share(hist[124], n),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): one vector per document; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics((v.as_py() or "").encode()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {field_type(docs, id_col)}, x array<double>")


@dataclass
class Discriminant:
    """Means, and inverse Cholesky factors with log-determinants, of both classes in standardised units."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiteners: list[np.ndarray]
    offsets: list[float]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 minus that of class 0."""
        z = (x - self.center) / self.scale
        logs = [o - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiteners, self.offsets, strict=True)]
        return logs[1] - logs[0]


def class_moments(rows: DataFrame, size: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``x`` by class ``y``. Tasks add up their rows; the driver gets
    2 * (1 + size + size * size) numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten()).reshape(len(y), size)
            for k in (0, 1):
                part = np.c_[np.ones((y == k).sum()), x[y == k]]
                total[k] = total.get(k, 0) + part.T @ part
        for k, s in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * s.size, pa.int32()), pa.array(range(s.size), pa.int32()), pa.array(s.ravel(), pa.float64())], ["y", "i", "v"]
            )

    sums = rows.select("y", "x").mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in (0, 1):
        s = np.zeros((size + 1) ** 2)
        for r in sums:
            if r["y"] == k:
                s[r["i"]] = r["v"]
        s = s.reshape(size + 1, size + 1)
        out[k] = (s[0, 0], s[0, 1:], s[1:, 1:])
    return out


def fit_discriminant(moments, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant | None:
    """None if a class has no rows."""
    n = [moments[k][0] for k in (0, 1)]
    if min(n) < 1:
        return None
    total = sum(n)
    center = sum(moments[k][1] for k in (0, 1)) / total
    second = np.diag(sum(moments[k][2] for k in (0, 1)) / total)
    scale = np.sqrt(np.maximum(second - center**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    means, covariances = [], []
    for k in (0, 1):
        mean = moments[k][1] / n[k]
        means.append((mean - center) / scale)
        covariances.append((moments[k][2] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / total
    whiteners, offsets = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * covariances[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(pooled) / len(c), 1e-6) * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        whiteners.append(np.linalg.inv(factor))
        offsets.append(float(np.log(n[k] / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(center, scale, means, whiteners, offsets)


def score_quality(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """One row per document: id and ``score`` in 0 to 1, higher where label 1 is likelier.

    One pass turns texts into statistics; they are written once, so texts are never shuffled. Class sums over all
    labelled rows open to learning give the two Gaussians; each task scores with the cached factors. The signed
    logarithm of the density difference is calibrated against the labels by one counting pass.

    Null and empty texts are scored as texts without words. Repeated rows and null ids keep one score each; labels
    of unknown documents and null labels are left out; without labels of both classes every score is 0.5.
    Other columns are never read.
    """
    size = len(STATISTICS)
    x = shared_table(document_statistics(docs, id_col, text_col), "statistics")
    known = learned_labels(labels, label_col, modulus, remainder, id_col)
    model = fit_discriminant(class_moments(x.join(known, "id"), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.difference(v), pa.float64())], ["id", "d"])

    if model is None:
        return x.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))
    scored = x.mapInArrow(run, f"id {field_type(x, 'id')}, d double")
    value = F.signum("d") * F.log1p(F.abs("d"))
    slope, offset = calibrated(scored, known, value)
    return scored.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-(value * slope + offset)))).alias("score"))
