"""Quality classifier: regularised quadratic discriminant on document statistics.

Each whole text becomes a short vector of transformed statistics. One Spark
aggregation over all labelled training rows gives mean and covariance of each
class. A covariance is shrunk towards the pooled one and towards a multiple of
the identity; its Cholesky factor is computed once and sent to the tasks, where
Mahalanobis distances and log determinants give the log-density difference. The
difference is calibrated by a logistic curve fitted to a histogram of it over a
fifth of the training rows (by hash) that the moments are not taken from.

Labels, language, source and id are never inputs of a score. Null and empty
texts are scored like any text (all counts are zero). Repeated ids are scored
row by row; equal rows of the labels count once; other columns are not read,
and texts of any length are read whole. Rows without a label or id are not learned from. Without rows of
both classes every score is the share of label 1, or 0.5 without any label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import bucket_of, written

#: The statistics, in the order of the vector.
NAMES = (
    "log_words",
    "log_word_length",
    "word_length_spread",
    "upper_share",
    "digit_share",
    "symbol_share",
    "bar_share",
    "shout_share",
    "stop_share",
    "comma_share",
    "log_line_words",
    "repeat_share",
    "distinct_share",
    "long_word_share",
    "capital_words",
    "byte_entropy",
)
FLAT = 40.0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&<>=_~^@{}[]\\/+"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _root(share: np.ndarray) -> np.ndarray:
    """Variance-stabilising transform of a share."""
    return np.arcsin(np.sqrt(np.clip(share, 0, 1)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a piece."""
    starts, ends, hashes, first = tk.tokens(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(offsets).astype(float)
    words = np.diff(first).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets]).astype(float)

    def per_words(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=float)])[first])

    some, chars = np.maximum(words, 1), np.maximum(size, 1)
    length = (ends - starts).astype(float)
    mean = per_words(length) / some
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log1p(mean)
    out[:, 2] = np.log1p(np.maximum(per_words(length**2) / some - mean**2, 0))
    upper = _UPPER[data]
    for k, flags in ((3, upper), (4, _DIGIT[data]), (5, _SYMBOL[data]), (6, data == 124), (7, data == 33), (8, data == 46), (9, data == 44)):
        out[:, k] = _root(per_text(flags) / chars)
    out[:, 10] = np.log1p(words / (1 + per_text(data == 10)))
    out[:, 13] = _root(per_words(length > 20) / some)
    out[:, 14] = _root(per_words(upper[starts]) / some) if len(starts) else 0
    grams = np.zeros(max(0, len(hashes) - 2), dtype=tk.U64)
    for k in range(3):
        grams = grams * tk.BASE + hashes[k : k + len(grams)]
    for d in range(n):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= 3:
            out[d, 11] = _root(np.array(1 - len(np.unique(grams[a : b - 2])) / (b - a - 2)))
        if b > a:
            out[d, 12] = np.log(len(np.unique(hashes[a:b]))) / np.log(b - a + 1)
        own = data[offsets[d] : offsets[d + 1]]
        if len(own):
            p = np.bincount(own, minlength=256) / len(own)
            out[d, 15] = -(p[p > 0] * np.log2(p[p > 0])).sum()
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in tk.pieces(batch.column(1)):
            rows = statistics(data, offsets)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(NAMES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], names=["doc_id", "x"])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_extract, "doc_id long, x array<double>")


@dataclass
class Model:
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0."""
        side = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            z = np.linalg.solve(factor, (x - mean).T)
            side.append(-0.5 * (z * z).sum(axis=0) - 0.5 * log_det)
        return side[1] - side[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.prior)
        t = np.clip(self.slope * squash(self.difference(x)) + self.offset, -40, 40)
        return 1 / (1 + np.exp(-t))


def squash(d: np.ndarray) -> np.ndarray:
    """Signed square root: tails of log densities grow quadratically."""
    return np.sign(d) * np.sqrt(np.abs(d))


def shrunk(cov: np.ndarray, n: float, pooled: np.ndarray, to_pooled: float, to_identity: float) -> np.ndarray:
    """Regularised covariance; small classes lean more on the pooled one."""
    a = to_pooled + (1 - to_pooled) * len(cov) / (len(cov) + n)
    mixed = (1 - a) * cov + a * pooled
    return (1 - to_identity) * mixed + to_identity * (np.trace(pooled) / len(cov) + 1e-9) * np.eye(len(cov))


def calibration_part(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for the moments and rows for the calibration, by hash of the vector; all rows for both where a part lacks a class."""
    part = F.pmod(F.xxhash64("x"), F.lit(5)) == 0
    rest, own = labelled.where(~part), labelled.where(part)
    seen = labelled.groupBy(part.alias("part")).agg(F.count_distinct("y").alias("classes")).where("classes = 2").count()
    return (rest, own) if seen == 2 else (labelled, labelled)


def fit(labelled: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.02) -> Model:
    """Model from (x, y) rows; only class moments and a histogram reach the driver."""
    k = len(NAMES)
    x = [F.get("x", i) for i in range(k)]
    labelled, calibration = calibration_part(labelled)
    moments = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]
    moments += [F.avg(x[i] * x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]
    rows = {r["y"]: r for r in labelled.groupBy("y").agg(F.count("*").alias("n"), *moments).collect()}
    total = sum(r["n"] for r in rows.values())
    prior = rows[1]["n"] / total if 1 in rows else (0.0 if total else 0.5)
    if set(rows) != {0, 1}:
        return Model(np.zeros((0, k)), np.zeros((0, k, k)), np.zeros(0), prior)
    means, covs = [], []
    for y in (0, 1):
        mean = np.array([rows[y][f"m{i}"] for i in range(k)])
        cov = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = rows[y][f"c{i}_{j}"] - mean[i] * mean[j]
        means.append(mean)
        covs.append(cov)
    n = np.array([rows[0]["n"], rows[1]["n"]], dtype=float)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    factors = [np.linalg.cholesky(shrunk(c, m, pooled, to_pooled, to_identity)) for c, m in zip(covs, n)]
    model = Model(np.array(means), np.array(factors), np.array([2 * np.log(np.diag(f)).sum() for f in factors]), prior)
    # differences are cut off where the curve is flat, so the histogram has at most 2 * FLAT * 10 + 1 bins
    flat = F.greatest(F.least(F.col("score"), F.lit(FLAT)), F.lit(-FLAT))
    bins = scored(calibration, model, "difference").groupBy("y", F.round(flat, 1).alias("d")).agg(F.count("*").alias("n"))
    bins = bins.groupBy("d").agg(F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n"))).alias("n0")).toPandas().fillna(0)
    model.slope, model.offset = calibrated(bins["d"].to_numpy(float), bins["n0"].to_numpy(float), bins["n1"].to_numpy(float))
    return model


def calibrated(d: np.ndarray, n0: np.ndarray, n1: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve through binned counts (ridge Newton steps)."""
    b, design = np.zeros(2), np.stack([d, np.ones(len(d))], axis=1)
    penalty = np.diag([1e-2, 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ (n1 - (n0 + n1) * p) - penalty @ b
        hessian = (design * ((n0 + n1) * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        b += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(b[0]), 1e-6), float(b[1])


def scored(vectors: DataFrame, model: Model, what: str = "score") -> DataFrame:
    """Add ``score``: the probability of label 1, or the squashed log-density difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, len(NAMES))
            score = model.score(x) if what == "score" else squash(model.difference(x))
            keep = [i for i, name in enumerate(batch.schema.names) if name != "x"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(score, pa.float64())], names=[*[batch.schema.names[i] for i in keep], "score"])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "x"]
    return vectors.mapInArrow(run, ", ".join([*rest, "score double"]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learned from rows that are not held out."""
    vectors = written(features(docs, doc_id, text), "quality")
    y = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1)).distinct()
    train = vectors.join(y.where(bucket_of(F.col("doc_id"), modulus) != held_out), "doc_id").select("x", "y")
    model = fit(train)
    return scored(vectors, model).select(
        "doc_id",
        F.coalesce(bucket_of(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
