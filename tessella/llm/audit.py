"""How filters interact: who removes what in every order, from signed parity sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
#: Bit of a filter in a mask of failed filters.
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"

ORDERS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str) -> int:
    """The filters A to D that a text fails.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * letters
    A-Z > 2 * code points; D: any of ``#$%&*|``. Words are maximal runs without
    ASCII white space, case-sensitive.
    """
    raw = text.encode("utf-8")
    words = raw.split()  # of bytes: splits at \x20 and \x09-\x0D only
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return (
        BIT["A"] * (len(words) < 200)
        | BIT["B"] * (100 * len(set(words)) < 50 * len(words))
        | BIT["C"] * (100 * capitals > 2 * len(text))
        | BIT["D"] * (symbols > 0)
    )


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("part"),
                pa.array([hashlib.sha256(t.encode("utf-8")).digest() for t in texts], pa.binary()),
                pa.array([failures(t) for t in texts], pa.int32()),
            ],
            ["doc_id", "part", "digest", "mask"],
        )


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): numbers of documents by part, failed filters and labels.

    E fails where a smaller id anywhere has the same text (null texts are
    empty). Ids are compared in their own type; a row without an id has no
    smaller one and no label. A document is good or toxic if any label row of
    its id says so.
    """
    kind = docs.schema["doc_id"].dataType
    told = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(_facts, f"doc_id {kind.simpleString()}, part string, digest binary, mask int")
    # repeated rows become one before anything is joined; written, so that texts are read once
    rows = written(told.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "failures")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("_first")).where("doc_id IS NOT NULL")
    # the key holds the id, so the copies of one text are spread
    judged = rows.join(firsts, ["digest", "doc_id"], "left")
    again = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    cells = judged.select("doc_id", "digest", "part", F.when(again, F.col("mask") + BIT["E"]).otherwise(F.col("mask")).alias("mask"), "n")
    says = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast(kind).alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    # rows without an id find no label; they are many keys, not one
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0))
    known = cells.withColumn("_s", spread).join(says.withColumn("_s", F.lit(0).cast("long")), ["doc_id", "_s"], "left")
    return known.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")


def _sign(mask: Column, subset: int) -> Column:
    """-1 where an odd number of the subset's filters failed, else 1."""
    return F.lit(1) - 2 * F.pmod(F.bit_count(mask.bitwiseAND(F.lit(subset))), F.lit(2))


def parity_sums(cells: DataFrame) -> DataFrame:
    """(part, all, good, toxic): for each label class 32 sums of signed parities, one for each subset of filters."""
    n, mask = F.col("n"), F.col("mask")
    weights = {"all": n, "good": F.when(F.col("good"), n).otherwise(F.lit(0)), "toxic": F.when(F.col("toxic"), n).otherwise(F.lit(0))}
    sums = [F.sum(w * _sign(mask, s)).alias(f"_{label}{s}") for label, w in weights.items() for s in range(32)]
    return cells.groupBy("part").agg(*sums).select("part", *[F.array(*[F.col(f"_{label}{s}") for s in range(32)]).alias(label) for label in weights])


def inverted(sums: np.ndarray) -> np.ndarray:
    """The counts of masks whose parity sums these are: the Walsh-Hadamard transform is its own inverse but for the factor 32."""
    out = sums.astype(np.int64).copy()
    for bit in BIT.values():
        for low in range(32):
            if not low & bit:
                out[low], out[low | bit] = out[low] + out[low | bit], out[low] - out[low | bit]
    assert not (out % 32).any()
    return out // 32


def _steps(part: str, every: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """The rows of one part: all orders of the filters and their steps."""
    at = np.arange(32)
    failed = np.array([m.bit_count() for m in range(32)])
    share = {f: int(sum(int(every[m]) * 120 // int(failed[m]) for m in at if m & BIT[f])) for f in FILTERS}
    for order in permutations(FILTERS):
        before, kept = 0, int(every.sum())
        for step, f in enumerate(order, 1):
            fails = (at & BIT[f]) > 0
            here = fails & ((at & before) == 0)
            removed = int(every[here].sum())
            kept -= removed
            yield (
                part, "".join(order), step, kept, removed, int(every[fails].sum()) - removed,
                int(every[BIT[f]]), int(good[here].sum()), int(toxic[here].sum()), share[f],
            )
            before |= BIT[f]


def _evaluated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part, *sums in frame[["part", "all", "good", "toxic"]].itertuples(index=False):
            yield pd.DataFrame(list(_steps(part, *[inverted(np.asarray(s)) for s in sums])), columns=[c.split()[0] for c in ORDERS.split(", ")])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step (see ``ORDERS``).

    ``redundant`` fail the filter but were removed before it; ``unique_fails``
    fail no other; ``shapley`` is what the filter removes over all 120 orders: a
    document that fails k filters is removed by each of them in 120 / k orders.
    Null sources are the part of the empty string; an empty table gives no rows.
    """
    return parity_sums(masks(docs, labels)).mapInPandas(_evaluated, ORDERS)
