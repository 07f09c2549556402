"""Similarity join on word n-gram sets by MinHash banding with exact verification.

1. Each text becomes the set of its word 5-gram hashes (lower case, words of
   letters and digits). Texts of one set are one class from here on.
2. Every set gets b bands of r MinHashes, b and r chosen for a target recall at
   the threshold. Sets that share a band hash are linked in a star around the
   smallest id of their bucket, and the stars' components are the candidate
   groups: every pair that collides in a band is inside one group.
3. Groups are cut into blocks by hash. Every pair of blocks goes to one task,
   which verifies all its pairs on full sets and returns a row for each member:
   its number of links there and its parent in a spanning forest of the links.
   No pair leaves a task.
4. The components of the forests are the classes.

Null and empty texts have no n-grams: each is its own class with no links.
Exact copies count as links. Ties take the smaller id. ``id`` must be an
integer. A document is a pair of id and text: rows that repeat both are one
document, and one id on two texts is two. Rows without an id are a document
each; they come last in ties, and a class of such rows only has no id.
Where ids are missing or repeat, documents get keys in the order of their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, written
from .components import connected_components

#: Smallest and largest block of a candidate group; between them a group has about PARTS blocks, whose pairs go to different tasks.
BLOCK, LARGEST_BLOCK, PARTS = 64, 512, 40
#: Parts in which the members of a candidate group meet its size.
SALTS = 16


def choose_bands(threshold: float = 0.8, target_recall: float = 0.999, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which so few hashes reach the target recall at the threshold."""
    best = None
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("the target recall can't be met with so few hashes")
    return best


def _signatures(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        a = (rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        c = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]
        weight = rng.integers(1, 2**62, rows, dtype=tk.U64) * tk.U64(2) + tk.U64(1)
        for batch in batches:
            size, fp1, fp2, out = [], [], [], []
            for _, _, data, offsets in tk.pieces(batch.column(1)):
                _, _, hashes, first = tk.tokens(data, offsets)
                for grams in tk.shingles(hashes, first, n):
                    size.append(len(grams))
                    fp1.append(int(grams.sum().view(np.int64)) if len(grams) else 0)
                    fp2.append(int((grams * (grams >> tk.U64(7) | tk.U64(1))).sum().view(np.int64)) if len(grams) else 0)
                    if not len(grams):
                        out.append(None)
                        continue
                    short = (grams >> tk.U64(32)).astype(np.uint32)
                    least = np.full((bands * rows, 1), 0xFFFFFFFF, dtype=np.uint32)
                    for at in range(0, len(short), 256):
                        hashed = a * short[None, at : at + 256]
                        hashed += c
                        least = np.minimum(least, hashed.min(axis=1, keepdims=True))
                    out.append(tk.mix((least.reshape(bands, rows).astype(tk.U64) * weight).sum(axis=1)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int32()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                names=["id", "h", "n", "f1", "f2", "bands"],
            )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.pieces(batch.column(0), 1 << 22):
                _, _, hashes, first = tk.tokens(data, offsets)
                grams = tk.shingles(hashes, first, n)
                columns = [pa.array([g.tobytes() for g in grams], pa.binary())]
                columns += [batch.column(k).slice(lo, hi - lo) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["grams", *batch.schema.names[1:]])

    return run


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every row set with every column set."""
    values = np.concatenate(rows + columns)
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(x) for x in rows] + [len(x) for x in columns])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    for at in range(0, int(column[-1]) + 1, 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        block = np.zeros((len(rows) + len(columns), 2048), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        out += block[: len(rows)] @ block[len(rows) :].T
    return out


def _verify_block(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray], cross: bool, threshold: float) -> tuple[list[int], list[int], list[int]]:
    """Members with links, their numbers of linked documents, and their parents in a spanning forest."""
    left = np.flatnonzero(side == 0) if cross else np.arange(len(ids))
    right = np.flatnonzero(side == 1) if cross else left
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    inter = overlaps([sets[i] for i in left], [sets[i] for i in right])
    linked = inter >= np.float32(threshold) * (sizes[left][:, None] + sizes[right][None, :] - inter) - np.float32(1e-3)
    exact = inter[linked] / (np.add.outer(sizes[left], sizes[right])[linked] - inter[linked]) >= threshold - 1e-9
    linked[linked] = exact
    if not cross:
        np.fill_diagonal(linked, False)
    count = np.zeros(len(ids), dtype=np.int64)
    count[left] += (linked * copies[right][None, :]).sum(axis=1)
    if cross:
        count[right] += (linked * copies[left][:, None]).sum(axis=0)
    label = ids.copy()
    while True:  # labels fall to the smallest id that links reach
        l, r = label[left], label[right]
        most = np.iinfo(np.int64).max
        down = np.minimum(l, np.where(linked, r[None, :], most).min(axis=1, initial=most))
        label[left] = down
        up = np.minimum(label[right], np.where(linked, label[left][:, None], most).min(axis=0, initial=most))
        if (down == l).all() and (up == r).all():
            break
        label[right] = np.minimum(label[right], up)
    keep = count > 0
    return ids[keep].tolist(), count[keep].tolist(), label[keep].tolist()


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        found: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(rows) > 1:
                ids, copies, side = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
                got = _verify_block(ids, copies, side, [np.frombuffer(r[3], dtype=tk.U64) for r in rows], key[1] != key[2], threshold)
                for whole, part in zip(found, got):
                    whole.extend(part)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "links", "parent"])

        for batch in batches:
            column = [c.to_pylist() for c in batch.columns]
            for g, i, j, a, copies, side, grams in zip(*column):
                if (g, i, j) != key:
                    close()
                    key, rows = (g, i, j), []
                rows.append((a, copies, side, grams))
            if len(found[0]) > 10_000:
                yield table()
                found = ([], [], [])
        close()
        yield table()

    return run


def similarity_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, n: int = 5, target_recall: float = 0.999, most_hashes: int = 256) -> DataFrame:
    """(id, class_id, n_links) of every document."""
    return document_classes(docs, id, text, threshold, n, target_recall, most_hashes).select(
        F.col("id").alias(id), F.col("first.id").alias("class_id"), "n_links"
    )


def document_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, n: int = 5, target_recall: float = 0.999, most_hashes: int = 256) -> DataFrame:
    """(id, h, n, n_links, first, own) of every document: hash of the text, size of its set, links, id and hash of the first document of its class, and whether that is itself."""
    bands, rows = choose_bands(threshold, target_recall, most_hashes)
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    signed = written(
        source.select("id", "text", "h").mapInArrow(_signatures(bands, rows, n), "id long, h long, n int, f1 long, f2 long, bands array<long>"), "signatures"
    )
    keys = None
    if not _own_ids(signed):
        counted = signed.groupBy("id", "h").agg(F.count("*").alias("times"))
        keys = written(counted.orderBy(F.col("id").asc_nulls_last(), "h").withColumn("key", F.monotonically_increasing_id()), "keys")
        k = keys.withColumnsRenamed({"id": "doc", "h": "hash"})
        same = F.col("id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("hash"))
        once = signed.groupBy("id", "h").agg(*[F.first(c).alias(c) for c in ("n", "f1", "f2", "bands")])
        signed = written(
            once.join(k, same).select(F.col("key").alias("id"), "n", "f1", "f2", "bands", F.when(F.col("doc").isNull(), F.col("times")).otherwise(1).alias("rows")), "signatures"
        )
    else:
        signed = signed.withColumn("rows", F.lit(1))
    sets = signed.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.sum("rows").alias("copies"))
    sets = cut(sets)
    of_rep = signed.where("n > 0").join(sets.select("rep", "copies"), F.col("id") == F.col("rep"), "left_semi")
    banded = of_rep.select("id", F.posexplode("bands").alias("band", "h"))
    # stars: in each bucket the smallest id, then an edge from every other member to it
    least = banded.groupBy("band", "h").agg(F.min("id").alias("low"), F.count("*").alias("members")).where("members > 1")
    stars = banded.join(least, ["band", "h"]).where("id != low").select(F.col("id").alias("u"), F.col("low").alias("v")).distinct()
    groups = connected_components(stars)
    # a large group is spread over tasks, not read by one; merged, since a broadcast of the members would leave all rows of a group where its size is
    sized = groups.groupBy("component").agg(F.count("*").alias("size")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = (
        groups.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        .join(sized.hint("merge"), ["component", "salt"])
        .drop("salt")
        .join(sets.select(F.col("rep").alias("node"), "copies"), "node")
        .withColumn("blocks", F.ceil(F.col("size") / F.least(F.greatest(F.col("size") / PARTS, F.lit(BLOCK)), F.lit(LARGEST_BLOCK))).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    if keys is None:
        with_text = source.join(members.withColumnRenamed("node", "id"), "id")
    else:
        wanted = members.join(k.withColumnRenamed("key", "node"), "node")
        with_text = source.join(wanted, same).drop("id").withColumnRenamed("node", "id").dropDuplicates(["id"])
    texts = with_text.select("text", "component", "blocks", "block", "id", "copies")
    grams = texts.mapInArrow(_sets(n), "grams binary, component long, blocks int, block int, id long, copies long")
    paired = (
        grams.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            "component",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "id",
            "copies",
            (F.col("block") > F.col("other")).cast("long").alias("side"),
            "grams",
        )
    )
    verified = cut(
        paired.repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInArrow(_verify(threshold), "id long, links long, parent long")
    )
    links = verified.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    classes = connected_components(verified.select(F.col("id").alias("u"), F.col("parent").alias("v")))
    named = (
        sets.join(links, "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select("f1", "f2", "n", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    if keys is None:
        ids = signed.select("id", "h", "f1", "f2", "n")
        first = F.struct(F.coalesce("class_id", "id").alias("id"))
        own = F.coalesce("class_id", "id") == F.col("id")
    else:
        ids = signed.select("id", "f1", "f2", "n")
    found = ids.join(named, ["f1", "f2", "n"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    if keys is None:
        return found.select("id", "h", "n", "n_links", first.alias("first"), own.alias("own"))
    first = keys.select(F.col("key").alias("class_id"), F.struct("id", "h").alias("first"))
    return (
        found.withColumn("class_id", F.coalesce("class_id", "id"))
        .join(first, "class_id")
        .join(k, F.col("id") == F.col("key"))
        .withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("doc").isNull(), F.col("times")).otherwise(1))))
        .select(F.col("doc").alias("id"), F.col("hash").alias("h"), "n", "n_links", "first", (F.col("id") == F.col("class_id")).alias("own"))
    )


def _own_ids(signed: DataFrame) -> bool:
    total, distinct = signed.agg(F.count("*"), F.count_distinct("id")).first()
    return total == distinct


def one_per_class(docs: DataFrame, classes: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of :func:`document_classes`: of its first document; of rows that repeat that, the one with the smallest hash.

    Rows without an id and without words are each a class.
    """
    mine = F.col(id).cast("long")
    owners = classes.where("own")
    if _own_ids(docs.select(F.col(id).alias("id"))):
        return docs.join(owners.select(F.col("id").alias("_id")), mine == F.col("_id"), "left_semi")
    keep = owners.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg((F.col("_id").isNull() & (F.max("n") == 0)).alias("_all"))
    same = mine.eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_h"))
    kept = docs.join(keep, same)
    row = F.struct(*docs.columns).alias("_row")
    every = kept.where("_all").select(*docs.columns)
    single = kept.where("not _all").select("_id", "_h", row, F.xxhash64(*docs.columns).alias("_order"))
    return every.unionByName(single.groupBy("_id", "_h").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*"))
