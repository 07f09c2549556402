"""Duplicate substrings by bounded suffix order and previous factors.

Removes bytes covered by strings of ``length`` bytes that occur more than once,
in a corpus that no task can hold. The suffix order is needed only to that
depth and only where something repeats, so it is built in buckets:

1. Every window of ``length`` bytes picks its content-defined anchor: the
   leftmost smallest hash of the k-byte strings in it. Equal windows have equal
   anchors at equal offsets. Neighbouring windows of one anchor form a *run*,
   about ``length``/2 bytes long. Buckets with a single run hold no duplicate.
2. Equal runs of a bucket collapse to one with its number and first position
   (aggregation with map-side partials; a group of copies is one row from here).
3. Each remaining bucket is a small suffix array. Its runs are sorted by what
   follows the anchor, with LCPs of neighbours. The sweep then moves the suffix
   start left one byte at a time; a stable sort by that byte turns the suffix
   order at offset l into the one at l + 1. At every offset, suffixes with
   LCP >= ``length`` to a neighbour form an interval. A suffix in it with a
   previous or next smaller position in suffix order has an earlier match: its
   longest previous factor reaches ``length``. All but the interval's first
   text position are such "later" suffixes; all of them are "repeated".
4. A bucket of more than ``most`` different runs is not swept in one task. Its
   windows are hashed by two independent polynomials (128 bits) and counted by
   aggregation, which gives the same answer for hot buckets in any number of
   tasks, but for a chance collision of both hashes.

Matches never cross documents. Null texts are empty. Every row is a document
of its own, with an integer id; where ids are missing or repeat, rows get keys in
the order of their ids, those without one last. Other columns are not read.
Texts shorter than ``length`` are returned unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, whole, written

RUNS = "doc_id long, anchor int, lo int, hi int, v long, f long"
GRAM = 64


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, anchor hash, run hash) of the runs of one text of at least ``length`` bytes."""
    sums = tk.prefix(data)
    n = len(data)
    gram = min(gram, (length + 1) // 2)
    at = np.arange(n - gram + 1)
    hashes = tk.span_hashes(sums, at, at + gram)
    w = length - gram + 1
    least = tk.slide_min(hashes, w)  # by window
    # an occurrence of a minimum is the anchor of windows from just after the occurrence before it
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    begin = np.concatenate([[0], change])
    end = np.concatenate([change, [len(least)]])
    place, first, last = [], [], []
    # positions whose hash is the minimum of some window that holds them: it equals the largest of those minima
    edge = np.zeros(w - 1, tk.U64)
    chosen = np.flatnonzero(hashes == ~tk.slide_min(~np.concatenate([edge, least, edge]), w))
    # for each run of windows with one minimum, split at every chosen position that holds it
    low = np.searchsorted(chosen, begin)
    high = np.searchsorted(chosen, end - 1 + w)
    for b, e, i, j in zip(begin.tolist(), end.tolist(), low.tolist(), high.tolist()):
        value = least[b]
        s = b
        for p in chosen[i:j].tolist():
            if s >= e:
                break
            if hashes[p] == value and p >= s:
                place.append(p)
                first.append(s)
                last.append(min(e - 1, p))
                s = min(e - 1, p) + 1
    place, first, last = (np.array(x, dtype=np.int64) for x in (place, first, last))
    run = tk.mix(tk.span_hashes(sums, first, last + length) + tk.U64(31) * (place - first).astype(tk.U64) + tk.U64(1 << 20) * (last - first).astype(tk.U64))
    return place, first, last, hashes[place], run


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, data, offsets in tk.pieces(batch.column(1), 1 << 20):
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                for k in range(hi - lo):
                    if offsets[k + 1] - offsets[k] < length:
                        continue
                    place, first, last, v, f = anchors(data[offsets[k] : offsets[k + 1]], length)
                    for whole_, part in zip(out, (np.full(len(place), ids[lo + k]), place, place - last, place - first, v.view(np.int64), f.view(np.int64))):
                        whole_.append(part)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds)], names=["doc_id", "anchor", "lo", "hi", "v", "f"]
                )

    return run


def _contexts(length: int):
    """Cut the bytes around each wanted run out of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(1), batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for lo, hi, data, offsets in tk.pieces(texts, 1 << 20):
                for k in range(lo, hi):
                    own = data[offsets[k - lo] : offsets[k - lo + 1]]
                    for r in wanted[k]:
                        a = r["anchor"]
                        rows.append((r["v"], r["f"], ids[k], a, r["lo"], r["hi"], r["copies"], own[a - r["hi"] : a - r["lo"] + length].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            names = ["v", "f", "doc_id", "anchor", "lo", "hi", "copies", "bytes"]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def _range_min(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of x[a + 1 .. b] for a < b, from a table of minima of power-of-two lengths."""
    size = b - a
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(a), dtype=np.int32)
    for k in np.unique(level).tolist():
        s = level == k
        out[s] = np.minimum(table[k][a[s] + 1], table[k][b[s] + 1 - (1 << k)])
    return out


def sweep(bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[bytes], place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run and offset 0 <= l < ``length``: is the suffix l bytes left of the anchor repeated, and is it later.

    ``place`` ranks the runs by text position. Row i has bytes from hi[i] left of
    its anchor to ``length`` - lo[i] right of it.
    """
    n = len(texts)
    tails = [t[h:] for t, h in zip(texts, hi.tolist())]
    order = np.array(sorted(range(n), key=lambda i: (bucket[i], tails[i])), dtype=np.int64)
    bucket, lo, hi, place = bucket[order], lo[order], hi[order], place[order]
    texts, tails = [texts[i] for i in order], [tails[i] for i in order]
    right = np.zeros((n, length), dtype=np.uint8)
    width = int(hi.max()) if n else 0
    left = np.zeros((width, n), dtype=np.uint8)
    for i, (t, tail) in enumerate(zip(texts, tails)):
        right[i, : len(tail)] = np.frombuffer(tail, dtype=np.uint8)
        head = np.frombuffer(t, dtype=np.uint8)[: hi[i]]
        left[: len(head), i] = head[::-1]
    lcp = np.zeros(n, dtype=np.int32)
    if n > 1:
        differ = right[1:] != right[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        lcp[1:][bucket[1:] != bucket[:-1]] = -1
    del right
    table = [lcp]
    while (1 << len(table)) <= n:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    repeated = np.zeros((n, width + 1), dtype=bool)
    later = np.zeros((n, width + 1), dtype=bool)
    at = np.arange(n)  # suffix order: ranks of the runs still in play
    group = np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]])) if n else at
    for l in range(width + 1):
        if l:
            stay = hi[at] >= l
            at, group = at[stay], group[stay]
            key = group * 256 + left[l - 1, at]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            alone = fresh.copy()
            alone[:-1] &= fresh[1:]
            at, fresh = at[~alone], fresh[~alone]
            group = np.cumsum(fresh) - 1
        own = np.flatnonzero(lo[at] <= l)
        if len(own) < 2:
            if not len(at):
                break
            continue
        ranks, groups = at[own], group[own]
        same = np.flatnonzero(groups[1:] == groups[:-1])
        near = np.zeros(len(own), dtype=bool)  # LCP with the suffix before it reaches the length
        near[same + 1] = _range_min(table, ranks[same], ranks[same + 1]) + l >= length
        head = np.flatnonzero(~near)
        in_interval = near.copy()
        in_interval[:-1] |= near[1:]
        smallest = np.repeat(np.minimum.reduceat(place[ranks], head), np.diff(np.concatenate([head, [len(own)]])))
        repeated[ranks[in_interval], l] = True
        later[ranks[in_interval & (place[ranks] > smallest)], l] = True
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    return repeated[back], later[back]


def _pack(flags: np.ndarray) -> list[int]:
    """Offsets of a Boolean row as start, end, start, end, ..."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).tolist()


def _sweep_buckets(length: int, chunk: int = 6000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "f", "repeated", "later"]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))

        def solved(rows: list[tuple]) -> pa.RecordBatch:
            v, f, doc, anchor, lo, hi, _, texts = zip(*rows)
            place = np.lexsort((np.array(anchor), np.array(doc)))
            rank = np.empty(len(rows), dtype=np.int64)
            rank[place] = np.arange(len(rows))
            repeated, later = sweep(np.array(v), np.array(lo), np.array(hi), list(texts), rank, length)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((v, f, [_pack(x) for x in repeated], [_pack(x) for x in later]), kinds)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(rows) >= chunk and row[0] != rows[-1][0]:
                    yield solved(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solved(rows)

    return run


def _hash_windows(length: int):
    """(run, offset, window digest) for the runs of hot buckets: 128 bits of BLAKE2b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, f, doc, anchor, lo, hi, copies, text in zip(*[c.to_pylist() for c in batch.columns]):
                start = np.arange(hi - lo + 1)
                told = b"".join(hashlib.blake2b(text[s : s + length], digest_size=16).digest() for s in start.tolist())
                h1, h2 = np.frombuffer(told, dtype=np.int64).reshape(-1, 2).T
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, x), t) for x, t in ((v, pa.int64()), (f, pa.int64()), (doc, pa.int64()), (anchor, pa.int32()), (copies, pa.int64()))]
                    + [pa.array(hi - start, pa.int32()), pa.array(h1), pa.array(h2)],
                    names=["v", "f", "doc_id", "anchor", "copies", "l", "h1", "h2"],
                )

    return run


def _ranges(offsets) -> F.Column:
    """Sorted offsets as start, end, start, end, ..."""
    s = F.sort_array(offsets)
    opens = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x - 1), x)), lambda x: x.isNotNull())
    closes = F.filter(F.transform(s, lambda x, i: F.when((i == F.size(s) - 1) | (F.get(s, i + 1) != x + 1), x + 1)), lambda x: x.isNotNull())
    return F.sort_array(F.concat(opens, closes))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id, text): the key is the id where ids are unique, and else a number that is written once."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    total, distinct = source.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if total == distinct:
        return source.withColumn("key", F.col("doc_id"))
    ordered = source.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return written(ordered.withColumn("key", F.monotonically_increasing_id()), "keyed")


def repeated_windows(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", most: int = 20_000, keep_first: bool = False) -> DataFrame:
    """(doc_id, starts): window starts as [first, last] pairs of those that repeat, or with ``keep_first`` of those that have an earlier match."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    runs = written(source.mapInArrow(_runs(length), RUNS), "runs")
    per_run = runs.groupBy("v", "f").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "anchor", "lo", "hi")).alias("first"))
    per_run = cut(per_run)
    buckets = per_run.groupBy("v").agg(F.sum("copies").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    placed = cut(per_run.join(buckets, "v"))
    mixed = placed.where("kinds > 1")
    wanted = mixed.groupBy("first.doc_id").agg(
        F.collect_list(F.struct("v", "f", "first.anchor", "first.lo", "first.hi", "copies", "kinds")).alias("wanted")
    )
    context_schema = "v long, f long, doc_id long, anchor int, lo int, hi int, copies long, bytes binary"
    hot = mixed.where(F.col("kinds") > most)
    has_hot = bool(hot.take(1))
    contexts = source.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_contexts(length), context_schema)
    if has_hot:
        contexts = written(contexts, "contexts").join(buckets.select("v", "kinds"), "v")
        cool = contexts.where(F.col("kinds") <= most).drop("kinds")
    else:
        cool = contexts
    found = (
        cool.repartition("v").sortWithinPartitions("v").mapInArrow(_sweep_buckets(length), "v long, f long, repeated array<int>, later array<int>")
    )
    if has_hot:
        windows = (
            contexts.where(F.col("kinds") > most)
            .drop("kinds")
            .mapInArrow(_hash_windows(length), "v long, f long, doc_id long, anchor int, copies long, l int, h1 long, h2 long")
        )
        groups = windows.groupBy("v", "l", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "anchor")).alias("low")).where("n > 1")
        flagged = windows.join(groups, ["v", "l", "h1", "h2"]).groupBy("v", "f").agg(
            F.collect_list("l").alias("all"),
            F.collect_list(F.when(F.struct("doc_id", "anchor") > F.col("low"), F.col("l"))).alias("not_first"),
        )
        found = found.unionByName(flagged.select("v", "f", _ranges(F.col("all")).alias("repeated"), _ranges(F.col("not_first")).alias("later")))
    known = placed.join(found, ["v", "f"], "left").select(
        "v",
        "f",
        "first",
        "copies",
        (F.col("copies") > 1).alias("all"),
        F.col("later" if keep_first else "repeated").alias("part"),
    )
    # written, so that the join deals both sides anew and a run of many copies can be split
    known = written(known.where(F.col("all") | (F.size("part") > 0)), "known")
    joined = runs.join(known, ["v", "f"])
    here = F.struct("doc_id", "anchor", "lo", "hi")
    whole_run = F.array(F.struct((F.col("anchor") - F.col("hi")).alias("a"), (F.col("anchor") - F.col("lo")).alias("b")))
    pieces = F.transform(
        F.sequence(F.lit(0), (F.size("part") / 2).cast("int") - 1),
        lambda k: F.struct((F.col("anchor") - F.get("part", 2 * k + 1) + 1).alias("a"), (F.col("anchor") - F.get("part", 2 * k)).alias("b")),
    )
    none = F.array().cast("array<struct<a:int,b:int>>")
    part = F.when(F.size("part") > 0, pieces).otherwise(none)
    take_all = F.col("all") & ((here != F.col("first")) if keep_first else F.lit(True))
    spans = joined.select("doc_id", F.when(take_all, whole_run).otherwise(part).alias("s")).where(F.size("s") > 0)
    return spans.groupBy("doc_id").agg(F.flatten(F.collect_list("s")).alias("starts"))


def _cut_out(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, starts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for lo, hi, data, offsets in tk.pieces(texts, 1 << 22):
                rows = []
                for k in range(lo, hi):
                    own = data[offsets[k - lo] : offsets[k - lo + 1]]
                    if not starts[k]:
                        rows.append((len(own), [], own.tobytes()))
                        continue
                    gone: list[list[int]] = []
                    for a, b in sorted((s["a"], s["b"] + length) for s in starts[k]):
                        if gone and a <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], b)
                        else:
                            gone.append([a, b])
                    edges = [0, *[x for g in gone for x in g], len(own)]
                    rows.append((len(own), gone, b"".join(own[edges[i] : edges[i + 1]].tobytes() for i in range(0, len(edges), 2))))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int32()))),
                        pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "removed", "kept"],
                )

    return run


def deduplicated(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", most: int = 20_000, keep_first: bool = True) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): removed byte runs as [start, end] and the bytes that stay.

    With ``keep_first`` only later copies go; without, every copy does.
    """
    source = _keyed(docs, doc_id, text)
    starts = repeated_windows(source, length, "key", "text", most, keep_first).withColumnRenamed("doc_id", "key")
    return source.join(starts, "key", "left").select("doc_id", "text", "starts").mapInArrow(
        _cut_out(length), "doc_id long, n_bytes long, removed array<array<int>>, kept binary"
    )


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
