"""Benchmark decontamination on a stored, distributed positional inverted index.

``index`` cuts the training table into segments of whole documents (about 1 MB
of text each; a longer document is a segment of its own) and writes their
postings: for each term of a segment, the sorted word positions at which it
stands. The index holds all terms, so any benchmark can be searched in it.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter
item is one window). Spark counts the corpus postings of every benchmark term,
and each window's terms are ranked from the rarest to the most common. In every
segment, the postings of a window's rarest term give candidate starts, and the
lists of its other terms, moved by their offsets, are intersected in rank order.
What is left are exact phrase matches. With ``reach``, a proximity match is
reported where every word of a window stands within ``reach`` words of an
occurrence of its longest word (in bytes; ties: the first in the alphabet), in
one document and in any order; the lists of the other words are looked up from
the rarest to the most common.

The windows go to the tasks in blocks of about ``block_windows``, each of which
is a pass over the index; an item of any length is split over blocks. Documents
are never shuffled. Terms are 64-bit hashes of lower-cased words.

Null and empty texts have no words and are returned with zeros. A null item id
reads as "null"; items that repeat an id count once. Repeated rows of the
training table are judged one by one, whatever their ids; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import written

#: A segment: its documents, their first word positions (one more at the end), its terms in order, where each term's positions begin (one more at the end), and the positions.
INDEX = "segment long, doc_ids array<long>, first array<int>, terms binary, begin binary, positions binary"
WINDOWS = "item string, terms array<long>, anchor int"
FOUND = "segment long, place int, doc_id long, n_words long, hits array<struct<s:int,e:int>>, items array<string>, near array<string>"
PIECE = 1 << 20


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    for batch in batches:
        for lo, hi, data, offsets in tk.pieces(batch.column(1), PIECE):
            _, _, hashes, first = tk.tokens(data, offsets)
            order = np.argsort(hashes, kind="stable").astype(np.int32)
            terms, begin = np.unique(hashes[order], return_index=True)
            begin = np.append(begin, len(order)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0], pa.int64()),
                    pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                    pa.array([first.tolist()], pa.list_(pa.int32())),
                    *[pa.array([x.tobytes()], pa.binary()) for x in (terms, begin, order)],
                ],
                names=names,
            )


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the positional index of all words of all documents into the shared folder."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(source.mapInArrow(_postings, INDEX).withColumn("segment", F.monotonically_increasing_id()), "postings")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.pieces(batch.column(1)):
                starts, ends, hashes, first = tk.tokens(data, offsets)
                raw, signed = tk.LOWER[data].tobytes(), hashes.view(np.int64)
                for k in range(hi - lo):
                    a, b = int(first[k]), int(first[k + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    far = [(-(e - s), raw[s:e]) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    for at in range(0, b - a - n + 1, 4096):
                        rows = np.lib.stride_tricks.sliding_window_view(signed[a + at : min(b, a + at + 4095 + n)], n)
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * n, pa.int32()), pa.array(rows.ravel()))
                        name = pa.array([batch.column(0)[lo + k].as_py()] * len(rows), pa.string())
                        anchor = pa.array([min(range(n), key=lambda i: far[w + i]) for w in range(at, at + len(rows))], pa.int32())  # noqa: B023
                        yield pa.RecordBatch.from_arrays([name, flat, anchor], names=["item", "terms", "anchor"])

    return run


def windows(benchmark: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, terms): the distinct windows of every item, written."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return written(items.mapInArrow(_cut(window), WINDOWS).distinct(), "windows")


@dataclass
class Windows:
    """Windows of one length: their terms (indices into the vocabulary), items and offsets of their longest words."""

    terms: np.ndarray
    item: np.ndarray
    anchor: np.ndarray


class Queries:
    """Windows to search for: vocabulary, terms by window length ranked by corpus counts, item names."""

    def __init__(self, rows: list[tuple[str, list[int], int]]) -> None:
        self.names = sorted({i for i, _, _ in rows})
        place = {name: k for k, name in enumerate(self.names)}
        by_size: dict[int, list[tuple[list[int], int, int]]] = {}
        for item, terms, anchor in rows:
            by_size.setdefault(len(terms), []).append((terms, place[item], anchor))
        sizes = {n: (np.array([t for t, _, _ in w], dtype=np.int64).view(tk.U64), np.array([i for _, i, _ in w]), np.array([a for _, _, a in w])) for n, w in by_size.items()}
        self.vocabulary = np.unique(np.concatenate([t.ravel() for t, _, _ in sizes.values()])) if sizes else np.zeros(0, tk.U64)
        self.counts = np.zeros(len(self.vocabulary), dtype=np.int64)
        self.windows = {n: Windows(np.searchsorted(self.vocabulary, t), i, a) for n, (t, i, a) in sizes.items()}

    def ranked(self, counts: np.ndarray) -> None:
        """Take the corpus counts of the vocabulary; windows with a term that the corpus lacks are dropped."""
        self.counts = counts
        for n, w in list(self.windows.items()):
            there = counts[w.terms].min(axis=1) > 0
            self.windows[n] = Windows(w.terms[there], w.item[there], w.anchor[there])

    def order(self, terms: np.ndarray) -> np.ndarray:
        """Offsets of each window's terms from the rarest in the corpus to the most common."""
        return np.lexsort((terms, self.counts[terms]), axis=1)


class Segment:
    """Postings of the searched terms in one segment."""

    def __init__(self, vocabulary: np.ndarray, terms: np.ndarray, begin: np.ndarray, positions: np.ndarray, first: np.ndarray) -> None:
        self.first = first
        self.counts = np.zeros(len(vocabulary), dtype=np.int64)
        self.begin = np.zeros(len(vocabulary), dtype=np.int64)
        self.positions = positions
        if len(vocabulary) and len(terms):
            at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
            here = np.flatnonzero(terms[at] == vocabulary)
            self.counts[here] = np.diff(begin)[at[here]]
            self.begin[here] = begin[at[here]]
        # word by position, for terms that are searched for
        owner, at = self.expand(np.flatnonzero(self.counts))
        self.ids = np.full(int(first[-1]) if len(first) else 0, -1, dtype=np.int64)
        known = np.flatnonzero(self.counts)
        self.ids[at] = known[owner]
        self.keys = known[owner] << 32 | at  # sorted: terms in order, positions in order

    def expand(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``terms``, position) for every posting of every term."""
        n = self.counts[terms]
        owner = np.repeat(np.arange(len(terms)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return owner, self.positions[self.begin[terms][owner] + within].astype(np.int64)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def candidates(self, queries: Queries, w: Windows, anchored: bool = False, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, rank of their terms, owner, position) of windows whose terms are all here: the postings of each one's rarest term or longest word, in parts of bounded size."""
        there = np.flatnonzero(self.counts[w.terms].min(axis=1) > 0) if len(w.terms) else np.zeros(0, np.int64)
        if not len(there):
            return
        order = queries.order(w.terms[there])
        lead = w.terms[there, w.anchor[there] if anchored else order[:, 0]]
        load = np.cumsum(self.counts[lead])
        cuts = [0, *(np.flatnonzero(np.diff(load // most)) + 1).tolist(), len(there)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows, rank = there[lo:hi], order[lo:hi]
            owner, at = self.expand(lead[lo:hi])
            yield rows, rank, owner, at

    def phrases(self, queries: Queries, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence."""
        n = w.terms.shape[1]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for rows, rank, owner, at in self.candidates(queries, w):
            start = at - rank[owner, 0]
            doc = self.document(at)
            keep = (start >= self.first[doc]) & (start + n <= self.first[doc + 1])
            owner, start = owner[keep], start[keep]
            for k in range(1, n):
                if not len(owner):
                    break
                offset = rank[owner, k]
                keep = self.ids[start + offset] == w.terms[rows[owner], offset]
                owner, start = owner[keep], start[keep]
            found.append((rows[owner], start))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def proximities(self, queries: Queries, w: Windows, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, document) where all words of a window stand within ``reach`` words of its longest one."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for rows, rank, owner, at in self.candidates(queries, w, anchored=True):
            for k in range(w.terms.shape[1]):
                if not len(owner):
                    break
                term = w.terms[rows[owner], rank[owner, k]]
                doc = self.document(at)
                low = np.maximum(at - reach, self.first[doc])
                high = np.minimum(at + reach, self.first[doc + 1] - 1)
                # the first posting of the term from ``low`` on
                next_ = np.searchsorted(self.keys, term << 32 | low)
                keep = self.keys[np.minimum(next_, len(self.keys) - 1)] <= (term << 32 | high)
                keep &= next_ < len(self.keys)
                owner, at = owner[keep], at[keep]
            pairs = np.unique(np.stack([rows[owner], self.document(at)]), axis=1)
            found.append((pairs[0], pairs[1]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["terms"], tk.U64), np.frombuffer(row["begin"], np.int32), np.frombuffer(row["positions"], np.int32), np.array(row["first"], dtype=np.int64)


def _count_terms(vocabulary: np.ndarray):
    """Postings of each searched term, summed over the segments of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for terms, begin in zip(batch.column(0), batch.column(1)):
                own, starts = np.frombuffer(terms.as_py(), tk.U64), np.frombuffer(begin.as_py(), np.int32)
                if len(own):
                    at = np.minimum(np.searchsorted(own, vocabulary), len(own) - 1)
                    here = own[at] == vocabulary
                    total[here] += np.diff(starts)[at[here]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    return run


def _search(queries: Queries, reach: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield one(batch.slice(row, 1).to_pylist()[0])

    def one(row: dict) -> pa.RecordBatch:
        terms, begin, positions, first = _unpacked(row)
        segment = Segment(queries.vocabulary, terms, begin, positions, first)
        n_docs = len(first) - 1
        hits: list[list] = [[] for _ in range(n_docs)]
        items_of: list[set] = [set() for _ in range(n_docs)]
        near_of: list[set] = [set() for _ in range(n_docs)]
        diff = np.zeros(int(first[-1]) + 1, dtype=np.int64)
        for n, w in queries.windows.items():
            which, start = segment.phrases(queries, w)
            np.add.at(diff, start, 1)
            np.add.at(diff, start + n, -1)
            pairs = np.unique(np.stack([segment.document(start), w.item[which]]), axis=1)
            for d, i in pairs.T.tolist():
                items_of[d].add(queries.names[i])
            if reach is not None:
                which, docs = segment.proximities(queries, w, reach)
                for d, i in np.unique(np.stack([docs, w.item[which]]), axis=1).T.tolist():
                    near_of[d].add(queries.names[i])
        # a run of hit words ends where its document does
        words = np.flatnonzero(np.cumsum(diff[:-1]) > 0)
        which, at = np.unique(segment.document(words), return_index=True)
        for d, own in zip(which.tolist(), np.split(words, at[1:])):
            breaks = np.flatnonzero(np.diff(own) > 1)
            opens, closes = own[np.concatenate([[0], breaks + 1])], own[np.concatenate([breaks, [len(own) - 1]])] + 1
            hits[d] = [{"s": s, "e": e} for s, e in zip((opens - first[d]).tolist(), (closes - first[d]).tolist())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([row["segment"]] * n_docs, pa.int64()),
                pa.array(range(n_docs), pa.int32()),
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(np.diff(first), pa.int64()),
                pa.array(hits, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                pa.array([sorted(x) for x in items_of], pa.list_(pa.string())),
                pa.array([sorted(x) for x in near_of], pa.list_(pa.string())),
            ],
            names=["segment", "place", "doc_id", "n_words", "hits", "items", "near"],
        )

    return run


def _blocks(cut: DataFrame, block_windows: int) -> Iterator[list[tuple[str, list[int], int]]]:
    """Windows in blocks of about ``block_windows``, by hash; at least one block, which may be empty."""
    blocks = max(1, -(-cut.count() // block_windows))
    for b in range(blocks):
        yield [(r.item, r.terms, r.anchor) for r in cut.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == b).collect()]


def _covered(hits: Column) -> Column:
    """Number of words in the union of runs."""
    return F.aggregate(
        F.sort_array(hits),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, h: F.struct(
            (a["n"] + F.greatest(h["e"] - F.greatest(h["s"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], h["e"]).alias("to")
        ),
        lambda a: a["n"],
    )


def search(postings: DataFrame, cut: DataFrame, reach: int | None = None, block_windows: int = 200_000) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near) of every document of an index; ``items`` and ``near`` are sorted item ids."""
    passes = []
    for block in _blocks(cut, block_windows):
        queries = Queries(block)
        # a number for each term of a block, which is bounded
        counts = postings.select("terms", "begin").mapInArrow(_count_terms(queries.vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(len(queries.vocabulary), dtype=np.int64)
        for r in counts:
            total[r.term] = r.n
        queries.ranked(total)
        passes.append(postings.mapInArrow(_search(queries, reach), FOUND))
    found = passes[0]
    if len(passes) > 1:
        for other in passes[1:]:
            found = found.unionByName(other)
        found = found.groupBy("segment", "place", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("hits")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
        )
    return found.select("doc_id", "n_words", _covered(F.col("hits")).alias("n_hit"), "items", "near")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, reach: int | None = None, block_windows: int = 200_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, near) of every document, through a new index."""
    return search(index(docs, doc_id, text), windows(benchmark, window), reach, block_windows)


def _without(queries: Queries, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for lo, _, data, offsets in tk.pieces(batch.column(column).cast(pa.string()), PIECE):
                _, _, hashes, first = tk.tokens(data, offsets)
                order = np.argsort(hashes, kind="stable")
                terms, begin = np.unique(hashes[order], return_index=True)
                segment = Segment(queries.vocabulary, terms, np.append(begin, len(order)), order, first)
                for w in queries.windows.values():
                    keep[lo + segment.document(segment.phrases(queries, w)[1])] = False
            yield batch.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = 200_000, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no window of any item, with all their columns and without a shuffle.

    Only exact matches reject: a proximity match may be chance, and clean
    documents stay. Each row is needed once, so its segment of the index is made
    and searched inside the task that reads it, and terms are ranked as they
    come in the vocabulary, without corpus counts; the matches are the same.
    """
    for block in _blocks(windows(benchmark, window), block_windows):
        docs = docs.mapInArrow(_without(Queries(block), docs.columns.index(text)), docs.schema)
    return docs
