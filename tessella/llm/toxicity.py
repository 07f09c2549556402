"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lowers case and maps homoglyphs (Cyrillic, Greek, full width) and digit
substitutions to plain letters. The lexicon is learned from a bounded sample of
labelled rows: whole words and word beginnings whose smoothed document
log-odds are high, each with its log-odds as weight. A match counts at a word's
beginning, unless an exception phrase covers it. Exceptions are a few fixed
phrases and those learned from the sample: a match's word with the word before
or behind it, where clean rows hold the two at least as often as toxic rows do.
Sums of weights, as they are and by text length, go through a small logistic
model, fitted on the same sample.

The sample holds at most ``max_rows`` labelled rows, taken by hash. Labels,
language, source and id are never inputs of a score. Null and empty texts have
no matches and get the score of such. Texts of any length are matched whole;
repeated rows are scored row by row and other columns pass through. Rows without a label or id are not
learned from. Without rows of both classes the lexicon is empty and every score
is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, written

# Look-alike characters and the letters they stand for.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁɡһԛԝαβεικνορτυχ", "abekmhopctyxijsdghqwabeikvoptux"))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "​": "", "­": ""}
_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_ASCII = str.maketrans(DIGITS)
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "scum line", "stupid simple", "sore loser board")
WORD = re.compile(r"\w+")
SHORTEST, LONGEST = 4, 8


def folded(text: str) -> str:
    low = text.lower()
    return low.translate(_ASCII if low.isascii() else _FOLD)


def terms_of(text: str) -> set[str]:
    """Whole words (with a closing space) and word beginnings of one text."""
    out = set()
    for w in set(WORD.findall(folded(text))):
        if len(w) >= 3:
            out.add(w + " ")
        for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
            out.add(w[:k])
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    beta: tuple[float, float, float, float] = (0.0, 0.0, 0.0, -30.0)

    def automaton(self):
        # a beginning and a whole word can be of one spelling
        entries: dict[str, list[tuple[int, float | None, bool]]] = {}
        for term, weight in self.weights.items():
            entries.setdefault(term.rstrip(" "), []).append((len(term.rstrip(" ")), weight, term.endswith(" ")))
        for phrase in self.exceptions:
            entries.setdefault(folded(phrase), []).append((len(folded(phrase)), None, True))
        machine = ahocorasick.Automaton()
        for spelling, found in entries.items():
            machine.add_word(spelling, found)
        if len(machine):
            machine.make_automaton()
        return machine


def matches(machine, t: str) -> dict[int, float]:
    """Weight of the heaviest match at each place of a folded text, without what an exception covers."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for at, n, weight, word in ((at, *entry) for at, found in machine.iter(t) for entry in found):
        start = at - n + 1
        if start and (t[start - 1].isalnum() or t[start - 1] == "_"):
            continue
        if word and (t[at + 1 : at + 2].isalnum() or t[at + 1 : at + 2] == "_"):
            continue
        if weight is None:
            spared.append((start, at + 1))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared:
        # matches and exceptions in order of place, walked once: an exception reaches as far as any before it
        spared.sort()
        at, reach = 0, 0
        for start in sorted(best):
            while at < len(spared) and spared[at][0] <= start:
                reach = max(reach, spared[at][1])
                at += 1
            if start < reach:
                del best[start]
    return best


def measures(machine, text: str | None) -> tuple[float, float, float]:
    """Logarithms of weight sum, weight per hundred words, and number of matched words."""
    if not text or not len(machine):
        return 0.0, 0.0, 0.0
    t = folded(text) + " "
    best = matches(machine, t)
    total, words = sum(best.values()), 1 + t.count(" ")
    return math.log1p(total), math.log1p(100 * total / (words + 20)), math.log1p(len(best))


def phrases_of(machine, text: str) -> set[str]:
    """Each match's word with the word before it and with the word behind it, as they stand in the folded text with one space between."""
    t = folded(text)
    starts = matches(machine, t)
    if not starts:
        return set()
    words = [w.span() for w in WORD.finditer(t)]
    out = set()
    for k, (a, b) in enumerate(words):
        if a in starts:
            if k and words[k - 1][1] + 1 == a and t[a - 1] == " ":
                out.add(t[words[k - 1][0] : b])
            if k + 1 < len(words) and words[k + 1][0] == b + 1 and t[b] == " ":
                out.add(t[a : words[k + 1][1]])
    return out


def _phrased(lexicon: Lexicon):
    """Document counts of the phrases around matches, by label, summed in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        seen: Counter[tuple[str, int]] = Counter()
        if len(machine):
            for batch in batches:
                for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        seen.update((phrase, y) for phrase in phrases_of(machine, text))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["phrase", "y", "n"]
        )

    return run


def _counted(label: int, wanted: frozenset[str] | None):
    """Document counts of terms over the rows of one label, summed in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if y == label and text:
                    terms = terms_of(text)
                    seen.update(terms if wanted is None else terms & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return run


def _measured(lexicon: Lexicon, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            rows = [measures(machine, t.as_py()) for t in batch.column(column)]
            rest = [i for i in range(batch.num_columns) if i != column]
            z = [pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], *z], names=[*[batch.schema.names[i] for i in rest], "_a", "_b", "_c"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, doc_id: str = "doc_id", text: str = "text", max_rows: int = 20_000, least: int = 4, odds: float = 3.0) -> Lexicon:
    """Lexicon and calibration from at most ``max_rows`` labelled rows outside the held-out part."""
    y = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    y = y.where(bucket_of(F.col("id"), modulus) != held_out).orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # at most max_rows pairs of integers, so the broadcast is bounded
    sample = written(source.join(F.broadcast(y), "id").select("text", "y"), "toxicity")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = n1 / max(1, n0 + n1)
        return Lexicon({}, beta=(0.0, 0.0, 0.0, math.log((share + 1e-6) / (1 - share + 1e-6))))
    positive = sample.mapInArrow(_counted(1, None), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= min(least, n1))
    in_toxic = {r["term"]: r["n"] for r in positive.collect()}  # bounded by the sample
    negative = sample.mapInArrow(_counted(0, frozenset(in_toxic)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    in_clean = {r["term"]: r["n"] for r in negative.collect()}
    lexicon = Lexicon(chosen(in_toxic, in_clean, n1, n0, odds))
    around = sample.mapInArrow(_phrased(lexicon), "phrase string, y int, n long").groupBy("phrase").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic")
    )
    harmless = around.where((F.col("clean") >= least) & ((F.col("toxic") + 0.5) / (n1 + 1) <= (F.col("clean") + 0.5) / (n0 + 1)))
    lexicon.exceptions += tuple(sorted(r["phrase"] for r in harmless.collect()))  # bounded by the sample
    z = sample.mapInArrow(_measured(lexicon, 0), "y int, _a double, _b double, _c double").toPandas()  # at most max_rows rows
    lexicon.beta = logistic(z[["_a", "_b", "_c"]].to_numpy(), z["y"].to_numpy(dtype=float))
    return lexicon


def chosen(in_toxic: dict[str, int], in_clean: dict[str, int], n1: int, n0: int, odds: float) -> dict[str, float]:
    """Terms of high log-odds; a longer term stays only where it says clearly more than its own beginning."""
    weight = {}
    for term, k in in_toxic.items():
        w = math.log((k + 0.5) / (n1 + 1)) - math.log((in_clean.get(term, 0) + 0.5) / (n0 + 1))
        if w >= odds:
            weight[term] = w
    out: dict[str, float] = {}
    for term in sorted(weight, key=lambda t: (len(t.rstrip(" ")), t.endswith(" "), t)):
        stem = term.rstrip(" ")
        shorter = [out[stem[:k]] for k in range(SHORTEST, len(stem) + 1) if stem[:k] in out]
        if not shorter or weight[term] > max(shorter) + 0.5:
            out[term] = weight[term]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> tuple[float, float, float, float]:
    """Ridge logistic regression by damped Newton steps."""
    design = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    b = np.zeros(design.shape[1])
    penalty = ridge * np.eye(len(b))
    penalty[-1, -1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        step = np.linalg.solve((design * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ b)
        b += step * min(1.0, 4 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in b)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``score``."""
    rest = [c for c in docs.columns if c != text]
    source = docs.select(F.col(text).cast("string").alias("_text"), *rest)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]], "_a double", "_b double", "_c double"])
    b = lexicon.beta
    logit = b[0] * F.col("_a") + b[1] * F.col("_b") + b[2] * F.col("_c") + b[3]
    return source.mapInArrow(_measured(lexicon, 0), schema).select(*rest, (1 / (1 + F.exp(-logit))).alias("score"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5, text: str = "text") -> DataFrame:
    """Rows whose score is below ``limit``, with all their columns."""
    doubled = docs.withColumn("_scored_text", F.col(text))
    return score(doubled, lexicon, "_scored_text").where(F.col("score") < limit).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 5, held_out: int = 0, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    lexicon = train(docs, labels, doc_id=doc_id, text=text, modulus=modulus, held_out=held_out, **options)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return score(source, lexicon).select(
        "doc_id",
        F.coalesce(bucket_of(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
