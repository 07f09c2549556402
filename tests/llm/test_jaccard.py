import random
import re

import pytest

from tessella.llm import jaccard


def shingles(text, n=5):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(docs, threshold):
    sets = {d: shingles(t) for d, t in docs}
    links = {d: 0 for d in sets}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (find(d), links[d]) for d in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    docs = []
    for k in range(8):
        base = [word() for _ in range(rng.randint(60, 150))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += ["", None, "one two", "One, two!", "one two three", docs[0], docs[0].upper(), "...", "é à", "é à"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [512, 3])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similarity_classes(df).collect()}
    assert got == brute(docs, 0.8)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similarity_classes(df).collect() == []
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, None, 1), (3, "A b c, d e f", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.similarity_classes(df).collect()}
    assert got == {(1, 1, 1), (2, 2, 0), (3, 1, 1)}


def test_bands():
    bands, rows = jaccard.choose_bands(0.8, 0.999, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.999
