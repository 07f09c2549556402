import random
import re

import pytest

from tessella.llm import decontam


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, window=10):
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, x in items:
            q = words(x)
            n = min(window, len(q))
            for s in range(len(q) - n + 1) if n else ():
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == q[s : s + n]:
                        hit.update(range(a, a + n))
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "élan", "X1", "run", "a", "sea", "don't"])
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 10, 14, 25])))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (53, items[0][1])]
    docs = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if k % 3 == 0:
            parts.append(rng.choice(items[:12])[1].upper())
        if k % 5 == 0:
            parts.append(", ".join(rng.choice(items[:12])[1].split()[:12]))
        rng.shuffle(parts)
        docs.append((k, " \n".join(parts)))
    docs += [(100, None), (101, ""), (102, " - ")]
    return docs, items


def brute_near(docs, items, reach, window=10):
    out = {}
    for d, t in docs:
        w, found = words(t), set()
        for i, x in items:
            q = words(x)
            n = min(window, len(q))
            for s in range(len(q) - n + 1) if n else ():
                own = q[s : s + n]
                far = min(own, key=lambda v: (-len(v.encode()), v.encode()))
                if any(set(own) <= set(w[max(0, a - reach) : a + reach + 1]) for a, v in enumerate(w) if v == far):
                    found.add(str(i))
        out[d] = sorted(found)
    return out


@pytest.mark.parametrize("block_windows,piece", [(200_000, 1 << 20), (7, 1 << 20), (200_000, 200)])
def test_against_brute_force(spark, monkeypatch, block_windows, piece):
    monkeypatch.setattr(decontam, "PIECE", piece)
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contamination(df, bench, reach=8, block_windows=block_windows).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in rows} == brute(docs, items)
    assert {r.doc_id: list(r.near) for r in rows} == brute_near(docs, items, 8)
    kept = {r.doc_id for r in decontam.clean(df, bench, block_windows=block_windows).collect()}
    assert kept == {d for d, x in brute(docs, items).items() if x[1] == 0}


def test_proximity(spark):
    bench = spark.createDataFrame([("p", "alpha beta gammalong delta")], "item_id string, text string")
    docs = [(1, "delta x alpha gammalong y beta"), (2, "gammalong beta alpha " + "z " * 20 + "delta"), (3, "alpha beta gammalong delta")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r.near)) for r in decontam.contamination(df, bench, reach=6).collect()}
    assert got == {1: (0, ["p"]), 2: (0, []), 3: (4, ["p"])}


def test_an_index_serves_any_benchmark_and_blocks_split_an_item(spark):
    """The stored postings are searched again without the texts; one long item is spread over several passes."""
    text = " ".join(f"w{k}" for k in range(500))
    postings = decontam.index(spark.createDataFrame([(1, text), (1, text), (None, "x"), (2, "w1 w2 w3")], "doc_id long, text string"))
    long_item = spark.createDataFrame([("a", " ".join(f"w{k}" for k in range(100, 400))), ("b", "w2 w3")], "item_id string, text string")
    cut = decontam.windows(long_item)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.search(postings, cut, block_windows=40).collect())
    assert got == [(0, 1, 0, ()), (1, 500, 302, ("a", "b")), (1, 500, 302, ("a", "b")), (2, 3, 2, ("b",))]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string")
    (r,) = decontam.contamination(docs, none).collect()
    assert (r.n_words, r.n_hit, list(r["items"])) == (2, 0, [])
    assert decontam.contamination(docs.limit(0), none).collect() == []


def test_long_words_that_collide_in_a_polynomial(spark):
    """5 and 8 in Thue-Morse order and its complement: equal modulo 2**64 for every odd base."""
    order = [bin(k).count("1") % 2 for k in range(2048)]
    one, other = ("".join("58"[b ^ flip] for b in order) for flip in (0, 1))
    docs = spark.createDataFrame([(1, one), (2, other), (3, "x" + other[1:])], "doc_id long, text string")
    items = spark.createDataFrame([("a", other)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontam.contamination(docs, items, window=10).collect()} == {1: 0, 2: 1, 3: 0}
