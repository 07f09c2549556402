import random
from collections import defaultdict

import pytest

from tessella.llm import suffix_dedup


def brute(docs, length):
    """Removed runs by document: bytes covered by strings of ``length`` bytes that start at least twice; and with the first kept."""
    where = defaultdict(list)
    for d, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            where[b[s : s + length]].append((d, s))
    every, later = defaultdict(set), defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for d, s in places:
                every[d].update(range(s, s + length))
            for d, s in sorted(places)[1:]:
                later[d].update(range(s, s + length))
    return every, later


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(3)]
    docs = []
    for k in range(60):
        kind = k % 6
        if kind == 0:
            text = prose(80)
        elif kind in (1, 2):
            text = prose(rng.randint(1, 60)) + rng.choice(passages) + prose(rng.randint(0, 60))
        elif kind == 3:
            words = docs[-3][1].split() if docs[-3][1] else []
            for _ in range(2):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind == 4:
            text = docs[rng.randrange(len(docs))][1]
        else:
            text = rng.choice(["", None, "ab" * 300, "x" * 450, passages[0] + passages[0], prose(5)])
        docs.append((k, text))
    return docs


@pytest.mark.parametrize("seed,length,most", [(1, 100, 20_000), (2, 128, 20_000), (3, 100, 3), (4, 90, 1)])
def test_against_brute_force(spark, seed, length, most):
    docs = corpus(seed)
    every, later = brute(docs, length)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for keep_first, truth in ((False, every), (True, later)):
        got = suffix_dedup.deduplicated(df, length, most=most, keep_first=keep_first).collect()
        assert len(got) == len(docs)
        texts = dict(docs)
        for r in got:
            raw = (texts[r.doc_id] or "").encode()
            removed = {i for a, b in r.removed for i in range(a, b)}
            assert removed == truth[r.doc_id], (seed, keep_first, r.doc_id)
            assert bytes(r.kept) == bytes(c for i, c in enumerate(raw) if i not in truth[r.doc_id])
            assert r.n_bytes == len(raw)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, starts int, v string")
    assert suffix_dedup.deduplicated(df, 100).collect() == []
    df = spark.createDataFrame([(1, "q" * 500, 3, "x")], "doc_id long, text string, starts int, v string")
    (row,) = suffix_dedup.deduplicated(df, 400, keep_first=False).collect()
    assert row.removed == [[0, 500]] and bytes(row.kept) == b""
