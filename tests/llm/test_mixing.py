"""Source mixing against plain Python on the same counts."""

import math
import random
from collections import defaultdict

import pytest

from tessella.llm import mixing


def corpus(sizes, seed=2):
    rng = random.Random(seed)
    rows, d = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((d, "w " * rng.randint(1, 60), source, d % 7))
            d += 1
    return rows


def weights(totals, a):
    total = sum(totals)
    raised = [(t / total) ** a for t in totals]
    return [r / sum(raised) for r in raised]


def entropy(w):
    return -sum(x * math.log(x) for x in w)


def dealt(exact, budget):
    """Whole numbers by largest remainder, ties by name."""
    out = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: budget - sum(out.values())]:
        out[s] += 1
    return out


def brute_exponent(totals, budget, entropy_share, max_repeats, gain=None):
    """The same two conditions, looked for on a fine grid; no budget: the least that covers all."""
    a = 1.0
    natural = entropy(weights(totals, 1.0))
    target = entropy_share * math.log(len(totals)) if gain is None else natural + gain * (math.log(len(totals)) - natural)
    if budget is None:
        repeats = lambda w: max(x / t for x, t in zip(w, totals)) / min(x / t for x, t in zip(w, totals))
    else:
        repeats = lambda w: max(x * budget / t for x, t in zip(w, totals))
    grid = [k / 20_000 for k in range(20_001)]
    if entropy(weights(totals, 1.0)) < target:
        a = next(x for x in grid if entropy(weights(totals, x)) <= target)
    fits = lambda x: repeats(weights(totals, x)) <= max_repeats
    return a if fits(a) else next(x for x in grid if x >= a and fits(x))


@pytest.mark.parametrize("entropy_share,max_repeats,budget", [(0.95, 4.0, None), (0.999, 3.0, None), (0.9, 100.0, 20_000), (0.5, 1.5, 900)])
def test_exponent_budget_and_blocks(spark, entropy_share, max_repeats, budget):
    rows = corpus({"big": 400, "mid": 60, "small": 9, "tiny": 2})
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    tokens = {d: len(t.split()) for d, t, _, _ in rows}
    of = defaultdict(list)
    for d, _, s, _ in rows:
        of[s].append(d)
    totals = {s: sum(tokens[d] for d in ds) for s, ds in of.items()}
    budget = budget or sum(totals.values())
    a = brute_exponent(list(totals.values()), budget, entropy_share, max_repeats)
    table = spark.createDataFrame(list(totals.items()), "source string, total long")
    got = mixing.solve(table, sum(totals.values()), budget, entropy_share, max_repeats)
    assert abs(got - a) < 2e-4
    w = dict(zip(totals, weights(list(totals.values()), got)))
    copies = mixing.plan(docs, budget, entropy_share, max_repeats, block_tokens=100).collect()
    by_source = defaultdict(list)
    for r in copies:
        by_source[r.source].append(r)
    shares = dealt({s: x * budget for s, x in w.items()}, budget)
    assert sum(shares.values()) == budget
    for s, t in totals.items():
        share = shares[s]
        assert share <= max_repeats * t + 1
        mine = sorted(by_source[s], key=lambda r: r.position)
        # whole passes hold every document once, the last pass is a prefix of a permutation within the rest
        epochs = defaultdict(list)
        at = 0
        for r in mine:
            assert r.position == at and r.n_tokens == tokens[r.doc_id]
            at += r.n_tokens
            epochs[r.epoch].append(r.doc_id)
        assert at <= share
        for e, ids in epochs.items():
            assert sorted(ids) == of[s] if e < share // t else len(set(ids)) == len(ids)
        assert all(e in epochs for e in range(share // t))
        # what is missing to the share is less than one block's next document
        assert share - at <= max(tokens[d] for d in of[s])
    if max_repeats == 100.0:  # the entropy alone decides
        assert abs(entropy(list(w.values())) - entropy_share * math.log(len(totals))) < 1e-3


def test_passes_differ_in_order_and_runs_repeat(spark):
    docs = spark.createDataFrame(corpus({"a": 500, "b": 40}), "doc_id long, text string, source string, other int")
    run = lambda: sorted((r.source, r.epoch, r.position, r.doc_id) for r in mixing.plan(docs, block_tokens=200).collect())
    first = run()
    assert first == run()
    passes = defaultdict(list)
    for s, e, _, d in first:
        passes[s, e].append(d)
    assert passes["b", 0] != passes["b", 1] and sorted(passes["b", 0]) == sorted(passes["b", 1])


def test_many_sources(spark):
    """One aggregation a step, whatever the number of sources."""
    docs = spark.range(120_000).selectExpr("id AS doc_id", "repeat('w ', int(id % 5) + 1) AS text", "concat('s', id) AS source")
    plan = mixing.plan(docs, budget=720_000, entropy_share=0.99, max_repeats=4.0)
    n, total = plan.selectExpr("count(DISTINCT source)", "sum(n_tokens)").first()
    assert 360_000 < total <= 720_000 and n > 100_000


def test_copies_carry_their_text(spark):
    rows = [(1, "a b", "x", 0), (1, "c d e", "x", 0), (None, "f", "y", 0), (2, None, "y", 0), (3, "g h", None, 0), (3, "g h", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    got = mixing.mixed(docs, budget=40).collect()
    assert {(r.doc_id, r.text) for r in got} == {(d, t) for d, t, _, _ in rows}
    assert all(r.n_tokens == len((r.text or "").split()) for r in got)
    plain = sorted((r.doc_id or 0, r.source, r.epoch, r.n_tokens) for r in mixing.plan(docs, budget=40).collect())
    assert sorted((r.doc_id or 0, r.source, r.epoch, r.n_tokens) for r in got) == plain


def test_natural_shares_lose_no_document(spark):
    """An exponent of 1 and the whole budget: floating point may not take a token."""
    rows = corpus({f"s{k}": 3 + 7 * k for k in range(23)}, seed=9)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    got = mixing.plan(docs, entropy_share=None, max_repeats=None, block_tokens=200).collect()
    assert sorted((r.doc_id, r.epoch) for r in got) == [(d, 0) for d, *_ in rows]


@pytest.mark.parametrize("seed", [3, 4])
def test_cover_reads_every_document_and_the_target_binds(spark, seed):
    rows = corpus({"big": 500, "b2": 41, "b3": 40, "b4": 12, "tiny": 2}, seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    got = mixing.plan(docs, entropy_gain=0.5, max_repeats=4.0, cover=True, block_tokens=300).collect()
    totals = defaultdict(int)
    for _, t, s, _ in rows:
        totals[s] += len(t.split())
    a = brute_exponent(list(totals.values()), None, None, 4.0, gain=0.5)
    assert 0.0 < a < 1.0
    assert {r.doc_id for r in got} == {d for d, *_ in rows}
    read = defaultdict(int)
    for r in got:
        read[r.source] += r.n_tokens
    w = dict(zip(totals, weights(list(totals.values()), a)))
    budget = max(totals[s] / w[s] for s in totals)
    for s, t in totals.items():
        assert t <= read[s] <= 4.0 * t + 1 and abs(read[s] - w[s] * budget) <= 0.002 * budget + 60


def test_query_mixes_and_keeps_all(spark):
    from tessella.llm import queries

    path = "/root/testdata/sf0.01"
    got = queries.queries()["op7_source_mixing"](spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert got.select("doc_id").distinct().count() == docs.count() < got.count()
    totals = {r.source or "": r.n for r in mixing.counted(docs).groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "n").collect()}
    assert brute_exponent(list(totals.values()), None, None, 4.0, gain=0.5) < 0.999


def test_null_and_repeated_ids_fill_all_blocks(spark):
    docs = spark.range(0, 3000, 1, 6).selectExpr("if(id % 2 = 0, null, 7) AS doc_id", "'a b c' AS text", "'s' AS source")
    got = mixing.plan(docs, entropy_share=None, max_repeats=None, block_tokens=300).groupBy("block").count().collect()
    assert len(got) == 30 and max(r["count"] for r in got) < 200
