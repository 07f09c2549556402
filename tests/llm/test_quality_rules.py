import random
import re
from collections import Counter

from tessella.llm import quality_rules as qr


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 50, "😀 é\x0bz\x85w", "\n\n"]
    for _ in range(200):
        words = [rng.choice(["a", "b", "Ca", "d#", "é", "f|g"]) for _ in range(rng.randint(1, 60))]
        out.append("".join(w + rng.choice([" ", "\n", "\t ", " \n"]) for w in words))
    return list(enumerate(out))


def test_statistics_and_verdicts(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_lines int")
    rules = [r for r, _, _ in qr.plan_cascade(df, qr.default_rules(), sample_rows=150)]
    assert sorted(r.name for r in rules) == sorted(r.name for r in qr.default_rules())
    got = {r.doc_id: r for r in qr.verdicts(df, rules, always=tuple(brute(""))).collect()}
    for i, t in rows:
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, repr(t)
        if want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]:
            assert not got[i].kept
    forward = {r.doc_id for r in qr.surviving(df, rules).collect()}
    backward = {r.doc_id for r in qr.surviving(df, rules[::-1]).collect()}
    assert forward == backward == {i for i, r in got.items() if r.kept}
    assert qr.surviving(df, rules).columns == df.columns


def test_a_rejection_stops_the_cascade(spark):
    """In any order the same rows stay, and statistics behind the rejecting rule are not computed."""
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    for rules in (qr.default_rules(), qr.default_rules()[::-1]):
        for r in qr.verdicts(df, rules).collect():
            known = True
            for rule in rules:
                own = [s for s in rule.needs if sum(s in other.needs for other in rules) == 1]
                assert all((r[s] is not None) == known for s in own), (r, rule.name)
                known = known and rule.name != r.failed_rule
            assert r.kept == (r.failed_rule is None)


def test_cascade_order_follows_rejections_per_cost(spark):
    df = spark.createDataFrame([(i, "word " * (4 if i % 2 else 400)) for i in range(400)], "doc_id long, text string")
    measured = qr.plan_cascade(df, qr.default_rules()[:1] + qr.default_rules()[2:4])
    rates = [share / cost for _, share, cost in measured]
    assert rates == sorted(rates, reverse=True) and measured[0][0].name == "too_few_words"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    rules = [r for r, _, _ in qr.plan_cascade(df, qr.default_rules())]
    assert qr.verdicts(df, rules).collect() == []


def test_the_order_repeats(spark):
    df = spark.createDataFrame(texts() * 10, "doc_id long, text string").repartition(4)
    runs = [[(r.name, share, cost) for r, share, cost in qr.plan_cascade(df, qr.default_rules(), sample_rows=500)] for _ in range(3)]
    assert runs[0] == runs[1] == runs[2]
    assert set(qr.WORK) == set(qr.STATISTICS)


def test_a_need_is_paid_once_and_shared_needs_by_each_rule(spark):
    df = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    cost = {r.name: c for r, _, c in qr.plan_cascade(df, qr.default_rules(), sample_rows=10)}
    words = 18 * qr.WORK["_words"][0] + 4 * qr.WORK["n_words"][1]
    assert cost["too_few_words"] == words
    assert cost["few_distinct_words"] == words + 4 * qr.WORK["n_distinct_words"][1]
