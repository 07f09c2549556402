"""The whole pipeline against plain Python, stage by stage, on the smallest tables."""

import math
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tessella.llm import toxicity  # noqa: E402

from .test_decontam import words  # noqa: E402
from .test_jaccard import brute as classes  # noqa: E402
from .test_mixing import entropy, weights  # noqa: E402
from .test_native_spans import brute_secrets  # noqa: E402

TABLES = "/root/testdata/sf0.001"
SEED = 17


def toxic_score(lexicon, text):
    """The score of one text, with every term tried at every place."""
    t = toxicity.folded(text or "") + " "
    phrases = [toxicity.folded(p) for p in lexicon.exceptions]
    spared = {i for p in phrases for m in re.finditer(f"(?={re.escape(p)} )", t) for i in range(m.start(), m.start() + len(p))}
    best = []
    for m in re.finditer(r"\w+", t):
        at = m.start()
        # places at which a term may begin: the one before is neither letter, digit nor underline
        for start in (at + k for k in range(len(m[0])) if k == 0 or not (m[0][k - 1].isalnum() or m[0][k - 1] == "_")):
            ends = lambda w: not (t[start + len(w) : start + len(w) + 1].isalnum() or t[start + len(w) : start + len(w) + 1] == "_")  # noqa: E731, B023
            found = [v for w, v in lexicon.weights.items() if t.startswith(w.rstrip(" "), start) and (not w.endswith(" ") or ends(w.rstrip(" ")))]
            if found and start not in spared:
                best.append(max(found))
    z = (math.log1p(sum(best)), math.log1p(100 * sum(best) / (1 + t.count(" ") + 20)), math.log1p(len(best))) if text else (0.0, 0.0, 0.0)
    return 1 / (1 + math.exp(-(sum(b * x for b, x in zip(lexicon.beta, z)) + lexicon.beta[3])))


def contaminated(text, items, window=10):
    w = words(text)
    for x in items:
        q = words(x)
        n = min(window, len(q))
        asked = {tuple(q[s : s + n]) for s in range(len(q) - n + 1)} if n else set()
        if any(tuple(w[a : a + n]) in asked for a in range(len(w) - n + 1)) and asked:
            return True
    return False


def masked(text):
    if text is None:
        return None
    found = [(a, b) for _, a, b in brute_secrets(text)] + [m.span() for m in re.finditer("-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", text)]
    keep, at = "", 0
    for a, b in sorted(found):
        if b > at:
            keep += (text[at:a] + "[SECRET]") if a >= at else ""
            at = b
    return keep + text[at:]


def smallest(holds, low, high):
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def order(epoch, doc_id):
    """The hash by which documents of a block are ordered, as a signed number."""
    h = 42
    for value, size in ((SEED, 4), (epoch, 4), (doc_id, 8)):
        h = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def mixture(rows, entropy_gain=0.5, max_repeats=4.0, block_tokens=1 << 18):
    """(doc_id, source, epoch, block, position, n_tokens, text) of every copy, for sources of one block each."""
    by_source = defaultdict(list)
    for d, text, source in rows:
        by_source[source or ""].append((d, len(re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+", text or "")), text))
    totals = {s: sum(n for _, n, _ in docs) for s, docs in by_source.items()}
    totals = {s: t for s, t in totals.items() if t}
    assert max(totals.values()) <= block_tokens
    sizes = list(totals.values())
    natural = entropy(weights(sizes, 1.0))
    target = natural + entropy_gain * (math.log(len(sizes)) - natural)
    a = smallest(lambda x: entropy(weights(sizes, x)) <= target, 0.0, 1.0)
    fits = lambda x: (max(sizes) / min(sizes)) ** (1 - x) <= max_repeats
    if not fits(a):
        a = smallest(fits, a, 1.0)
    assert a < 1
    w = dict(zip(totals, weights(sizes, a)))
    budget = math.ceil(max(t / w[s] for s, t in totals.items()) - 1e-6)
    shares = {s: math.floor(w[s] * budget) for s in totals}
    for s in sorted(totals, key=lambda s: (shares[s] - w[s] * budget, s))[: budget - sum(shares.values())]:
        shares[s] += 1
    out = set()
    for s, t in totals.items():
        passes, rest = divmod(max(shares[s], t), t)
        for e in range(passes + (rest > 0)):
            to = 0
            for _, d, n, text in sorted((order(e, d), d, n, text) for d, n, text in by_source[s]):
                to += n
                if e < passes or to <= rest:
                    out.add((d, s, e, 0, e * t + to - n, n, text))
    return out


#: Texts that the smallest tables lack: secrets alone, twice in a text, in near copies, and in a text that another stage rejects.
SECRETS = ["password=hunter2hunter2", "token: 'abcdefgh01'", "AKIA" + "B" * 16, "0123456789abcdef" * 2, "-----BEGIN RSA PRIVATE KEY-----", "secret=short"]


def planted(rows):
    base = max(r.doc_id for r in rows) + 1
    prose = [r.text for r in rows if r.text and 40 < len(r.text.split()) < 400][:12]
    texts = [f"note {k} of the day {x} and {y} so it ends {k}" for k, (x, y) in enumerate(zip(SECRETS, SECRETS[1:] + SECRETS[:1]))]
    texts += [f"{p} api_key = key{k}key{k}key" for k, p in enumerate(prose)] + ["", None, None]
    return [(base + k, t, "en", ("web", "books", None)[k % 3], len(t or "")) for k, t in enumerate(texts)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    tables = {n: spark.read.parquet(f"{TABLES}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    more = spark.createDataFrame(planted(tables["documents"].collect()), "doc_id long, text string, lang string, source string, n_chars long")
    tables["documents"] = tables["documents"].unionByName(more)
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = {r.doc_id: (r.text, r.source) for r in tables["documents"].collect()}
    assert len(rows) == tables["documents"].count()
    lexicon = toxicity.train(tables["documents"], tables["labels"])
    assert lexicon.weights
    clean = {d: x for d, x in rows.items() if toxic_score(lexicon, x[0]) < 0.5}
    links = classes([(d, x[0]) for d, x in clean.items()], 0.8)
    first = {d: x for d, x in clean.items() if links[d][0] == d}
    items = [r.text for r in tables["benchmark"].collect()]
    left = {d: x for d, x in first.items() if not contaminated(x[0], items)}
    # every stage before the last has work to do
    assert len(rows) > len(clean) > len(first) > len(left)
    assert any(masked(t) != t for t, _ in left.values())
    want = mixture([(d, masked(t), s) for d, (t, s) in left.items()])
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "epoch", "block", "position", "n_tokens", F.col("text")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    # mixing repeats and loses nothing
    assert {r.doc_id for r in got} == set(left) and len(got) > len(left)
