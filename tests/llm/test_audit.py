"""The filter audit against filters applied one after the other."""

import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import audit

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def failed(row, rows):
    doc_id, text, _ = row
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * (doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows))


def expected(rows, labels):
    good, toxic = ({i for i, *says in labels if i is not None and says[k] == 1} for k in (0, 1))
    out = {}
    fails = [failed(r, rows) for r in rows]
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                all_fail = sum(f in x[1] for x in mine)
                totals[f] += len(gone)
                lost = [sum(i in which for i, _ in gone) for which in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(gone), all_fail - len(gone), sum(x[1] == f for x in mine), *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(totals[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def made():
    rng = random.Random(3)
    bits = ["plain words here ", "LOUD ", "cost $5 ", "naïve 😀 ", "\x0b\t", "a b c d e f g h i j k l m n o p "]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(bits) * rng.choice([1, 1, 30]) for _ in range(rng.randrange(0, 12)))
        if rng.random() < 0.4:
            text = " ".join(f"w{k}" for k in range(rng.randrange(190, 230))) + text
        rows.append((i, text, rng.choice(["a", "b", "", None])))
    rows += [(rng.randrange(200), rng.choice(rows)[1], rng.choice(["a", "c"])) for _ in range(60)]
    rows += [(None, rows[3][1], "a"), (None, None, "a"), (5, None, "b"), (6, "", "c"), (900, "W" * 1_000_000, "c")] + [(17, "same", None)] * 40
    labels = [(rng.choice([None, *range(200)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    return rows, labels


def test_equals_filters_in_turn(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("mask", F.lit("clash")).withColumn("part", F.lit("clash")).withColumn("good", F.lit("x"))
    got = audit.interactions(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == expected(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit.interactions(none, spark.createDataFrame([], LABELS)).count() == 0
    one = audit.interactions(spark.createDataFrame([("x", "y", "s")], "doc_id string, text string, source string"), spark.createDataFrame([], LABELS))
    assert one.count() == 600


def test_parity_sums_invert_exactly():
    counts = np.random.default_rng(1).integers(0, 10**12, 32)
    sums = [sum(int(c) * (-1) ** (m & s).bit_count() for m, c in enumerate(counts)) for s in range(32)]
    assert (audit.inverted(np.array(sums)) == counts).all()
