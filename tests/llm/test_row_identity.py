"""Rows without an id, repeated rows, and one id on two texts."""

import pytest

from tessella.llm import jaccard, suffix_dedup

A = "one two three four five six seven eight nine ten eleven twelve"
B = "red orange yellow green blue indigo violet black white grey brown pink"
C = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
SCHEMA = "doc_id long, text string, source string"
ROWS = [
    (None, A, "p"), (None, A, "q"), (3, A.upper(), "r"),  # copies: 3 is first
    (5, B, "p"), (5, B, "p"), (5, B, "q"),  # one document in three rows
    (7, C, "p"), (7, A, "p"),  # one id on two texts
    (None, B + " " + C, "p"), (None, C + " " + A, "p"), (None, C + " " + A, "q"),  # two further classes without an id
    (None, None, "p"), (None, None, "p"), (None, "", "q"), (9, "", "p"), (9, "", "p"),
]


def text_of(row):
    return (row.doc_id, row.text)


def test_classes(spark):
    got = sorted(map(str, (tuple(r) for r in jaccard.similarity_classes(spark.createDataFrame(ROWS, SCHEMA)).collect())))
    want = [(None, 3, 3)] * 2 + [(3, 3, 3), (7, 3, 3), (5, 5, 0), (7, 7, 0), (None, None, 0), (None, None, 1), (None, None, 1)]
    want += [(None, None, 0)] * 3 + [(9, 9, 0)]
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("partitions", [1, 7])
def test_one_row_of_each_class_stays(spark, partitions):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(partitions)
    out = jaccard.one_per_class(docs, jaccard.document_classes(docs))
    assert out.columns == docs.columns
    want = [(3, A.upper()), (5, B), (7, C), (None, B + " " + C), (None, C + " " + A), (None, None), (None, None), (None, ""), (9, "")]
    assert sorted(map(str, map(text_of, out.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("keep_first", [True, False])
def test_spans_belong_to_rows(spark, keep_first):
    rows = [(None, "xy" + A), (None, B), (4, A + "zz"), (4, C), (6, C), (6, C), (None, None)]
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 40, keep_first=keep_first).collect()
    kept = sorted((str(r.doc_id), bytes(r.kept).decode()) for r in got)
    first = [("4", A + "zz"), ("4", C)] if keep_first else [("4", "zz"), ("4", "")]
    assert kept == sorted([("None", "xy"), ("None", B), ("6", ""), ("6", ""), ("None", ""), *first])
