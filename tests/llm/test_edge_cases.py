"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tessella.llm import audit, decontam, jaccard, licenses, mixing, pii, quality, quality_rules, secrets, sharding, suffix_dedup, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id string, text string"
#: Names that operators use inside, as further columns of the input.
CLASHES = ("id", "v", "f", "n", "tokens", "epoch", "block", "size", "spans", "findings", "blob", "score", "_text", "digest", "kept", "n_words", "component", "starts", "total")
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(10_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix twelve blue potions under a pale moon"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "web", 0),
        (3, " \n\t ", "en", "web", 4),
        (4, LONG, "en", "web", len(LONG)),
        (5, PROSE, "en", "books", len(PROSE)),
        (6, PROSE, "en", "books", len(PROSE)),
        (6, PROSE, "en", "books", len(PROSE)),
        (7, "password: hunter2hunter2 mail me at a.b@example.org or +49 170 1234567 from 10.0.0.1", None, "web", None),
        (8, "x", "en", None, 1),
        (9, "you stupid idiot, total moron", "en", "web", 29),
        (10, "ünïcode 😀 " + PROSE.upper(), "en", "web", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 9)) for i in range(1, 11)] + [(None, 1, 1), (3, None, None), (99, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("a", PROSE), ("a", PROSE), (None, None), ("b", ""), ("c", "Total Moron")], ITEMS)


def operators(labels, benchmark, known):
    return {
        "quality": lambda d: quality.classify(d, labels),
        "suffix": lambda d: suffix_dedup.deduplicated(d.dropDuplicates(["doc_id"]), length=40),
        "licenses": lambda d: licenses.scan(d, known),
        "secrets": lambda d: secrets.findings(d)[0],
        "jaccard": lambda d: jaccard.similarity_classes(d),
        "toxicity": lambda d: toxicity.classify(d, labels),
        "mixing": lambda d: mixing.plan(d),
        "pii": lambda d: pii.detect(d),
        "decontamination": lambda d: decontam.contamination(d, benchmark, reach=20),
        "rules": lambda d: quality_rules.verdicts(d, quality_rules.default_rules()).drop("text"),
        "sharding": lambda d: sharding.plan(d, 3),
        "audit": lambda d: audit.interactions(d, labels),
    }


NAMES = ("quality", "suffix", "licenses", "secrets", "jaccard", "toxicity", "mixing", "pii", "decontamination", "rules", "sharding", "audit")


@pytest.mark.parametrize("name", NAMES)
def test_same_result_with_clashing_columns(spark, docs, wide, labels, benchmark, name):
    run = operators(labels, benchmark, licenses.known_digests(spark))[name]
    plain = run(docs)
    columns = [c for c in plain.columns if c not in ("failed_rule",)]
    own = sorted(map(str, plain.select(columns).collect()))
    assert own
    assert sorted(map(str, run(wide).select(columns).collect())) == own


@pytest.mark.parametrize("name", NAMES)
def test_empty_table_gives_an_empty_result(spark, none, labels, benchmark, name):
    assert operators(labels, benchmark, licenses.known_digests(spark))[name](none).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("suffix", "mixing", "jaccard", "audit")])
def test_one_row_for_each_row(spark, docs, labels, benchmark, name):
    assert operators(labels, benchmark, licenses.known_digests(spark))[name](docs).count() == docs.count()


def test_no_labels_and_no_benchmark(spark, docs, labels, benchmark):
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(docs, labels.limit(0)).where("predicted = 1").isEmpty()
    assert decontam.contamination(docs, benchmark.limit(0)).where("n_hit > 0").isEmpty()


def test_copies_share_a_class(docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similarity_classes(docs).collect()}
    # 10 is the same text in capitals behind two more words; the two rows of 6 are one document
    assert got[5] == got[6] == got[10] == (5, 2)
    assert all(got[i] == (i, 0) for i in (1, 2, 3, 4, 7, 9))


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path, docs, none, labels, benchmark, stage):
    for frame, name in ((labels, "labels"), (benchmark, "benchmark"), (docs, "documents")):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert {2, 4} <= kept
    assert run(spark, none, str(tmp_path)).count() == 0
