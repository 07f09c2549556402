"""Held-out accuracy of the classifiers, for each class, on the small tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.llm import queries

TABLES = Path("/root/testdata/sf0.1")


@pytest.mark.parametrize(("name", "label", "modulus", "left_out"), [("op1_quality_classifier", "quality", 3, 1), ("op6_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, label, modulus, left_out):
    if not TABLES.exists():
        pytest.skip("no test tables")
    scores = queries.queries()[name](spark, str(TABLES))
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = scores.join(labels, "doc_id").where("held_out").groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("y")).alias("right"))
    got = {r.y: r.right / r.n for r in rows.collect()}
    assert set(got) == {0, 1} and min(got.values()) >= 0.9, got
    odd = scores.where(f"NOT (score BETWEEN 0 AND 1) OR predicted <> int(score >= 0.5) OR held_out <> (crc32(string(doc_id)) % {modulus} = {left_out})")
    assert odd.count() == 0
