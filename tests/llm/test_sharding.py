"""Shards against a plain interleaving, and the SQL twins of the new queries."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import TABLES, comparable
from tessella.llm import queries, sharding

SCHEMA = "doc_id long, text string, source string"


def expected(rows, n_shards, seed):
    """(doc_id, shard, slot) of each row."""
    by = defaultdict(list)
    for doc_id, text, source in rows:
        raw = (text or "").encode()
        key = hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
        by[source].append((key, len(raw) + 8, zlib.crc32(raw), doc_id))
    line = []
    for source, mine in by.items():
        for r, x in enumerate(sorted(mine, key=lambda x: (*x[:3], x[3] is not None, x[3])), 1):
            line.append(((2 * r - 1) / (2 * len(mine)), source is not None, source or "", r, x))
    line.sort(key=lambda x: x[:4])
    shards = [at * n_shards // len(line) for at in range(len(line))]
    begins = {s: shards.index(s) for s in set(shards)}
    return sorted((str(x[4][3]), x[4][1], x[4][2], s, at - begins[s]) for at, (x, s) in enumerate(zip(line, shards, strict=True)))


def made():
    rows = [(i, f"text {i} " * (i % 9), f"s{min(3, i % 11)}" if i % 50 else None) for i in range(400)]
    return rows + [(None, None, "s1"), (None, "", "s1"), (None, "x", None), (7, "again", "s9"), (7, "again", "s9"), (400, "wide " * 50_000, "s2")] + [(None, "", None)] * 90


@pytest.mark.parametrize("n_shards", [1, 7, 24])
def test_equals_a_plain_interleaving(spark, n_shards):
    docs = spark.createDataFrame(made(), SCHEMA).repartition(5).withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("place", F.lit(1))
    got = sharding.plan(docs, n_shards, 3).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.slot) for r in got) == expected(made(), n_shards, 3)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    # every shard holds its share of each source, give or take a row at both ends
    whole = Counter(r.source for r in got)
    for (_, source), n in Counter((r.shard, r.source) for r in got).items():
        assert abs(n - whole[source] / n_shards) <= 2


def test_fewer_rows_than_shards_and_none(spark):
    few = sharding.plan(spark.createDataFrame(made()[:5], SCHEMA), 24)
    assert sorted((r.shard, r.slot) for r in few.collect()) == [(s, 0) for s in (0, 4, 9, 14, 19)]
    assert sharding.plan(spark.createDataFrame([], SCHEMA), 24).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame(made(), SCHEMA).repartition(5)
    sharding.write_shards(docs, f"{tmp_path}/out", n_shards=6, rows_per_file=30)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select("doc_id", "text", "source").collect())) == sorted(map(str, docs.collect()))
    plan = {(str(r.doc_id), r["size"], r.shard, r.slot) for r in sharding.plan(docs, 6).collect()}
    assert {(str(r.doc_id), len((r.text or "").encode()) + 8, r.shard, r.slot) for r in back.collect()} == plan
    assert len(back.inputFiles()) >= 6 * 2


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


@pytest.mark.parametrize("name", ["op11_sharding", "op12_filter_audit"])
def test_query_equals_its_twin(spark, duck, name):
    got = queries.queries()[name](spark, str(TABLES))
    want = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert comparable(got.columns, got.collect()) == comparable(columns, want.fetchall())
