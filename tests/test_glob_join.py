"""Patterns with many rows and many files."""

import fnmatch

from pyspark.sql import functions as F

from tessella.operators import drift


def test_one_common_pattern_is_spread(spark, monkeypatch):
    monkeypatch.setattr(drift, "PORTION", 10)
    rows = [("m", f"o{k}", "src/*" if k % 10 else "src/f1*", k) for k in range(120)] + [("m", "o1", "src/*", 1)] * 2 + [("o", "o1", "src/*", 1), ("m", "x", "lib/*", 0)]
    paths = [("m", f"src/f{k}", k) for k in range(80)] + [("m", "src/f1", 7), ("o", "src/f3", 0), ("m", "src/a/b", 0)]
    source_map = spark.createDataFrame(rows, "model string, owner_id string, pattern string, pos int").repartition(3)
    file = spark.createDataFrame(paths, "model string, path string, mtime int").repartition(3)
    want = sorted((*r, *f[1:]) for r in rows for f in paths if r[0] == f[0] and f[1].count("/") == 1 and fnmatch.fnmatchcase(f[1], r[2]))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = drift.glob_join(source_map, file)
        got = out.select("model", "owner_id", "pattern", "pos", "path", "mtime", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out.columns == ["model", "owner_id", "pattern", "pos", "path", "mtime"]
    assert sorted(tuple(r)[:6] for r in got) == want
    # all rows of one pattern used to come from one task
    assert len({r["at"] for r in got if r.pattern == "src/*"}) == 4
    assert drift.glob_join(source_map.drop("model"), file.drop("model")).count() == sum(f[1].count("/") == 1 and fnmatch.fnmatchcase(f[1], r[2]) for r in rows for f in paths)
