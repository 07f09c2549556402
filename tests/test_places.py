"""Row numbers of groups of any size."""

import pytest
from pyspark.sql import functions as F

from tessella.places import numbered

ROWS = [(k, v, i) for i, (k, v) in enumerate([("a", i % 7) for i in range(300)] + [("b", 3), (None, 1), (None, None), ("c", None)] + [("b", 1)] * 60)]


@pytest.mark.parametrize("partitions", [1, 9])
def test_places_equal_a_plain_sort(spark, partitions):
    rows = spark.createDataFrame(ROWS, "k string, v int, i int").repartition(partitions)
    got = numbered(rows, ["k"], [F.col("v"), F.col("i")], total="size").collect()
    want = {}
    for k in {r[0] for r in ROWS}:
        mine = sorted((r for r in ROWS if r[0] == k), key=lambda r: (r[1] is not None, r[1], r[2]))
        want |= {r[2]: (n + 1, len(mine)) for n, r in enumerate(mine)}
    assert {r.i: (r.place, r["size"]) for r in got} == want and len(got) == len(ROWS)


def test_equal_rows_of_one_group_get_every_place(spark):
    rows = spark.createDataFrame([(1,)] * 500, "v int").repartition(6)
    assert sorted(r.place for r in numbered(rows, [], [F.col("v")]).collect()) == list(range(1, 501))
    assert numbered(rows.limit(0), [], [F.col("v")]).count() == 0


def test_no_window_over_the_group_alone(spark):
    plan = numbered(spark.createDataFrame(ROWS, "k string, v int, i int"), ["k"], [F.col("v")])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number" in line]
    assert windows and all("_range" in line for line in windows)
