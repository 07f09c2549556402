"""Places in an order: row numbers of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def numbered(rows: DataFrame, group: list[str], order: list[Column], place: str = "place", total: str | None = None) -> DataFrame:
    """All columns and ``place``, from 1: the row's number in its group by ``order``; ``total`` names a column for the group's size.

    A group is cut into ranges of its order, each of them is numbered by itself,
    and the sizes of the ranges before are added: neither a large group nor the
    whole table (no ``group``) meets in one task. Nulls come first, also as
    values of a group's columns. Rows equal in group and order are told apart by
    where they were read, so that they can be cut as well.
    """
    key = F.struct(*group) if group else F.struct(F.lit(0))
    told = rows.select(*[rows[c] for c in rows.columns], key.alias("_group"), F.monotonically_increasing_id().alias("_read"))
    sort = [c.alias(f"_by{i}") for i, c in enumerate(order)]
    by = [f"_by{i}" for i in range(len(order))]
    ranged = told.select("*", *sort).repartitionByRange("_group", *by, "_read")
    # written, so that the ranges are the same wherever the rows are read again
    cut = written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_group", "_range").agg(F.count("*").alias("_n"))
    over = Window.partitionBy("_group").orderBy("_range")  # as many rows as ranges at most
    before = F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_group", "_range", before.alias("_before"), F.sum("_n").over(Window.partitionBy("_group")).alias("_total"))
    inside = F.row_number().over(Window.partitionBy("_range", "_group").orderBy(*by, "_read"))
    out = cut.withColumn("_place", inside).join(sizes, ["_range", "_group"])
    at = (F.col("_before") + F.col("_place")).cast("long").alias(place)
    return out.select(*rows.columns, at, *([F.col("_total").alias(total)] if total else []))
