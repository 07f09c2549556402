"""Runs of neighbouring rows in long sequences, without one task reading a sequence whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_runs(rows: DataFrame, keys: list[str], order: list[str], chunk: Column, carry: list[str], breaks: Callable[[Column, Column], Column]) -> DataFrame:
    """All columns and ``run``, from 1: a run begins with the first row of its keys and wherever ``breaks(before, row)`` holds.

    ``chunk`` cuts each sequence into stretches by a value that never falls along
    ``order``. Rows are compared inside their stretch; of each stretch one row
    (its last ``carry`` columns and its number of beginnings) goes to the next.
    All rows of one stretch meet in one task: choose a ``chunk`` that holds few,
    or one made from ``places.numbered`` where values may crowd.
    """
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    over = Window.partitionBy(*keys).orderBy("_chunk")
    cut = rows.withColumn("_chunk", chunk)
    own = F.struct(*carry)
    ends = cut.groupBy(*keys, "_chunk").agg(F.max_by(own, F.struct(*order)).alias("_end"))
    ends = ends.select(*keys, "_chunk", F.lag("_end").over(over).alias("_before"))
    placed = cut.withColumn("_own", F.lag(own).over(inside)).withColumn("_first", F.row_number().over(inside) == 1).join(ends, [*keys, "_chunk"])
    before = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_own"))
    fresh = (before.isNull() | breaks(before, own)).cast("long")
    marked = placed.withColumn("_fresh", fresh).withColumn("_upto", F.sum("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counts = marked.groupBy(*keys, "_chunk").agg(F.sum("_fresh").alias("_n"))
    counts = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    return marked.join(counts, [*keys, "_chunk"]).select(*rows.columns, (F.col("_earlier") + F.col("_upto")).alias("run"))
