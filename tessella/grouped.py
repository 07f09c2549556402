"""Groups that fit into a task, many of them in one Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Groups that are worked on at once in a task.
AT_ONCE = 512


def each(rows: DataFrame, keys: list[str], columns: list[str], kernel: Callable[[list[list[tuple]]], list[list[tuple]]], kind: str) -> DataFrame:
    """``keys`` and the columns of ``kind``: the rows that ``kernel`` makes of each group's rows, which come as tuples of ``columns`` in any order.

    The kernel gets the groups of a chunk together and returns a list for each of
    them. Many small groups share a batch, since a batch for each would cost more
    than what is done with it. Groups are dealt over all tasks even where their
    bytes are few, because the time goes into the kernel.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    listed = rows.repartition(tasks, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    made = StructType.fromDDL(kind)
    schema = StructType([rows.schema[k] for k in keys] + made.fields)
    types = [f.type for f in to_arrow_schema(made)]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                lists = part.column(len(keys))
                flat, ends = lists.flatten(), lists.value_lengths().to_pylist()
                values = list(zip(*(flat.field(k).to_pylist() for k in range(len(columns))), strict=True))
                groups, begin = [], 0
                for n in ends:
                    groups.append(values[begin : begin + n])
                    begin += n
                out = kernel(groups)
                take = pa.array([k for k, g in enumerate(out) for _ in g], pa.int64())
                flat_out = [row for g in out for row in g]
                made_columns = list(zip(*flat_out, strict=True)) if flat_out else [[]] * len(types)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).take(take) for k in range(len(keys))] + [pa.array(c, t) for c, t in zip(made_columns, types, strict=True)], names
                )

    return listed.mapInArrow(run, schema)


def one_by_one(kernel: Callable[[list[tuple]], list[tuple]]) -> Callable[[list[list[tuple]]], list[list[tuple]]]:
    """A kernel for :func:`each` from one for a single group."""
    return lambda groups: [kernel(g) for g in groups]
