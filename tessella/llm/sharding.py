"""Shards that all hold the mixture of the sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.places import numbered

from .common import whole, written


def shuffle_key(seed: int, doc_id: str = "doc_id") -> Column:
    """The key of a row in the seeded shuffle of its source: MD5 of the seed and the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))


def interleaved(rows: DataFrame, source: str, order: list[Column], n_shards: int) -> DataFrame:
    """All columns of ``rows``, ``shard`` from 0 and ``slot`` from 0 in the shard.

    Rows are ranked by ``order`` inside their source; the row of rank r of n has
    the fraction (2r - 1) / 2n, and all rows sorted by it (ties by source and
    rank) are cut into stretches whose lengths differ by one at most. A stretch
    holds of each source its share, give or take one row at each end. Null
    sources are one source. With fewer rows than shards, some shards are empty.
    """
    ranked = numbered(rows, [source], order, place="_rank", total="_of")
    fraction = (2 * F.col("_rank") - 1) / (2 * F.col("_of"))
    dealt = numbered(ranked.withColumn("_fraction", fraction), [], [F.col("_fraction"), F.col(source), F.col("_rank")], place="_at", total="_all")
    at = F.col("_at") - 1
    return dealt.withColumn("shard", F.expr(f"((_at - 1) * {n_shards}L) div _all").cast("int")).select(
        *rows.columns, "shard", (at - F.expr(f"(shard * _all + {n_shards - 1}L) div {n_shards}L")).alias("slot")
    )


def plan(docs: DataFrame, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): a row for each row of ``docs``; ``shard`` counts differ by one at most.

    Size: UTF-8 bytes of the text (null: none) and 8. Texts themselves are not
    moved. Nulls: a null id is a value like another, null sources are one
    source. Repeated rows, and rows with one id, are ordered by size and
    checksum; equal ones are interchangeable. An empty table gives no rows.
    Further columns are not looked at.
    """
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(whole()) + 8).cast("long").alias("size"),
        F.crc32(whole().cast("binary")).alias("text_crc32"),
        shuffle_key(seed).alias("_key"),
    )
    return interleaved(rows, "source", [F.col(c) for c in ("_key", "size", "text_crc32", "doc_id")], n_shards).drop("_key")


def sharded(docs: DataFrame, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``; the texts move once, joined by a row key that is written with them."""
    keyed = written(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "to-shard")
    text = whole(F.col("_doc.text"))
    rows = keyed.select("_row", F.col("_doc.source").alias("source"), shuffle_key(seed, "_doc.doc_id").alias("_key"), F.octet_length(text).alias("_size"), F.crc32(text.cast("binary")).alias("_crc"))
    placed = interleaved(rows, "source", [F.col(c) for c in ("_key", "_size", "_crc", "_row")], n_shards).select("_row", "shard", "slot")
    return keyed.join(placed, "_row").select(*[F.col("_doc")[c].alias(c) for c in docs.columns], "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: int = 17, rows_per_file: int = 100_000) -> None:
    """Write the rows as Parquet, a folder ``shard=N`` for each shard and files of ``rows_per_file`` slots, each in order of its slots.

    A shard of any size is cut into files, so that no task writes a whole shard. Columns named ``shard`` or ``slot`` are replaced.
    """
    out = sharded(docs.drop("shard", "slot"), n_shards, seed).withColumn("_file", F.expr(f"slot div {rows_per_file}L"))
    parts = out.repartition("shard", "_file").sortWithinPartitions("shard", "_file", "slot").drop("_file")
    parts.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
