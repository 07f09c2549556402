"""Change events in batch form; ``live`` has the streams. What says so is the same code for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.runs import numbered_runs


def model_events(event: DataFrame) -> DataFrame:
    """Create and modify events of model files; baselines and temporary files are left out. Batch and stream."""
    name = F.element_at(F.split("path", "/"), -1)
    return event.where(
        F.col("kind").isin("create", "modify") & F.endswith(name, F.lit(".scry")) & ~F.endswith(name, F.lit(".baseline.scry")) & ~F.startswith(name, F.lit(".tmp"))
    )


def first_seen(event: DataFrame) -> DataFrame:
    """(path, created): each model once. Batch."""
    return event.groupBy("path").agg(F.min("ts").alias("created"))


def debounced(event: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """(fires, path, events): one row for each burst, at the end of a quiet gap, with the last event's path. Batch.

    The timer is shared by all paths, so this is one session key; ``debounced_log``
    reads a long log in stretches, and a stream is keyed by its log
    (``debounced_by_model``).
    """
    bursts = event.groupBy(F.session_window("ts", gap).alias("w")).agg(F.max_by("path", F.struct("ts", "path")).alias("path"), F.count("*").alias("events"))
    return bursts.select(F.col("w.end").alias("fires"), "path", "events")


def debounced_by_model(event: DataFrame, gap: str = "500 milliseconds", delay: str | None = None) -> DataFrame:
    """(model, fires, path, events): as ``debounced``, with a timer for each model.

    Batch, or stream with ``delay`` as watermark: a burst is told once the
    watermark has passed its end.
    """
    rows = event if delay is None else event.withWatermark("ts", delay)
    bursts = rows.groupBy("model", F.session_window("ts", gap).alias("w")).agg(F.max_by("path", F.struct("ts", "path")).alias("path"), F.count("*").alias("events"))
    return bursts.select("model", F.col("w.end").alias("fires"), "path", "events")


def debounced_log(event: DataFrame, gap_seconds: float, chunk_seconds: int = 86_400) -> DataFrame:
    """(model, fires, path, events): as ``debounced``, over a log of any length. Batch.

    One timer for all paths of a model makes the log one long sequence; it is
    read in stretches of time that meet only at their ends.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast(event.schema["ts"].dataType)
    micros = lambda ts: F.timestamp_diff("MICROSECOND", epoch, ts)
    late = lambda before, row: micros(row["ts"]) - micros(before["ts"]) >= int(gap_seconds * 1_000_000)
    runs = numbered_runs(event, ["model"], ["ts", "path"], F.floor(micros(F.col("ts")) / (chunk_seconds * 1_000_000)), ["ts"], late)
    bursts = runs.groupBy("model", "run").agg(F.max("ts").alias("_last"), F.max_by("path", F.struct("ts", "path")).alias("path"), F.count("*").alias("events"))
    return bursts.select("model", (F.col("_last") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("fires"), "path", "events")


def changed_content(event: DataFrame) -> DataFrame:
    """Events whose content differs from the last known content of their path. Batch."""
    w = Window.partitionBy("model", "path").orderBy("seq")
    return event.withColumn("_last", F.lag("content").over(w)).withColumn("_first", F.row_number().over(w) == 1).where(
        F.col("_first") | ~F.col("content").eqNullSafe(F.col("_last"))
    ).drop("_last", "_first")


def accepted_starts(event: DataFrame) -> DataFrame:
    """(model, session_key, seq, accepted): a start is refused while the session before it is not done. Batch.

    Between two starts without a done there is nothing that ends a session, so
    the kind of the event before decides.
    """
    w = Window.partitionBy("model", "session_key").orderBy("seq")
    return event.withColumn("_last", F.lag("kind").over(w)).where("kind = 'start'").select(
        "model", "session_key", "seq", (~F.col("_last").eqNullSafe(F.lit("start"))).alias("accepted")
    )
