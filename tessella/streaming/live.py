"""Live change events: file streams, keyed state that survives a restart, sinks that take a batch twice without harm.

Events of a key are handed on in order of time and number once the watermark
has passed them, so that what arrives out of order, but not later than the
delay, gives the rows of the batch forms in ``events``. What is later is dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessella.lineage import shared_dir

#: A line of a change log.
EVENT = "model string, seq long, ts timestamp, kind string, path string, content string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, schema: StructType | str = EVENT, form: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """A change log that grows by files in ``folder``, older files first."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


class InOrder(StatefulProcessor):
    """Keeps a key's events until the watermark has passed them and then takes them in order of (us, seq).

    State: the events that wait, as many as fall into the delay, and one known value.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "us long, seq long, value string")
        self._known = handle.getValueState("known", "value string")

    def take(self, known: tuple | None, value: str | None) -> tuple[tuple | None, str | None, bool]:
        """(what is known from now on, what is told, is it told) of the next event; ``known`` is None before the first."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            values = [v if isinstance(v, str) else None for v in frame["value"]]
            events = list(zip(map(int, frame["us"]), map(int, frame["seq"]), values, strict=True))
            self._waiting.appendList(events)
            for due in {us // 1000 + 1 for us, _, _ in events}:
                self._handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((e for e in self._waiting.get()), key=lambda e: e[:2]) if self._waiting.exists() else []
        due = [e for e in events if e[0] < passed]
        if not due:
            return
        known = self._known.get() if self._known.exists() else None
        told = []
        for us, seq, value in due:
            known, says, is_told = self.take(known, value)
            if is_told:
                told.append((*key, us, seq, says))
        if known is not None:
            self._known.update(known)
        if rest := events[len(due) :]:
            self._waiting.put(rest)
        else:
            self._waiting.clear()
        if told:
            yield pd.DataFrame(told, columns=[*(f"key{i}" for i in range(len(key))), "us", "seq", "value"])

    def close(self) -> None:
        pass


class _Changed(InOrder):
    def take(self, known, value):
        return (value,), value, known is None or known[0] != value


class _Session(InOrder):
    def take(self, known, value):
        running = known is not None and known[0] == "start"
        return (value,), str(not running).lower(), value == "start"


class _First(InOrder):
    def take(self, known, value):
        return ("seen",), None, known is None


def _ordered(event: DataFrame, keys: list[str], value: Column, delay: str, processor: InOrder) -> DataFrame:
    """(key0, key1, ..., us, seq, value) as told by the processor; keys are strings, not null. Events without a time are left out."""
    rows = event.where("ts IS NOT NULL").withWatermark("ts", delay).select(*keys, F.unix_micros("ts").alias("us"), "seq", value.cast("string").alias("value"), "ts")
    names = [f"key{i}" for i in range(len(keys))]
    out = ", ".join([*(f"{n} string" for n in names), "us long, seq long, value string"])
    event.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "append", "eventTime")


def changed_content(event: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(model, path, seq, content): events whose content is not the one last known of their path; ``events.changed_content`` as a stream."""
    out = _ordered(event, ["model", "path"], F.col("content"), delay, _Changed())
    return out.select(F.col("key0").alias("model"), F.col("key1").alias("path"), "seq", F.col("value").alias("content"))


def accepted_starts(event: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(model, session_key, seq, accepted): a start is refused until the session before it is done; ``events.accepted_starts`` as a stream."""
    out = _ordered(event, ["model", "session_key"], F.col("kind"), delay, _Session())
    return out.select(F.col("key0").alias("model"), F.col("key1").alias("session_key"), "seq", F.col("value").cast("boolean").alias("accepted"))


def first_seen(event: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(model, path, created): each model's first event by time, never forgotten; ``events.first_seen`` as a stream."""
    out = _ordered(event, ["model", "path"], F.lit("seen"), delay, _First())
    return out.select(F.col("key0").alias("model"), F.col("key1").alias("path"), F.timestamp_micros("us").alias("created"))


class Sink:
    """A folder of batches: a batch that is written again replaces itself, so that a restart neither loses nor doubles rows."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        return spark.read.schema(schema).option("basePath", self.folder).parquet(f"{self.folder}/batch=*")


def drain(stream: DataFrame, sink: Sink, checkpoint: str) -> None:
    """Take what has arrived since the checkpoint, and stop."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def replayed(event: DataFrame, run: Callable[[DataFrame], DataFrame], parts: int = 2) -> DataFrame:
    """What ``run`` tells of a table of events that arrives in ``parts`` by time, the stream stopped after each of them.

    A closing event of another model, a year later, lets the watermark pass all
    others, but not itself. Everything lies in the shared folder.
    """
    spark = event.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    micros = F.unix_micros("ts")
    cuts = event.agg(F.percentile_approx(micros, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 1000).alias("c"), F.max(micros).alias("m")).first()
    bounds = [None, *(cuts["c"] or []), None]
    sink = Sink(f"{folder}/out")

    def arrived(rows: DataFrame) -> DataFrame:
        rows.write.mode("append").parquet(f"{folder}/log")
        stream = run(event_stream(spark, f"{folder}/log", event.schema, "parquet"))
        drain(stream, sink, f"{folder}/checkpoint")
        return stream

    for low, high in zip(bounds, bounds[1:], strict=False):
        inside = F.lit(True)
        inside = inside & (micros > low) if low is not None else inside
        inside = inside & (micros <= high) if high is not None else inside
        arrived(event.where(inside))
    last = F.timestamp_micros(F.lit((cuts["m"] or 0) + 365 * 86_400_000_000)).cast(event.schema["ts"].dataType)
    values = {"ts": last, "seq": F.lit(-1), "kind": F.lit("create"), "path": F.lit("closing.scry")}  # passes for a model's event
    closing = spark.range(1).select(*[values.get(f.name, F.lit("closing" if f.dataType.simpleString() == "string" else None)).cast(f.dataType).alias(f.name) for f in event.schema])
    return sink.read(spark, arrived(closing).schema)
