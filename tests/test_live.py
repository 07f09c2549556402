"""File streams that are stopped and started again, with late and out-of-order events, against the batch forms."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessella.streaming import events as ev
from tessella.streaming import live

BATCH = live.EVENT


def log(rng, n=120, paths=6):
    """Events in order of time; at each time one event, contents and kinds at random."""
    rows, at = [], 0
    for seq in range(n):
        at += rng.choice([70, 210, 440, 3000, 20_000])  # milliseconds; no sum is a gap
        path = f"models/m{rng.randrange(paths)}" + rng.choice([".scry"] * 6 + [".baseline.scry", ".txt"])
        rows.append(
            {"model": rng.choice("ab"), "seq": seq, "ts": f"2024-03-01T10:{at // 60_000:02d}:{at // 1000 % 60:02d}.{at % 1000:03d}Z", "kind": rng.choice(["create", "modify", "modify", "remove"]),
             "path": path, "content": rng.choice(["x", "x", "y", None])}
        )
    return rows


def put(folder, rows):
    """One file, seen whole or not at all."""
    folder.mkdir(exist_ok=True)
    name = uuid.uuid4().hex
    (folder / f".{name}.tmp").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (folder / f".{name}.tmp").rename(folder / f"{name}.json")


CLOSING = {"model": "z", "seq": 10**6, "ts": "2025-03-01T10:00:00.000Z", "kind": "create", "path": "z.scry", "content": "z"}

FORMS = {
    "changed": (lambda e: live.changed_content(e, "1 minute"), lambda e: ev.changed_content(e).select("model", "path", "seq", "content")),
    "first": (lambda e: live.first_seen(e, "1 minute"), lambda e: e.groupBy("model", "path").agg(F.min("ts").alias("created"))),
    "debounced": (lambda e: ev.debounced_by_model(e, "300 milliseconds", "1 minute"), lambda e: ev.debounced_log(e, 0.3)),
    "by_model": (lambda e: ev.debounced_by_model(e, "500 milliseconds", "1 minute"), lambda e: ev.debounced_by_model(e)),
}


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("form", sorted(FORMS))
def test_restarted_stream_equals_the_batch_form(spark, tmp_path, form):
    rng = random.Random(form)
    rows = log(rng)
    stream, batch = FORMS[form]
    sink, checkpoint = live.Sink(f"{tmp_path}/out"), f"{tmp_path}/checkpoint"
    # parts by time; inside a part files and lines are shuffled
    for part in (rows[:50], rows[50:90], rows[90:], [CLOSING]):
        mixed = rng.sample(part, len(part))
        put(tmp_path / "log", mixed[::2])
        if mixed[1::2]:
            put(tmp_path / "log", mixed[1::2])
        told = stream(ev.model_events(live.event_stream(spark, f"{tmp_path}/log")))
        live.drain(told, sink, checkpoint)  # starts anew from the checkpoint
    given = ev.model_events(spark.read.schema(BATCH).json(f"{tmp_path}/log")).where("seq < 1000000")
    got = sink.read(spark, told.schema).select(*told.columns)
    assert rows_of(got) == rows_of(batch(given)) and got.count() > 5


def test_sessions_across_a_restart(spark, tmp_path):
    schema = "model string, session_key string, seq long, ts timestamp, kind string"
    rng = random.Random(11)
    rows = [{"model": "m", "session_key": rng.choice("pqr"), "seq": i, "ts": f"2024-03-01T10:00:{i % 60:02d}Z", "kind": rng.choice(["start", "start", "done"])} for i in range(60)]
    closing = {"model": "z", "session_key": "z", "seq": 99, "ts": "2025-03-01T10:00:00Z", "kind": "start"}
    sink = live.Sink(f"{tmp_path}/out")
    for part in (rows[:25], rows[25:], [closing]):
        put(tmp_path / "log", rng.sample(part, len(part)))
        told = live.accepted_starts(live.event_stream(spark, f"{tmp_path}/log", schema), "10 seconds")
        live.drain(told, sink, f"{tmp_path}/checkpoint")
    want = ev.accepted_starts(spark.createDataFrame([(r["model"], r["session_key"], r["seq"], r["kind"]) for r in rows], "model string, session_key string, seq long, kind string"))
    assert rows_of(sink.read(spark, told.schema).select(*told.columns)) == rows_of(want)


def test_late_events_are_dropped_and_others_are_not(spark, tmp_path):
    at = lambda seq, ts, content: CLOSING | {"path": "a.scry", "seq": seq, "ts": f"2024-03-01T{ts}Z", "content": content}
    sink = live.Sink(f"{tmp_path}/out")
    (tmp_path / "log").mkdir()
    told = live.changed_content(live.event_stream(spark, f"{tmp_path}/log"), "1 minute")
    # 3 comes before 2 but is in time; 4 comes after the watermark has passed it
    for part in ([at(1, "10:00:00", "x"), at(3, "10:02:00", "y")], [at(2, "10:01:30", "x")], [at(4, "10:00:30", "late"), at(5, "10:05:00", "y")], [CLOSING]):
        put(tmp_path / "log", part)
        live.drain(told, sink, f"{tmp_path}/checkpoint")
    assert sorted((r.seq, r.content) for r in sink.read(spark, told.schema).collect()) == [(1, "x"), (3, "y")]


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    sink = live.Sink(f"{tmp_path}/out")
    rows = spark.range(5)
    for number in (0, 1, 1, 0):
        sink(rows, number)
    assert sink.read(spark, rows.schema).count() == 10
