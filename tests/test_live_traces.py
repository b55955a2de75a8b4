"""Streams of traces: state over restarts equals the batch result, sinks write nothing twice, gaps over micro-batches."""

import datetime
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.streaming import live, traces

EVENT = "trace_id string, sequence long, invocation_id string, occurred_at timestamp, phase string, tool_name string, label string"
START = datetime.datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, live.ROCKS)
    yield spark
    spark.conf.set(name, was)


def run(frame, checkpoint, sink, mode="update"):
    q = frame.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def put(folder, name, rows):
    path = folder / name
    path.write_text("\n".join(json.dumps({**r, "occurred_at": (START + datetime.timedelta(seconds=r["at"])).isoformat() + "Z"}) for r in rows))
    at = 1_700_000_000 + int(name[0])  # files of a stream come by their time
    os.utime(path, (at, at))


def test_invocations_over_a_restart_equal_the_batch(rocks, tmp_path):
    spark, rng = rocks, random.Random(2)
    folder = tmp_path / "in"
    folder.mkdir()
    rows = []
    for i in range(160):
        t, at = rng.choice("aaab"), rng.randrange(2000)
        rows.append({"trace_id": t, "sequence": 2 * i + 1, "invocation_id": f"{t}{i}", "at": at, "phase": "started", "tool_name": f"tool{i % 3}", "label": f"l{i}"})
        if rng.random() < 0.8:
            rows.append({"trace_id": t, "sequence": 2 * i + 2, "invocation_id": f"{t}{i}", "at": at + rng.randrange(1, 50), "phase": rng.choice(["completed", "failed"]), "tool_name": None, "label": None})
    rng.shuffle(rows)
    out = str(tmp_path / "views")
    sink = lambda batch, number: batch.withColumn("n", F.lit(number)).write.mode("append").parquet(out)
    stream = lambda: live.invocation_views(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(folder)))
    put(folder, "1.json", rows[:120])
    put(folder, "2.json", rows[120:170])
    run(stream(), tmp_path / "c", sink)
    put(folder, "3.json", rows[170:])
    run(stream(), tmp_path / "c", sink)  # a new query that goes on from the checkpoint
    views = spark.read.parquet(out)
    assert views.select("n").distinct().count() >= 3
    got = {r.invocation_id: (r.started_ms, r.ended_ms, r.outcome) for r in live.latest_views(views).collect()}
    batch = spark.read.schema(EVENT).json(str(folder)).withColumn("phase", F.upper("phase")).withColumn("at_ms", F.unix_millis("occurred_at"))
    assert got == {r.invocation_id: (r.started_ms, r.ended_ms, r.outcome) for r in traces.invocations(batch, "invocation_id", "phase", "at_ms").collect()}
    log = live.last_invocations(live.latest_views(views)).collect()
    assert Counter(r.trace_id for r in log) == {"a": 10, "b": 10}
    starts = sorted((s or e for i, (s, e, _) in got.items() if i[0] == "a"), reverse=True)
    assert [r.started_ms or r.ended_ms for r in sorted(log, key=lambda r: r.place) if r.trace_id == "a"] == starts[:10]


def test_open_invocations_expire_by_a_timer(rocks, tmp_path):
    spark, folder, seen = rocks, tmp_path / "in", []
    folder.mkdir()
    one = lambda i, at, phase: {"trace_id": "t", "sequence": at, "invocation_id": i, "at": at, "phase": phase, "tool_name": "x", "label": "y"}
    put(folder, "1.json", [one("old", 0, "started"), one("done", 1, "started"), one("done", 2, "completed")])
    put(folder, "2.json", [one("new", 9000, "started")])
    put(folder, "3.json", [one("newer", 9030, "started")])
    views = live.invocation_views(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(folder)), "10 seconds", 60_000)
    run(views, tmp_path / "c", lambda batch, number: seen.extend(batch.collect()))
    assert {(r.invocation_id, r.outcome) for r in seen if r.expired} == {("old", "ACTIVE")}
    assert Counter(r.invocation_id for r in seen if not r.expired) == {"old": 1, "done": 1, "new": 1, "newer": 1}


def test_gaps_over_micro_batches(rocks, tmp_path):
    spark, folder, seen = rocks, tmp_path / "in", []
    folder.mkdir()
    rows = lambda trace, *sequences: [{"trace_id": trace, "sequence": s, "at": s} for s in sequences]
    put(folder, "1.json", rows("a", 1, 2, 5) + rows("b", 2))
    put(folder, "2.json", rows("a", 6, 9, 7, 8))
    put(folder, "3.json", rows("a", 12, 12) + rows("b", 3))
    stream = live.gaps(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(folder)))
    run(stream, tmp_path / "c", lambda batch, number: seen.extend(batch.collect()), "append")
    assert sorted(tuple(r) for r in seen) == [("a", 2, 5, 2), ("a", 9, 12, 2), ("b", 0, 2, 1)]


def test_the_sink_writes_a_batch_once(spark, tmp_path):
    events = spark.createDataFrame([("t", i) for i in range(4)], "trace_id string, sequence long")
    folder = str(tmp_path / "out")
    sink = live.trace_sink(folder, "one", {"trace_id": "t"})
    sink(events, 0)
    sink(events.where("sequence < 2"), 1)
    sink(events, 1)  # replayed, with other rows: what was written stands
    live.trace_sink(folder, "one")(events, 0)  # another process of the same stream
    got = live.read_sink(spark, folder, "trace_id string, sequence long, batch int")
    assert Counter(r.batch for r in got.collect()) == {0: 4, 1: 2}
    with pytest.raises(FileExistsError, match="stream one"):
        live.trace_sink(folder, "two")(events, 0)
    (tmp_path / "out" / "batch=000000001" / "_SUCCESS").unlink()  # as if it had been cut off
    sink(events, 1)
    assert live.read_sink(spark, folder, "trace_id string, sequence long, batch int").count() == 8
    (tmp_path / "taken").mkdir()
    with pytest.raises(FileExistsError, match="exists"):
        live.trace_sink(str(tmp_path / "taken"), "one")(events, 0)


def test_a_stream_into_the_sink_is_replayed(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    put(folder, "1.json", [{"trace_id": "t", "sequence": s, "at": s} for s in range(1, 4)])
    stream = spark.readStream.schema("trace_id string, sequence long").json(str(folder))
    run(stream, tmp_path / "c", live.trace_sink(out, "s"), "append")
    put(folder, "2.json", [{"trace_id": "t", "sequence": s, "at": s} for s in range(4, 6)])
    run(stream, tmp_path / "c", live.trace_sink(out, "s"), "append")
    run(stream, tmp_path / "c2", live.trace_sink(out, "s"), "append")  # all from the first batch on, which is there already
    assert sorted(r.sequence for r in live.read_sink(spark, out, "trace_id string, sequence long").collect()) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("turned", [False, True])
def test_outcome_of_two_ends_at_one_time_is_the_first(spark, turned):
    rows = [(1, 0, 5, "STARTED"), (1, 1, 9, "COMPLETED"), (1, 2, 9, "FAILED"), (2, 3, 5, "STARTED"), (2, 4, 9, "FAILED"), (2, 5, 9, "COMPLETED")]
    frame = spark.createDataFrame(rows[::-1] if turned else rows, "i long, n long, at_ms long, phase string").coalesce(1)
    assert {r.i: r.outcome for r in traces.invocations(frame, "i", "phase", "at_ms", "n").collect()} == {1: "COMPLETED", 2: "FAILED"}
    assert {r.i: r.outcome for r in traces.invocations(frame, "i", "phase", "at_ms").collect()} == {1: "COMPLETED", 2: "COMPLETED"}
