"""Traces as streams: what is known of each invocation, gaps in sequences, and a sink that writes no line twice."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VIEW = "trace_id string, invocation_id string, tool_name string, label string, started_ms long, ended_ms long, outcome string, expired boolean"
_HELD = "tool_name string, label string, started_ms long, ended_ms long, outcome string"
LOG = 10
GAP = "trace_id string, after long, before long, missing long"


def merged(held: tuple | None, event: tuple) -> tuple:
    """What is known of an invocation after one more event, in any order: (tool, label, started, ended, outcome) with the
    earliest start and end; of ends at one time, the outcome that comes first by name. Words are those of the start."""
    tool, label, started, ended, outcome = held or (None, None, None, None, None)
    own_tool, own_label, own_started, own_ended, own_outcome = event
    if own_started is not None and (started is None or (own_started, own_tool or "", own_label or "") < (started, tool or "", label or "")):
        tool, label, started = own_tool, own_label, own_started
    if own_ended is not None and (ended is None or (own_ended, own_outcome) < (ended, outcome)):
        ended, outcome = own_ended, own_outcome
    return tool, label, started, ended, outcome


class _Invocations(StatefulProcessor):
    """State of one trace's share of invocations: those open, and the ``LOG`` last started ones."""

    def __init__(self, late_ms: int):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("invocations", "invocation_id string", _HELD)

    def _row(self, trace: str, name: str, v: tuple, expired: bool) -> Row:
        return Row(trace_id=trace, invocation_id=name, tool_name=v[0], label=v[1], started_ms=v[2], ended_ms=v[3], outcome=v[4] or "ACTIVE", expired=expired)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        changed: dict[str, tuple] = {}
        for r in rows:
            name = r["invocation_id"]
            if name not in changed:
                changed[name] = self._known(name)
            start = r["phase"] == "STARTED"
            changed[name] = merged(changed[name], (r["tool_name"], r["label"], r["at_ms"] if start else None, None if start else r["at_ms"], None if start else r["phase"]))
        now = timerValues.getCurrentWatermarkInMs()
        for name, v in changed.items():
            self.held.updateValue((name,), v)
            if v[3] is None and v[2] is not None:
                self.handle.registerTimer(max(v[2], now) + self.late_ms)
        yield from (self._row(key[0], name, v, False) for name, v in changed.items())
        # ended ones stay while they are among the last started
        all_of = [(k[0], tuple(v)) for k, v in self.held.iterator()]
        ended = sorted(((v[2] if v[2] is not None else v[3], k) for k, v in all_of if v[3] is not None), reverse=True)
        for _, name in ended[LOG:]:
            self.held.removeKey((name,))

    def _known(self, name: str) -> tuple | None:
        return tuple(self.held.getValue((name,))) if self.held.containsKey((name,)) else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = [(k[0], tuple(v)) for k, v in self.held.iterator() if v[3] is None and v[2] is not None and v[2] + self.late_ms <= at]
        for name, v in out:
            self.held.removeKey((name,))
            yield self._row(key[0], name, v, True)

    def close(self) -> None:
        pass


def invocation_views(events: DataFrame, late: str = "1 hour", late_ms: int = 3_600_000, shares: int = 16) -> DataFrame:
    """A stream of ``VIEW`` rows, one for each invocation that a micro-batch changes. ``events``: trace_id, invocation_id,
    phase (upper case), tool_name, label, occurred_at. A trace's invocations are dealt to ``shares`` keys by their hash, so
    one trace with most of the events fills many tasks; each keeps what is open and its ``LOG`` last ones. An invocation
    without an end ``late_ms`` after its start, by the watermark, comes out once more as expired and is forgotten."""
    share = F.pmod(F.xxhash64("invocation_id"), F.lit(shares)).cast("int")
    kept = events.where("trace_id is not null and invocation_id is not null and phase is not null and occurred_at is not null").withWatermark("occurred_at", late)
    keyed = kept.select("trace_id", share.alias("share"), "invocation_id", F.upper("phase").alias("phase"), "tool_name", "label", "occurred_at", F.unix_millis("occurred_at").alias("at_ms"))
    return keyed.groupBy("trace_id", "share").transformWithState(statefulProcessor=_Invocations(late_ms), outputStructType=VIEW, outputMode="Update", timeMode="EventTime")


def latest_views(views: DataFrame) -> DataFrame:
    """One row for each invocation from all ``VIEW`` rows that a stream has written, in any order and number."""
    end = F.struct("ended_ms", "outcome")
    ended = F.col("ended_ms").isNotNull()
    start = F.struct("started_ms", F.coalesce("tool_name", F.lit("")).alias("t"), F.coalesce("label", F.lit("")).alias("l"))
    return views.groupBy("trace_id", "invocation_id").agg(
        F.min(F.when(F.col("started_ms").isNotNull(), F.struct(start.alias("o"), "tool_name", "label"))).alias("s"), F.min(F.when(ended, end)).alias("e"),
    ).select("trace_id", "invocation_id", "s.tool_name", "s.label", F.col("s.o.started_ms").alias("started_ms"), "e.ended_ms", F.coalesce("e.outcome", F.lit("ACTIVE")).alias("outcome"))


def last_invocations(views: DataFrame, n: int = LOG) -> DataFrame:
    """The log: each trace's ``n`` last started invocations, with their place."""
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc(F.coalesce("started_ms", "ended_ms")), "invocation_id"))
    return views.withColumn("place", place).where(F.col("place") <= n)


class _Gaps(StatefulProcessor):
    """The highest sequence of a trace so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else 0
        for s in sorted({r["sequence"] for r in rows}):
            if s > last + 1:
                yield Row(trace_id=key[0], after=last, before=s, missing=s - last - 1)
            last = max(last, s)
        self.last.update((last,))

    def close(self) -> None:
        pass


def gaps(events: DataFrame) -> DataFrame:
    """A stream of gaps (``GAP``): sequences that a trace left out between two that came, also over micro-batches. A
    sequence that comes after its gap was told doesn't take it back."""
    rows = events.where("trace_id is not null and sequence is not null").select("trace_id", "sequence")
    return rows.groupBy("trace_id").transformWithState(statefulProcessor=_Gaps(), outputStructType=GAP, outputMode="Append", timeMode="None")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def trace_sink(folder: str, stream: str, header: dict | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that appends events as JSON lines, a folder for each micro-batch. A batch that was
    written whole is not written again, one that was cut off is written anew. ``folder`` must be new or have been begun by
    the same ``stream``, a name of the caller's that stays the same over restarts; anything else is an error."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        about = f"{folder}/_stream"
        if _exists(spark, f"{about}/_SUCCESS"):
            begun = json.loads(spark.read.text(about).first()[0])
            if begun["stream"] != stream:
                raise FileExistsError(f"{folder} belongs to the stream {begun['stream']}")
        elif _exists(spark, folder) and not _exists(spark, about):
            raise FileExistsError(f"{folder} exists already")
        else:
            text = json.dumps({"record_type": "trace_header", "schema_version": 1, **(header or {}), "stream": stream})
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(about)
        path = f"{folder}/batch={number:09d}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            batch.select(F.to_json(F.struct(*batch.columns)).alias("value")).write.mode("overwrite").text(path)

    return write


def read_sink(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The events that a sink has written whole, with their batch."""
    return spark.read.schema(schema).json(folder)
