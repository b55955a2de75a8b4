"""Trace files checked in the order of their lines, whatever number of splits a file has.

A file's lines are scanned split by split. What has to be known from the splits before (the last sequence) is one
row per split, combined in order; what concerns a whole file (its ids, the life of its invocations) is counted and
brought together by least places, so neither a long file nor an invocation with most of the events fills one task.

A valid file begins with a header of version 1 (files without one are taken as they are), has one event a line, all of
the header's trace id, with strictly rising sequences above 0; each invocation starts once and ends at most once, after
its start. An invocation may stay open. The last line may be torn. Empty lines don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut
from tessera.streaming.traces import EVENT

VERSION = 1
_LINE = f"{EVENT}, record_type string, format string, schema_version int, version int, _broken string"
_KEYS = ["file", "start", "o"]


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """file, start (of the split), o (order in it), kind (event, header, broken, other), header (record type, format,
    version), trace_id, sequence, invocation_id, phase of every line that isn't empty, stored once. A file's last line
    may be torn: it is ``torn`` then."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("o"))
    e = F.from_json("value", _LINE, {"columnNameOfCorruptRecord": "_broken"})
    read = lines.withColumn("e", F.when(F.trim("value") != "", e))
    version = F.coalesce("e.schema_version", "e.version")
    kind = (
        F.when(F.trim("value") == "", "empty").when(F.col("e._broken").isNotNull() | F.col("e").isNull(), "broken")
        .when(F.col("e.record_type").isNotNull() & (F.col("e.record_type") != "event") | F.col("e.sequence").isNull() & version.isNotNull(), "header")
        .when(F.col("e.sequence").isNull() | F.col("e.trace_id").isNull() | F.col("e.invocation_id").isNull() | F.col("e.phase").isNull(), "other").otherwise("event")
    )
    made = read.select(*_KEYS, kind.alias("kind"), F.struct("e.record_type", "e.format", version.alias("version")).alias("header"), "e.trace_id", "e.sequence", "e.invocation_id", F.upper("e.phase").alias("phase"))
    held = cut(made, "lines")
    last = held.groupBy("file").agg(F.max(F.struct("start", "o")).alias("p")).select("file", "p.start", "p.o", F.lit(True).alias("last"))
    # by file and place: the lines of a large file stay spread
    marked = held.where("kind = 'broken'").join(last, _KEYS, "left").where("last").select(*_KEYS, F.lit(True).alias("torn"))
    return held.join(F.broadcast(marked), _KEYS, "left").withColumn("kind", F.when(F.col("torn"), "torn").otherwise(F.col("kind"))).drop("torn").where("kind <> 'empty'")


def trace_heads(lines: DataFrame) -> DataFrame:
    """file, header, trace_id (the header's, or the first event's), headed, torn, events of each file."""
    place = F.struct("start", "o")
    event = F.col("kind") == "event"
    return lines.groupBy("file").agg(
        F.min_by(F.struct("kind", "header", "trace_id"), place).alias("first"), F.min_by(F.when(event, F.col("trace_id")), F.when(event, place)).alias("event_id"),
        F.bool_or(F.col("kind") == "torn").alias("torn"), F.count_if(event).alias("events"),
    ).select("file", F.col("first.header").alias("header"), (F.col("first.kind") == "header").alias("headed"), F.coalesce(F.when(F.col("first.kind") == "header", F.col("first.trace_id")), "event_id").alias("trace_id"), "torn", "events")


def _sequences(lines: DataFrame) -> DataFrame:
    """Events whose sequence isn't above the one before, with that one. Lines are compared inside their split; the
    first of a split with the last of the splits before it."""
    events = lines.where("kind = 'event'").select(*_KEYS, "sequence")
    inside = Window.partitionBy("file", "start").orderBy("o")
    paired = events.withColumn("before", F.lag("sequence").over(inside)).withColumn("first", F.row_number().over(inside) == 1)
    ends = events.groupBy("file", "start").agg(F.max_by("sequence", "o").alias("last"))
    carried = ends.select("file", "start", F.lag("last").over(Window.partitionBy("file").orderBy("start")).alias("carried"))
    met = paired.where("first").join(carried, ["file", "start"]).select(*_KEYS, "sequence", F.coalesce("carried", F.lit(0).cast("long")).alias("before"))
    return paired.where("not first").select(*_KEYS, "sequence", "before").unionByName(met).where("sequence <= before")


def _lives(lines: DataFrame) -> DataFrame:
    """file, invocation_id, problem, n, start, o: what is wrong with an invocation's starts and ends."""
    place, started = F.struct("start", "o"), F.col("phase") == "STARTED"
    life = lines.where("kind = 'event'").groupBy("file", "invocation_id").agg(
        F.count_if(started).alias("starts"), F.count_if(~started).alias("ends"), F.min(F.when(started, place)).alias("s"), F.max(F.when(started, place)).alias("s2"),
        F.min(F.when(~started, place)).alias("t"), F.max(F.when(~started, place)).alias("t2"),
    )
    early = (F.col("ends") > 0) & (F.col("s").isNull() | (F.col("t") < F.col("s")))
    found = F.array(
        F.when(F.col("starts") > 1, F.struct(F.lit("repeated start").alias("problem"), (F.col("starts") - 1).alias("n"), F.col("s2").alias("p"))),
        F.when(early, F.struct(F.lit("end without a start").alias("problem"), F.lit(1).cast("long").alias("n"), F.col("t").alias("p"))),
        F.when(F.col("ends") > 1, F.struct(F.lit("repeated end").alias("problem"), (F.col("ends") - 1).alias("n"), F.col("t2").alias("p"))),
    )
    return life.select("file", "invocation_id", F.inline(F.array_compact(found))).select("file", "invocation_id", "problem", "n", "p.start", "p.o")


def problems_of(lines: DataFrame, form: str | None = None, headed: bool = False) -> DataFrame:
    """file, trace_id (the file's), problem, invocation_id, n, start, o: everything that makes a scanned file invalid; n
    counts what is of one kind and place is that of one of them (of the first, where it stands for a line). ``form``:
    the format that headers must name; ``headed``: a file without a header is invalid."""
    heads = trace_heads(lines)
    none = F.lit(None).cast("string")
    one = F.lit(1).cast("long").alias("n")
    at = lambda problem, rows: rows.select("file", F.lit(problem).alias("problem"), none.alias("invocation_id"), one, "start", "o")
    top = heads.select("file", "headed", "header", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("o"))
    wrong = F.when(~F.col("headed"), F.lit("no header" if headed else None)).when(F.coalesce("header.version", F.lit(VERSION)) != VERSION, "unknown version")
    if form is not None:
        wrong = F.coalesce(wrong, F.when(F.col("headed") & ~F.col("header.format").eqNullSafe(F.lit(form)), "unknown format"))
    first = lines.groupBy("file").agg(F.min(F.struct("start", "o")).alias("p")).select("file", "p.start", "p.o")
    later = lines.where("kind = 'header'").join(first, _KEYS, "left_anti")
    ids = lines.where("kind = 'event'").groupBy("file", "trace_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start", "o")).alias("p"))
    mixed = ids.join(heads.select("file", F.col("trace_id").alias("own")), "file").where("trace_id <> own").select("file", F.lit("mixed trace ids").alias("problem"), none.alias("invocation_id"), "n", "p.start", "p.o")
    steps = _sequences(lines)
    found = (
        top.withColumn("problem", wrong).where("problem is not null").select("file", "problem", none.alias("invocation_id"), one, "start", "o")
        .unionByName(at("line is no JSON", lines.where("kind = 'broken'"))).unionByName(at("line is no event", lines.where("kind = 'other'"))).unionByName(at("header within the events", later))
        .unionByName(mixed).unionByName(at("repeated sequence", steps.where("sequence = before"))).unionByName(at("falling sequence", steps.where("sequence < before")))
        .unionByName(_lives(lines).select("file", "problem", "invocation_id", "n", "start", "o"))
    )
    return found.join(heads.select("file", "trace_id"), "file").select("file", "trace_id", "problem", "invocation_id", "n", "start", "o")


def trace_problems(spark: SparkSession, folder: str, form: str | None = None, headed: bool = False) -> DataFrame:
    """``problems_of`` all files of a folder."""
    return problems_of(scan(spark, folder), form, headed)


def read_valid(spark: SparkSession, folder: str, form: str | None = None, headed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The events of a folder's trace files, with their file and place, and the files' heads; any problem is an error
    at once that names the first."""
    lines = scan(spark, folder)
    first = problems_of(lines, form, headed).orderBy("file", "start", "o", "problem").first()
    if first is not None:
        raise ValueError(f"{first['file']}, split {first['start']}: {first['problem']}" + (f" of {first['invocation_id']}" if first["invocation_id"] else ""))
    return lines.where("kind = 'event'").drop("kind", "header"), trace_heads(lines)
