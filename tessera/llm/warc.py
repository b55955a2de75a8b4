"""Operator 4: WARC archives, written from pages and read back by tasks that scan byte ranges.

Writing: payloads of at least ``least`` bytes that are equal share one ``response`` record, that of the
largest page_id; the others are ``revisit`` records that name it and hold no payload. Smaller payloads are
all responses. Each task writes one archive, a gzip member per record, under a name of its own, and the
archives of tasks that were committed are listed in a table; leftovers of failed attempts aren't.

Reading: each archive is dealt out in byte ranges. A task looks for the gzip magic in its range, takes a
candidate if its first bytes decode to a WARC version line and reads on from member to member; it owns the
records that start inside its range and reads past the end for the last one. A payload that does not match
its digest is an error.

Edge cases: null html is an empty payload. Null url: the record has no target (``about:blank``). A null
page_id is below all others; in a group without any page_id all are responses. Rows that repeat the largest
page_id of their group are all responses. A group that holds a large part of the pages isn't shuffled by its digest. Control characters in a url are percent-encoded. Other columns are
not read; no pages, no archives and no records. A very long payload is compressed and read in one piece.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import cut, new_path

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
RANGE_BYTES = 8 << 20
#: tasks that read archives, at most; each takes its ranges one after the other
READ_TASKS = 1 << 15
#: groups of equal payloads that hold more than this part of all grouped pages are broadcast: no more than so many can
HOT_GROUPS = 10_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _ident(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a response or revisit record."""
    block = HTTP + (b"" if refers_to is not None else payload)
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_ident(page_id)}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {RECORD_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_ident(refers_to)}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, at = pafs.FileSystem.from_uri(folder)
        path = f"{at}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                out.write(record := warc_record(row["page_id"], row["url"], row["payload"], row["refers_to"]))
                size, n = size + len(record), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return run


def write_warc(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``; returns path, bytes, records of each."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.concat(F.sha1("payload"), F.lit(":"), F.octet_length("payload").cast("string"))))
    groups = cut(keyed.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1"), "digests")
    common = F.col("n") * HOT_GROUPS > (groups.agg(F.sum("n")).first()[0] or 0)
    hot = groups.where(common).select("digest", F.col("largest").alias("hot_largest"), F.lit(True).alias("hot"))
    met = keyed.join(F.broadcast(hot), "digest", "left")
    # pages of common payloads, and those that take no part in revisits, have keys of their own, so they don't meet in one task
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "payload").cast("string"))
    met = met.withColumn("digest", F.when(F.col("hot").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(own))
    largest = F.coalesce("hot_largest", "largest")
    roles = met.join(groups.where(~common).select("digest", "largest"), "digest", "left").select("page_id", "url", "payload", F.when(~largest.eqNullSafe(F.col("page_id")), largest).alias("refers_to"))
    return cut(roles.mapInArrow(_write(folder), "path string, bytes long, records long"), "archives")


def _header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Source:
    """Bytes of a file, read on in chunks from any place."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data = file, start, bytearray()

    def fill(self, upto: int) -> bool:
        """Hold the bytes before offset ``upto``, if the file has them."""
        while self.base + len(self.data) < upto:
            more = self.file.read_at(CHUNK, self.base + len(self.data))
            if not more:
                return False
            self.data += more
        return True

    def drop(self, before: int) -> None:
        if before - self.base > CHUNK:
            del self.data[: before - self.base]
            self.base = before


def _member(source: Source, at: int) -> tuple[bytes, int] | None:
    """(content, next offset) of the gzip member at ``at``; None if none that begins like a record is there."""
    unpack, out, place, checked = zlib.decompressobj(31), [], at, False
    try:
        while not unpack.eof:
            if not source.fill(place + 1):
                return None
            piece = source.data[place - source.base : place - source.base + 65536]
            out.append(unpack.decompress(piece))
            place += len(piece)
            if not checked and sum(map(len, out)) >= 6:
                if not b"".join(out).startswith(b"WARC/1"):
                    return None
                checked = True
    except zlib.error:
        return None
    return (b"".join(out), place - len(unpack.unused_data)) if checked else None


def scan(file, start: int, end: int) -> Iterator[bytes]:
    """The records that start at offsets in [start, end)."""
    source, at, sure = Source(file, start), start, start == 0
    while at < end:
        if not source.fill(at + len(MAGIC)):
            return
        found = source.data.find(MAGIC, at - source.base)
        if found < 0:
            at = max(at + 1, source.base + len(source.data) - len(MAGIC) + 1)
            source.drop(at)
            continue
        at = source.base + found
        if at >= end:
            return
        member = _member(source, at)
        if member is None:
            if sure:
                raise ValueError(f"no whole record at offset {at}")
            at += 1
            continue
        content, at = member
        sure = True
        source.drop(at)
        yield content


def _parsed(content: bytes) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    h = _header(head)
    block = rest[: int(h["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
    return {
        "record_id": h["warc-record-id"].strip("<>"), "record_type": h["warc-type"], "target_uri": h["warc-target-uri"], "refers_to": h.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": digest, "payload_bytes": len(payload) if payload is not None else int(h["x-payload-length"]), "payload": payload,
    }


def _read(folder: str, with_payload: bool):
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(r["path"]) as file:
                    held, size = [], 0
                    for content in scan(file, r["start"], r["stop"]):
                        held.append(x := _parsed(content))
                        size += len(content)
                        if not with_payload:
                            x["payload"] = None
                        if len(held) >= 512 or with_payload and size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def read_warc(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the listed archives (path, bytes), read by byte ranges."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = archives.select("path", "bytes", F.explode(starts).alias("start")).select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("stop"))
    # a stated number of tasks: by the size of these rows, which only name the bytes to read, few would do
    tasks = min(ranges.count(), READ_TASKS) or 1
    return ranges.repartition(tasks, F.xxhash64("path", "start")).mapInArrow(_read(folder, with_payload), RECORD)


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read from its archive."""
    folder = new_path(spark, "warc")
    records = read_warc(write_warc(pages, folder, least), folder, with_payload=False)
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
