"""Operator 3: media columns from archives, through a data source of our own.

Writing: a payload (a text's UTF-8 bytes, filled up with zero bytes to a positive multiple of ``WIDTH``)
becomes an 8-bit grey PNG, ``WIDTH`` samples wide, which is lossless; its unpadded length is a text chunk.
Each task stores its images in one zip archive under a name of its own; archives of committed tasks are
listed in a manifest table, so leftovers of failed attempts are never read.

Reading: the data source ``zip_media`` plans byte-range partitions over the archives of a manifest. A task
reads its archive's directory (at the end of the file), owns the members whose headers start in its range
and streams them through Arrow in batches of bounded bytes. Every member is fetched by its own offset and
checked against its checksum; one that fails is fetched again, alone, up to ``attempts`` times.

Edge cases: null text is empty: one row of zero samples. A null doc_id stays null. Repeated rows are members
of their own with equal media. Other columns aren't read. No documents: no archive, no partition, no rows.
A very long text is one tall image; it's held once as text and once as samples.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.shared import new_path

WIDTH = 64
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LENGTH_KEY = b"Payload-Length"
MEDIA = "archive string, member string, header_offset long, media binary"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (WIDTH if not raw else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(raw: bytes) -> bytes:
    """A grey image of the payload's bytes, one sample each; the same bytes give the same image."""
    samples = np.frombuffer(padded(raw), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), np.uint8)
    lines[:, 1:] = samples
    packed = zlib.compress(lines.tobytes(), 1)
    parts = [_chunk(b"IDAT", packed[i : i + (1 << 24)]) for i in range(0, len(packed), 1 << 24)]
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), _chunk(b"tEXt", LENGTH_KEY + b"\0" + str(len(raw)).encode()), *parts, _chunk(b"IEND", b"")])


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """(samples by rows, unpadded length) of an image that ``encode_png`` made."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, packed, shape, length = len(SIGNATURE), [], None, None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(LENGTH_KEY + b"\0"):
            length = int(body[len(LENGTH_KEY) + 1 :])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if shape is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0) or length is None:
        raise ValueError("not an image of 8-bit grey samples with a payload length")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:], length


def features(samples: np.ndarray) -> str:
    """Size, mean, spread, entropy and horizontal contrast of an image, as text."""
    flat = samples.reshape(-1)
    share = np.bincount(flat, minlength=256) / flat.size
    levels = np.arange(256)
    mean = float(share @ levels)
    spread = float(np.sqrt(max(0.0, share @ (levels - mean) ** 2)))
    used = share[share > 0]
    contrast = float(np.abs(np.diff(samples.astype(np.int16), axis=1)).mean())
    return f"{WIDTH}x{len(samples)};mean={mean:.3f};spread={spread:.3f};entropy={float(-(used * np.log2(used)).sum()):.4f};contrast={contrast:.3f}"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, at = pafs.FileSystem.from_uri(folder)
        path = f"{at}/part-{task.partitionId():06d}-{task.taskAttemptId()}.zip"
        out, archive, n = None, None, 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            for i in range(batch.num_rows):
                if archive is None:
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                name = "null" if ids[i].as_py() is None else str(ids[i].as_py())
                archive.writestr(zipfile.ZipInfo(f"{n:010d}_{name}.png", (1980, 1, 1, 0, 0, 0)), encode_png(texts[i].as_py() or b""))
                n += 1
        if archive is not None:
            archive.close()
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "members": pa.array([n], pa.int64())})

    return run


def write_media(docs: DataFrame, folder: str) -> str:
    """Archives of the images of ``docs`` (doc_id, text) in ``folder``; returns the manifest's path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    manifest = f"{folder}-manifest"
    rows.mapInArrow(_write(folder), "path string, bytes long, members long").write.parquet(manifest)
    return manifest


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.manifest = options["manifest"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[Range]:
        fs, at = pafs.FileSystem.from_uri(self.manifest)
        listed = pq.read_table(at, filesystem=fs, columns=["path", "bytes"]).to_pylist()
        return [Range(r["path"], a, min(a + self.range_bytes, r["bytes"])) for r in listed for a in range(0, r["bytes"], self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.manifest)
        with fs.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            own = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.stop]
        names, offsets, media, held = [], [], [], 0
        for m in own:
            media.append(fetch(fs, partition.path, m, self.attempts))
            names.append(m.filename)
            offsets.append(m.header_offset)
            held += len(media[-1])
            if held >= BATCH_BYTES:
                yield _batch(partition.path, names, offsets, media)
                names, offsets, media, held = [], [], [], 0
        if names:
            yield _batch(partition.path, names, offsets, media)


def _batch(path: str, names: list[str], offsets: list[int], media: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(names)), pa.array(names), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], names=["archive", "member", "header_offset", "media"])


_open: dict[str, object] = {}


def fetch(fs: pafs.FileSystem, path: str, member: zipfile.ZipInfo, attempts: int = 3) -> bytes:
    """A stored member's bytes by its offset; a failed read or checksum is tried again on a new handle."""
    for attempt in range(1, attempts + 1):
        try:
            if path not in _open:
                _open.clear()
                _open[path] = fs.open_input_file(path)
            file = _open[path]
            head = file.read_at(30, member.header_offset)
            if len(head) < 30 or head[:4] != b"PK\x03\x04":
                raise OSError("no member header")
            name, extra = struct.unpack_from("<HH", head, 26)
            body = file.read_at(member.compress_size, member.header_offset + 30 + name + extra)
            if len(body) != member.file_size or zlib.crc32(body) != member.CRC:
                raise OSError("checksum of member")
            return body
        except OSError as e:
            _open.clear()
            if attempt == attempts:
                raise OSError(f"{path}, {member.filename} at {member.header_offset}: {e}") from e
            time.sleep(0.2 * attempt)
    raise AssertionError


class ZipMedia(DataSource):
    """Members of the zip archives that a manifest table (path, bytes) lists."""

    @classmethod
    def name(cls) -> str:
        return "zip_media"

    def schema(self) -> str:
        return MEDIA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_media(spark: SparkSession, manifest: str, range_bytes: int = RANGE_BYTES, attempts: int = 3) -> DataFrame:
    """archive, member, header_offset, media of every member."""
    spark.dataSource.register(ZipMedia)
    return spark.read.format("zip_media").option("manifest", manifest).option("range_bytes", range_bytes).option("attempts", attempts).load()


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for member, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist()):
            samples, n = decode_png(media)
            payload = samples.tobytes()
            name = member.partition("_")[2].removesuffix(".png")
            rows.append((None if name == "null" else int(name), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in _DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def digests(media: DataFrame) -> DataFrame:
    """Digests and features of the payloads that the images of ``media`` hold."""
    return media.select("member", "media").mapInArrow(_digested, _DIGEST)


def round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every document's payload stored as an image, read back and digested."""
    return digests(read_media(spark, write_media(docs, new_path(spark, "media"))))
