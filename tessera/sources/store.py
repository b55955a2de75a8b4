"""Artifacts of several tables by run, replaced in one commit: data in folders of their own, named by a manifest.

    <root>/data/<version and table>/...     written once, never changed
    <root>/_manifests/<number>.json         which folder holds a run's rows of a table

A commit writes the new rows of all its tables first and then one manifest; readers take the newest whole manifest. So a
failure between two tables leaves everything as it was, and a run that has no rows left in a table is gone from it. A
manifest is created exclusively: of two commits at once, one fails. Manifests list runs, not rows.

Tables may be clustered: the rows of a run are then written in sorted buckets of a key, so lookups by the key open one
bucket of it and joins of two tables clustered alike move no row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUN = "run_id"


class Conflict(RuntimeError):
    """Another commit took the number of this one."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    fs, at = _fs(spark, f"{root}/_manifests")
    if not fs.exists(at):
        return []
    names = [str(f.getPath().getName()) for f in fs.listStatus(at)]
    return sorted((int(n.removesuffix(".json")), n) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The newest whole manifest, or that of a version; an empty one where there is none. One that was cut off is no manifest."""
    for number, name in reversed(_manifests(spark, root)):
        if version is not None and number != version:
            continue
        fs, at = _fs(spark, f"{root}/_manifests/{name}")
        stream = fs.open(at)
        try:
            text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            if version is not None:
                raise
    if version is not None:
        raise FileNotFoundError(f"{root} has no version {version}")
    return {"version": 0, "tables": {}}


def _publish(spark: SparkSession, root: str, number: int, made: dict) -> None:
    fs, at = _fs(spark, f"{root}/_manifests/{number:010d}.json")
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "already exists" in str(e) or "FileAlreadyExists" in str(e):
            raise Conflict(f"version {number} of {root} exists already") from e
        raise
    try:
        out.write(bytearray(json.dumps(made, sort_keys=True).encode()))
    finally:
        out.close()


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], runs: Iterable[str], clusters: dict[str, tuple[str, int]] | None = None) -> int:
    """Replace the rows of ``runs`` in all ``tables`` (each with the column run_id) and give the new version. Rows of other
    runs in a table are an error. ``clusters``: tables whose rows are kept in so many sorted buckets of a key."""
    runs, before = [str(r) for r in runs], manifest(spark, root)
    number = max([before["version"], *(n for n, _ in _manifests(spark, root))]) + 1
    made = {name: {**t, "runs": {r: p for r, p in t["runs"].items() if r not in runs}} for name, t in before["tables"].items()}
    for name, rows in tables.items():
        strange = rows.where(~F.col(RUN).cast("string").isin(runs) | F.col(RUN).isNull()).limit(1)
        if not strange.isEmpty():
            raise ValueError(f"{name} has rows of other runs")
        key, buckets = (clusters or {}).get(name, (None, 0))
        entry = made.setdefault(name, {"runs": {}})
        entry |= {"schema": rows.schema.json(), "key": key, "buckets": buckets}
        folder = f"data/{number:010d}-{uuid.uuid4().hex}-{name}"
        if key is None:
            rows.withColumn("_run", F.col(RUN).cast("string")).write.partitionBy("_run").parquet(f"{root}/{folder}")
            held = {r["_run"] for r in spark.read.parquet(f"{root}/{folder}").select("_run").distinct().collect()} if _has_rows(spark, f"{root}/{folder}") else set()
            entry["runs"] |= {str(r): f"{folder}/_run={_escaped(spark, str(r))}" for r in held}
            continue
        for r in runs:
            own = rows.where(F.col(RUN).cast("string") == r)
            path = f"{root}/{folder}/{len(entry['runs'])}-{uuid.uuid4().hex}"
            sorted_rows = own.repartition(buckets, key).sortWithinPartitions(key)
            sorted_rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(f"tessera_{uuid.uuid4().hex}")
            if not spark.read.schema(rows.schema).parquet(path).isEmpty():
                entry["runs"][r] = path.removeprefix(f"{root}/")
    _publish(spark, root, number, {"version": number, "tables": made})
    return number


def _has_rows(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return any(str(f.getPath().getName()).startswith("_run=") for f in fs.listStatus(at))


def _escaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def runs_of(spark: SparkSession, root: str, table: str, version: int | None = None) -> list[str]:
    return sorted(manifest(spark, root, version)["tables"].get(table, {"runs": {}})["runs"])


def open_store(spark: SparkSession, root: str, required: Iterable[str] = ()) -> dict[str, DataFrame]:
    """All tables of the newest version, each with its runs; a required one that is missing is an error at once."""
    held = manifest(spark, root)["tables"]
    missing = [t for t in required if t not in held]
    if missing:
        raise FileNotFoundError(f"{root} has no table {', '.join(missing)}")
    return {t: open_table(spark, root, t) for t in held}


def open_table(spark: SparkSession, root: str, table: str, runs: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
    """A table's rows of the named runs (of all, without names): only their folders are read. A run that isn't there has
    no rows. With one run of a clustered table, Spark knows its buckets and their order."""
    held = manifest(spark, root, version)["tables"].get(table)
    if held is None:
        raise FileNotFoundError(f"{root} has no table {table}")
    schema = StructType.fromJson(json.loads(held["schema"]))
    paths = [f"{root}/{p}" for r, p in sorted(held["runs"].items()) if runs is None or r in {str(x) for x in runs}]
    if not paths:
        return spark.createDataFrame([], schema)
    if held["key"] is None or len(paths) > 1:
        return spark.read.schema(schema).parquet(*paths)
    name, key = f"tessera_{uuid.uuid4().hex}", held["key"]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {held['buckets']} BUCKETS LOCATION '{paths[0]}'")
    return spark.table(name)
