"""Sources and sinks: tab-separated datasets, packs, structure lists, artifacts by run, exports."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import base64_url, blank_to_null, one_line
from tessera.operators.rowsets import numbered
from tessera.sources.shared import cut, new_path

#: the files of a dataset folder and their columns
DATASET = {
    "endpoints": "endpoint_id string, name string, path string, datatype string, endpoint_type string, evaluation_mode string, unit string, scale string, domain_lower_bound double, domain_upper_bound double, description string",
    "subjects": "subject_id string, structure_id string, batch_id string, project string, series string, smiles string",
    "values": "subject_id string, endpoint_id string, state string, mean double, n int, raw_values string, first_measurement string, last_measurement string",
    "subject_sets": "subject_set_id string, name string, set_type string, subject_set_scope string, parent_set_id string, description string",
    "subject_set_memberships": "subject_set_id string, subject_id string",
}
#: columns that a dataset's files must have
REQUIRED = {
    "endpoints": ["endpoint_id", "name", "datatype"], "subjects": ["subject_id", "structure_id"], "values": ["subject_id", "endpoint_id", "state", "mean"],
    "subject_sets": ["subject_set_id", "name"], "subject_set_memberships": ["subject_set_id", "subject_id"],
}
#: JSON type of a pack's column
PACK_TYPES = {"number": "double", "integer": "long", "boolean": "boolean"}


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, required: list[str] | None = None) -> DataFrame:
    """A tab-separated file, or a folder of them, with a header each; columns are taken by name, those that it lacks are
    null unless they are ``required``: then that is an error."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    missing = [c for c in required or [] if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    if schema is None:
        return raw
    wanted = [c.strip().rpartition(" ") for c in schema.split(",")]
    return raw.select(*[(F.col(n).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, _, t in wanted])


def open_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five tables of a dataset folder. A table without one of its ``REQUIRED`` columns is an error at once, a
    (subject, endpoint) pair that repeats is one on use."""
    tables = {n: read_tsv(spark, f"{folder}/{n}.*tsv", s, REQUIRED[n]) for n, s in DATASET.items()}
    n = F.count(F.lit(1)).over(Window.partitionBy("subject_id", "endpoint_id"))
    repeated = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated value of "), F.col("subject_id"), F.lit("/"), F.col("endpoint_id"))).cast("int"))
    tables["values"] = tables["values"].withColumn("_n", n).withColumn("_n", repeated).where("_n is null").drop("_n")
    return tables


def open_pack(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The table and manifest of a pack: a folder, or an archive (``.zip``, ``.prismpack``) of one. Its schema file names
    each column's type and meaning."""
    if folder.endswith((".zip", ".prismpack")):
        folder = _unpacked(spark, folder)
    manifest = json.loads(spark.read.text(f"{folder}/*-pack.json", wholetext=True).first()[0])
    declared = json.loads(spark.read.text(f"{folder}/schema/dataframe.schema.json", wholetext=True).first()[0])
    columns = declared["columns"]
    table = read_tsv(spark, f"{folder}/data/dataframe.tsv", ", ".join(f"{c.get('id', c.get('name'))} {PACK_TYPES.get(c['type'], 'string')}" for c in columns))
    for c in columns:
        name = c.get("id", c.get("name"))
        table = table.withMetadata(name, {"semanticType": c.get("semanticType", ""), "role": c.get("role", "")})
    return table, manifest


def _unpacked(spark: SparkSession, path: str) -> str:
    """A shared folder with the pack files of an archive. A task opens the archive where it lies and reads its members a
    megabyte at a time, never whole; the lines of each member are written by Spark."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["path"]:
                fs, at = (pafs.LocalFileSystem(), "/" + at[5:].lstrip("/")) if at.startswith("file:") else pafs.FileSystem.from_uri(at)
                with fs.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
                    for name in archive.namelist():
                        if name.endswith(("/dataframe.tsv", "/dataframe.schema.json", "-pack.json")):
                            rows = io.TextIOWrapper(archive.open(name), "utf-8", newline="\n")
                            while part := rows.readlines(1 << 20):
                                yield pd.DataFrame({"name": name.rpartition("/")[2], "value": [x.rstrip("\r\n") for x in part]})

    read = cut(spark.read.format("binaryFile").load(path).select("path").mapInPandas(lines, "name string, value string"), "pack")
    folder = new_path(spark, "pack")
    for name, to in (("dataframe.tsv", "data/dataframe.tsv"), ("dataframe.schema.json", "schema/dataframe.schema.json"), ("-pack.json", "all-pack.json")):
        read.where(F.col("name").endswith(name)).select("value").coalesce(1).write.text(f"{folder}/{to}")
    return folder


def wide(values: DataFrame, ids: list[str], state: str = "state", mean: str = "mean") -> DataFrame:
    """One row per subject with a column per endpoint; only measured values show."""
    shown = F.first(F.when(F.col(state) == "VALUE", F.col(mean)), ignorenulls=True)
    return values.groupBy("subject_id").pivot("endpoint_id", ids).agg(shown)


def wide_terms(rows: DataFrame, subject: str, path: str, paths: list, columns: dict[str, str]) -> DataFrame:
    """One row per subject with the named columns of each path as ``<path>_<name>``; the least, if a path repeats."""
    return rows.groupBy(subject).pivot(path, paths).agg(*[F.min(c).alias(n) for n, c in columns.items()])


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """row (1, 2, ... over all files), structure, id from text lines: blanks and ``#`` comments go, tokens are split at
    white space, comma or semicolon, a file's first line is a header if it begins with ``smiles``, the id defaults to
    ``s`` and the row. Rows are numbered split by split, so no task sees all of them."""
    lines = cut(_lines(spark, path).where("trim(value) <> '' and not trim(value) like '#%'"), "lines")
    tokens = F.split(F.trim("value"), r"[\s,;]+")
    first = lines.groupBy("file").agg(F.min("place").alias("first"))
    rows = lines.join(first, "file").where(~((F.col("place") == F.col("first")) & (F.lower(tokens[0]) == "smiles")))
    split = ["file", F.col("place.start")]
    sizes = rows.groupBy("file", F.col("place.start").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy(*split).orderBy("place"))).withColumn("start", F.col("place.start"))
    numbered = own.join(sizes.select("file", "start", before.alias("before")), ["file", "start"]).withColumn("row", F.col("before") + F.col("own"))
    return numbered.select("row", tokens[0].alias("structure"), F.coalesce(F.get(tokens, F.lit(1)), F.concat(F.lit("s"), F.col("row").cast("string"))).alias("id"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, place (start of its split, order in it) of every text line."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("o")).alias("place"))


def tsv_lines(rows: DataFrame, columns: list[str], places: int = 4) -> DataFrame:
    """One text line per row: fields by tabs, doubles with fixed places, nulls empty, lists as URL-safe
    Base64 joined by ``|``."""

    def shown(name: str) -> Column:
        kind = rows.schema[name].dataType.simpleString()
        if kind in ("double", "float"):
            return F.when(F.col(name).isNull(), "").otherwise(F.printf(F.lit(f"%.{places}f"), F.col(name)))
        if kind == "array<string>":
            return F.coalesce(F.array_join(F.transform(name, lambda x: base64_url(x.cast("binary"))), "|"), F.lit(""))
        return one_line(F.col(name).cast("string"))

    return rows.select(F.concat_ws("\t", *[shown(c) for c in columns]).alias("value"))


def write_tsv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """``tsv_lines`` as a folder of files that ``read_tsv`` reads, gzipped if the path ends so; each has the header."""
    packed = {"compression": "gzip"} if path.endswith(".gz") else {}
    line = F.split("value", "\t")
    fields = tsv_lines(rows, columns).select(*[line[i].alias(c) for i, c in enumerate(columns)])
    fields.write.mode("overwrite").options(**packed).csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def unique_names(names: list[str]) -> list[str]:
    """Field names as column ids; a repeated one gets _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        clean = "".join(c if c.isalnum() else "_" for c in n.strip().lower()).strip("_") or "field"
        seen[clean] = seen.get(clean, 0) + 1
        out.append(clean if seen[clean] == 1 else f"{clean}_{seen[clean]}")
    return out


def save_artifact(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Replace the rows of the runs in ``rows`` and leave other runs as they are. Rows gather by run, and a run with many
    of them is split over tasks."""
    rows.hint("rebalance", run).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def open_artifact(spark: SparkSession, folder: str, tables: list[str]) -> dict[str, DataFrame]:
    """The named tables of an artifact folder; a missing one is an error at once."""
    found = {}
    for t in tables:
        try:
            found[t] = spark.read.parquet(f"{folder}/{t}")
        except Exception as e:
            raise FileNotFoundError(f"{folder} has no table {t}") from e
    return found


def export_selection(selection: DataFrame, subjects: DataFrame, values: DataFrame, endpoints: list[str]) -> DataFrame:
    """The chosen subjects with their fields and a column per endpoint, in the order of ``ordinal`` if the selection has one."""
    table = wide(values.where(F.col("endpoint_id").isin(endpoints)), endpoints)
    out = selection.join(subjects, "subject_id", "left").join(table, "subject_id", "left")
    return out.orderBy("ordinal") if "ordinal" in selection.columns else out


def safe_columns(names: list[str], prefix: str) -> dict[str, str]:
    """A column for each name: the prefix and the name in lower case, all but a-z and 0-9 as ``_``; clashes get _2, _3, ..."""
    seen: dict[str, int] = {}
    out = {}
    for n in names:
        safe = re.sub("[^a-z0-9]+", "_", (prefix + n).strip().lower()).strip("_") or "column"
        seen[safe] = seen.get(safe, 0) + 1
        out[n] = safe if seen[safe] == 1 else f"{safe}_{seen[safe]}"
    return out


def export_rows(selection: DataFrame, fields: DataFrame | None = None, values: DataFrame | None = None, endpoints: list[str] | None = None, dates: DataFrame | None = None, fragments: DataFrame | None = None, paths: list[str] | None = None) -> DataFrame:
    """The chosen subjects (subject_id) as a table of rows: their ``fields`` as field_ columns; first and last measurement
    and the number of measured endpoints (``dates``: subject_id, first_measurement, last_measurement, endpoints); one
    row for each of ``endpoints``, with its value's columns, empty where the subject has none; and for each of ``paths``
    the label, fragment_id and fragment_smiles of the subject's ``fragments`` (subject_id, path, ...). Names that clash
    are numbered."""
    out = selection
    if fields is not None:
        names = safe_columns(sorted(c for c in fields.columns if c != "subject_id"), "field_")
        out = out.join(fields.select("subject_id", *[F.col(n).alias(c) for n, c in names.items()]), "subject_id", "left")
    if dates is not None:
        out = out.join(dates.select("subject_id", F.col("first_measurement").alias("subject_first_measurement"), F.col("last_measurement").alias("subject_last_measurement"), F.col("endpoints").alias("subject_measurement_endpoint_count")), "subject_id", "left")
    if endpoints:
        asked = out.withColumn("endpoint_id", F.explode(F.array(*[F.lit(e) for e in endpoints])))
        out = asked.join(values.where(F.col("endpoint_id").isin(endpoints)), ["subject_id", "endpoint_id"], "left")
    if fragments is not None:
        bases = safe_columns(paths or [], "decomp_")
        made = fragments.groupBy("subject_id").agg(*[F.min(F.when(F.col("path") == p, F.col(n))).alias(f"{b}_{n}") for p, b in bases.items() for n in ("label", "fragment_id", "fragment_smiles")])
        out = out.join(made, "subject_id", "left")
    return out


def export_snapshot(spark: SparkSession, tables: dict[str, DataFrame], folder: str, about: dict | None = None) -> None:
    """Tables as Parquet in a new folder, then a manifest (JSON) that lists them: without it a snapshot isn't whole."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
    text = json.dumps({"version": 1, "tables": {n: t.schema.simpleString() for n, t in tables.items()}, **(about or {})}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest.json")


def open_snapshot(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and manifest of an exported snapshot."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json").first()[0])
    return open_artifact(spark, folder, list(manifest["tables"])), manifest


def with_ids(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` structures (id, structure) where those without an id get ``s`` and a number that goes on from the number of
    existing ones, in the order of their structures."""
    start = existing.count()
    none = numbered(new.where(blank_to_null(F.col("id")).isNull()), ["structure"])
    made = none.select(F.concat(F.lit("s"), (F.col("number") + start).cast("string")).alias("id"), "structure")
    return new.where(blank_to_null(F.col("id")).isNotNull()).select("id", "structure").unionByName(made)


def register(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Structures (id, structure) with ``new`` ones added; an id that exists already, or that ``new`` repeats, is an error
    on use, and so is a missing one."""
    # counted by id with a map side: an id that most rows repeat fits too
    ids = new.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("structure").alias("structure"))
    met = ids.join(existing.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    wrong = F.when(blank_to_null(F.col("id")).isNull(), F.lit("a structure has no id")).when(F.col("known"), F.concat(F.lit("structure id exists already: "), F.col("id"))).when(F.col("n") > 1, F.concat(F.lit("repeated structure id: "), F.col("id")))
    checked = met.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)))
    return existing.select("id", "structure").unionByName(checked.select("id", "structure"))

