"""Stored pair analytics: runs with their pairs and statistics, looked up by id, paged and counted."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import finite, half_up
from tessera.operators.graphs import degrees, neighbours
from tessera.operators.rowsets import page
from tessera.sources.tables import save_artifact

#: the total order of each kind of row
ORDERS = {
    "transforms": ["-support", "transform_id"],
    "pairs": ["transform_id", "subject_a", "subject_b", "key"],
    "runs": ["endpoint_id", "run_id"],
}
LARGEST_PAGE = 500


def ordered(kind: str) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDERS[kind]]


def page_and_total(rows: DataFrame, kind: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the rows with their total count beside each; both come from the same predicate."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return page(rows, ordered(kind), offset, limit, LARGEST_PAGE).join(F.broadcast(total))  # one row


def pairs_of(pairs: DataFrame, subject: int | str | None = None, transform: str | None = None) -> DataFrame:
    """Pairs of a transform, and with the subject on either side."""
    if transform is not None:
        pairs = pairs.where(F.col("transform_id") == transform)
    return pairs if subject is None else pairs.where((F.col("subject_a") == subject) | (F.col("subject_b") == subject))


def lookup(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``wanted`` (one column of that name)."""
    return rows.join(wanted.select(column).distinct(), column, "left_semi")


def requested(values: DataFrame, request: DataFrame) -> DataFrame:
    """Values by (subject_id, endpoint_id) in the request's order (ordinal); a request that has no value is
    an error on use."""
    met = request.join(values, ["subject_id", "endpoint_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no value of "), F.col("subject_id").cast("string"), F.lit("/"), F.col("endpoint_id"))).cast("double")
    return met.withColumn("mean", F.when(F.col("mean").isNull(), missing).otherwise(F.col("mean")))


def with_fragments(stats: DataFrame, transforms: DataFrame) -> DataFrame:
    """Statistics with the values that their transform leads from and to."""
    return stats.join(transforms.select("transform_id", "cut_count", "from_value", "to_value").distinct(), "transform_id")


def run_counts(runs: DataFrame, pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Runs with their numbers of pairs and of statistics; a run may have none."""
    count = lambda df, n: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(n))
    met = runs.join(count(pairs, "pair_count"), "run_id", "left").join(count(stats, "stats_count"), "run_id", "left")
    return met.fillna(0, ["pair_count", "stats_count"])


def store_run_counts(runs: DataFrame, pairs: DataFrame, stats: DataFrame, path: str) -> DataFrame:
    """Write the runs with their counts to the artifact table at ``path``; rows of other runs there stay."""
    save_artifact(run_counts(runs, pairs, stats), path)
    return runs.sparkSession.read.parquet(path).withColumn("run_id", F.col("run_id").cast(runs.schema["run_id"].dataType))


def merged_capabilities(*sources: DataFrame) -> DataFrame:
    """Capabilities (name, priority, ...) where a later source takes the place of an earlier one's name."""
    tagged = None
    for i, s in enumerate(sources):
        t = s.withColumn("_source", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("_source"), F.desc("priority")))
    return tagged.withColumn("_r", last).where("_r = 1").drop("_r", "_source")


def most_measured(values: DataFrame, group: str, count: str, most: int = 80) -> DataFrame:
    """The subjects with most raw values of each endpoint, with their effective date (last, else first)."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(count), "subject_id"))
    dated = values.withColumn("effective_date", F.coalesce("last_measurement", "first_measurement"))
    return dated.withColumn("rank", rank).where(F.col("rank") <= most)


def _closest(met: DataFrame, most: int) -> DataFrame:
    """Neighbours (centre, other, degree, cv, ov) by how close both values are."""
    gap = half_up(F.abs(F.col("ov") - F.col("cv")))
    rank = F.row_number().over(Window.partitionBy("centre").orderBy(F.asc_nulls_last("gap"), F.desc("degree"), "other"))
    return met.withColumn("gap", gap).withColumn("rank", rank).where(F.col("rank") <= most).select("centre", "other", "degree", "gap", "rank")


def nearest_in_value(near: DataFrame, values: DataFrame, most: int) -> DataFrame:
    """Neighbours (centre, other, degree) by how close their value is to the centre's; measured ones first,
    then by degree and id."""
    v = values.select("node", finite(F.col("value")).alias("v"))
    return _closest(near.join(v.select(F.col("node").alias("centre"), F.col("v").alias("cv")), "centre", "left").join(v.select(F.col("node").alias("other"), F.col("v").alias("ov")), "other", "left"), most)


def neighbours_in_value(edges: DataFrame, values: DataFrame, most: int, once: bool = False) -> DataFrame:
    """``nearest_in_value`` of each node of ``values`` (node once, value) among its neighbours in the graph; degrees and values come to
    an edge together. ``once`` as in ``neighbours``."""
    v = values.select("node", finite(F.col("value")).alias("v"), F.lit(True).alias("wanted"))
    met = neighbours(edges, degrees(edges).select("node", "degree").join(v, "node", "left"), once).where("centre_wanted")
    return _closest(met.select("centre", "other", F.col("other_degree").alias("degree"), F.col("centre_v").alias("cv"), F.col("other_v").alias("ov")), most)


def column_roles(columns: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(column, role) from (name, type, meaning): identifier, structure, endpoint or field."""
    roles = []
    for name, kind, meaning in columns:
        low = name.lower()
        role = "structure" if meaning == "chemical_structure" or low in ("smiles", "structure") else "identifier" if meaning.endswith("_id") or low == "id" or low.endswith(("_id", "key")) else "endpoint" if kind in ("double", "float", "int", "bigint") else "field"
        roles.append((name, role))
    return roles


def counts_by(columns: list[tuple[str, str, str]]) -> dict[str, dict[str, int]]:
    """How many of the columns (name, type, meaning) have each role, type and meaning."""
    roles = column_roles(columns)
    return {"role": dict(Counter(r for _, r in roles)), "type": dict(Counter(t for _, t, _ in columns)), "meaning": dict(Counter(m for _, _, m in columns))}
