"""Tables in the shape that graph and projection files have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graphs import degrees
from tessera.operators.rowsets import numbered

# fixed values: the columns of an edge file, in order
EDGE_COLUMNS = [
    "edge_id", "source_row_id", "target_row_id", "label", "relation_type", "similarity", "edge_source", "descriptor", "rank_a_to_b", "rank_b_to_a", "mutual_knn",
    "transform_id", "transform_text", "key_fragment", "from_fragment", "to_fragment", "cut_count", "delta", "value_a", "value_b", "key_idcode", "from_value_idcode", "to_value_idcode",
]


def edge_table(edges: DataFrame, prefix: str = "similarity-edge-") -> DataFrame:
    """Edges (source, target and any of the file's other columns) with all columns of an edge file; those that they lack
    are null. Edges are numbered by source and target."""
    named = numbered(edges, ["source", "target"]).withColumns({"edge_id": F.concat(F.lit(prefix), F.col("number").cast("string")), "source_row_id": F.col("source"), "target_row_id": F.col("target")})
    return named.select(*[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in EDGE_COLUMNS])


def node_table(rows: DataFrame, row_id: str, edges: DataFrame) -> DataFrame:
    """row_id, degree of every row, 0 without an edge."""
    return degree_table(rows, row_id, degrees(edges))


def degree_table(rows: DataFrame, row_id: str, degrees: DataFrame) -> DataFrame:
    """``node_table`` of degrees (node, degree) that are known."""
    met = rows.select(F.col(row_id).alias("row_id")).join(degrees.select(F.col("node").alias("row_id"), "degree"), "row_id", "left")
    return met.select("row_id", F.coalesce("degree", F.lit(0)).alias("degree"))
