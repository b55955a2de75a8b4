"""Ordered, duplicate-free row sets (row_id, ordinal) and their algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.sources.shared import cut


def row_set(rows: DataFrame, row_id: str, order: Column) -> DataFrame:
    """Row ids with the place of their first occurrence in ``order``; the place is the order value itself,
    so no global numbering is needed."""
    return rows.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("row_id")).agg(F.min(order).alias("ordinal"))


def union(*sets: DataFrame) -> DataFrame:
    """Ids of any set. First come those of the first set in its order, then new ones of the second, ..."""
    tagged = reduce(DataFrame.unionByName, [s.select("row_id", F.struct(F.lit(i).alias("source"), "ordinal").alias("o")) for i, s in enumerate(sets)])
    return tagged.groupBy("row_id").agg(F.min("o").alias("o")).select("row_id", F.col("o.source").alias("source"), F.col("o.ordinal").alias("ordinal"))


def intersect(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Ids of all sets, in the first one's order."""
    return reduce(lambda a, b: a.join(b.select("row_id"), "row_id", "left_semi"), others, first)


def subtract(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Ids of the first set that no other has, in its order."""
    return reduce(lambda a, b: a.join(b.select("row_id"), "row_id", "left_anti"), others, first)


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 100, most: int = 1000) -> DataFrame:
    """Rows offset.. of a total order; a limit beyond ``most`` is an error, not a shorter page."""
    if offset < 0 or not 1 <= limit <= most:
        raise ValueError(f"offset must be 0 or more and limit 1..{most}")
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_in_groups(rows: DataFrame, group: list[str], order: list[Column], offset: int, limit: int) -> DataFrame:
    """The same page of every group."""
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def at_most(rows: DataFrame, limit: int, what: str) -> DataFrame:
    """The rows, stored, or an error if there are more than ``limit``: nothing is cut off silently. The rows are counted
    as they are written, so what makes them runs once."""
    seen = Observation()
    kept = cut(rows.observe(seen, F.count(F.lit(1)).alias("n")), "counted")
    if seen.get["n"] > limit:
        raise ValueError(f"more than {limit} {what}")
    return kept


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")


def hash_sample(rows: DataFrame, key: str, k: int, seed: int, group: list[str] | None = None) -> DataFrame:
    """The k rows (of each group) with the least SHA-256 of ``key|seed``: the same for any row order."""
    place = F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256), 1, 16)
    if not group:
        return rows.withColumn("place", place).orderBy("place", key).limit(k)
    return rows.withColumn("place", place).withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("place", key))).where(F.col("_r") <= k).drop("_r")


def hash_share(key: Column, seed: int, rate: float) -> Column:
    """Whether a row belongs to a share of about ``rate``: its SHA-256 of ``key|seed`` lies in that part of all hashes."""
    if not 0 <= rate <= 1:
        raise ValueError("a rate lies in 0..1")
    place = F.substring(F.sha2(F.concat_ws("|", key.cast("string"), F.lit(str(seed))), 256), 1, 8)
    return place < f"{int(rate * 2**32):08x}" if rate < 1 else F.lit(True)


def in_ranges(rows: DataFrame, order: list[str | Column], group: list[str]) -> DataFrame:
    """``rows``, stored, with ``_part``: their group and the range of the order that they stand in. A group of any size is
    dealt over many parts, which hold its rows one part after the other."""
    return cut(rows.repartitionByRange(*group, *order).withColumn("_part", F.struct(*group, F.spark_partition_id().alias("_range"))), "ranges")


def over_parts(group: list[str]) -> WindowSpec:
    """A window over the parts of ``in_ranges``, one row each, of a group in their order."""
    return Window.partitionBy(*[F.col("_part")[g] for g in group]).orderBy(F.col("_part")["_range"])


def numbered(rows: DataFrame, order: list[str | Column], name: str = "number", group: list[str] | None = None) -> DataFrame:
    """``rows`` with their place 1, 2, ... in a total order, of all rows or of their ``group``. Ranges of the order are
    numbered side by side; only their sizes meet in one task (of a group: the sizes of its ranges)."""
    ids = group or []
    ranges = in_ranges(rows, order, ids)
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = over_parts(ids).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_before"))
    own = ranges.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(before, "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
