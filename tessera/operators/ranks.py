"""Exact statistics of groups of any size: values with their counts and ranks, spread over tasks by value range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut

_SHARE = "_share"
#: different values of a group that one task ranks
LARGE = 1 << 20


def ranked_values(rows: DataFrame, group: list[str], value: Column, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per group and different value: ``x``, ``n`` rows that hold it, ``before`` (the group's rows of lesser
    values), and the group's ``valid`` rows and ``mean``. Rows without a value count in no rank; their x is null.
    ``sums`` are aggregates to take along, by name.

    Rows are counted before they move, and the counts are stored, so ``rows`` is read once. A group of at most ``LARGE``
    different values is ranked by a window of its own; one with more by ranges of its values, so that it fills many
    tasks, none in memory. Both ways give the same rows.
    """
    return ranked_counts(rows.groupBy(*group, value.alias("x")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in (sums or {}).items()]), group)


def ranked_counts(counts: DataFrame, group: list[str]) -> DataFrame:
    """``ranked_values`` of values that are counted: x, n and what was taken along, once per group and value."""
    counts = cut(counts, "counts")
    sizes = counts.groupBy(*group).agg(F.count(F.lit(1)).alias(_SHARE)).where(F.col(_SHARE) > LARGE).drop(_SHARE)
    if not group:
        return _by_ranges(counts, []) if counts.limit(LARGE + 1).count() > LARGE else _by_window(counts, [])
    large = cut(sizes, "large")
    if large.isEmpty():
        return _by_window(counts, group)
    same = [counts[g].eqNullSafe(large[g]) for g in group]
    return _by_window(counts.join(large, same, "left_anti"), group).unionByName(_by_ranges(counts.join(large, same, "left_semi"), group))


def _by_window(counts: DataFrame, group: list[str]) -> DataFrame:
    whole = Window.partitionBy(*group)
    valid = F.when(F.col("x").isNotNull(), F.col("n"))
    lower = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(valid).over(whole), F.lit(0))
    return counts.withColumns({"valid": total, "before": F.coalesce(F.sum(valid).over(lower), F.lit(0)), "mean": F.try_divide(F.sum(valid * F.col("x")).over(whole), total)})


def _by_ranges(counts: DataFrame, group: list[str]) -> DataFrame:
    """The counts are sorted over all tasks by group and value, and the rank that a range starts with comes from the
    ranges' totals."""
    ranges = counts.repartitionByRange(*group, "x").withColumn(_SHARE, F.struct(*group, F.spark_partition_id().alias("range")))
    ranges = cut(ranges, "ranges")
    valid = F.when(F.col("x").isNotNull(), F.col("n"))
    totals = ranges.groupBy(_SHARE).agg(F.coalesce(F.sum(valid), F.lit(0)).alias("_n"), F.sum(valid * F.col("x")).alias("_s"))
    whole = Window.partitionBy(*[F.col(_SHARE)[g] for g in group])
    lower = whole.orderBy(F.col(_SHARE)["range"]).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(_SHARE, F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("valid"), F.sum("_s").over(whole).alias("_sum"))
    inside = Window.partitionBy(_SHARE).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum(valid).over(inside), F.lit(0))
    return ranges.join(starts, _SHARE).withColumns({"before": before, "mean": F.try_divide("_sum", "valid")}).drop(_SHARE, "_start", "_sum")


def count(where: Column | None = None) -> Column:
    """Aggregate of ``ranked_values``: rows with a value, or those of them that meet a condition on x."""
    met = F.col("x").isNotNull() if where is None else where
    return F.coalesce(F.sum(F.when(met, F.col("n"))), F.lit(0))


def missing() -> Column:
    """Aggregate of ``ranked_values``: rows without a value."""
    return count(F.col("x").isNull())


def mean() -> Column:
    return F.max("mean")


def quantile(p: float) -> Column:
    """Aggregate of ``ranked_values``: the p-quantile, between two values in proportion."""
    place = (F.col("valid") - 1) * F.lit(p)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("x")))

    low, high = at(F.floor(place)), at(F.ceil(place))
    return low + (high - low) * F.max(place - F.floor(place))


def deviation() -> Column:
    """Aggregate of ``ranked_values``: the population deviation, from squares around the mean."""
    away = F.when(F.col("x").isNotNull(), F.col("n") * (F.col("x") - F.col("mean")) ** 2)
    return F.sqrt(F.try_divide(F.sum(away), F.max("valid")))
