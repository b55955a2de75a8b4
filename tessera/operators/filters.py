"""Typed predicates over a table's columns. Each is a boolean column, never null."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import upper_bound


def _or_missing(test: Column, column: Column, include_missing: bool) -> Column:
    return F.coalesce(test, F.lit(False)) | (column.isNull() if include_missing else F.lit(False))


def in_range(column: Column, low: float | None = None, high: float | None = None, include_missing: bool = False) -> Column:
    """low <= value <= high; NaN is outside every range."""
    if low is None and high is None:
        raise ValueError("a range needs a bound")
    if low is not None and high is not None and low > high:
        raise ValueError("low is above high")
    test = ~F.isnan(column.cast("double"))
    if low is not None:
        test = test & (column >= low)
    if high is not None:
        test = test & (column <= high)
    return _or_missing(test, column, include_missing)


def in_categories(column: Column, values: Iterable[str], include_missing: bool = False) -> Column:
    values = list(values)
    if not values:
        raise ValueError("no category")
    return _or_missing(column.isin(values), column, include_missing)


def has_text(column: Column, text: str, case_sensitive: bool = False, include_missing: bool = False) -> Column:
    test = column.contains(text) if case_sensitive else F.contains(F.lower(column), F.lit(text.lower()))
    return _or_missing(test, column, include_missing)


def matches(column: Column, pattern: str, case_sensitive: bool = False, include_missing: bool = False) -> Column:
    return _or_missing(column.rlike(pattern if case_sensitive else f"(?i){pattern}"), column, include_missing)


def compares(value: Column, state: Column, operator: str, bound: float) -> Column:
    """A measured value against a bound: rows in another state than VALUE never match, NaN equals only
    itself and zeros of either sign differ."""
    d = value.cast("double")
    nan = F.isnan(d)
    if operator == "eq":
        same = nan if bound != bound else (d == bound)
        if bound == 0:
            same = same & (d.cast("string").startswith("-") == F.lit(math.copysign(1, bound) < 0))
        return F.coalesce((state == "VALUE") & same, F.lit(False))
    test = {"gt": d > bound, "gte": d >= bound, "lt": d < bound, "lte": d <= bound}[operator]
    return F.coalesce((state == "VALUE") & ~nan & test, F.lit(False))


def measured_between(date: Column, low: str | None = None, high: str | None = None, require_date: bool | None = None) -> Column:
    """Inclusive date bounds in UTC; a date-only upper bound covers its whole day. Without a date a row fails
    if one is required, which it is by default as soon as a bound is given."""
    required = (low is not None or high is not None) if require_date is None else require_date
    date, test = date.cast("timestamp_ntz"), F.lit(True)
    if low is not None:
        test = test & (date >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        bound, exclusive = upper_bound(high)
        test = test & ((date < bound) if exclusive else (date <= bound))
    return F.coalesce(test if not required else test & date.isNotNull(), F.lit(not required))


def region(chosen: Column, edited: Column, mode: str) -> Column:
    """How a set of edited places (array) lies to the chosen ones: inside, equal, touching, or any."""
    tests = {
        "editable": F.size(F.array_except(edited, chosen)) == 0,
        "exact": F.sort_array(F.array_distinct(edited)) == F.sort_array(F.array_distinct(chosen)),
        "vicinity": F.arrays_overlap(edited, chosen),
        "all": F.lit(True),
    }
    return F.coalesce(tests[mode], F.lit(False))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_id, missing, filled of each column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column_id"), (F.col("n") - F.col(f"c{i}")).alias("missing"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(columns)]))
    return counts.select(rows)


def first_candidate(sets: DataFrame, patterns: list[str], text: str) -> DataFrame:
    """The subject set that stands for ``text``: by the first id pattern that fits (``{}`` is the text), else
    by a name that contains it. Needs subject_set_id, name; one row at most."""
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        rank = F.when(F.lower("subject_set_id") == p.format(text.lower()), F.lit(i)).otherwise(rank)
    ranked = sets.withColumn("rank", F.coalesce(rank, F.when(has_text(F.col("name"), text), F.lit(len(patterns))))).where("rank is not null")
    return ranked.orderBy("rank", "subject_set_id").limit(1)


def fragment_sizes(key: Column, value: Column, total: Column, least_key: int = 1, least_value: int = 0, most_value: int | None = None, most_fraction: float = 1.0) -> Column:
    """Whether a cut leaves a key and a value of allowed sizes; the value has at most a fraction of the whole."""
    test = (key >= least_key) & (value >= least_value) & (value <= total * most_fraction)
    if most_value is not None:
        test = test & (value <= most_value)
    return F.coalesce(test, F.lit(False))


def within_limits(limits: dict[str, tuple[float | None, float | None]]) -> Column:
    """Whether every named column lies in its limits (low, high), either of which may be open."""
    test = F.lit(True)
    for name, (low, high) in limits.items():
        test = test & in_range(F.col(name), low, high)
    return test


def with_cuts(cut_count: Column, allowed: Iterable[int]) -> Column:
    """Whether a transform was made by an allowed number of cuts; all numbers, if none is named."""
    allowed = list(allowed)
    return F.coalesce(cut_count.isin(allowed), F.lit(False)) if allowed else F.lit(True)
