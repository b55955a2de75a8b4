"""Summaries of numeric, categorical and date columns, for a table or for each of its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import blank_to_null, finite, half_up
from tessera.operators import ranks
from tessera.operators.rowsets import numbered


def numeric_summary(rows: DataFrame, column: str, group: list[str] | None = None, threshold: float | None = None) -> DataFrame:
    """valid, missing, mean, median, quartiles, range and, with a threshold, hits; non-finite is missing."""
    ids = group or []
    quartiles = [half_up(ranks.quantile(p)).alias(name) for name, p in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))]
    measures = [ranks.count().alias("valid"), ranks.missing().alias("missing"), half_up(ranks.mean()).alias("mean"), *quartiles, F.min("x").alias("min"), F.max("x").alias("max")]
    if threshold is not None:
        measures.append(ranks.count(F.col("x") >= threshold).alias("hits"))
    out = ranks.ranked_values(rows, ids, finite(F.col(column))).groupBy(*ids).agg(*measures)
    return out if threshold is None else out.withColumn("hit_rate", half_up(F.try_divide("hits", "valid")))


def several_numeric(rows: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """``numeric_summary`` of several columns in one shuffle: rows are unpivoted first."""
    ids = group or []
    long = rows.select(*ids, *[F.col(c).cast("double") for c in columns]).unpivot(ids, columns, "column_id", "value")
    return numeric_summary(long, "value", [*ids, "column_id"])


def categories(rows: DataFrame, column: str, top: int = 10, group: list[str] | None = None) -> DataFrame:
    """The ``top`` values by count, then by value; blank text is missing. Each with its share of valid rows."""
    ids = group or []
    counts = rows.select(*ids, blank_to_null(F.col(column).cast("string")).alias("value")).where("value is not null").groupBy(*ids, "value").agg(F.count(F.lit(1)).alias("n"))
    if not ids:  # the top by a distributed sort with a limit, the totals as one row
        best = counts.orderBy(F.desc("n"), "value").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))
        totals = counts.agg(F.sum("n").alias("valid"), F.count(F.lit(1)).alias("distinct_values"))
        return best.join(F.broadcast(totals)).select("rank", "value", "n", half_up(F.col("n") / F.col("valid")).alias("fraction"), "distinct_values")
    return top_of(counts, ids, top).select(*ids, "rank", "value", "n", half_up(F.col("n") / F.col("valid")).alias("fraction"), "distinct_values")


def top_of(counts: DataFrame, group: list[str], top: int) -> DataFrame:
    """The ``top`` values of each group by count, then value, with the group's total (``valid``) and its number of values.
    ``counts``: group, value, n. Each task keeps ``top`` of a group before groups meet, and totals are sums with a map
    side, so a group of any number of values fits."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "value"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= top)
    totals = counts.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.sum("n").alias("valid"), F.count(F.lit(1)).alias("distinct_values"))
    return best.join(totals, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]).drop(*[f"_{g}" for g in group])


def with_other(rows: DataFrame, column: str, top: int) -> DataFrame:
    """Counts of the ``top`` values, of all other values together, and of missing ones."""
    counts = rows.groupBy(blank_to_null(F.col(column).cast("string")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.where("value is not null").orderBy(F.desc("n"), "value").limit(top).select("value", F.lit(True).alias("best"))
    label = F.when(F.col("value").isNull(), F.lit("(missing)")).when(F.col("best"), F.col("value")).otherwise(F.lit("(other)"))
    return counts.join(F.broadcast(best), "value", "left").groupBy(label.alias("bucket")).agg(F.sum("n").alias("n"))


def qc(rows: DataFrame, group: list[str], state: str, mean: str, n: str) -> DataFrame:
    """How an endpoint is measured: states, mean, median, population deviation, range, replicates."""
    x = F.when(F.col(state) == "VALUE", finite(F.col(mean)))
    other = F.count_if(F.coalesce(F.col(state) != "VALUE", F.lit(True)))
    sums = {"other": other, "replicates": F.sum(F.when(x.isNotNull(), F.col(n))), "counted": F.count(F.when(x.isNotNull(), F.col(n)))}
    return ranks.ranked_values(rows, group, x, sums).groupBy(*group).agg(
        ranks.count().alias("measured"),
        F.sum("other").alias("not_measured"),
        half_up(ranks.mean()).alias("mean"),
        half_up(ranks.quantile(0.5)).alias("median"),
        half_up(ranks.deviation()).alias("sd"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        half_up(F.try_divide(F.sum("replicates"), F.sum("counted"))).alias("mean_n"),
    )


def histogram(rows: DataFrame, column: str, group: list[str]) -> DataFrame:
    """Equal-width bins per group: clamp(ceil(sqrt(n)), 5, 30) of them, the largest value in the last."""
    x = rows.select(*group, finite(F.col(column)).alias("x")).where("x is not null")
    span = x.groupBy(*group).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.least(F.greatest(F.ceil(F.sqrt(F.count(F.lit(1)))), F.lit(5)), F.lit(30)).cast("int").alias("bins"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")), F.col("bins") - 1)).otherwise(F.lit(0)).cast("int")
    return x.join(span, group).groupBy(*group, "bins", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def measurement_dates(values: DataFrame, subject: str, first: str, last: str) -> DataFrame:
    """First and last measurement of each subject over all its endpoints; subjects without a date drop out."""
    out = values.groupBy(subject).agg(F.min(first).alias("first_measurement"), F.max(last).alias("last_measurement"), F.count(F.lit(1)).alias("endpoints"))
    return out.where("first_measurement is not null or last_measurement is not null")


def scaled(rows: DataFrame, column: str, group: list[str]) -> DataFrame:
    """``rows`` with ``scaled``: the column within its group's finite range, 0 to 1."""
    from tessera.functions.scalars import min_max_scaled

    span = rows.groupBy(*group).agg(F.min(finite(F.col(column))).alias("_low"), F.max(finite(F.col(column))).alias("_high"))
    return rows.join(span, group).withColumn("scaled", min_max_scaled(finite(F.col(column)), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def status_counts(rows: DataFrame, group: list[str], status: str, values: list[str]) -> DataFrame:
    """One count column for each status value."""
    counted: list[Column] = [F.count_if(F.col(status) == v).alias(v.lower()) for v in values]
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *counted)


def label_frequencies(rows: DataFrame, label: str, signature: str) -> DataFrame:
    """How often each signature stands at each label, with its share of the label's rows."""
    counts = rows.groupBy(label, signature).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_total"))
    return counts.join(totals, F.col(label).eqNullSafe(F.col("_label"))).withColumn("fraction", half_up(F.col("n") / F.col("_total"))).drop("_label", "_total")


def signature_summary(rows: DataFrame, kind: str, signature: str) -> DataFrame:
    """Per kind: its rows, and its signatures by falling frequency. Ranks are given range by range."""
    counts = rows.groupBy(kind, signature).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(F.col(kind).alias("_kind")).agg(F.count(F.lit(1)).alias("kind_total"))
    ranked = numbered(counts, [F.desc("n"), F.asc(signature)], "rank", [kind])
    return ranked.join(totals, F.col(kind).eqNullSafe(F.col("_kind"))).select(kind, signature, "n", "kind_total", F.col("rank").cast("int").alias("rank"))
