"""Pivots of bucketed positions, fragment histograms and synthon tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import half_up
from tessera.operators import ranks
from tessera.operators.summaries import top_of

#: order of the buckets of a position
UNSUBSTITUTED, SUBSTITUENT, MULTIPLE, UNMATCHED = range(4)


def bucketed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with label and sort key of a position that holds a comma-separated list of substituents."""
    parts = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda x: F.trim(x) != "")
    label = F.when(F.col(column).isNull(), "(unmatched)").when(F.size(parts) == 0, "(none)").when(F.size(parts) == 1, F.trim(parts[0])).otherwise("(multiple)")
    key = F.when(F.col(column).isNull(), UNMATCHED).when(F.size(parts) == 0, UNSUBSTITUTED).when(F.size(parts) == 1, SUBSTITUENT).otherwise(MULTIPLE)
    return rows.withColumn(f"{column}_bucket", label).withColumn(f"{column}_key", key)


def one_dimension(rows: DataFrame, bucket: str, row_id: str, examples: int = 5) -> DataFrame:
    """bucket, size and the first row ids."""
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy(row_id))).where(F.col("_r") <= examples).groupBy(bucket).agg(F.sort_array(F.collect_list(row_id)).alias("first_rows"))
    return rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("size")).join(few, bucket)


def two_dimensions(rows: DataFrame, row_bucket: str, column_bucket: str, columns: list[str]) -> DataFrame:
    """Counts of row buckets by the named column buckets; 0 where nothing is."""
    return rows.groupBy(row_bucket).pivot(column_bucket, columns).agg(F.count(F.lit(1))).fillna(0)


def several_dimensions(rows: DataFrame, buckets: list[str], unmatched: str = "(unmatched)", keep_unmatched: bool = False) -> DataFrame:
    """composite key (joined by ``||``) and size; rows with an unmatched position only if asked for."""
    matched = reduce(lambda a, b: a & b, [F.col(b) != unmatched for b in buckets])
    kept = rows if keep_unmatched else rows.where(matched)
    return kept.groupBy(F.concat_ws("||", *buckets).alias("composite")).agg(F.count(F.lit(1)).alias("size"))


def context_diversity(rows: DataFrame, bucket: str, others: list[str], top: int = 3) -> DataFrame:
    """Per bucket and other position: how many different values stand there, and the most frequent."""
    long = rows.select(bucket, *others).unpivot([bucket], others, "position", "value").groupBy(bucket, "position", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_of(long, [bucket, "position"], top).where("distinct_values > 1")
    return ranked.select(bucket, "position", F.col("distinct_values").alias("values"), "rank", "value", "n")


def projection_table(rows: DataFrame, positions: list[str], others: list[str], row_id: str, examples: int = 3, keep_unmatched: bool = False) -> DataFrame:
    """One row per bucket of several positions, as a projection is exported: bucket_key, count, the first row ids joined
    by ``|``, type and label of each position's bucket (atom_1_type, atom_1_label, ...), whether all other positions
    agree in the bucket's rows (clean_matched_context), and how many of them don't."""
    types = F.array(*[F.lit(t) for t in ("unsubstituted", "substituent", "multiple", "unmatched")])
    made = reduce(bucketed, [*positions, *others], rows)
    if not keep_unmatched:
        made = made.where(reduce(lambda a, b: a & b, [F.col(f"{p}_key") != UNMATCHED for p in positions]))
    shown = [c for i, p in enumerate(positions, 1) for c in (F.element_at(types, F.col(f"{p}_key") + 1).alias(f"atom_{i}_type"), F.col(f"{p}_bucket").alias(f"atom_{i}_label"))]
    keys = [f"atom_{i}_{c}" for i in range(1, len(positions) + 1) for c in ("type", "label")]
    held = made.select(F.concat_ws("||", *[F.col(f"{p}_bucket") for p in positions]).alias("bucket_key"), *shown, F.col(row_id).alias("row_id"), *[F.col(f"{o}_bucket").alias(f"_o{i}") for i, o in enumerate(others)])
    first = F.row_number().over(Window.partitionBy("bucket_key", *keys).orderBy("row_id"))
    few = held.withColumn("_r", first).where(F.col("_r") <= examples).groupBy("bucket_key", *keys).agg(F.array_join(F.sort_array(F.collect_list("row_id")).cast("array<string>"), "|").alias("example_row_ids"))
    # a position differs in a bucket if its least and greatest values do
    differ = reduce(lambda a, b: a + b, [(F.min(f"_o{i}") != F.max(f"_o{i}")).cast("int") for i in range(len(others))], F.lit(0))
    counted = held.groupBy("bucket_key", *keys).agg(F.count(F.lit(1)).alias("count"), differ.alias("diverse_other_position_count"))
    return counted.join(few, ["bucket_key", *keys]).select("bucket_key", "count", "example_row_ids", *keys, (F.col("diverse_other_position_count") == 0).alias("clean_matched_context"), "diverse_other_position_count")


def fragment_summary(fragments: DataFrame, path: str, fragment: str) -> DataFrame:
    """Per path: occurrences, different fragments and those that occur once."""
    counts = fragments.groupBy(path, fragment).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(path).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_fragments"), F.count_if(F.col("n") == 1).alias("singletons"))


def fragment_histogram(fragments: DataFrame, fragment: str, structure: str, value: str | None = None) -> DataFrame:
    """Per fragment: different structures that hold it, and the statistics of their values."""
    once = fragments.select(fragment, structure, *([value] if value else [])).distinct()
    support = once.select(fragment, structure).distinct().groupBy(fragment).agg(F.count(structure).alias("support"))
    if not value:
        return support
    values = ranks.ranked_values(once, [fragment], F.col(value).cast("double"))
    measures = [ranks.count().alias("measured"), half_up(ranks.mean()).alias("mean"), half_up(ranks.quantile(0.5)).alias("median")]
    stats = values.groupBy(F.col(fragment).alias("_fragment")).agg(*measures)
    return support.join(stats, F.col(fragment).eqNullSafe(F.col("_fragment"))).drop("_fragment")


def synthons(rows: DataFrame, synthon: str, signature: str, source: str, order: str, most: int = 8) -> DataFrame:
    """Per synthon: occurrences, its signatures in order, and the first different sources."""
    first = rows.groupBy(synthon, source).agg(F.min(order).alias("o")).withColumn("_r", F.row_number().over(Window.partitionBy(synthon).orderBy("o", source))).where(F.col("_r") <= most)
    listed = first.groupBy(synthon).agg(F.sort_array(F.collect_list(F.struct("_r", source))).alias("s")).select(synthon, F.col(f"s.{source}").alias("first_sources"))
    counts = rows.groupBy(synthon).agg(F.count(F.lit(1)).alias("occurrences"), F.sort_array(F.collect_set(signature)).alias("signatures"))
    return counts.join(listed, synthon)


def replacement_classes(rows: DataFrame, environment: str, synthon: str) -> DataFrame:
    """Per environment: observations and the different synthons seen there."""
    return rows.groupBy(environment).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct(synthon).alias("synthons"))


def candidate_score(rows: DataFrame, candidate: list[str], structure: str, fraction: str, size: str, exits: str) -> DataFrame:
    """Support, mean explained fraction and a score that puts support first."""
    out = rows.groupBy(*candidate).agg(F.count_distinct(structure).alias("support"), half_up(F.avg(fraction)).alias("mean_fraction"), F.max(size).alias("size"), F.max(exits).alias("exits"))
    return out.withColumn("score", half_up(1000 * F.col("support") + 100 * F.col("mean_fraction") + 10 * F.col("size") + F.col("exits")))


def assembled(left: DataFrame, right: DataFrame, signature: str, key: str, k: int, seed: int) -> DataFrame:
    """Products of two sampled pools that share an attachment signature: the k hash-first of each side and
    signature, so a signature makes k * k products at most."""
    from tessera.operators.rowsets import hash_sample

    a = hash_sample(left, key, k, seed, [signature]).select(signature, F.col(key).alias("left_key"))
    b = hash_sample(right, key, k, seed + 1, [signature]).select(signature, F.col(key).alias("right_key"))
    return a.join(b, signature)
