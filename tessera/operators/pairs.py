"""Matched pairs: records that share a constant key, directed changes of their values, and transform statistics.

A record is (subject, cut_count, key, value); two records of one key with different subjects and values
make a pair in each direction, and the change from one value to the other names its transform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import finite, half_up
from tessera.operators import ranks
from tessera.operators.rowsets import at_most, in_ranges, over_parts
from tessera.sources.shared import cut

#: pairs that must be decided before a direction can be tested
TESTABLE = 6
#: records of a key that one task pairs with each other
KEY_BLOCK = 4096


def transform_id(cut_count: Column, from_value: Column, to_value: Column) -> Column:
    return F.concat(cut_count.cast("string"), F.lit("|"), from_value, F.lit(">>"), to_value)


def large_keys(records: DataFrame, key: list[str], most: int) -> DataFrame:
    """Keys of more than ``most`` records, with the number of blocks of about that many that they are dealt into."""
    large = records.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    return large.select(*[F.col(c).alias(f"_{c}") for c in key], F.ceil(F.col("_n") / most).cast("int").alias("_blocks"))


def block_pairs(records: DataFrame, key: list[str], large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join on ``key`` whose ``large`` keys are dealt into blocks: (left, right), each ``records``
    with the columns ``_i`` and ``_j`` to join on too. Block pairs i <= j meet, each in a join key of its own, so every
    pair of records meets once, in one order or the other, and those within a block (i = j) in both. All other keys are
    one block."""
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    dealt = records.join(large, same, "left").drop(*[f"_{c}" for c in key]).withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64(*[c for c in records.columns if c not in key]), F.col("_blocks")).cast("int"))
    left = dealt.withColumn("_j", F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1))).withColumnRenamed("_b", "_i")
    right = dealt.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_b")))).withColumnRenamed("_b", "_j")
    return left.drop("_blocks"), right.drop("_blocks")


def mine_pairs(records: DataFrame, most_per_key: int | None = None, block: int = KEY_BLOCK) -> DataFrame:
    """Both directions of every pair. The records are stored once; the self-join keeps one order of each pair and
    the other is its mirror, so the join makes half the rows. A key with more than ``block`` records is joined block by block, so it fills as
    many tasks as it has pairs of blocks. By default all pairs are made; with ``most_per_key`` a key that may make more
    directed pairs is an error before any is made, never a cut."""
    r = cut(records.select("subject", "cut_count", "key", "value").distinct(), "records")
    if most_per_key is not None:
        at_most(r.groupBy("cut_count", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * (F.col("n") - 1) > most_per_key), 0, f"keys with {most_per_key} pairs")
    key = ["cut_count", "key"]
    large = cut(large_keys(r, key, block), "large")
    none = large.isEmpty()
    left, right = (r, r) if none else block_pairs(r, key, large)
    on, one_order = (key, F.col("subject_a") < F.col("subject_b")) if none else ([*key, "_i", "_j"], (F.col("_i") < F.col("_j")) | (F.col("subject_a") < F.col("subject_b")))
    a = left.select(*on, F.col("subject").alias("subject_a"), F.col("value").alias("from_value"))
    b = right.select(*on, F.col("subject").alias("subject_b"), F.col("value").alias("to_value"))
    met = a.join(b, on).where((F.col("subject_a") != F.col("subject_b")) & (F.col("from_value") != F.col("to_value")) & one_order)
    ends = F.array(*[F.struct(F.col(f"subject_{x}").alias("subject_a"), F.col(f"{u}_value").alias("from_value"), F.col(f"subject_{y}").alias("subject_b"), F.col(f"{w}_value").alias("to_value")) for x, u, y, w in (("a", "from", "b", "to"), ("b", "to", "a", "from"))])
    both = met.select("cut_count", "key", F.inline(ends))
    return both.withColumn("transform_id", transform_id(F.col("cut_count"), F.col("from_value"), F.col("to_value")))


def with_deltas(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs with value_a, value_b and delta; pairs without both finite values drop out."""
    v = values.select("subject", finite(F.col("value")).alias("v")).where("v is not null")
    left = v.select(F.col("subject").alias("subject_a"), F.col("v").alias("value_a"))
    right = v.select(F.col("subject").alias("subject_b"), F.col("v").alias("value_b"))
    return pairs.join(left, "subject_a").join(right, "subject_b").withColumn("delta", F.col("value_b") - F.col("value_a"))


def transform_stats(pairs: DataFrame, by: list[str] | None = None, least: int = 2) -> DataFrame:
    """Support, mean, exact median, population deviation, range and direction of each transform's deltas."""
    group, x = by or ["transform_id"], F.col("x")
    values = ranks.ranked_values(pairs.where("delta is not null"), group, F.col("delta").cast("double"))
    out = values.groupBy(*group).agg(
        ranks.count().alias("support"), half_up(ranks.mean()).alias("mean"), half_up(ranks.quantile(0.5)).alias("median"), half_up(ranks.deviation()).alias("sd"),
        half_up(F.min(x)).alias("min"), half_up(F.max(x)).alias("max"), ranks.count(x > 0).alias("up"), ranks.count(x < 0).alias("down"), ranks.count(x == 0).alias("tie"),
    )
    return out.where(F.col("support") >= least).withColumn("positive_fraction", half_up(F.col("up") / F.col("support")))


def transform_stats_ranked(pairs: DataFrame, least: int = 2) -> DataFrame:
    """The same median and deviation by the places of all rows and mergeable moments, as a check of ``transform_stats``.
    Equal deltas are counted before they move and the counts are stored, so the pairs are made once. Places are given range
    by range, and only middle rows meet their transform, so none is one task."""
    held = cut(pairs.where("delta is not null").groupBy("transform_id", "delta").agg(F.count(F.lit(1)).alias("n")), "deltas")
    ranges = in_ranges(held, ["delta"], ["transform_id"])
    before = ranges.groupBy("_part").agg(F.sum("n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(over_parts(["transform_id"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("n").over(Window.partitionBy("_part").orderBy("delta").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranges.withColumn("_own", own).join(before, "_part").select("transform_id", "delta", "n", (F.col("_before") + F.col("_own")).alias("last"))
    means = held.groupBy("transform_id").agg(F.sum("n").alias("support"), (F.sum(F.col("n") * F.col("delta")) / F.sum("n")).alias("mean")).where(F.col("support") >= least)
    away = F.sum(F.col("n") * (F.col("delta") - F.col("mean")) ** 2)
    moments = held.join(means, "transform_id").groupBy("transform_id", "support").agg(half_up(F.sqrt(away / F.col("support"))).alias("sd"))
    middles = moments.select("transform_id", F.explode(F.array(F.expr("(support + 1) div 2"), F.expr("(support + 2) div 2"))).alias("r"))
    at = (F.col("r") > F.col("last") - F.col("n")) & (F.col("r") <= F.col("last"))
    median = ranked.join(middles, "transform_id").where(at).groupBy("transform_id").agg(half_up(F.avg("delta")).alias("median"))
    return moments.join(median, "transform_id").select("transform_id", "support", "median", "sd")


def directions(stats: DataFrame) -> DataFrame:
    """Stats with the shares and tests of direction that follow from them."""
    decided = F.col("up") + F.col("down")
    return stats.withColumns({
        "negative_fraction": half_up(F.col("down") / F.col("support")), "tie_fraction": half_up(F.col("tie") / F.col("support")), "decided": decided,
        "majority": F.greatest("up", "down"), "testable": decided >= TESTABLE,
    })


def recommend(fragments: DataFrame, stats: DataFrame, direction: str = "up", limit: int = 50) -> DataFrame:
    """Transforms that start from a fragment of the query, best mean change first; one row per product."""
    tasks = fragments.join(stats, ["cut_count", "from_value"]).where(F.col("from_value") != F.col("to_value"))
    aim = {"up": F.desc("mean"), "down": F.asc("mean")}.get(direction)
    order = [aim, F.desc("support")] if aim is not None else [F.desc("support"), F.desc(F.abs("mean"))]
    by = [*order, F.asc("transform_id"), F.asc("key")]
    best = Window.partitionBy("query_id", "key", "to_value").orderBy(*by)
    one = tasks.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    return ranked.where(F.col("rank") <= limit)


def evidence(recommended: DataFrame, other_stats: DataFrame) -> DataFrame:
    """Recommendations with another run's statistics beside them, where it has any."""
    side = other_stats.select("transform_id", F.col("support").alias("other_support"), F.col("mean").alias("other_mean"), F.col("median").alias("other_median"))
    return recommended.join(side, "transform_id", "left")


def sorted_summary(stats: DataFrame, mode: str) -> list[Column]:
    """Order of a transform summary; nulls go last, then the transform's text."""
    absolute = F.coalesce(F.abs(F.col("median")), F.lit(-1.0))
    first = {"support_desc": [F.desc("support")], "median_delta_desc": [F.desc_nulls_last("median")], "median_delta_asc": [F.asc_nulls_last("median")], "abs_median_delta_desc": [absolute.desc()], "transform_text": []}[mode]
    return [*first, F.asc("transform_id")]


def transform_summary(pairs: DataFrame, examples: int = 3, least: int = 2) -> DataFrame:
    """Per transform: support, delta statistics and the first example pairs by (source, target). The pairs are stored
    once for both."""
    pairs = cut(pairs.select("transform_id", "subject_a", "subject_b", "key", "delta"), "pairs")
    sample = F.slice(F.sort_array(F.collect_list(F.struct("subject_a", "subject_b", "key"))), 1, examples)
    # examples are cut to a few per key first, so no list grows with a transform's support
    near = Window.partitionBy("transform_id").orderBy("subject_a", "subject_b", "key")
    few = pairs.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= examples).groupBy("transform_id").agg(sample.alias("examples"))
    return transform_stats(pairs, least=least).join(few, "transform_id")
