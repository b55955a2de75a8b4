"""The analytics' tables, made from the given star schema: entities, measured endpoints, records, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import table


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """Customers as entities: subject_id, series (market segment), group (nation), balance."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("series"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))


def values(spark: SparkSession, d: str) -> DataFrame:
    """Order totals per customer and priority as endpoint values: state, mean (whole units), n, first and last date.
    Single measurements count as not measured."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("endpoint_id"))
    made = o.agg(F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) + 0.5).cast("double").alias("mean"), F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_measurement"), F.max("o_orderdate").alias("last_measurement"))
    return made.withColumn("state", F.when(F.col("n") > 1, "VALUE").otherwise("NOT_MEASURED"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Fragment records: parts (subject) with their brand (value) in an order (key)."""
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_orderkey").alias("key"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("subject"), F.col("p_brand").alias("value"))
    return line.join(part, "subject").select("subject", F.lit(1).alias("cut_count"), "key", "value").distinct()


def part_values(spark: SparkSession, d: str, column: str = "p_retailprice") -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("subject"), F.col(column).cast("double").alias("value"))


def trace_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a trace: user (trace), millisecond, sequence, phase and the element that they touch."""
    e = table(spark, d, "events")
    phase = F.when(F.col("event_id") % 3 == 0, "STARTED").when(F.col("event_id") % 3 == 1, "COMPLETED").otherwise("FAILED")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("trace"), F.col("event_id").alias("sequence"), ms.alias("at_ms"), F.col("ts").alias("at"), phase.alias("phase"), "event_type", F.floor(F.col("event_id") / 3).alias("invocation"), "value")

__all__ = ["part_values", "records", "subjects", "table", "trace_events", "values"]
