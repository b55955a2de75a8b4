"""Operator 8: allow and block rules for urls by a sort-merge range join, in DataFrame operations only.

A host's canonical key is its labels reversed, each ended by a dot (``www.example.com`` is
``com.example.www.``). A rule's host and its subdomains are then the keys of one interval, from ``com.``
to just before ``com/`` (the slash follows the dot), and rules' intervals nest. Their ends cut the key
space into segments, each with the stack of rules that are active in it. Different hosts of the urls and
the segments' starts are sorted together by range; in a sweep each host takes the stack of the last start
before it, and the first rows of a range take what the ranges before it leave. Urls join their host's
stack, keep the rules whose path starts theirs, and the longest wins (host and path together; ties go to
the smaller rule string).

Only different hosts are sorted, so a very common host costs one row; the carried stacks are one row per
range. A url that no rule fits gets ``default``.

Edge cases: null url, or one without ``://``: host and path are empty and no rule fits. Repeated rows get
equal verdicts, null page_ids stay null, other columns aren't read, an empty table gives no rows. An empty
host has the key ``.``. Hosts may be of any length. No rules: every url gets ``default``. Equal rules
given twice with different verdicts: block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
RULE_SCHEMA = "rule_host string, rule_path string, verdict string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def segments(rules: DataFrame) -> DataFrame:
    """key, stack: the start of each segment and the rules (host, path, verdict) that hold in it."""
    hosts = (
        rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
        .groupBy(host_key(F.col("rule_host")).alias("key")).agg(F.collect_list(F.struct("rule_host", "rule_path", "verdict")).alias("own"))
    )
    # the rules that hold where a rule's host begins are those of its host and of the hosts above it
    labels = F.split(F.rtrim(F.col("key"), F.lit(".")), r"\.")
    above = hosts.select("key", "own", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("depth")).withColumn("up", F.concat(F.array_join(F.slice(labels, F.lit(1), F.col("depth")), "."), F.lit(".")))
    chain = above.join(hosts.select(F.col("key").alias("up"), F.col("own").alias("held")), "up")
    begin = chain.groupBy("key").agg(F.flatten(F.collect_list("held")).alias("stack"))
    # where it ends, those of the hosts above it alone
    outer = chain.where("up <> key").groupBy("key").agg(F.flatten(F.collect_list("held")).alias("outer"))
    nothing = F.slice("stack", 1, 0)
    end = begin.join(outer, "key", "left").select(F.concat(F.rtrim(F.col("key"), F.lit(".")), F.lit("/")).alias("key"), F.coalesce("outer", nothing).alias("stack"))
    return begin.unionByName(end)


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, stack for each different host that some rule's interval holds."""
    starts = segments(rules).select("key", "stack", F.lit(None).cast("string").alias("host"))
    probes = hosts.select(host_key(F.col("host")).alias("key"), F.lit(None).cast(starts.schema["stack"].dataType).alias("stack"), "host")
    ranged = cut(starts.unionByName(probes).repartitionByRange("key").withColumn("range", F.spark_partition_id()), "ranged")
    left = ranged.where("stack is not null").groupBy("range").agg(F.max_by("stack", "key").alias("left"))
    ranges = ranged.select("range").distinct().join(left, "range", "left")
    carried = ranges.withColumn("carried", F.last("left", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("range", "carried")
    sweep = Window.partitionBy("range").orderBy("key", F.col("host").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("host is not null")
    return swept.join(carried, "range", "left").select("host", F.coalesce("active", "carried").alias("stack")).where(F.size("stack") > 0)


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url)."""
    urls = pages.select("page_id", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"))
    stacks = host_stacks(urls.select("host").distinct(), rules)
    met = urls.join(stacks, "host", "left")
    fitting = F.filter("stack", lambda r: F.col("path").startswith(r["rule_path"]))
    ranked = F.transform(fitting, lambda r: F.struct((-F.length(r["rule_host"]) - F.length(r["rule_path"])).alias("rank"), F.concat(r["rule_host"], r["rule_path"]).alias("rule"), r["verdict"].alias("verdict")))
    best = F.array_min(ranked)
    return met.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
