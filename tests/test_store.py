"""Artifacts of several tables: one commit, runs that vanish, lookups that open one bucket."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import store


def rows(spark, run, n, extra=0):
    return spark.range(n).select(F.lit(run).alias("run_id"), F.concat(F.lit("t"), (F.col("id") % 20).cast("string")).alias("transform_id"), (F.col("id") + extra).alias("x"))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_failure_between_tables_leaves_the_old_run(spark, tmp_path):
    root = str(tmp_path)
    both = lambda a, b: {"pairs": a, "stats": b}
    assert store.commit(spark, root, both(rows(spark, "r1", 10).unionByName(rows(spark, "r/2", 4)), rows(spark, "r1", 3).unionByName(rows(spark, "r/2", 2))), ["r1", "r/2"]) == 1
    broken = rows(spark, "r1", 5).withColumn("x", F.raise_error(F.lit("cut off")).cast("long"))
    with pytest.raises(Exception, match="cut off"):
        store.commit(spark, root, both(rows(spark, "r1", 7), broken), ["r1"])
    assert store.open_table(spark, root, "pairs").where("run_id = 'r1'").count() == 10 and store.open_table(spark, root, "stats", ["r1"]).count() == 3
    with pytest.raises(ValueError, match="other runs"):
        store.commit(spark, root, both(rows(spark, "r3", 1), rows(spark, "r1", 1)), ["r1"])
    # r1 has fewer pairs and no statistics any more; the other run isn't touched
    assert store.commit(spark, root, both(rows(spark, "r1", 7), rows(spark, "r1", 0)), ["r1"]) == 2
    assert store.runs_of(spark, root, "stats") == ["r/2"] and store.runs_of(spark, root, "pairs") == ["r/2", "r1"]
    assert {r.run_id: r["count"] for r in store.open_table(spark, root, "pairs").groupBy("run_id").count().collect()} == {"r1": 7, "r/2": 4}
    assert store.open_table(spark, root, "stats", ["r1"]).count() == 0
    assert store.open_table(spark, root, "stats", ["r1"], version=1).count() == 3  # an old version stands
    assert set(store.open_store(spark, root, ["pairs", "stats"])) == {"pairs", "stats"}
    with pytest.raises(FileNotFoundError, match="universe"):
        store.open_store(spark, root, ["pairs", "universe"])


def test_commits_at_once_and_torn_manifests(spark, tmp_path):
    root = str(tmp_path)
    store.commit(spark, root, {"pairs": rows(spark, "r1", 2)}, ["r1"])
    with pytest.raises(store.Conflict):
        store._publish(spark, root, 1, {"version": 1, "tables": {}})
    (tmp_path / "_manifests" / "0000000002.json").write_text('{"version": 2, "tab')
    assert store.open_table(spark, root, "pairs").count() == 2
    assert store.commit(spark, root, {"pairs": rows(spark, "r1", 5)}, ["r1"]) == 3
    assert store.open_table(spark, root, "pairs").count() == 5


def test_clustered_tables_are_pruned_and_joined_in_place(spark, tmp_path):
    root = str(tmp_path)
    tables = {"pairs": rows(spark, "r1", 400), "stats": rows(spark, "r1", 20, 7).withColumnRenamed("x", "support")}
    store.commit(spark, root, tables, ["r1"], {"pairs": ("transform_id", 8), "stats": ("transform_id", 8)})
    pairs, stats = (store.open_table(spark, root, t, ["r1"]) for t in ("pairs", "stats"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")  # the plan names buckets only so; files are left out either way
    try:
        one = pairs.where("transform_id = 't3'")
        assert "SelectedBucketsCount: 1 out of 8" in plan(one) and one.count() == 20
        met = pairs.join(stats, "transform_id")
        assert "Exchange" not in plan(met) and "SortMergeJoin" in plan(met) and met.count() == 400
    finally:
        for n in names:
            spark.conf.unset(n)
