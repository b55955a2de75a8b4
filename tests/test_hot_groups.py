"""Groups and keys that hold most rows: the same results as in one piece, dealt over many tasks."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import pairs, ranks, summaries
from tessera.operators.rowsets import in_ranges
from tessera.streaming import traces


def test_a_hot_key_fills_many_tasks(spark):
    """One key of 3,000 records in blocks of 200: all pairs once in each direction, over 120 pairs of blocks."""
    hot = spark.range(3000).select(F.col("id").alias("subject"), F.lit(1).alias("cut_count"), F.lit("hot").alias("key"), (F.col("id") % 7).cast("string").alias("value"))
    cold = spark.range(40).select(F.col("id").alias("subject"), F.lit(1).alias("cut_count"), F.concat(F.lit("k"), (F.col("id") % 10).cast("string")).alias("key"), (F.col("id") % 3).cast("string").alias("value"))
    both = hot.unionByName(cold)
    left, right = pairs.block_pairs(both, ["cut_count", "key"], pairs.large_keys(both, ["cut_count", "key"], 200))
    met = left.where("key = 'hot'").groupBy("_i", "_j").count().collect()
    assert len(met) == 15 * 16 // 2 and max(r["count"] for r in met) < 400
    mined = pairs.mine_pairs(both, block=200)
    n = Counter(i % 7 for i in range(3000))
    assert mined.where("key = 'hot'").count() == 3000 * 3000 - sum(v * v for v in n.values())
    assert mined.where("key = 'hot'").select("subject_a", "subject_b").distinct().count() == 3000 * 3000 - sum(v * v for v in n.values())
    one = pairs.mine_pairs(both.where("key <> 'hot'"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, mined.where("key <> 'hot'").collect()))


def test_a_subject_with_several_values_in_blocks(spark):
    rng = random.Random(3)
    rows = {(rng.randrange(60), 1, rng.choice(["a", None]), rng.choice("xyz")) for _ in range(300)}
    frame = spark.createDataFrame(sorted(rows, key=repr), "subject long, cut_count int, key string, value string")
    got = sorted((r.subject_a, r.from_value, r.subject_b, r.to_value) for r in pairs.mine_pairs(frame, block=9).collect())
    own = [r for r in rows if r[2] == "a"]
    assert got == sorted((a[0], a[3], b[0], b[3]) for a in own for b in own if a[0] != b[0] and a[3] != b[3])


def test_ranks_by_window_and_by_ranges_are_the_same(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), 1.0, rng.random(), rng.gauss(0, 5)]), "VALUE", rng.randrange(5)) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "g string, v double, state string, n int")

    def both():
        return [sorted(map(repr, x.collect())) for x in (summaries.numeric_summary(frame, "v", ["g"], 0.5), summaries.numeric_summary(frame, "v"), summaries.qc(frame, ["g"], "state", "v", "n"))]

    small = both()
    monkeypatch.setattr(ranks, "LARGE", 500)  # a is ranked by ranges, b and null by windows
    assert both() == small
    monkeypatch.setattr(ranks, "LARGE", 0)
    assert both() == small


@pytest.fixture
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, was)


def _hot_trace(spark):
    """Events of which one trace has most; times repeat, pause for long and are missing."""
    rng = random.Random(11)
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([0, 1, 50, 3000])
        rows.append(("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), i, None if i % 97 == 0 else at, rng.randrange(60)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "trace string, sequence long, at_ms long, rising long"), rows


def test_a_hot_trace_is_read_range_by_range(many_ranges):
    events, rows = _hot_trace(many_ranges)
    shown, batch, breaks = {}, {}, set()
    for t in ["hot", "a", "b", None]:
        total, last, n = 0, None, 0
        for _, i, at, _ in sorted((r for r in rows if r[0] == t), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            total += min(1200, at - last) if at is not None and last is not None else 0
            shown[i], batch[i], last, n = total, n // 25, at, n + 1
        own = sorted((r for r in rows if r[0] == t), key=lambda r: r[1])
        breaks |= {(b[1], a[3]) for a, b in zip(own, own[1:]) if b[3] <= a[3]}
    assert {r.sequence: r.shown_ms for r in traces.timeline(events, "trace", "at_ms", "sequence").collect()} == shown
    assert {r.sequence: r.batch for r in traces.batches(events, "trace", ["at_ms", "sequence"]).collect()} == batch
    assert {(r.sequence, r.before) for r in traces.sequence_breaks(events, "trace", "sequence", "rising").collect()} == breaks
    parts = in_ranges(events, ["sequence"], ["trace"]).where("trace = 'hot'").select("_part").distinct().count()
    assert parts > 1  # the hot trace did fill several


def test_medians_by_places_of_a_hot_transform(many_ranges):
    rng = random.Random(3)
    deltas = {"hot": [rng.randrange(50) / 4 for _ in range(301)], "even": [1.0, 2.0, 4.0, 8.0], "once": [1.0]}
    changes = many_ranges.createDataFrame([(t, x) for t, v in deltas.items() for x in v] + [("even", None)], "transform_id string, delta double")
    got = {r.transform_id: r for r in pairs.transform_stats_ranked(changes).collect()}
    assert {t: (r.support, r.median) for t, r in got.items()} == {"hot": (301, round(statistics.median(deltas["hot"]), 6)), "even": (4, 3.0)}
    assert all(abs(r.sd - statistics.pstdev(deltas[t])) < 1e-5 for t, r in got.items())


def test_ranked_stats_count_equal_deltas_before_they_move(spark, monkeypatch):
    sizes = []
    in_ranges = pairs.in_ranges
    monkeypatch.setattr(pairs, "in_ranges", lambda rows, *x: sizes.append(rows.count()) or in_ranges(rows, *x))
    deltas = [("a", 1.0)] * 500 + [("a", 3.0)] * 500 + [("b", 2.0)] * 3 + [("b", 5.0)] * 2 + [("c", 1.0)]
    got = {r.transform_id: tuple(r)[1:] for r in pairs.transform_stats_ranked(spark.createDataFrame(deltas, "transform_id string, delta double")).collect()}
    assert got == {"a": (1000, 2.0, 1.0), "b": (5, 2.0, 1.469694)} and sizes == [5]
