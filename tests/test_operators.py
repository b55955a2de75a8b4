"""Hand-sized cases of the analytics' operators."""

import json
import math
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as sc
from tessera.functions.predictions import Capability, Registry, needing_prediction, reference_predictor
from tessera.operators import artifacts, clusters, filters, graphs, pairs, pivots, ranks, rowsets, similarity, summaries
from tessera.sources import tables
from tessera.streaming import trace_files, traces


def test_pair_statistics_by_hand(spark):
    made = spark.createDataFrame([("t", 2.0), ("t", 4.0), ("u", 1.0), ("n", None)], "transform_id string, delta double")
    (row,) = pairs.transform_stats(made).collect()
    assert (row.transform_id, row.support, row["mean"], row["median"], row.sd, row["min"], row["max"], row.positive_fraction) == ("t", 2, 3.0, 3.0, 1.0, 2.0, 4.0, 1.0)


def test_every_pair_of_a_key_is_mined(spark):
    records = spark.range(500).select(F.format_string("c%03d", "id").alias("subject"), F.lit(1).alias("cut_count"), F.lit("k").alias("key"), F.format_string("v%03d", "id").alias("value"))
    assert pairs.mine_pairs(records).count() == 249_500


def test_same_subject_or_value_makes_no_pair(spark):
    records = spark.createDataFrame([("a", 1, "k", "x"), ("a", 1, "k", "y"), ("b", 1, "k", "x"), ("c", 2, "k", "z")], "subject string, cut_count int, key string, value string")
    got = {(r.subject_a, r.from_value, r.subject_b, r.to_value) for r in pairs.mine_pairs(records).collect()}
    assert got == {("a", "y", "b", "x"), ("b", "x", "a", "y")}


def test_value_comparisons_follow_ieee(spark):
    rows = spark.createDataFrame([(math.nan, "VALUE"), (-0.0, "VALUE"), (2.0, "VALUE"), (2.0, "MISSING"), (None, "VALUE")], "mean double, state string")
    count = lambda op, b: rows.where(filters.compares(F.col("mean"), F.col("state"), op, b)).count()
    assert [count("gt", 1.0), count("eq", 0.0), count("eq", -0.0), count("eq", math.nan), count("lte", 2.0)] == [1, 0, 1, 1, 2]


def test_ranges_and_missing(spark):
    rows = spark.createDataFrame([(7.2,), (6.1,), (None,), (math.nan,)], "x double")
    assert rows.where(filters.in_range(F.col("x"), low=7.0)).count() == 1
    assert rows.where(filters.in_range(F.col("x"), low=7.0, include_missing=True)).count() == 2
    with pytest.raises(ValueError):
        filters.in_range(F.col("x"), 2.0, 1.0)


def test_dates_cover_their_whole_day(spark):
    rows = spark.createDataFrame([("2025-03-01T23:59:59",), ("2025-03-02T00:00:00",), (None,)], "t string").withColumn("t", sc.day_start(F.col("t")))
    assert rows.where(filters.measured_between(F.col("t"), high="2025-03-01")).count() == 1
    assert rows.where(filters.measured_between(F.col("t"), high="2025-03-01", require_date=False)).count() == 2
    assert rows.where(filters.measured_between(F.col("t"))).count() == 3


def test_rounding_goes_up_at_halves(spark):
    r = spark.createDataFrame([(-5e-7,), (5e-7,), (1.2345675,)], "x double").select(sc.half_up(F.col("x")).alias("y")).collect()
    assert [x.y for x in r] == [0.0, 1e-6, 1.234568]


def test_rounding_keeps_what_has_no_such_places(spark):
    rows = [1e15, -1e300, float("inf"), float("-inf"), 123456789.1234565, None]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x double").select("i", sc.half_up(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [1e15, -1e300, float("inf"), float("-inf"), 123456789.123457, None]
    (nan,) = spark.range(1).select(sc.half_up(F.lit(float("nan"))).alias("y")).collect()
    assert nan.y != nan.y


def test_text_hash_matches_its_definition(spark):
    def expected(s):
        v = 0
        for c in s:
            v = (31 * v + ord(c)) & 0xFFFFFFFF
        return v - (1 << 32) if v >= 1 << 31 else v

    texts = ["", "a", "hello world", "zzzzzzzzzzzz"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(sc.text_hash(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [expected(t) for t in texts]


def test_piecewise_scores(spark):
    got = spark.createDataFrame([(4.0,), (6.5,), (9.0,), (None,)], "x double").select(sc.piecewise(F.col("x"), [(8.0, 1.0), (5.0, 0.0)]).alias("s")).collect()
    assert [r.s for r in got] == [0.0, 0.5, 1.0, None]


def test_row_set_algebra_keeps_first_order(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1)], "row_id string, ordinal int")
    b = spark.createDataFrame([("y", 0), ("z", 5)], "row_id string, ordinal int")
    order = lambda df: [r.row_id for r in df.orderBy(*[c for c in ("source", "ordinal") if c in df.columns]).collect()]
    assert order(rowsets.union(a, b)) == ["y", "x", "z"]
    assert order(rowsets.intersect(a, b)) == ["y"]
    assert order(rowsets.subtract(a, b)) == ["x"]


def test_limits_fail_closed(spark):
    rows = spark.range(5)
    assert rowsets.at_most(rows, 5, "rows").count() == 5
    with pytest.raises(ValueError):
        rowsets.at_most(rows, 4, "rows")
    with pytest.raises(ValueError):
        rowsets.page(rows, [F.asc("id")], 0, 1001)


def test_numeric_summary_skips_what_is_not_finite(spark):
    rows = spark.createDataFrame([(1.0,), (3.0,), (math.inf,), (math.nan,), (None,)], "x double")
    (r,) = summaries.numeric_summary(rows, "x").collect()
    assert (r.valid, r.missing, r["mean"], r["median"], r.q1, r.q3) == (2, 3, 2.0, 2.0, 1.5, 2.5)


def test_ranks_over_many_ranges_match_plain_statistics(spark):
    draw = np.random.default_rng(5)
    groups = {"hot": np.round(draw.normal(0, 50, 3000), 1), "flat": np.full(400, 2.5), "two": np.array([1.0, 4.0]), None: draw.normal(0, 1, 31)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("hot", None), ("empty", None), ("hot", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values = ranks.ranked_values(df, ["g"], summaries.finite(F.col("v"))).cache()
        got = {r.g: r for r in values.groupBy("g").agg(ranks.count().alias("valid"), ranks.missing().alias("gone"), ranks.mean().alias("m"), ranks.deviation().alias("sd"), *[ranks.quantile(p).alias(f"q{i}") for i, p in enumerate((0.0, 0.1, 0.5, 0.75, 1.0))]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, x in groups.items():
        assert (got[g].valid, got[g].gone) == (len(x), 2 if g == "hot" else 0)
        assert got[g].m == pytest.approx(x.mean()) and got[g].sd == pytest.approx(x.std(), abs=1e-12)
        assert [got[g][f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(x, [0, 0.1, 0.5, 0.75, 1])))
    assert (got["empty"].valid, got["empty"].gone, got["empty"].m, got["empty"].q2) == (0, 1, None, None)


def test_ranks_of_an_empty_table(spark):
    (r,) = summaries.numeric_summary(spark.createDataFrame([], "x double"), "x", threshold=1.0).collect()
    assert (r.valid, r.missing, r["mean"], r["median"], r.hits, r.hit_rate) == (0, 0, None, None, 0, None)


def test_endpoint_qc(spark):
    rows = spark.createDataFrame([("e", "VALUE", 1.0, 2), ("e", "VALUE", 3.0, 1), ("e", "NOT_MEASURED", None, 0)], "e string, state string, mean double, n int")
    (r,) = summaries.qc(rows, ["e"], "state", "mean", "n").collect()
    assert (r.measured, r.not_measured, r["mean"], r["median"], r.mean_n) == (2, 1, 2.0, 2.0, 1.5)


CHAIN = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11)]


def test_paths(spark):
    edges = spark.createDataFrame(CHAIN, "source long, target long")
    assert graphs.shortest_path(edges, 1, 5) == ("connected", [1, 2, 3, 4, 5])
    assert graphs.shortest_path(edges, 5, 1) == ("connected", [5, 4, 3, 2, 1])
    assert graphs.shortest_path(edges, 1, 5, 2)[0] == "max_depth_exceeded"
    assert graphs.shortest_path(edges, 1, 11)[0] == "no_path"
    assert graphs.shortest_path(edges, 1, 1) == ("same_row", [1])
    assert graphs.shortest_path(edges, 1, 77)[0] == "target_not_in_graph"
    assert graphs.shortest_path(edges, 76, 77)[0] == "rows_not_in_graph"


def test_components(spark):
    edges = spark.createDataFrame(CHAIN, "source long, target long")
    assert {(r.component, r["size"]) for r in graphs.component_sizes(edges).collect()} == {(1, 5), (10, 2)}


def greedy(ids, weight, sims):
    left, out = set(ids), {}
    while left:
        near = {a: [b for b in left if b != a and (min(a, b), max(a, b)) in sims] for a in left}
        mean = lambda a: math.floor(sum(sims[min(a, b), max(a, b)] for b in near[a]) / len(near[a]) * 1e6 + 0.5) / 1e6 if near[a] else 0.0
        best = min(left, key=lambda a: (-len(near[a]), mean(a), -weight[a], a))
        for b in [best, *near[best]]:
            out[b] = best
            left.discard(b)
    return out


def test_leader_clusters_equal_the_sequential_rule(spark):
    import random

    rng = random.Random(5)
    ids = list(range(60))
    sims = {(a, b): round(rng.uniform(0.8, 1.0), 3) for a in ids for b in ids if a < b and rng.random() < 0.07}
    weight = {i: rng.randrange(5) for i in ids}
    rows = spark.createDataFrame(list(weight.items()), "row_id long, weight int")
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "source long, target long, similarity double")
    got = {r.row_id: r.leader for r in clusters.leader_clusters(rows, edges).collect()}
    assert got == greedy(ids, weight, sims)


def test_cluster_summary(spark):
    c = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.9), (3, 1, 0.7), (4, 4, 1.0)], "row_id long, leader long, similarity double")
    (r,) = clusters.cluster_summary(c).collect()
    assert (r.leader, r["size"], r.min_similarity, r.mean_similarity) == (1, 3, 0.7, 0.8)


def test_mutual_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None)], "id long, v array<double>")
    got = {(r.source, r.target): (r.mutual, r.origin) for r in similarity.graph(v, "id", "v", "knn", 1).collect()}
    assert got == {(1, 2): (True, "knn"), (2, 3): (False, "knn")}


def test_similarity_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 5))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>")
    whole = sorted(similarity.graph(v, "id", "v", "hybrid", 3, 0.6).collect())
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 17)
    assert sorted(similarity.graph(v, "id", "v", "hybrid", 3, 0.6).collect()) == whole
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.floor(u @ u.T * 1e6 + 0.5) / 1e6
    above = {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.6}
    near = {(i, j) for i in range(120) for j in sorted((j for j in range(120) if j != i), key=lambda j: (-s[i, j], j))[:3]}
    assert {(r.source, r.target) for r in whole} == above | {(min(p), max(p)) for p in near}
    assert {(r.source, r.target) for r in whole if r.mutual} == {(i, j) for i, j in near if i < j and (j, i) in near}
    with pytest.raises(ValueError, match="edges"):
        similarity.graph(v, "id", "v", "hybrid", 3, 0.6, most_edges=5)


def test_a_key_beyond_the_limit_is_an_error(spark):
    records = spark.createDataFrame([(i, 1, "k", f"v{i}") for i in range(30)], "subject long, cut_count int, key string, value string")
    assert pairs.mine_pairs(records).count() == pairs.mine_pairs(records, 870).count() == 870
    with pytest.raises(ValueError, match="keys"):
        pairs.mine_pairs(records, 869)


def test_buckets(spark):
    rows = spark.createDataFrame([("a",), ("a, b",), ("",), (None,)], "r1 string")
    got = [tuple(r)[1:] for r in pivots.bucketed(rows, "r1").collect()]
    assert got == [("a", 1), ("(multiple)", 2), ("(none)", 0), ("(unmatched)", 3)]


def test_predictions(spark):
    registry = Registry()
    registry.register(Capability("b", "potency", reference_predictor, 1))
    registry.register(Capability("a", "potency", reference_predictor, 5))
    assert [c.name for c in registry.for_endpoint("potency")] == ["a", "b"]
    rows = spark.createDataFrame([("x", 1.0), (" ", None)], "smiles string, measured double")
    got = registry.predict(rows, "potency", "smiles").collect()
    assert got[1].potency_status == "FAILURE" and got[1].potency_value is None and got[0].potency_value is not None
    assert needing_prediction(rows.withColumn("p", F.lit(None).cast("double")), "measured", "p").count() == 1


def test_structure_lines(spark, tmp_path):
    (tmp_path / "s.smi").write_text("\nSMILES id\nCCO a1\n# no\nCCN;b2\nCCC\n")
    got = [(r.structure, r.id[:1]) for r in tables.read_structures(spark, str(tmp_path / "s.smi")).orderBy("row").collect()]
    assert got == [("CCO", "a"), ("CCN", "b"), ("CCC", "s")]


def test_structure_rows_are_numbered_over_files(spark, tmp_path):
    (tmp_path / "a.smi").write_text("smiles\n" + "\n".join(f"A{i}" for i in range(40)) + "\n")
    (tmp_path / "b.smi").write_text("SMILES;name\n\nB0\nB1 own\n")
    got = [tuple(r) for r in tables.read_structures(spark, str(tmp_path)).orderBy("row").collect()]
    assert got == [(i + 1, f"A{i}", f"s{i + 1}") for i in range(40)] + [(41, "B0", "s41"), (42, "B1", "own")]


def test_tables_come_back_from_their_files(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), i / 8, [f"ä|{i}", "x"] if i % 3 else []) for i in range(50)] + [("a\tb", None, None), ("", 2.0, [])], "s string, d double, l array<string>")
    for name in ("t", "t.gz"):
        tables.write_tsv(rows.repartition(5), str(tmp_path / name), ["s", "d", "l"])
        back = tables.read_tsv(spark, str(tmp_path / name), "s string, d double, l string", required=["s", "d"]).select("s", "d", sc.text_list(F.col("l")).alias("l")).collect()
        want = [(str(i), i / 8, [f"ä|{i}", "x"] if i % 3 else []) for i in range(50)] + [("a b", None, []), (None, 2.0, [])]
        assert sorted(map(repr, map(tuple, back))) == sorted(map(repr, want))
    with pytest.raises(ValueError, match="no column z"):
        tables.read_tsv(spark, str(tmp_path / "t"), "s string, z string", required=["z"])


def test_dataset_and_repeated_values(spark, tmp_path):
    for n, c in tables.DATASET.items():
        names = [x.strip().rpartition(" ")[0] for x in c.split(",")]
        rows = [["s1", "e1", "VALUE", "7.2", "3", "", "2025-01-01", ""]] if n == "values" else []
        (tmp_path / f"{n}.set.tsv").write_text("\n".join("\t".join(r) for r in [names, *rows]) + "\n")
    data = tables.open_dataset(spark, str(tmp_path))
    (v,) = data["values"].collect()
    assert (v.subject_id, v["mean"], v.n) == ("s1", 7.2, 3)
    assert tables.wide(data["values"], ["e1"]).collect()[0]["e1"] == 7.2
    with (tmp_path / "values.set.tsv").open("a") as f:
        f.write("s1\te1\tVALUE\t7.3\t3\t\t\t\n")
    with pytest.raises(Exception, match="repeated value"):
        tables.open_dataset(spark, str(tmp_path))["values"].collect()


def test_pack(spark, tmp_path):
    for d in ("data", "schema"):
        (tmp_path / d).mkdir()
    (tmp_path / "table-pack.json").write_text(json.dumps({"version": 1}))
    (tmp_path / "schema/dataframe.schema.json").write_text(json.dumps({"columns": [{"id": "compound_id", "type": "text", "semanticType": "compound_id"}, {"id": "pIC50", "type": "number", "semanticType": "endpoint_value"}]}))
    (tmp_path / "data/dataframe.tsv").write_text("compound_id\tpIC50\nC1\t7.2\nC2\t\n")
    table, manifest = tables.open_pack(spark, str(tmp_path))
    assert manifest["version"] == 1 and [r.pIC50 for r in table.orderBy("compound_id").collect()] == [7.2, None]
    assert table.schema["pIC50"].metadata["semanticType"] == "endpoint_value"


def test_artifact_replaces_its_runs_only(spark, tmp_path):
    path = str(tmp_path / "stats")
    tables.save_artifact(spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, x int"), path)
    tables.save_artifact(spark.createDataFrame([("r2", 3)], "run_id string, x int"), path)
    assert {(r.run_id, r.x) for r in spark.read.parquet(path).collect()} == {("r1", 1), ("r2", 3)}
    with pytest.raises(FileNotFoundError):
        tables.open_artifact(spark, str(tmp_path), ["stats", "pairs"])


def test_export_and_names(spark, tmp_path):
    rows = spark.createDataFrame([("a\tb", 1.5, ["x"]), (None, None, None)], "s string, d double, l array<string>")
    assert [r.value for r in tables.tsv_lines(rows, ["s", "d", "l"]).collect()] == ["a b\t1.5000\teA", "\t\t"]
    tables.write_tsv(rows, str(tmp_path / "out.gz"), ["s"])
    assert any(f.endswith(".gz") for f in os.listdir(tmp_path / "out.gz"))
    assert tables.unique_names(["Log D", "log-d", "?"]) == ["log_d", "log_d_2", "field"]


def test_exports_keep_their_order(spark):
    chosen = spark.createDataFrame([("c", 1), ("a", 2), ("b", 3)], "subject_id string, ordinal int")
    subjects = spark.createDataFrame([(x, x * 2) for x in "abc"], "subject_id string, name string")
    values = spark.createDataFrame([("a", "e", "VALUE", 1.0)], "subject_id string, endpoint_id string, state string, mean double")
    assert [(r.subject_id, r.e) for r in tables.export_selection(chosen, subjects, values, ["e"]).collect()] == [("c", None), ("a", 1.0), ("b", None)]


def test_a_broken_middle_line_is_an_error(spark, tmp_path):
    line = lambda i, phase="STARTED": json.dumps({"trace_id": "t", "sequence": i, "invocation_id": f"i{i}", "phase": phase})
    for name, text, error in (("middle", f'{line(1)}\n{{"trace\n{line(2)}\n', "no event"), ("version", f'{{"version": 2}}\n{line(1)}\n', "version"), ("second", f'{line(1)}\n{{"version": 1}}\n{line(2)}\n', "no event")):
        (tmp_path / f"{name}.jsonl").write_text(text)
        with pytest.raises(Exception, match=error):
            traces.read_traces(spark, str(tmp_path / f"{name}.jsonl")).collect()
    (tmp_path / "good.jsonl").write_text(f'{{"version": 1}}\n{line(1)}\n{line(2, "COMPLETED")}\n{line(2)}\n{{"torn')
    assert traces.read_traces(spark, str(tmp_path / "good.jsonl")).count() == 3
    assert {r.problem for r in trace_files.trace_problems(spark, str(tmp_path / "good.jsonl")).collect()} == {"repeated sequence", "end without a start"}


def test_registering_structures(spark):
    old = spark.createDataFrame([("s1", "C")], "id string, structure string")
    assert tables.register(old, spark.createDataFrame([("s2", "N")], "id string, structure string")).count() == 2
    with pytest.raises(Exception, match="exists already"):
        tables.register(old, old).collect()


def _events(spark):
    rows = [("t", 1, "i1", 0, "STARTED"), ("t", 2, "i1", 500, "COMPLETED"), ("t", 3, "i2", 5000, "STARTED"), ("t", 4, "i3", 5100, "STARTED"), ("t", 5, "i3", 9000, "FAILED")]
    return spark.createDataFrame(rows, "trace string, sequence long, invocation string, at_ms long, phase string")


def test_trace_batch(spark):
    e = _events(spark)
    assert [r.shown_ms for r in traces.timeline(e, "trace", "at_ms", "sequence").orderBy("sequence").collect()] == [0, 500, 1700, 1800, 3000]
    assert {r.invocation: r.outcome for r in traces.invocations(e, "invocation", "phase", "at_ms").collect()} == {"i1": "COMPLETED", "i2": "ACTIVE", "i3": "FAILED"}
    assert traces.sequence_breaks(e, "trace", "sequence", "at_ms").count() == 0
    assert {r.invocation for r in traces.strongest(e, "invocation", "phase", "at_ms", 5500).collect()} == {"i2", "i3"}


def test_trace_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"record_type": "header", "trace_id": "t"}] + [{"trace_id": "t", "sequence": i, "invocation_id": f"i{i // 2}", "occurred_at": f"2025-01-01T00:{i:02d}:00Z", "phase": "STARTED" if i % 2 == 0 else "COMPLETED"} for i in range(6)]
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"trace_id": "t", "sequ')
    assert traces.read_traces(spark, str(folder)).count() == 6
    stream = traces.windowed_counts(traces.read_traces(spark, str(folder), stream=True), "occurred_at", ["phase"], "10 minutes")
    run = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.phase, r.n) for r in spark.table("counted").collect()} == {("STARTED", 3), ("COMPLETED", 3)}
    joined = traces.open_invocations(traces.read_traces(spark, str(folder), stream=True), "invocation_id", "phase", "occurred_at")
    run = joined.writeStream.format("memory").queryName("opened").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.invocation_id, r.outcome) for r in spark.table("opened").collect()} == {(f"i{i}", "COMPLETED") for i in range(3)}
    traces.write_traces(traces.read_traces(spark, str(folder)), str(tmp_path / "out"))
    assert traces.read_traces(spark, str(tmp_path / "out")).count() == 6


def test_a_stream_tells_what_it_rejects(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    event = json.dumps({"trace_id": "t", "sequence": 1, "invocation_id": "i", "phase": "STARTED"})
    bad = ['{"torn', '{"trace_id": "t"}', '{"version": 2}', "null"]
    (folder / "a.jsonl").write_text("\n".join(['{"version": 1, "record_type": "header"}', event, "", *bad]) + "\n")
    for name, stream in (("kept", traces.read_traces(spark, str(folder), stream=True)), ("rejected", traces.rejected_lines(spark, str(folder)))):
        run = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert [r.sequence for r in spark.table("kept").collect()] == [1]
    assert sorted(r.value for r in spark.table("rejected").collect()) == sorted(bad)
    assert all(r.file.endswith("a.jsonl") for r in spark.table("rejected").collect())


def test_all_neighbours_are_ranked_by_value(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 1102)] + [(i, i + 1) for i in range(1, 1100)], "source long, target long")
    near = graphs.neighbourhood(edges, spark.createDataFrame([(0,)], "node long"), None)
    assert near.count() == 1101 and "rank" not in near.columns


def test_pack_archive(spark, tmp_path):
    path = tmp_path / "a.prismpack"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x/table-pack.json", json.dumps({"version": 1}))
        z.writestr("x/schema/dataframe.schema.json", json.dumps({"columns": [{"id": "compound_id", "type": "text"}, {"id": "pIC50", "type": "number"}]}, indent=1))
        z.writestr("x/data/dataframe.tsv", "compound_id\tpIC50\nC1\t7.2\nC2\t\n")
        z.writestr("x/other.bin", b"\xff\xfe")
    table, manifest = tables.open_pack(spark, str(path))
    assert manifest["version"] == 1 and [tuple(r) for r in table.orderBy("compound_id").collect()] == [("C1", 7.2), ("C2", None)]


def test_snapshots_are_new_and_whole(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    tables.export_snapshot(spark, {"t": t}, str(tmp_path / "s"), {"name": "first"})
    back, manifest = tables.open_snapshot(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back["t"].collect()), key=str) == [(1, "a"), (2, None)] and manifest["name"] == "first"
    with pytest.raises(Exception, match="(?i)exists"):
        tables.export_snapshot(spark, {"t": t}, str(tmp_path / "s"))


def test_traces_with_a_header(spark, tmp_path):
    events = spark.createDataFrame([("t", i, "STARTED") for i in range(20)], "trace_id string, sequence long, phase string")
    traces.write_traces(events.repartition(3), str(tmp_path / "t"), {"trace_id": "t"})
    assert sorted(r.sequence for r in traces.read_traces(spark, str(tmp_path / "t")).collect()) == list(range(20))
    with pytest.raises(Exception, match="(?i)exists"):
        traces.write_traces(events, str(tmp_path / "t"), {})


def test_structures_without_ids_go_on_counting(spark):
    held = spark.createDataFrame([("a", "X"), ("b", "Y")], "id string, structure string")
    new = spark.createDataFrame([(None, "Q"), ("own", "R"), (" ", "P")], "id string, structure string")
    assert sorted(map(tuple, tables.with_ids(held, new).collect())) == [("own", "R"), ("s3", "P"), ("s4", "Q")]


def test_numbers_over_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"))
    got = {r.x: r.number for r in rowsets.numbered(rows, ["x"]).collect()}
    assert got == {x: x + 1 for x in range(5000)}
    assert rowsets.numbered(rows.limit(0), ["x"]).count() == 0


def test_sizes_limits_and_cuts(spark):
    rows = spark.createDataFrame([(10, 5, 15, 1), (1, 14, 15, 2), (None, 5, 15, None)], "k int, v int, t int, c int")
    assert [r[0] for r in rows.select(filters.fragment_sizes(F.col("k"), F.col("v"), F.col("t"), 2, 1, 8, 0.5)).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(filters.within_limits({"k": (0, 9), "v": (None, 20)})).collect()] == [False, True, False]
    assert [r[0] for r in rows.select(filters.with_cuts(F.col("c"), [1])).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(filters.with_cuts(F.col("c"), [])).collect()] == [True] * 3


def test_roles_are_counted():
    got = artifacts.counts_by([("id", "bigint", ""), ("smiles", "string", ""), ("a", "double", "endpoint_value"), ("b", "double", "endpoint_value")])
    assert got["role"] == {"identifier": 1, "structure": 1, "endpoint": 2} and got["type"]["double"] == 2 and got["meaning"]["endpoint_value"] == 2


def test_share_follows_its_rate(spark):
    n = spark.range(20_000).where(rowsets.hash_share(F.col("id"), 3, 0.1)).count()
    assert 1_800 < n < 2_200 and spark.range(9).where(rowsets.hash_share(F.col("id"), 3, 1.0)).count() == 9


@pytest.mark.parametrize("ends", [40, 300, 1 << 22])
def test_leaders_of_a_dense_graph_in_few_rounds(spark, monkeypatch, ends):
    import random

    rng = random.Random(8)
    ids = [(1 << 60) + i for i in range(90)]
    sims = {(a, b): round(rng.uniform(0.8, 1.0), 3) for a in ids for b in ids if a < b and rng.random() < 0.25}
    weight = {i: rng.randrange(3) for i in ids}
    rows = spark.createDataFrame(list(weight.items()), "row_id long, weight int")
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "source long, target long, similarity double")
    monkeypatch.setattr(clusters, "MOST_ENDS", ends)
    got = clusters.leader_clusters(rows, edges).collect()
    assert {r.row_id: r.leader for r in got} == greedy(ids, weight, sims) and len(got) == 90
    assert all(r.similarity == (1.0 if r.row_id == r.leader else sims[tuple(sorted((r.row_id, r.leader)))]) for r in got)
    assert ends < 1 << 22 or max(r.round for r in got) == 1
