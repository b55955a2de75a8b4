"""Paths, lanes, predictors, limits, registration and exports on small cases and against plain Python."""

import random
from collections import defaultdict, deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import predictions
from tessera.operators import graphs, rowsets, summaries
from tessera.sources import tables


def test_paths_against_breadth_first_search(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(62)} | {(100, 101), (101, 102), (103, 103)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def hops(a, b):
        seen, todo = {a: 0}, deque([a])
        while todo:
            x = todo.popleft()
            for y in near[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen.get(b)

    asked = [(rng.randrange(60), rng.randrange(60)) for _ in range(60)] + [(100, 102), (100, 103), (100, 1), (7, 900), (900, 7), (900, 901), (103, 103), (100, 100), (100, 102)]
    frame = spark.createDataFrame(sorted(edges), "source long, target long")
    got = {(r.source, r.target): r for r in graphs.paths(frame, spark.createDataFrame(asked, "source long, target long")).collect()}
    assert got.keys() == set(asked)
    for (a, b), r in got.items():
        ins = a in near, b in near
        want = {(False, False): "rows_not_in_graph", (False, True): "source_not_in_graph", (True, False): "target_not_in_graph"}.get(ins)
        want = want or ("same_row" if a == b else "no_path" if hops(a, b) is None else "connected")
        assert r.reason == want, (a, b)
        if want == "connected":
            assert r.hops == hops(a, b) and r.path[0] == a and r.path[-1] == b and all(y in near[x] for x, y in zip(r.path, r.path[1:]))
        else:
            assert r.path == ([a] if want == "same_row" else []) and r.hops == (0 if want == "same_row" else None)
    far = {(a, b) for a, b in asked if a in near and b in near and a != b and (hops(a, b) or 0) > 3}
    short = graphs.paths(frame, spark.createDataFrame(asked, "source long, target long"), 3).where("reason = 'max_depth_exceeded'").collect()
    assert far <= {(r.source, r.target) for r in short} and all((hops(r.source, r.target) or 9) > 3 for r in short)


def test_registered_paths_end_after_twelve_hops(spark, tmp_path, monkeypatch):
    from tessera.plans import build_queries

    spark.range(40).selectExpr("id as vec_id", "array(1.0D) as embedding", "0 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    chain = spark.range(39).selectExpr("id as source", "id + 1 as target", "0.5D as similarity", "true as mutual", "'knn' as origin")
    monkeypatch.setattr(build_queries, "_edges", lambda s, d: chain)
    got = {(r.source, r.target): (r.reason, r.hops) for r in build_queries.g4_paths(spark, str(tmp_path)).collect()}
    far = {(a, a * 7 % 40): abs(a - a * 7 % 40) for a in range(0, 40, 5)}
    assert max(far.values()) > 12 and got == {p: ("same_row", 0) if n == 0 else ("connected", n) if n <= 12 else ("no_path", None) for p, n in far.items()}


def test_lanes_against_a_walk(spark):
    rng = random.Random(9)
    parent = {i: None if i == 0 or rng.random() < 0.1 else rng.randrange(max(0, i - 6), i) for i in range(80)}
    parent |= {i: i - 1 for i in range(81, 140)} | {80: None}  # a long chain
    children = defaultdict(list)
    for i, p in parent.items():
        children[p].append(i)
    want, free = {}, [0]

    def walk(node, root):
        below = [walk(c, root) for c in sorted(children[node])]
        if not below:
            below = [(free[0], free[0])]
            free[0] += 1
        low, high = below[0][0], below[-1][1]
        want[node] = (root, (low + high) / 2, low, high - low + 1)
        return low, high

    for root in sorted(children[None]):
        walk(root, root)
    forest = spark.createDataFrame([(c, p) for c, p in parent.items() if p is not None], "child long, parent long")
    order = spark.createDataFrame([(i, i) for i in parent], "node long, place long")
    assert {r.node: tuple(r)[1:] for r in graphs.lanes(forest, order).collect()} == want


def test_a_batch_goes_on_after_a_row_fails(spark):
    calls = []

    def sizes(names: pd.Series) -> pd.DataFrame:
        if names.str.contains("bad").any():
            raise ValueError("bad name")
        return pd.DataFrame({"value": names.str.len().where(names != "inf", float("inf")), "uncertainty": 0.1, "applicability": names.str.len() / 10})

    rows = spark.createDataFrame([(f"n{'x' * (i % 9)}",) for i in range(300)] + [("bad",), (None,), (" ",), ("inf",), ("also bad",)], "name string")
    got = rows.withColumn("p", predictions.batched(sizes, 0.3)(F.col("name"))).select("name", "p.*").collect()
    assert {r.name: (r.status, r.message) for r in got if r.status == "FAILURE"} == {"bad": ("FAILURE", "ValueError: bad name"), "also bad": ("FAILURE", "ValueError: bad name"), None: ("FAILURE", "no input"), " ": ("FAILURE", "no input"), "inf": ("FAILURE", "no finite value")}
    assert all(r.value == len(r.name) and r.status == ("SUCCESS" if len(r.name) >= 3 else "OUT_OF_DOMAIN") for r in got if r.status != "FAILURE")
    registry = predictions.Registry()
    registry.register(predictions.Capability("sizes", "length", predictions.batched(sizes)))
    assert registry.predict(rows.limit(3), "length", "name").columns == ["name", "length_value", "length_uncertainty", "length_applicability", "length_status"]
    assert not calls


def test_a_limit_runs_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(1000).mapInPandas(counted, "id long")
    assert rowsets.at_most(rows, 1000, "rows").count() == 1000 and seen.value == 1000
    with pytest.raises(ValueError, match="more than 999 rows"):
        rowsets.at_most(rows, 999, "rows")
    assert seen.value == 2000
    assert rowsets.at_most(rows.limit(0), 0, "rows").count() == 0


def test_registration_rejects_any_duplicate(spark):
    old = spark.createDataFrame([("s1", "C")], "id string, structure string")
    new = lambda *rows: spark.createDataFrame(list(rows), "id string, structure string")
    assert sorted(map(tuple, tables.register(old, new(("a", "N"), ("b", None))).collect())) == [("a", "N"), ("b", None), ("s1", "C")]
    for rows, error in (([("x", "N"), ("x", "O")], "repeated structure id: x"), ([("s1", "N")], "exists already: s1"), ([(None, "N")], "no id"), ([("x", "N"), ("x", "N")], "repeated")):
        with pytest.raises(Exception, match=error):
            tables.register(old, new(*rows)).collect()


def test_a_dataset_must_have_its_columns(spark, tmp_path):
    files = {
        "endpoints": "endpoint_id\tname\tdatatype\nE\tE\tnumeric\n", "subjects": "subject_id\tstructure_id\nA\tS\n", "values": "subject_id\tendpoint_id\tstate\tmean\nA\tE\tVALUE\t1.5\n",
        "subject_sets": "subject_set_id\tname\nX\tX\n", "subject_set_memberships": "subject_set_id\tsubject_id\nX\tA\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.prism.tsv").write_text(text)
    assert tables.open_dataset(spark, str(tmp_path))["values"].first().mean == 1.5
    (tmp_path / "values.prism.tsv").write_text("subject_id\tendpoint\tstate\tmean\nA\tE\tVALUE\t1.5\n")
    with pytest.raises(ValueError, match="no column endpoint_id"):
        tables.open_dataset(spark, str(tmp_path))


def test_columns_that_clash_are_numbered(spark):
    assert tables.safe_columns(["Log D", "log-d", "?", "ä"], "field_") == {"Log D": "field_log_d", "log-d": "field_log_d_2", "?": "field", "ä": "field_2"}
    chosen = spark.createDataFrame([("a",), ("b",)], "subject_id string")
    fields = spark.createDataFrame([("a", "1", "2")], "subject_id string, `Log D` string, `log-d` string")
    values = spark.createDataFrame([("a", "E", 1.0), ("a", "F", 2.0)], "subject_id string, endpoint_id string, mean double")
    fragments = spark.createDataFrame([("a", "R1", "l", "i", "s"), ("b", "r-1", "m", "j", "t")], "subject_id string, path string, label string, fragment_id string, fragment_smiles string")
    out = tables.export_rows(chosen, fields, values, ["E", "G"], None, fragments, ["R1", "r-1", "r_1"])
    assert out.columns == ["subject_id", "endpoint_id", "field_log_d", "field_log_d_2", "mean"] + [f"decomp_{b}_{c}" for b in ("r1", "r_1", "r_1_2") for c in ("label", "fragment_id", "fragment_smiles")]
    got = {(r.subject_id, r.endpoint_id): (r.field_log_d_2, r.mean, r.decomp_r1_label, r.decomp_r_1_label, r.decomp_r_1_2_label) for r in out.collect()}
    assert got == {("a", "E"): ("2", 1.0, "l", None, None), ("a", "G"): ("2", None, "l", None, None), ("b", "E"): (None, None, None, "m", None), ("b", "G"): (None, None, None, "m", None)}


def test_top_values_of_a_group_with_very_many(spark):
    rows = spark.range(120_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(None).alias("g"), F.least(F.col("id"), F.col("id") % 100_000).cast("string").alias("v"))
    got = summaries.categories(rows, "v", 3, ["g"])
    plan = got._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # tasks keep three of a group before it meets
    by = {(r.g, r["rank"]): (r.n, r.distinct_values) for r in got.collect()}
    assert by["hot", 1] == (2, 90_000) and by[None, 1] == (2, 10_000) and len(by) == 6


def test_numbers_within_groups_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", None]), rng.randrange(500), i) for i in range(600)]
    frame = spark.createDataFrame(rows, "g string, v long, id long").repartition(5)
    got = {r.id: r.number for r in rowsets.numbered(frame, [F.desc("v"), F.asc("id")], group=["g"]).collect()}
    for g in ("a", None):
        own = sorted((-v, i) for x, v, i in rows if x == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))


def test_a_failing_batch_is_not_tried_where_it_must_fail(spark):
    calls = []

    def function(part):
        calls.append(len(part))
        if (part == "bad").any():
            raise ValueError("unlucky")
        return pd.DataFrame({"value": [1.0] * len(part), "uncertainty": 0.5, "applicability": 1.0})

    run = predictions.batched(function).func
    out = next(iter(run(iter([pd.Series(["good"] * 1023 + ["bad"])]))))
    assert (out["status"] == "SUCCESS").sum() == 1023 and out["message"].iloc[-1] == "ValueError: unlucky" and out["value"].iloc[-1] is None
    assert len(calls) == 12  # the whole, ten sound halves, the row itself


def test_predictions_are_spread_over_cores(spark):
    assert predictions.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_collapsed_neighbours_move_each_edge_once(spark):
    rows = [(1, 2, "t", 1.0), (2, 1, "u", 4.0), (1, 2, "t", 2.0), (3, 1, None, None), (1, 3, "v", 7.0), (4, 4, "w", 5.0), (5, 6, None, None)]
    edges = spark.createDataFrame(rows, "source long, target long, transform_id string, delta double")
    found = graphs.collapsed(edges, spark.createDataFrame([(1,), (2,), (4,), (6,)], "node long"))
    got = {(r.centre, r.other): tuple(r)[2:] for r in found.collect()}
    assert got == {(1, 2): (3, 2, 2.333333, 2.0, 1.0, 4.0), (2, 1): (3, 2, 2.333333, 2.0, 1.0, 4.0), (1, 3): (2, 1, 7.0, 7.0, 7.0, 7.0), (4, 4): (2, 1, 5.0, 5.0, 5.0, 5.0), (6, 5): (1, 0, None, None, None, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Expand" not in plan
