"""Graph operators whose work on an edge is counted: neighbours, levels, components."""

import random

import pytest

from tessera.operators import artifacts, graphs


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(4)
    return [(a, b) for a, b in {(rng.randrange(40), rng.randrange(40)) for _ in range(150)} if a < b]


def frame(spark, edges):
    return spark.createDataFrame(edges, "source long, target long")


@pytest.mark.parametrize("once", [True, False])
def test_neighbours_carry_both_ends(spark, drawn, once):
    given = drawn if once else [*drawn, *[(b, a) for a, b in drawn[:20]], drawn[0], (3, 3), (None, 5)]
    nodes = spark.createDataFrame([(n, n * 10) for n in range(39)], "node long, x long")
    got = sorted(tuple(r) for r in graphs.neighbours(frame(spark, given), nodes, once).select("centre", "other", "centre_x", "other_x").collect())
    both = {(a, b) for a, b in given if a is not None} | {(b, a) for a, b in given if a is not None}
    assert got == sorted((a, b, a * 10, b * 10) for a, b in both if a < 39 and b < 39)


def test_neighbours_of_some_centres_are_ranked(spark, drawn):
    edges, centres = frame(spark, [*drawn, drawn[0][::-1]]), spark.createDataFrame([(1,), (2,), (99,)], "node long")
    ends = [n for e in [*drawn, drawn[0]] for n in e]
    want = []
    for c in (1, 2):
        near = {b for a, b in drawn if a == c} | {a for a, b in drawn if b == c}
        want += [(c, o, ends.count(o), r) for r, o in enumerate(sorted(near, key=lambda o: (-ends.count(o), o))[:3], 1)]
    assert sorted(tuple(r) for r in graphs.neighbourhood(edges, centres, 3).collect()) == sorted(want)


def test_values_and_degrees_come_to_an_edge_together(spark, drawn):
    values = spark.createDataFrame([(n, None if n % 7 == 0 else float(n % 5)) for n in range(38)], "node long, value double")
    edges = frame(spark, drawn)
    want = artifacts.nearest_in_value(graphs.neighbourhood(edges, values.select("node"), None), values, 3)
    got = artifacts.neighbours_in_value(edges, values, 3, once=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() > 50


def test_edges_are_stored_as_they_stand(spark, drawn, monkeypatch):
    stored, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df, name: stored.append((name, out := cut(df, name))) or out)
    edges = frame(spark, [*drawn, *drawn, (4, 4)])
    found = {r.node: r.distance for r in graphs.distances(edges, spark.createDataFrame([(0,)], "node long"), 50).collect()}
    want, front = {0: 0}, {0}
    while front:
        front = {n for a, b in drawn for n, m in ((a, b), (b, a)) if m in front} - want.keys()
        want |= dict.fromkeys(front, max(want.values()) + 1)
    assert found == want and [df.count() for name, df in stored if name == "edges"] == [2 * len(drawn)]
    stored.clear()
    graphs.components(edges)
    assert stored[0][1].columns == ["source", "target"]  # made once, though read from either end
