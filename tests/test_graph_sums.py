"""Sums over a similarity graph's edges against the graph itself, and what is stored for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.test_similarity_blocks import clustered, frame

from tessera.operators import graph_sums, graphs, similarity
from tessera.plans import export_queries, graph_queries


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def drawn(spark, kind, monkeypatch):
    """Vectors in many small blocks: clusters, copies and lone rows, whose nearest are below the threshold; or few; or with a repeated id."""
    rng = np.random.default_rng(17)
    v = np.concatenate([clustered(rng, 200, 6, 0.3), rng.normal(size=(80, 12))])
    v[7], v[20:30] = 0.0, v[31]
    ids = (np.arange(280) * 37) % 280  # in another order than the rows'
    if kind == "few":
        v, ids = v[:4], ids[:4]
    if kind == "repeated":
        v, ids = np.concatenate([v, v[:1]]), np.append(ids, 8)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 40)
    return frame(spark, ids, v)


CASES = [("many", "hybrid", 0.9), ("many", "hybrid", 0.0), ("many", "knn", 0.9), ("many", "threshold", 0.9), ("few", "hybrid", 0.9), ("repeated", "hybrid", 0.9)]


@pytest.mark.parametrize("kind, mode, least", CASES)
def test_degrees_are_those_of_the_edges(spark, monkeypatch, kind, mode, least):
    given = drawn(spark, kind, monkeypatch)
    args = (given, "vec_id", "embedding", mode, 3, least)
    want = rows_of(graphs.degrees(similarity.graph(*args)).select("node", "degree"))
    assert rows_of(graph_sums.degrees(*args)) == want and want


def test_a_tile_tells_a_row_once(spark, monkeypatch):
    given, stored, cut = drawn(spark, "many", monkeypatch), [], graph_sums.cut
    monkeypatch.setattr(graph_sums, "cut", lambda df, name: stored.append(out := cut(df, name)) or out)
    assert {r.degree for r in graph_sums.degrees(given, "vec_id", "embedding", "hybrid", 3, -1.0).collect()} == {279}  # every pair is an edge
    assert stored[0].count() < 280 * 279 / 2 / 2 and not stored[0].where("near").count()  # less than half as many as edges


def test_degree_queries_store_no_edges(spark, monkeypatch):
    want = rows_of(graphs.degrees(graph_queries._edges(spark, SMALL)).select("node", "degree"))
    monkeypatch.setattr(similarity, "_edges", None)
    lines = dict(r.value.split("\t") for r in export_queries.s10_node_lines(spark, SMALL).collect())
    assert [(n, d) for n, d in want if lines[str(n)] != str(d)] == [] and sum(map(int, lines.values())) == sum(d for _, d in want)
    assert graph_queries.a11_degree_stats(spark, SMALL).first().nodes == len(want)


@pytest.mark.parametrize("kind, mode, least", [CASES[0], ("many", "threshold", -1.0), *CASES[2:3], *CASES[4:]])
def test_parents_are_those_of_the_edges(spark, monkeypatch, kind, mode, least):
    at = F.when(F.col("vec_id") % 11 > 0, F.col("vec_id") % 50)  # ties, and rows without a place
    given = drawn(spark, kind, monkeypatch).withColumn("at", at)
    edges = similarity.graph(given, "vec_id", "embedding", mode, 3, least).select("source", "target", F.col("similarity").alias("score"))
    want = rows_of(graphs.parents(edges, given.select(F.col("vec_id").alias("node"), F.col("at").alias("place"))))
    assert rows_of(graph_sums.parents(given, "vec_id", "embedding", "at", mode, 3, least)) == want and want


def test_parent_queries_store_no_edges(spark, monkeypatch):
    edges = graph_queries._edges(spark, SMALL).select("source", "target", F.col("similarity").alias("score"))
    order = graph_queries.table(spark, SMALL, "embeddings").select(F.col("vec_id").alias("node"), F.col("vec_id").alias("place"))
    want = rows_of(graphs.parents(edges, order))
    monkeypatch.setattr(similarity, "_edges", None)
    assert rows_of(graph_queries.j12_parents(spark, SMALL)) == want and len(want) > 100


@pytest.mark.parametrize("kind, mode, least", [CASES[0], ("many", "threshold", -1.0), *CASES[2:3], *CASES[4:]])
def test_counts_are_those_of_the_edges(spark, monkeypatch, kind, mode, least):
    args = (drawn(spark, kind, monkeypatch), "vec_id", "embedding", mode, 3, least)
    edges, got = similarity.graph(*args), graph_sums.counts(*args)
    want = rows_of(edges.groupBy("similarity").agg(F.count(F.lit(1)), F.count_if("mutual")))
    assert rows_of(got) == want and want
    assert rows_of(graphs.stats_of_counts(got)) == rows_of(graphs.similarity_stats(edges))


def test_no_rows_have_no_counts(spark):
    empty = frame(spark, [1], [[1.0]]).limit(0)
    assert rows_of(graphs.stats_of_counts(graph_sums.counts(empty, "vec_id", "embedding"))) == rows_of(graphs.similarity_stats(similarity.graph(empty, "vec_id", "embedding")))
    assert not graph_sums.degrees(empty, "vec_id", "embedding").count() and not graph_sums.parents(empty, "vec_id", "embedding", "vec_id").count()


def test_similarity_statistics_store_no_edges(spark, monkeypatch):
    want = rows_of(graphs.similarity_stats(graph_queries._edges(spark, SMALL)).select("edges", "mutual", "min", "p25", "p50", "p75", "max"))
    monkeypatch.setattr(similarity, "_edges", None)
    assert rows_of(graph_queries.a12_similarity_stats(spark, SMALL)) == want and want[0][1] > 0
