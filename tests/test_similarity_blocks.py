"""Similarity in pruned blocks against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import similarity


def all_pairs(ids, v):
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    s = np.floor(u @ u.T * 1e6 + 0.5) / 1e6
    return {(a, b): s[i, j] for i, a in enumerate(ids) for j, b in enumerate(ids) if a != b}


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in r], "x") for i, r in zip(ids, v)], "vec_id long, embedding array<double>, block string").repartition(3)


def clustered(rng, n, clusters, spread=0.05, dim=12):
    centres = rng.normal(size=(clusters, dim))
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * spread


@pytest.mark.parametrize("kind", ["clustered", "even"])
def test_pruned_blocks_lose_nothing(spark, kind):
    rng = np.random.default_rng(7)
    v = clustered(rng, 380, 9) if kind == "clustered" else rng.normal(size=(380, 12))
    v[5], v[9], v[40:60] = 0.0, 0.0, v[30]  # zero vectors and copies
    ids = np.arange(380) * 3 + 1
    rows, want = frame(spark, ids, v), all_pairs(ids, v)
    found = similarity._scan(rows, "vec_id", "embedding", 4, 0.8, 16).collect()
    got = {(r.source, r.target): r.similarity for r in found if not r.near}
    sure = {p: s for p, s in want.items() if p[0] < p[1] and s >= 0.8}
    assert got.keys() == sure.keys() and all(abs(got[p] - s) < 2e-6 for p, s in sure.items())
    near = {}
    for r in found:
        if r.near:
            near.setdefault(r.source, []).append((-r.similarity, r.target))
    for a in ids.tolist():
        best = sorted((-want[a, b], b) for b in ids.tolist() if b != a)[:4]
        assert [-s for s, _ in sorted(near[a])[:4]] == pytest.approx([-s for s, _ in best], abs=2e-6)
    assert len([r for r in found if not r.near]) == len(got)


def test_clustered_vectors_visit_few_blocks(spark):
    rng = np.random.default_rng(2)
    v = clustered(rng, 3000, 40, 0.02)
    blocks = similarity.blocks_of(similarity._rows(frame(spark, np.arange(3000), v), "vec_id", "embedding"), 3000, 32)
    n = blocks.count()
    sizes = blocks.select(F.size("rows").alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert tuple(sizes) == (3000, 32)
    above = similarity.block_pairs(blocks, None, 0.9).count() / (n * (n + 1) / 2)
    near = similarity.block_pairs(blocks, 3, None).count() / (n * (n + 1) / 2)
    print("share of block pairs visited:", round(above, 3), round(near, 3))
    assert above < 0.1 and near < 0.3


def test_similarity_of_few_rows(spark):
    empty = frame(spark, [1], [[1.0]]).limit(0)
    assert similarity.nearest(empty, "vec_id", "embedding", 3).count() == 0
    one = frame(spark, [1], [[1.0, 0.0]])
    assert similarity.over_threshold(one, "vec_id", "embedding", -1.0).count() == 0
    zero = frame(spark, [1, 2, 3], [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]])
    assert [tuple(r) for r in similarity.over_threshold(zero, "vec_id", "embedding", 0.0).orderBy("source", "target").collect()] == [(1, 2, 0.0), (1, 3, 0.0), (2, 3, 0.0)]


@pytest.mark.parametrize("repeated", [False, True])
def test_edges_are_told_where_they_are_found(spark, monkeypatch, repeated):
    rng = np.random.default_rng(11)
    v, ids = clustered(rng, 300, 7, 0.3), np.arange(300) * 2
    given = frame(spark, [*ids, 8] if repeated else ids, [*v, v[4]] if repeated else v)
    want = all_pairs(ids, v)
    near = {(a, b) for a in ids.tolist() for _, b in sorted((-want[a, b], b) for b in ids.tolist() if b != a)[:3]}
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    got = {(r.source, r.target): r for r in similarity.graph(given, "vec_id", "embedding", "hybrid", 3, 0.9).collect()}
    pairs = {p for p, s in want.items() if p[0] < p[1] and (s >= 0.9 or p in near or p[::-1] in near)}
    for p in pairs if not repeated else {p for p in pairs if 8 not in p}:
        r, n = got[p], (p in near) + (p[::-1] in near)
        assert r.similarity == pytest.approx(want[p], abs=2e-6) and (repeated or r.mutual == (n == 2))
        assert repeated or r.origin == ("hybrid" if n and want[p] >= 0.9 else "knn" if n else "threshold")
    assert repeated or got.keys() == pairs


def test_a_block_moves_once_for_each_tile(spark):
    rows = similarity._rows(frame(spark, np.arange(4000), np.random.default_rng(5).normal(size=(4000, 12))), "vec_id", "embedding")
    blocks = similarity.blocks_of(rows, 4000, 8)
    pairs = similarity.block_pairs(blocks, None, -1.0)
    size, n = similarity._group_blocks(4000, 8), blocks.count()
    tiles = similarity._tiles(blocks, pairs, 4000, 8)
    assert size == 16 and n * (n + 1) // 2 == tiles.select(F.sum(F.size("partners"))).first()[0]
    assert tiles.count() < n * (n + 1) / size  # pairs of blocks sent two each


def test_floors_come_from_the_blocks_around(spark):
    v = clustered(np.random.default_rng(3), 640, 3, 0.5)
    rows = similarity._rows(frame(spark, np.arange(640), v), "vec_id", "embedding")
    own = similarity._with_own(similarity.blocks_of(rows, 640, 16).coalesce(1), 4).collect()
    want, met = all_pairs(np.arange(640), v), 0
    for b in own:
        for i, floor in zip(b.rows, b.own):
            assert floor <= sorted((want[i, j] for j in range(640) if j != i), reverse=True)[3] + 1e-9
            inside = sorted((want[i, j] for j in b.rows if j != i), reverse=True)
            met += len(inside) < 4 or floor > inside[3] + 1e-9
    assert met > 320  # a floor of the own block alone is below what other blocks have


def test_thresholds_are_decided_in_doubles(spark):
    angle = np.arccos(0.8) + np.arange(-40, 40) * 2.5e-7  # closer than single precision tells
    v = np.array([[1.0, 0.0], *np.column_stack([np.cos(angle), np.sin(angle)])])
    want = {p[1] for p, s in all_pairs(np.arange(81), v).items() if p[0] == 0 and s >= 0.8}
    got = similarity.over_threshold(frame(spark, np.arange(81), v), "vec_id", "embedding", 0.8).where("source = 0")
    assert 0 < len(want) < 80 and {r.target for r in got.collect()} == want
