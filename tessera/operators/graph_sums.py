"""What is asked of all edges of a similarity graph, summed up in the tiles where they are found. A tile tells a bounded number
of values for each of its rows, whatever the number of its edges; these are neither stored nor moved. Pairs of blocks are
multiplied once: pairs at or above the threshold are edges by themselves, so only those of the k nearest that are below it are
told one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graphs
from tessera.operators import similarity as si
from tessera.sources.shared import cut

SUMS = "near boolean, source long, target long, similarity double, n long"
MILLION = 10**6  # similarities have six places
NOWHERE = -(2**63)  # the place of a row without one, which is no row's parent and no row's child


class _Nearest(si._Best):
    """The ``k`` best targets of each row whose k-th may be below ``cap``; those of other rows are all at or above it."""

    def __init__(self, block: si._Block, k: int, floor: np.ndarray, cap: float):
        super().__init__(block, k, np.where(floor >= cap, np.inf, floor))
        self.cap = cap

    def open(self) -> bool:
        return bool((self.floor < np.inf).any())

    def take(self, p: np.ndarray, similarity: np.ndarray, other: np.ndarray) -> None:
        """What ``see`` would find among pairs that hold all of at least the least floor, by their rounded similarities."""
        kept = similarity >= self.floor[p]
        self.new.append((p[kept], similarity[kept], other[kept]))
        self.waiting += int(kept.sum())
        if self.waiting > 2 * self.k * len(self.block.ids):
            self.settle()

    def settle(self) -> None:
        super().settle()
        self.floor[self.floor >= self.cap] = np.inf


def _at_least(same: bool, x: si._Block, y: si._Block, s: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows p of x and q of y of each pair of at least ``least``, once. Doubles decide where single precision doesn't."""
    p, q = si._where(s >= si._limit(least, x.u.shape[1]))
    if same:
        p, q = (n[x.ids[p] < y.ids[q]] for n in (p, q))
    near = s[p, q].astype(float) < least + si._slack(x.u.shape[1])
    kept = ~near
    kept[near] = si._rounded(x.exact(p[near], y, q[near])) >= least
    return p[kept], q[kept]


class _Degrees:
    """Of each row of a tile the pairs of at least ``least``."""

    def __init__(self, least: float):
        self.least = least

    def start(self, held: dict) -> None:
        self.n = {b: (r.rows, np.zeros(len(r.rows), np.int64)) for b, r in held.items()}

    def see(self, i: int, j: int, x: si._Block, y: si._Block, s: np.ndarray) -> None:
        p, q = _at_least(i == j, x, y, s, self.least)
        for block, at in ((i, p), (j, q)):
            n = self.n[block][1]
            n += np.bincount(at, minlength=len(n))

    def tile(self) -> Iterator[tuple]:
        for ids, n in self.n.values():
            some = n > 0
            yield np.asarray(ids, np.int64)[some], np.zeros(some.sum(), np.int64), np.zeros(some.sum()), n[some]

    def task(self) -> Iterator[tuple]:
        return iter(())


class _Earlier:
    """Of each row of a tile the best pair of at least ``least`` with a row of a lesser place: by similarity, then the greater
    place, then the smaller id."""

    def __init__(self, least: float):
        self.least = least

    def start(self, held: dict) -> None:
        self.ids = {b: np.asarray(r.rows, np.int64) for b, r in held.items()}
        self.place = {b: np.asarray(r.place, np.int64) for b, r in held.items()}
        self.best = {b: (np.full(len(i), -np.inf), np.full(len(i), NOWHERE), np.zeros(len(i), np.int64)) for b, i in self.ids.items()}

    def see(self, i: int, j: int, x: si._Block, y: si._Block, s: np.ndarray) -> None:
        width = x.u.shape[1]
        low, lower = (si._limit(np.maximum(self.best[b][0], self.least), width) for b in (i, j))
        p, q = si._where((s >= low[:, None]) | (s >= lower[None, :]))
        near, at, other = s[p, q], self.place[i][p], self.place[j][q]
        mine = (other < at) & (other != NOWHERE) & (near >= low[p])
        self._take(i, p[mine], x, j, q[mine], y)
        if i != j:
            its = (at < other) & (at != NOWHERE) & (near >= lower[q])
            self._take(j, q[its], y, i, p[its], x)

    def _take(self, child: int, c: np.ndarray, x: si._Block, parent: int, p: np.ndarray, y: si._Block) -> None:
        similarity = si._rounded(x.exact(c, y, p))
        kept = similarity >= self.least
        c, similarity, place, ids = c[kept], similarity[kept], self.place[parent][p[kept]], self.ids[parent][p[kept]]
        order = np.lexsort((ids, -place, -similarity, c))
        order = order[np.diff(c[order], prepend=-1) > 0]  # each child's best
        c, new = c[order], (similarity[order], place[order], ids[order])
        old = tuple(b[c] for b in self.best[child])
        better = (new[0] > old[0]) | ((new[0] == old[0]) & ((new[1] > old[1]) | ((new[1] == old[1]) & (new[2] < old[2]))))
        for b, n in zip(self.best[child], new):
            b[c[better]] = n[better]

    def tile(self) -> Iterator[tuple]:
        for b, (similarity, place, ids) in self.best.items():
            some = similarity > -np.inf
            yield self.ids[b][some], ids[some], similarity[some], place[some]

    def task(self) -> Iterator[tuple]:
        return iter(())


class _Counts:
    """Of each similarity of at least ``least`` the pairs that have it, as a task has seen them."""

    def __init__(self, least: float):
        self.least, self.low = least, max(-MILLION, int(np.floor(least * MILLION)) - 1)
        self.n = np.zeros(max(0, MILLION + 2 - self.low), np.int64)

    def start(self, held: dict) -> None:
        pass

    def see(self, i: int, j: int, x: si._Block, y: si._Block, s: np.ndarray) -> tuple | None:
        """The pairs with their rounded similarities, where none is left out."""
        p, q = si._where(s >= si._limit(self.least, x.u.shape[1]))
        if i == j:
            p, q = (n[x.ids[p] < y.ids[q]] for n in (p, q))
        similarity = si._rounded(x.exact(p, y, q))
        kept = similarity >= self.least
        p, q, similarity = p[kept], q[kept], similarity[kept]
        np.add.at(self.n, np.rint(similarity * MILLION).astype(np.int64) - self.low, 1)
        return None if i == j else (p, q, similarity)

    def tile(self) -> Iterator[tuple]:
        return iter(())

    def task(self) -> Iterator[tuple]:
        some = np.flatnonzero(self.n)
        none = np.zeros(len(some), np.int64)
        yield none, none, (some + self.low) / MILLION, self.n[some]


def _with_places(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """``blocks`` with place, those of ``places`` (row, place) in the order of their rows."""
    own = blocks.select("block", F.posexplode("rows").alias("at", "row")).join(places, "row", "left")
    kept = F.sort_array(F.collect_list(F.struct("at", F.coalesce("place", F.lit(NOWHERE)).alias("place"))))
    own = own.groupBy("block").agg(kept.alias("l")).select("block", F.col("l.place").alias("place"))
    return blocks.join(cut(own, "places"), "block")


def _found(tiles: DataFrame, k: int | None, least: float | None, cap: float, kind: Callable) -> DataFrame:
    """near rows: source and its nearest targets, k a tile, of rows whose k-th may be below ``cap``. Others: what ``kind`` sums up
    of the pairs of at least ``least``."""

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        sums = None if least is None else kind(least)
        for held, pairs in si._met(parts):
            best = {}
            if sums:
                sums.start(held)
            for i, j, x, y, s in si._products(held, pairs):
                known = sums.see(i, j, x, y, s) if sums else None
                if k is not None:
                    for b, block in ((i, x), (j, y)):
                        if b not in best:
                            best[b] = _Nearest(block, k, held[b].own, cap)
                    for b, other, across in ((i, y, True), (j, x, False))[: 1 if i == j else 2]:
                        if known and best[b].floor.min() >= least:
                            p, q = known[:2] if across else known[1::-1]
                            best[b].take(p, known[2], other.ids[q])
                        elif best[b].open():
                            best[b].see(other, s, across)
            for b in best.values():
                source, target, similarity, near = b.rows()
                yield near, source, target, similarity, np.zeros(len(source), np.int64)
            if sums:
                yield from told(sums.tile())
        if sums:
            yield from told(sums.task())

    def told(rows: Iterator[tuple]) -> Iterator[tuple]:
        return ((np.zeros(len(r[0]), bool), *r) for r in rows)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return si._frames(found(parts), ["near", "source", "target", "similarity", "n"])

    return tiles.mapInPandas(run, SUMS)


def _blocks(vectors: DataFrame, row_id: str, vector: str, k: int | None, least: float | None) -> tuple[DataFrame, DataFrame, int] | None:
    """The rows in blocks, the pairs of blocks to meet, and the number of rows. None where ids repeat."""
    rows = si._rows(vectors, row_id, vector)
    count, different = rows.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    return None if count > different else (*si._blocks_and_pairs(rows, count, k, least, si.BLOCK_ROWS), count)


def _near_and_sums(blocks: DataFrame, pairs: DataFrame, count: int, k: int | None, least: float | None, kind: Callable, all_near: bool = False) -> tuple[DataFrame, DataFrame]:
    """The different pairs source < target, similarity, near (by how many of both) among the k nearest (those below the threshold;
    ``all_near``: all) and what ``kind`` sums up of the pairs at the threshold."""
    cap = np.inf if all_near or least is None else least
    kept = cut(_found(si._tiles(blocks, pairs, count, si.BLOCK_ROWS), k, least, cap, kind), "sums")
    near = si._ranked(kept.where("near"), k or 0).groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("near"))
    return near.where(F.col("similarity") < F.lit(float(cap))), kept.where("not near")


def _summed(vectors: DataFrame, row_id: str, vector: str, mode: str, k: int, least: float, kind: Callable, all_near: bool = False, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """``_near_and_sums`` of the graph. None where ids repeat."""
    k, least = si.chosen(mode, k, least)
    made = _blocks(vectors, row_id, vector, k, least)
    if made is None:
        return None
    blocks, pairs, count = made
    return _near_and_sums(blocks if places is None else _with_places(blocks, places), pairs, count, k, least, kind, all_near)


def degrees(vectors: DataFrame, row_id: str, vector: str, mode: str = "hybrid", k: int = 5, least: float = 0.85) -> DataFrame:
    """node, degree: the rows of ``similarity.graph`` that have edges, and how many."""
    found = _summed(vectors, row_id, vector, mode, k, least, _Degrees)
    if found is None:
        return graphs.degrees(si.graph(vectors, row_id, vector, mode, k, least)).select("node", "degree")
    near, above = found
    ends = graphs.both_ways(near).select("node", F.lit(1).cast("long").alias("n")).unionByName(above.select(F.col("source").alias("node"), "n"))
    return ends.groupBy("node").agg(F.sum("n").alias("degree"))


def parents(vectors: DataFrame, row_id: str, vector: str, place: str, mode: str = "hybrid", k: int = 5, least: float = 0.85) -> DataFrame:
    """``graphs.parents`` of ``similarity.graph``, by its similarities and a column of whole numbers: child, parent, score."""
    places = vectors.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("row"), F.col(place).cast("long").alias("place"))
    found = _summed(vectors, row_id, vector, mode, k, least, _Earlier, places=places)
    if found is None:
        edges = si.graph(vectors, row_id, vector, mode, k, least).select("source", "target", F.col("similarity").alias("score"))
        return graphs.parents(edges, vectors.select(F.col(row_id).alias("node"), F.col(place).alias("place")))
    near, above = found
    at = lambda n: places.select(F.col("row").alias(n), F.col("place").alias(f"{n}_place"))
    met = near.join(at("source"), "source").join(at("target"), "target").where("source_place <> target_place")
    later = F.col("source_place") > F.col("target_place")
    ends = F.when(later, F.struct("source", "target", "target_place")).otherwise(F.struct(F.col("target").alias("source"), F.col("source").alias("target"), F.col("source_place").alias("target_place")))
    below = met.select(ends.alias("e"), "similarity").select(F.col("e.source").alias("child"), F.col("e.target").alias("parent"), F.col("similarity").alias("score"), F.col("e.target_place").alias("parent_place"))
    return graphs.best_parents(below.unionByName(above.select(F.col("source").alias("child"), F.col("target").alias("parent"), F.col("similarity").alias("score"), F.col("n").alias("parent_place"))))


def counts(vectors: DataFrame, row_id: str, vector: str, mode: str = "hybrid", k: int = 5, least: float = 0.85) -> DataFrame:
    """similarity, n, mutual: how many edges of ``similarity.graph`` have each similarity, and how many of these are mutual."""
    found = _summed(vectors, row_id, vector, mode, k, least, _Counts, all_near=True)
    if found is None:
        return si.graph(vectors, row_id, vector, mode, k, least).groupBy("similarity").agg(F.count(F.lit(1)).alias("n"), F.count_if("mutual").alias("mutual"))
    near, above = found
    below = F.lit(True) if mode == "knn" else F.col("similarity") < F.lit(float(least))  # others are counted above
    ways = near.select("similarity", F.when(below, 1).otherwise(0).cast("long").alias("n"), F.when(F.col("near") == 2, 1).otherwise(0).cast("long").alias("mutual"))
    return ways.unionByName(above.select("similarity", "n", F.lit(0).cast("long").alias("mutual"))).groupBy("similarity").agg(F.sum("n").alias("n"), F.sum("mutual").alias("mutual"))
