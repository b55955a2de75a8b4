"""Cosine similarity of vectors in blocks of like directions. Blocks that can't hold a similar pair never meet; the others
meet once, in tiles of two groups of blocks, so the result is that of all pairs and a block moves once for each tile."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rowsets import at_most
from tessera.sources.shared import cut

BLOCK_ROWS = 1024
FEW_BLOCKS = 4  # that aren't worth a look at their middles: all pairs of them meet
BLOCKS_A_GROUP = 16  # at most; a tile, the work of one task, is the pairs of blocks of two groups
GROUPS = 20  # that blocks are dealt into while groups are smaller than that: what moves grows with the rows
MOST_TASKS = 20_000
CENTRES = 1024  # that blocks are dealt by
SUMMARIES = 1024  # of blocks that are compared at once
SLACK = 1e-6  # rounded similarities and sums of angles lose no pair
EXACT = 1 << 21  # components that are multiplied in doubles at once
BATCH = 1 << 16  # rows that a task gives back at once
BLOCK = "block long, rows array<bigint>, width int, v binary, middle array<double>, radius double, flat boolean"
REACH = "block long, middle array<double>, radius double, flat boolean, kth double"
PAIRS = "source long, target long, similarity double, near boolean"
EDGES = "source long, target long, millionths int, near int, above boolean"


def _rows(vectors: DataFrame, row_id: str, vector: str) -> DataFrame:
    return vectors.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")


def _normal(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _matrix(vectors: list) -> np.ndarray:
    return np.array(list(vectors), float).reshape(len(vectors), -1)


def _units(vectors: list) -> np.ndarray:
    return _normal(_matrix(vectors))


def _packed(v: np.ndarray) -> bytes:
    """In four bytes a component where they hold it exactly."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return (short if np.array_equal(short, v, equal_nan=True) else v).tobytes()


def _unit(rows: np.ndarray, width: int, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.float32 if len(v) == 4 * len(rows) * width else np.float64
    return np.asarray(rows, np.int64), _normal(np.frombuffer(v, kind).astype(float).reshape(len(rows), width))


class _Block:
    """A block's ids, its unit vectors, and these in single precision, by which pairs are looked for."""

    def __init__(self, rows: np.ndarray, width: int, v: bytes):
        self.ids, self.u = _unit(rows, width, v)
        self.short = self.u.astype(np.float32)

    def some(self, at: np.ndarray | slice) -> _Block:
        """The block's rows at these places."""
        block = copy(self)
        block.ids, block.u, block.short = self.ids[at], self.u[at], self.short[at]
        return block

    def exact(self, p: np.ndarray, other: _Block, q: np.ndarray) -> np.ndarray:
        """The similarities of rows p to the other block's rows q in doubles, the same for a pair wherever it is met."""
        step = max(1, EXACT // max(1, self.u.shape[1]))
        return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", self.u[p[n : n + step]], other.u[q[n : n + step]]) for n in range(0, len(p), step))])


def _slack(width: int) -> float:
    """No similarity in single precision, of vectors of that width, is farther than this from its rounded double: unit
    vectors' products and their sums are off by less than (width + 4) / 2^24."""
    return SLACK + (width + 8) / 2.0**23


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _few_blocks(rows: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """A few blocks that rows are dealt to by their hash, and all pairs i <= j of them."""

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for block, rows in zip(part["block"], part["rows"]):
                v = _matrix([r["v"] for r in rows])
                yield pd.DataFrame({"block": [block], "rows": [[r["id"] for r in rows]], "width": [v.shape[1]], "v": [_packed(v)], "middle": [None], "radius": [np.pi], "flat": [False]})

    dealt = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))
    made = cut(dealt.mapInPandas(packed, BLOCK), "blocks")
    return made, made.select(F.col("block").alias("i")).join(made.select(F.col("block").alias("j")), F.col("i") <= F.col("j"))


def _group_blocks(count: int, block_rows: int) -> int:
    return min(BLOCKS_A_GROUP, max(1, -(-count // (block_rows * GROUPS))))


def blocks_of(rows: DataFrame, count: int, block_rows: int) -> DataFrame:
    """block, rows (ids), width and v (their vectors), middle, radius, flat: the ``count`` rows (id, v) in blocks of ``block_rows`` at most. A block's rows have
    the same nearest of at most ``CENTRES`` centres (rows of the least hashes) and like angles to it; ``middle`` is the
    direction of their mean, ``radius`` the widest angle to it. Zero vectors have blocks of their own, without a middle.
    Rows are sorted by ranges, so a centre that most rows are nearest to fills many tasks."""
    centres = min(CENTRES, max(1, -(-count // block_rows)))
    held = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(centres).collect()] if centres > 1 else []
    sizes = {len(v) for v in held}
    middle = _units(held) if len(sizes) == 1 else np.zeros((1, 0))

    @F.pandas_udf("centre int, angle double")
    def placed(v: pd.Series) -> pd.DataFrame:
        u = _units(v.tolist())
        near = u @ middle.T if middle.shape[1] == u.shape[1] else np.zeros((len(u), 1))
        at = near.argmax(axis=1)
        empty = ~u.any(axis=1)
        return pd.DataFrame({"centre": np.where(empty, -1, at).astype(np.int32), "angle": np.where(empty, 0.0, _angles(near[np.arange(len(u)), at]))})

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block() -> pd.DataFrame:
            v = _matrix([v for _, _, v in held])
            u = _normal(v)
            mean = u.mean(axis=0)
            size = np.linalg.norm(mean)
            known = held[0][0] >= 0 and size > 1e-9
            mean = mean / size if known else mean
            radius = float(_angles(u @ mean).max()) if known else np.pi
            return pd.DataFrame({"block": [number], "rows": [[i for _, i, _ in held]], "width": [v.shape[1]], "v": [_packed(v)], "middle": [mean.tolist() if known else None], "radius": [radius], "flat": [held[0][0] < 0]})

        for part in parts:
            for centre, i, v in zip(part["centre"], part["id"], part["v"]):
                if held and (held[0][0] != centre or len(held) == block_rows):
                    yield block()
                    number, held = number + 1, []
                held.append((centre, i, v))
        if held:
            yield block()

    near = rows.withColumn("p", placed("v")).select("id", "v", "p.centre", "p.angle")
    ordered = near.repartitionByRange(max(1, -(-count // (block_rows * _group_blocks(count, block_rows)))), "centre", "angle", "id").sortWithinPartitions("centre", "angle", "id")
    return cut(ordered.mapInPandas(packed, BLOCK), "blocks")


def _own_best(block: _Block, k: int) -> np.ndarray:
    """What the k-th best similarity that each of a block's rows has inside it is at least."""
    x, u = block.ids, block.short
    if len(x) <= k:
        return np.full(len(x), -np.inf)
    s = u @ u.T
    s[~np.isfinite(s) | (x[:, None] == x[None, :])] = -np.inf
    return np.partition(s, len(s) - k, axis=1)[:, len(s) - k].astype(float) - _slack(u.shape[1])


def _with_own(blocks: DataFrame, k: int) -> DataFrame:
    """``blocks`` with own, the least similarity that each row's ``k`` best of all can have, from its block and the blocks
    that are read with it: the nearer to the truth, the fewer candidates a row has in a tile."""

    def floors(near: list[_Block]) -> Iterator[list]:
        best = [_Best(b, k, _own_best(b, k)) for b in near]
        for i, b in enumerate(near):
            for j in range(i, len(near)):
                s = b.short @ near[j].short.T
                best[i].see(near[j], s, True)
                if i != j:
                    best[j].see(b, s, False)
        for b in best:
            b.settle()
            yield b.floor.tolist()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for n in range(0, len(part), BLOCKS_A_GROUP):
                some = part.iloc[n : n + BLOCKS_A_GROUP]
                yield some.assign(own=list(floors([_Block(r, w, v) for r, w, v in zip(some["rows"], some["width"], some["v"])])))

    return cut(blocks.mapInPandas(run, f"{BLOCK}, own array<double>"), "blocks")


def _reach(blocks: DataFrame, k: int | None) -> DataFrame:
    """block, middle, radius, flat, kth: the least of the k-th best similarities that the block's rows have inside it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [max(-2.0, _own_best(_Block(r, w, v), k).min()) for r, w, v in zip(part["rows"], part["width"], part["v"])]
            yield part[["block", "middle", "radius", "flat"]].assign(kth=out)

    if k is None:
        return blocks.select("block", "middle", "radius", "flat", F.lit(2.0).alias("kth"))
    return blocks.mapInPandas(run, REACH)


def block_pairs(blocks: DataFrame, k: int | None, least: float | None) -> DataFrame:
    """i, j (i <= j): the pairs of blocks that may hold a similar pair. By the triangle inequality of angles, rows of
    two blocks are no closer than their middles less both radii; a pair of blocks whose best similarity is below
    ``least`` and below the k-th best that each one's rows have in their own block is left out. Pairs are looked up
    among summaries, which meet in blocks of blocks."""
    reach = cut(_reach(blocks, k), "reach")
    n = max(1, -(-reach.count() // SUMMARIES))
    dealt = reach.groupBy(F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias("g")).agg(F.collect_list(F.struct("block", "middle", "radius", "flat", "kth")).alias("s"))
    left = dealt.select(F.col("g").alias("a"), F.col("s").alias("x"), F.explode(F.sequence(F.col("g"), F.lit(n - 1))).alias("b"))
    met = left.join(dealt.select(F.col("g").alias("b"), F.col("s").alias("y")), "b").repartition(F.col("a"), F.col("b"))

    def fields(s: np.ndarray, width: int) -> tuple:
        middle = np.array([r["middle"] if r["middle"] is not None else np.zeros(width) for r in s], float).reshape(len(s), width)
        known = np.array([r["middle"] is not None for r in s], bool)
        return np.array([r["block"] for r in s], np.int64), middle, known, np.array([r["radius"] for r in s]), np.array([r["flat"] for r in s], bool), np.array([r["kth"] for r in s])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a, b, x, y in zip(part["a"], part["b"], part["x"], part["y"]):
                width = max((len(r["middle"]) for r in [*x, *y] if r["middle"] is not None), default=0)
                (p, pm, pk, pr, pf, pt), (q, qm, qk, qr, qf, qt) = fields(x, width), fields(y, width)
                apart = np.maximum(_angles(pm @ qm.T) - pr[:, None] - qr[None, :], 0.0)
                best = np.where(pk[:, None] & qk[None, :], np.cos(np.minimum(apart, np.pi)) + SLACK, 1.0 + SLACK)
                best[pf, :] = best[:, qf] = SLACK  # a zero vector is at 0 to all
                wanted = np.zeros(best.shape, bool)
                if least is not None:
                    wanted |= best >= least
                if k is not None:
                    wanted |= (best >= pt[:, None]) | (best >= qt[None, :])
                wanted |= p[:, None] == q[None, :]
                i, j = np.nonzero(wanted if a != b else wanted & (p[:, None] <= q[None, :]))
                yield pd.DataFrame({"i": np.minimum(p[i], q[j]), "j": np.maximum(p[i], q[j])})

    return met.mapInPandas(run, "i long, j long")


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the few true ones, row by row."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.divmod(np.flatnonzero(flat), max(1, mask.shape[1]))
    eights = np.flatnonzero(flat.view(np.uint64) != 0)  # truth is found faster than numbers
    at, place = np.nonzero(flat.reshape(-1, 8)[eights])
    return np.divmod(8 * eights[at] + place, max(1, mask.shape[1]))


def _limit(least: np.ndarray | float, width: int) -> np.ndarray:
    return np.asarray(np.asarray(least, float) - _slack(width), np.float32)


class _Best:
    """The ``k`` best targets of each row of a block among those seen: by similarity, then the smaller id."""

    def __init__(self, block: _Block, k: int, floor: np.ndarray):
        self.block, self.k, self.floor = block, k, floor.copy()
        self.held, self.new, self.waiting = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), [], 0

    def see(self, other: _Block, s: np.ndarray, across: bool) -> None:
        """Similarities (in single precision) to the rows of ``other``, which stand in rows or, ``across``, in columns."""
        least = _limit(self.floor, other.u.shape[1])
        p, q = _where(s >= least[:, None]) if across else _where(s >= least[None, :])[::-1]
        found = self.block.exact(p, other, q)
        real = np.isfinite(found) & (self.block.ids[p] != other.ids[q])
        self.new.append((p[real], _rounded(found[real]), other.ids[q[real]]))
        self.waiting += int(real.sum())
        if self.waiting > 2 * self.k * len(self.block.ids):
            self.settle()

    def settle(self) -> None:
        p, s, other = (np.concatenate(x) for x in zip(self.held, *self.new))
        order = np.lexsort((other, -s, p))
        p, s, other = p[order], s[order], other[order]
        place = np.arange(len(p)) - np.searchsorted(p, p)
        self.held, self.new, self.waiting = tuple(x[place < self.k] for x in (p, s, other)), [], 0
        last = place == self.k - 1
        self.floor[p[last]] = np.maximum(self.floor[p[last]], s[last])

    def rows(self) -> tuple:
        self.settle()
        p, s, other = self.held
        return self.block.ids[p], other, s, np.ones(len(p), bool)


def _frames(found: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Tuples of columns as frames of at least ``BATCH`` rows, but for the last."""
    held, n = [], 0
    for some in found:
        held.append(some)
        n += len(some[0])
        if n >= BATCH:
            yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*held)))))
            held, n = [], 0
    if n:
        yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*held)))))


def _tiles(blocks: DataFrame, pairs: DataFrame, count: int, block_rows: int) -> DataFrame:
    """``blocks`` as often as they have tiles, with a, b (the tile's groups) and partners (the blocks of the tile that they
    are to meet); a tile's blocks follow each other in one task."""
    size = _group_blocks(count, block_rows)
    group = lambda c: F.shiftright(c, 32) * 4096 + F.floor((F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))) / (2 * size))  # a range's blocks, if not far more than meant
    tiles = pairs.select(group("i").alias("a"), group("j").alias("b"), "i", "j")
    need = tiles.select("a", "b", F.col("i").alias("block"), F.col("j").alias("partner")).unionByName(tiles.select("a", "b", F.col("j").alias("block"), F.lit(None).cast("long").alias("partner")))
    need = need.groupBy("a", "b", "block").agg(F.collect_list("partner").alias("partners"))
    groups = -(-count // (block_rows * size))
    tasks = max(1, min(MOST_TASKS, groups * (groups + 1) // 2))
    return need.join(blocks.drop("middle", "radius", "flat"), "block").repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "block")


def _met(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[dict, list]]:
    """For each tile its blocks by number, as rows, and the pairs of them to meet."""
    at, held, pairs = None, {}, []
    for part in parts:
        for row in part.itertuples(index=False):
            if at != (row.a, row.b):
                if held:
                    yield held, pairs
                at, held, pairs = (row.a, row.b), {}, []
            held[row.block] = row
            pairs.extend((row.block, j) for j in sorted(row.partners))
    if held:
        yield held, pairs


def _products(held: dict, pairs: list) -> Iterator[tuple]:
    """i, j, both blocks and their rows' similarities in single precision, right to ``_slack``, for each pair of blocks.
    They stand until the next pair's."""
    blocks = {n: _Block(r.rows, r.width, r.v) for n, r in held.items()}
    space = np.empty(max(len(b.ids) for b in blocks.values()) ** 2, np.float32)
    for i, j in pairs:
        x, y = blocks[i], blocks[j]
        s = space[: len(x.ids) * len(y.ids)].reshape(len(x.ids), len(y.ids))
        yield i, j, x, y, np.matmul(x.short, y.short.T, out=s)


def _blocks_and_pairs(rows: DataFrame, count: int, k: int | None, least: float | None, block_rows: int) -> tuple[DataFrame, DataFrame]:
    n = max(1, -(-count // block_rows))
    if n <= FEW_BLOCKS:
        blocks, pairs = _few_blocks(rows, n)
    else:
        blocks = blocks_of(rows, count, block_rows)
        pairs = block_pairs(blocks, k, least)
    return blocks if k is None else _with_own(blocks, k), pairs


def _found(tiles: DataFrame, k: int | None, least: float | None) -> DataFrame:
    """source, target, similarity, near: with ``k`` the ``k`` best targets that each row has in a tile (near, directed), with
    ``least`` every pair source < target of at least that similarity (not near)."""

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for held, pairs in _met(parts):
            best = {}
            for i, j, x, y, s in _products(held, pairs):
                if k is not None:
                    best.setdefault(i, _Best(x, k, held[i].own)).see(y, s, True)
                    if i != j:
                        best.setdefault(j, _Best(y, k, held[j].own)).see(x, s, False)
                if least is not None:
                    p, q = _where(s >= _limit(least, x.u.shape[1]))
                    near = _rounded(x.exact(p, y, q))
                    a, b = x.ids[p], y.ids[q]
                    kept = (near >= least) & ((a < b) if i == j else (a != b))
                    a, b = a[kept], b[kept]
                    yield np.minimum(a, b), np.maximum(a, b), near[kept], np.zeros(len(a), bool)
            for b in best.values():
                yield b.rows()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(found(parts), ["source", "target", "similarity", "near"])

    return tiles.mapInPandas(run, PAIRS)


def _scan(vectors: DataFrame, row_id: str, vector: str, k: int | None, least: float | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """source, target, similarity, near in one pass over the pairs of blocks that may hold any; see ``_found``."""
    rows = _rows(vectors, row_id, vector)
    count = rows.count()
    blocks, pairs = _blocks_and_pairs(rows, count, k, least, block_rows)
    return _found(_tiles(blocks, pairs, count, block_rows), k, least)


def _with_limits(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """``blocks`` with s and t of ``limits`` (row, s, t) in the order of their rows; rows without one are near to all."""
    own = blocks.select("block", F.posexplode("rows").alias("place", "row")).join(limits, "row", "left")
    kept = F.sort_array(F.collect_list(F.struct("place", F.coalesce("s", F.lit(float("-inf"))).alias("s"), F.coalesce("t", F.lit(2**63 - 1)).alias("t"))))
    own = own.groupBy("block").agg(kept.alias("l")).select("block", F.col("l.s").alias("s"), F.col("l.t").alias("t"))
    return blocks.join(cut(own, "limits"), "block")


def _edges(tiles: DataFrame, least: float | None) -> DataFrame:
    """Each pair source < target that is near (among the k best of either, by s and t of ``_with_limits``) or at least
    ``least`` (above), once, with the number of its rows that it is near to. So no edge has to be looked up among others."""
    none = "s" not in tiles.columns
    floor = np.inf if least is None else least

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for held, pairs in _met(parts):
            for i, j, x, y, s in _products(held, pairs):
                si, ti, sj, tj = (None,) * 4 if none else (held[i].s, held[i].t, held[j].s, held[j].t)
                width = x.u.shape[1]
                if none or (si.min() >= floor and sj.min() >= floor):
                    p, q = _where(s >= _limit(floor, width))
                else:
                    p, q = _where((s >= _limit(np.minimum(si, floor), width)[:, None]) | (s >= _limit(sj, width)[None, :]))
                if i == j:
                    p, q = (n[x.ids[p] < y.ids[q]] for n in (p, q))
                r = x.exact(p, y, q)
                real = np.isfinite(r) & (x.ids[p] != y.ids[q])
                p, q, r = p[real], q[real], _rounded(r[real])
                near = np.zeros(len(r), np.int32)
                if not none:
                    near += (r > si[p]) | ((r == si[p]) & (y.ids[q] <= ti[p]))
                    near += (r > sj[q]) | ((r == sj[q]) & (x.ids[p] <= tj[q]))
                above = r >= floor
                kept = above | (near > 0)
                a, b = x.ids[p[kept]], y.ids[q[kept]]
                yield np.minimum(a, b), np.maximum(a, b), np.rint(r[kept] * 1e6).astype(np.int32), near[kept], above[kept]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(found(parts), ["source", "target", "millionths", "near", "above"])

    return tiles.mapInPandas(run, EDGES)


def over_threshold(vectors: DataFrame, row_id: str, vector: str, least: float) -> DataFrame:
    """source < target, similarity (6 places) of all pairs with at least ``least``."""
    return _scan(vectors, row_id, vector, None, least).drop("near")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row; each task keeps k of a row before rows meet."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("similarity"), "target"))
    return found.select("source", "target", "similarity").withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, row_id: str, vector: str, k: int) -> DataFrame:
    """source, target, similarity, rank: the k most similar rows of each row, ties to the smaller id. Each
    tile sends k candidates per row, so the ranking sees a bounded number for each."""
    return _ranked(_scan(vectors, row_id, vector, k, None), k)


def chosen(mode: str, k: int, least: float) -> tuple[int | None, float | None]:
    """``k`` and ``least``, those of them that a graph of this mode looks at."""
    if mode not in ("knn", "threshold", "hybrid"):
        raise ValueError(mode)
    return None if mode == "threshold" else k, None if mode == "knn" else least


def graph(vectors: DataFrame, row_id: str, vector: str, mode: str = "hybrid", k: int = 5, least: float = 0.85, mutual_only: bool = False, most_edges: int | None = None) -> DataFrame:
    """Undirected edges source < target with similarity, whether both rank the other (mutual), and whether
    they come from the k nearest, the threshold, or both (hybrid). More than ``most_edges`` are an error. What is found is
    stored, so the edges may be used many times. Blocks are multiplied twice: for each row's k-th best, then for the edges,
    which are told by it where they are found. Only where ids repeat, what one pass finds is grouped by pair."""
    k, least = chosen(mode, k, least)
    rows = _rows(vectors, row_id, vector)
    count, different = rows.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    blocks, pairs = _blocks_and_pairs(rows, count, k, least, BLOCK_ROWS)
    pairs = pairs if k is None else cut(pairs, "met")
    tiles = _tiles(blocks, pairs, count, BLOCK_ROWS)
    if count > different:
        kept = cut(_found(tiles, k, least), "similar")
        ranked = _ranked(kept.where("near"), k or 0).select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "similarity", F.lit(1).alias("near"), F.lit(0).alias("above"))
        found = ranked.unionByName(kept.where("not near").select("source", "target", "similarity", F.lit(0).alias("near"), F.lit(1).alias("above")))
        edges = found.groupBy("source", "target").agg(F.max("similarity").alias("similarity"), F.sum("near").alias("near"), (F.max("above") > 0).alias("above"))
    else:
        limited = None if k is None else _with_limits(blocks, _ranked(_found(tiles, k, None), k).where(F.col("rank") == k).select(F.col("source").alias("row"), F.col("similarity").alias("s"), F.col("target").alias("t")))
        edges = cut(_edges(tiles if k is None else _tiles(limited, pairs, count, BLOCK_ROWS), least), "edges").withColumn("similarity", F.col("millionths") / 1e6)
    origin = F.when((F.col("near") > 0) & F.col("above"), "hybrid").when(F.col("near") > 0, "knn").otherwise("threshold")
    out = edges.select("source", "target", "similarity", (F.col("near") == 2).alias("mutual"), origin.alias("origin"))
    out = out.where("mutual or origin = 'threshold'") if mutual_only else out
    return out if most_edges is None else at_most(out, most_edges, "edges")
