"""Operator 1: mixing sources to target weights by the cube method.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of all
documents; a target stops at ``cap`` times its source's size, and the excess is shared by weight among the
others until none is above. That fixed point is a water level: target = min(weight * level, cap * size).

A document enters floor(rate) times for sure, rate being target / size of its source, and once more with
the fractional probability that is left. Those draws are balanced: within a source, blocks of documents
walk in the null space of two constraints (number of draws, words drawn) until at most two probabilities
per block stay fractional; these go on to the next, fewer blocks. The last two of a source land by a draw
each, as does one after the other of a small reserve (about ``reserve`` random documents of the source): the
words that a draw adds or takes away move the probabilities of the shorter documents that are left, so a
source misses its target by about its reserve's shortest documents. Every draw keeps its expectation.

All randomness comes from the source's number, the block and ``seed``, and rows walk from the longest
document to the shortest (then by doc_id): reruns agree, and what is left to land is short. Rows are dealt to blocks by
their id, size and their number among rows that are equal in these, so a block stays near ``block`` rows however often
a row repeats.

Edge cases: null or empty text has size 0: it costs nothing and its ``taken`` is 0. A source without words
has target 0. A null source is a source of its own; null doc_ids sort first; repeated rows are documents
of their own. Extra columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def flight(p: np.ndarray, z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: sum(p) and sum(z * p) are kept, at most two stay fractional.

    Three fractional rows at a time leave one direction free of both constraints; a fair step along it,
    as long as it goes either way, settles one row at least."""
    p = p.astype(float).copy()
    values, sizes = p.tolist(), z.astype(float).tolist()
    window: list[int] = []
    draws = iter(rng.random(2 * len(values) + 8).tolist())
    for i in range(len(values)):
        if not EPS < values[i] < 1 - EPS:
            continue
        window.append(i)
        while len(window) == 3:
            a, b, c = window
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - values[k]) / d if d > 0 else values[k] / -d for k, d in zip(window, u) if d)
            down = min(values[k] / d if d > 0 else (1 - values[k]) / -d for k, d in zip(window, u) if d)
            move = up if next(draws) * (up + down) < down else -down
            for k, d in zip(window, u):
                values[k] += move * d
                if values[k] <= EPS:
                    values[k] = 0.0
                elif values[k] >= 1 - EPS:
                    values[k] = 1.0
            window = [k for k in window if 0.0 < values[k] < 1.0]
    return np.array(values)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (source, doc_id, size, part, place) with ``again``: the number of each among its equals in source, id and
    size. ``part`` and ``place`` are a stored part's number and a row's place in it, so many equals are numbered part by part."""
    same = ["source", "doc_id", "size"]
    counts = rows.groupBy(*same, "part").agg(F.count(F.lit(1)).alias("held"))
    earlier = F.sum("held").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.withColumn("ahead", F.coalesce(earlier, F.lit(0))).where("ahead > 0").drop("held")
    own = rows.withColumn("again", F.row_number().over(Window.partitionBy(*same, "part").orderBy("place")))
    met = own.alias("o").join(ahead.alias("a"), reduce(lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"a.{c}")) for c in [*same, "part"]]), "left")
    return met.select("o.*", "a.ahead").withColumn("again", F.col("again") + F.coalesce("ahead", F.lit(0))).drop("ahead")


def _rng(key: tuple, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, *(int(k) & 0xFFFFFFFF for k in key)])


def _walk(seed: int, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "p"], ascending=[False, True, True], na_position="first", kind="stable")
        return rows.assign(p=flight(rows["p"].to_numpy(), rows["size"].to_numpy(), _rng((*key, level), seed)))

    return run


def descend(p: np.ndarray, z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draws for units sorted from the longest to the shortest that keep sum(z * p) as nearly as they can:
    the longer half walks on the words' constraint alone until one unit is left, which is drawn; the gap
    moves the probabilities of the shorter half, and so on."""
    p, start = p.astype(float).copy(), 0
    while start < len(p):
        stop = start + max(1, (len(p) - start) // 2)
        held = -1
        for i in range(start, stop):
            if not 0 < p[i] < 1 or z[i] <= 0:
                continue
            if held < 0:
                held = i
                continue
            a, b = held, i
            up = min((1 - p[a]) * z[a], p[b] * z[b])
            down = min(p[a] * z[a], (1 - p[b]) * z[b])
            move = up if rng.random() * (up + down) < down else -down
            p[a] += move / z[a]
            p[b] -= move / z[b]
            for k in (a, b):
                p[k] = 0.0 if p[k] <= EPS else 1.0 if p[k] >= 1 - EPS else p[k]
            held = next((k for k in (a, b) if 0 < p[k] < 1), -1)
        if held >= 0:
            drawn = float(rng.random() < p[held])
            gap, p[held] = z[held] * (drawn - p[held]), drawn
            rest = slice(stop, None)
            room = (z[rest] * (p[rest] if gap > 0 else 1 - p[rest]) * ((p[rest] > 0) & (p[rest] < 1))).sum()
            if room > 0:
                share = min(1.0, abs(gap) / room)
                live = (p[rest] > 0) & (p[rest] < 1)
                p[rest] = np.where(live, p[rest] * (1 - share) if gap > 0 else p[rest] + (1 - p[rest]) * share, p[rest])
        start = stop
    return (p > 0.5).astype(float)


def _land(seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rng = _rng((*key, 99), seed)
        rows = rows.sort_values(["reserved", "size", "doc_id", "p"], ascending=[True, False, True, True], na_position="first", kind="stable").reset_index(drop=True)
        p, z, last = rows["p"].to_numpy(float).copy(), rows["size"].to_numpy(float), rows["reserved"].to_numpy(bool)
        p[~last] = flight(p[~last], z[~last], rng)
        first = np.flatnonzero(~last & (p > 0) & (p < 1))
        order = np.concatenate([first, np.flatnonzero(last)])
        p[order] = descend(p[order], z[order], rng)
        return rows.assign(p=p)

    return run


def targets(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_no, source_size, n, target: one row per source of ``docs`` (source, size).

    The windows run over sources, of which there are few; documents are summed before."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sums.withColumn("source_no", F.row_number().over(one) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_level = Window.orderBy((cap * F.col("source_size") / F.col("weight")).asc(), F.col("source_no"))
    filled = (
        weighed.withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum(cap * F.col("source_size")).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_words") - F.col("capped_before")) / F.col("weight_left"))
    )
    # the level is the first that its own source can take in
    fits = filled.withColumn("ok", F.col("level") * F.col("weight") <= cap * F.col("source_size") + EPS)
    level = F.min(F.when(F.col("ok"), F.struct((cap * F.col("source_size") / F.col("weight")).alias("x"), "source_no", "level"))).over(everything)
    return fits.withColumn("water", level["level"]).select(
        "source", "source_no", "source_size", "n",
        F.coalesce(F.least(F.col("water") * F.col("weight"), cap * F.col("source_size")), cap * F.col("source_size"), F.lit(0.0)).alias("target"),
    )


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, block: int = 1024, reserve: int = 128, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and the columns of ``keep`` for every row of ``docs``
    (doc_id, text, source)."""
    keep = keep or []
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "sizes")
    rows = numbered(rows)
    aims = cut(targets(rows.select("source", "size"), weights, cap), "targets")
    rated = rows.join(aims, rows["source"].eqNullSafe(aims["source"])).select(
        "doc_id", *keep, "size", "again", "source_no", "source_size", "target", "n",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )
    whole = rated.withColumn("sure", F.floor(F.col("rate") + EPS).cast("int"))
    split = whole.withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0))).otherwise(F.lit(0.0)))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1))
    dealt = split.withColumn("b", F.pmod(F.xxhash64("doc_id", "size", "again", F.lit(seed)), blocks))
    dealt = dealt.withColumn("reserved", (F.col("p") > 0) & (F.pmod(F.xxhash64("doc_id", "size", "again", F.lit(seed + 1)), F.greatest("n", F.lit(1))) < reserve)).drop("n", "rate", "again")
    schema = dealt.schema
    kept_back = dealt.where("reserved")
    dealt = dealt.where("not reserved")
    done: list[DataFrame] = []
    level = 0
    while True:
        walked = cut(dealt.groupBy("source_no", "b").applyInPandas(_walk(seed, level), schema), "walk")
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(walked.where(settled))
        dealt = walked.where(~settled).withColumn("b", F.floor(F.col("b") / (block // 2)).cast("long"))
        level += 1
        if walked.where(~settled).groupBy("source_no").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block).isEmpty():
            break
    landed = dealt.unionByName(kept_back).withColumn("b", F.lit(0).cast("long")).groupBy("source_no", "b").applyInPandas(_land(seed), schema)
    all_rows = reduce(DataFrame.unionByName, [*done, landed])
    copies = F.col("sure") + F.round("p").cast("int")
    return all_rows.select("doc_id", *keep, "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
