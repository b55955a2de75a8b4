"""Operator 12: hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Vectors are integer (floor of ``scale`` * x), a row's score for an anchor is their inner product. Rows are packed into
blocks of bounded size, those of one label into blocks of one bucket of labels; in a block every dimension has its rows
in sorted order. For an anchor, a dimension's list is read from its large end where the anchor's component is positive,
from its small end where it's negative (sorted access); each row met is scored whole (random access). What the lists
stand at, times the anchor's components, bounds the score of every row not met yet: the threshold.

1. Positives: anchor blocks travel to the blocks of their own bucket of labels. Reading stops once the threshold falls
   strictly below the k-th best score of the anchor's label; the best of all blocks are ranked.
2. Negatives: the anchors travel on, with a window of scores for each positive, to all blocks. Reading stops once for
   each window the threshold is strictly below its k-th best score so far, or below the window.

Anchor blocks travel by equi-joins on the row block; row blocks are stored in buckets of it and stay. Each block sends k
rows of a window at most.

Edge cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; nor do
vectors of another length than the anchor's. Rows that have the anchor's vec_id are never its positives or negatives;
rows that repeat an anchor's vec_id are anchors of their own, and repeated rows count each. Components and scores beyond a long
stand at its limits. An anchor without positives, a positive whose score is negative and a window without rows give none.
Extra columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.top_k import BLOCK_VALUES, HIGH, LOW, quantised
from tessera.sources.shared import cut, cut_by

BUCKETS = 16  # of labels
FIRST_DEPTH = 32  # entries of each list read at first; then twice as many
POSITIVE = "anchor long, anchor_id long, positive_id long, score long"
NEGATIVE = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def usable(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """rid, vec_id, label, q, dim, bucket of every row that takes part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding").where("vec_id is not null and label is not null and embedding is not null").where(finite)
    made = kept.select("vec_id", "label", quantised(F.col("embedding"), scale).alias("q"))
    return made.withColumns({"dim": F.size("q"), "bucket": F.pmod(F.xxhash64("label"), F.lit(BUCKETS)), "rid": F.monotonically_increasing_id()})


def _packed(rows: DataFrame, values: int, fields: list[str]) -> DataFrame:
    """dim, bucket, block, blocks, rows: blocks of about the same bounded size."""
    size = F.greatest(F.floor(F.lit(values) / F.greatest("dim", F.lit(1))), F.lit(1))
    counts = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n")).select("dim", "bucket", F.ceil(F.col("n") / size).alias("blocks"))
    dealt = rows.join(counts, ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    return dealt.groupBy("dim", "bucket", "block", "blocks").agg(F.collect_list(F.struct(*fields)).alias("rows"))


class Lists:
    """Sorted lists of the dimensions of some rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.order, axis=0) if vectors.size else vectors

    def reads(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
        """(rows met so far, their scores, threshold) at each depth; the threshold is None once all rows are met. The
        arrays only grow: rows keep their places."""
        n, up, down = len(self.ids), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, scores = np.zeros(0, np.int64), np.zeros(0, anchor.dtype)
        seen, depth = np.zeros(n, bool), FIRST_DEPTH if len(up) + len(down) else n
        while True:
            if depth >= n:
                new = np.flatnonzero(~seen)
            else:
                before = seen.copy()
                seen[self.order[n - depth :, up]] = True
                seen[self.order[:depth, down]] = True
                new = np.flatnonzero(seen & ~before)
            own = self.rows[new] @ anchor
            met, scores = np.concatenate([met, new]), np.concatenate([scores, np.clip(own, LOW, HIGH) if own.dtype == object else own])
            if depth >= n:
                yield met, scores, None
                return
            yield met, scores, (anchor[up] * self.sorted[n - depth, up]).sum() + (anchor[down] * self.sorted[depth - 1, down]).sum()
            depth *= 2


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        held = np.flatnonzero(scores >= least)
    else:
        held = np.arange(len(scores))
    return held[np.lexsort((ids[held], -scores[held]))][:k]


def nearest(lists: Lists, anchor_id: int, anchor: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(vec_id, score) of the k best rows."""
    for met, scores, threshold in lists.reads(anchor):
        other = lists.ids[met] != anchor_id
        ids, own = lists.ids[met][other], scores[other]
        best = _first(ids, own, k)
        if threshold is None or len(best) == k and threshold < own[best[-1]]:
            return [(int(ids[i]), int(own[i])) for i in best]
    return []


def in_windows(lists: Lists, labels: np.ndarray, anchor_id: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (least, most) the (vec_id, score) of the k best rows of other labels whose score is in it."""
    for met, scores, threshold in lists.reads(anchor):
        other = (lists.ids[met] != anchor_id) & (labels[met] != label)
        ids, own = lists.ids[met][other], scores[other]
        out, ended = [], True
        for least, most in windows:
            held = np.flatnonzero((own >= least) & (own <= most))
            best = held[_first(ids[held], own[held], k)]
            ended = ended and (threshold is None or threshold < least or len(best) == k and bool(threshold < own[best[-1]]))
            out.append([(int(ids[i]), int(own[i])) for i in best])
        if ended:
            return out
    return [[] for _ in windows]


def _block(rows: pa.StructScalar) -> tuple:
    """(fields, ids, labels, vectors) of a block."""
    held = rows.values
    ids = held.field("vec_id").to_numpy(zero_copy_only=False)
    return held, ids, held.field("label").to_numpy(zero_copy_only=False), held.field("q").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _exact(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where sums of their products stay below 2**53, else as Python integers."""
    most = lambda x: int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    kind = np.float64 if q.shape[1] * most(q) * most(v) < 1 << 53 else object
    return q.astype(kind), v.astype(kind)


def _positives(k: int):
    names = [x.split()[0] for x in POSITIVE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors, rows in zip(batch.column("anchors"), batch.column("rows")):
                (held, aid, alabel, a), (_, vid, vlabel, v) = _block(anchors), _block(rows)
                a, v = _exact(a, v)
                number, out = held.field("rid").to_numpy(zero_copy_only=False), []
                for label in np.intersect1d(alabel, vlabel).tolist():
                    own = vlabel == label
                    lists = Lists(vid[own], v[own])
                    for i in np.flatnonzero(alabel == label).tolist():
                        out += [(int(number[i]), int(aid[i]), *x) for x in nearest(lists, int(aid[i]), a[i], k)]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(4)], names=names)

    return run


def _negatives(k: int, least: int, whole: int):
    fields = [x.rpartition(" ") for x in NEGATIVE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors, rows in zip(batch.column("anchors"), batch.column("rows")):
                (held, aid, alabel, a), (_, vid, vlabel, v) = _block(anchors), _block(rows)
                a, v = _exact(a, v)
                lists, number, out = Lists(vid, v), held.field("rid").to_numpy(zero_copy_only=False), []
                for i, positives in enumerate(held.field("positives").to_pylist()):
                    different = sorted({p["score"] for p in positives if p["score"] >= 0}, reverse=True)
                    windows = [(-(-least * s // whole), s) for s in different]
                    found = dict(zip(different, in_windows(lists, vlabel, int(aid[i]), int(alabel[i]), a[i], windows, k))) if windows else {}
                    out += [(int(number[i]), int(aid[i]), p["place"], p["positive_id"], p["score"], *x) for p in positives for x in found.get(p["score"], [])]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int32() if kind == "int" else pa.int64()) for j, (_, _, kind) in enumerate(fields)], names=[f[0] for f in fields])

    return run


def _best(found: DataFrame, by: list[str], score: str, ids: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), ids))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, block_values: int = BLOCK_VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that ``is_anchor`` (over
    vec_id) names and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels
    that score at least ``percent`` per cent of the positive and no more than it. ``vectors``: vec_id, embedding, label."""
    if positives < 1 or negatives < 1 or not 0 <= percent <= 100 or block_values < 1:
        raise ValueError("positives, negatives and block_values must be positive and percent in 0..100")
    rows = cut(usable(vectors, F.col("label") if label is None else label, scale), "mined")
    key = ["dim", "bucket", "block"]
    blocks = cut_by(_packed(rows, block_values, ["vec_id", "label", "q"]), "row_blocks", key)
    places = blocks.groupBy("dim", "bucket").agg(F.max("blocks").alias("row_blocks"))
    anchors = rows.where(is_anchor)

    def met(asked: DataFrame, fields: list[str], on: list[str]) -> DataFrame:
        own = [c for c in ("dim", "bucket") if c in on]
        packed = _packed(asked, block_values, fields).select(*own, F.col("rows").alias("anchors"))
        sent = packed.join(places, own).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_blocks") - 1)))
        return sent.join(blocks.select(*key, "rows"), key).select("anchors", "rows")

    near = met(anchors, ["rid", "vec_id", "label", "q"], ["dim", "bucket"]).mapInArrow(_positives(positives), POSITIVE)
    chosen = _best(near, ["anchor"], "score", "positive_id", positives)
    held = cut(chosen.groupBy("anchor").agg(F.collect_list(F.struct(F.col("rank").cast("int").alias("place"), "positive_id", "score")).alias("positives")), "positives")
    asked = anchors.join(held.withColumnRenamed("anchor", "rid"), "rid")
    found = met(asked, ["rid", "vec_id", "label", "q", "positives"], ["dim"]).mapInArrow(_negatives(negatives, percent, 100), NEGATIVE)
    out = _best(found, ["anchor", "place"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
