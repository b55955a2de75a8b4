"""Operator 2: exact top-k inner-product search by a three-phase uniform threshold.

Vectors are integer: floor(``scale`` * x) of each component. Their dimensions are dealt to ``lists`` score
lists; a vector's score for a query is the sum of its list scores. Rows are packed into blocks of bounded size,
which stay where they are; every query block travels to every row block, by an equi-join on the row block.

1. Each row block reads one of its score lists, the block's number says which, and sends for each query the
   whole scores of that list's ``k`` best rows. The k-th best score of a query so far is a safe cutoff: no row
   below it can be among its k best.
2. The cutoffs go out with the query blocks. A score of at least the cutoff needs a list score of at least
   cutoff / ``lists``, so each block collects, list by list, just the entries over that uniform threshold. A list's
   norms bound its scores: lists, queries and whole blocks that can't reach the threshold are not multiplied.
3. The scores of the rows collected are resolved exactly over all lists; those that reach the cutoff are
   ranked, ties to the smaller vec_id.

A query with fewer than k candidates has no cutoff and collects all of them.

Edge cases: null vectors, vectors with null or non-finite components and rows with null vec_id take no
part; nor do vectors of another length than the query's (they have no inner product). Every row is a candidate of
its own, also where rows repeat a vec_id, except rows with the query's vec_id; rows that repeat a query's vec_id are one
query with several vectors. Components and scores beyond a long stand at its limits; scores are exact below. Empty
vectors score 0. An empty table gives no rows; fewer than k candidates give all of them. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut, cut_by

BLOCK_VALUES = 1 << 19  # components of a block
CHUNK = 256  # queries multiplied at once
PRODUCTS = 1 << 21  # components of entries resolved at once
ENTRY = "query_id long, vec_id long, score long"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(float(LOW))), F.lit(float(HIGH)))).cast("long"))


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, q, dim, wide, rid: every row whose vector is whole and finite. ``wide`` ones may have products beyond 2**53."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    made = kept.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("q")).withColumn("dim", F.size("q"))
    most = F.sqrt(F.lit(2.0**53) / F.greatest("dim", F.lit(1)))
    wide = F.exists("q", lambda x: (x.cast("double") >= most) | (x.cast("double") <= -most))
    return made.withColumns({"wide": wide, "rid": F.monotonically_increasing_id()})


def _packed(rows: DataFrame, name: str, values: int, fields: list[str]) -> DataFrame:
    """Blocks of about the same bounded size; a block's rows have one dimension, wide ones smaller blocks of their own."""
    size = F.greatest(F.floor(F.lit(values) / F.greatest("dim", F.lit(1)) / F.when(F.col("wide"), 64).otherwise(1)), F.lit(1))
    counts = rows.groupBy("dim", "wide").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / size)).drop("n")
    dealt = rows.join(counts, ["dim", "wide"]).withColumn(name, F.pmod(F.xxhash64("rid"), F.col("blocks")))
    return dealt.groupBy("dim", "wide", name, "blocks").agg(F.collect_list(F.struct(*fields)).alias("rows"))


def _arrays(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """ids, vectors and all fields of a block."""
    held = rows.values
    ids = held.field("vec_id").to_numpy(zero_copy_only=False)
    return ids, held.field("q").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), held


def _exact(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where sums of their products stay below 2**53, else as Python integers."""
    most = lambda x: int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    kind = np.float64 if q.shape[1] * most(q) * most(v) < 1 << 53 else object
    return q.astype(kind), v.astype(kind)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _long(x: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(i), LOW), HIGH) for i in x], np.int64) if x.dtype == object else x.astype(np.int64)


def _best(k: int, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """The k best entries of each query, ties to the smaller row id."""
    order = np.lexsort((row, -score.astype(object) if score.size and score.min() == LOW else -score, query))
    query, row, score = query[order], row[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    kept = place < k
    return pa.RecordBatch.from_arrays([pa.array(query[kept]), pa.array(row[kept]), pa.array(score[kept])], names=["query_id", "vec_id", "score"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block number, query ids, query fields, queries, row ids, rows) of a few queries at a time."""
    for batch in batches:
        for number, queries, rows in zip(batch.column("row_block").to_pylist(), batch.column("queries"), batch.column("rows")):
            (qid, q, fields), (vid, v, _) = _arrays(queries), _arrays(rows)
            q, v = _exact(q, v)
            for a in range(0, len(qid), CHUNK):
                yield number, qid[a : a + CHUNK], fields[a : a + CHUNK], q[a : a + CHUNK], vid, v


def _gather(k: int, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, qid, _, q, vid, v in _chunks(batches):
            m = min(lists, max(1, q.shape[1]))
            of_list = (q[:, number % m :: m] @ v[:, number % m :: m].T) if q.shape[1] else np.zeros((len(q), len(v)))
            of_list = np.where(qid[:, None] == vid[None, :], -np.inf, of_list.astype(np.float64))
            n = min(k, len(vid))
            found = np.argpartition(-of_list, n - 1, axis=1)[:, :n]
            a, b = np.repeat(np.arange(len(qid)), n), found.ravel()
            other = qid[a] != vid[b]
            a, b = a[other], b[other]
            yield _best(k, qid[a], vid[b], _long((q[a] * v[b]).sum(axis=1)))

    return run


def _collect(k: int, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, qid, fields, q, vid, v in _chunks(batches):
            m = min(lists, max(1, q.shape[1]))
            held = fields.field("cutoff").to_pylist()
            none = np.array([c is None or c == LOW for c in held])
            cutoff = np.array([0 if c is None else c for c in held], q.dtype)
            # phase 2: entries over the uniform threshold, in any list. A list whose longest row is too short to reach it is
            # not read for that query, and a query that no list nor all together can reach the cutoff for isn't either
            most = [_norms(q[:, j::m]) * _norms(v[:, j::m]).max(initial=0.0) * (1 + 1e-9) for j in range(m)]
            asked = none | (sum(most) >= cutoff.astype(np.float64))
            over = np.repeat(none[:, None], len(vid), axis=1)
            for j in range(m):
                read = np.flatnonzero(asked & ~none & (most[j] * m >= cutoff.astype(np.float64)))
                if len(read):
                    over[read] |= ((q[read, j::m] @ v[:, j::m].T) * m >= cutoff[read, None]).astype(bool)
            if not q.shape[1]:
                over |= (cutoff <= 0).astype(bool)[:, None]
            over &= qid[:, None] != vid[None, :]
            a, b = np.nonzero(over)
            # phase 3: what is left is resolved over all lists, a bounded number of entries at a time
            step = max(1, PRODUCTS // max(1, q.shape[1]))
            whole = _long(np.concatenate([(q[a[i : i + step]] * v[b[i : i + step]]).sum(axis=1) for i in range(0, len(a), step)] or [np.zeros(0, q.dtype)]))
            kept = none[a] | (whole >= np.array([LOW if c is None else c for c in held], np.int64)[a])
            # many rows may tie at the cutoff; of one block, no more than k can be among the best
            yield _best(k, qid[a[kept]], vid[b[kept]], whole[kept])

    return run


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    """The k best entries of each query; each task sends k of them at most."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, lists: int = 4, block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` (vec_id, embedding) for each row that
    ``is_query`` (over vec_id) names."""
    if k < 1 or lists < 1 or block_values < 1:
        raise ValueError("k, lists and block_values must be positive")
    rows = cut(usable(vectors, scale), "quantised")
    asked = rows.where(is_query)
    key = ["dim", "wide", "row_block"]
    blocks = cut_by(_packed(rows, "row_block", block_values, ["vec_id", "q"]), "row_blocks", key)
    places = blocks.groupBy("dim", "wide").agg(F.max("blocks").alias("row_blocks"))

    def met(queries: DataFrame, fields: list[str]) -> DataFrame:
        packed = _packed(queries, "query_block", block_values, fields).select("dim", F.col("rows").alias("queries"))
        sent = packed.join(places, "dim").withColumn("row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_blocks") - 1)))
        return sent.select("dim", "wide", "row_block", "queries").join(blocks.select(*key, "rows"), key).select("row_block", "queries", "rows")

    seen = cut(_ranked(met(asked, ["vec_id", "q"]).mapInArrow(_gather(k, lists), ENTRY), k), "seen")
    cutoffs = seen.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    return _ranked(met(asked.join(cutoffs, "vec_id", "left"), ["vec_id", "q", "cutoff"]).mapInArrow(_collect(k, lists), ENTRY), k)
