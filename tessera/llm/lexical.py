"""Operator 11: exact ranked lexical search by term-at-a-time accumulators inside document-at-a-time skipping.

Documents are cut into shards of bounded bytes. ``index`` keeps, for each shard and term, the documents that hold it
and how often, and for each shard one header (term '') with its documents' ids and lengths. ``search`` meets the
index with the items' terms by an equi-join on the term; items travel in blocks of ``ITEMS``, so a shard and a block of
items meet in one group, which holds a shard's lists and no more. In it, for each item:

1. Term at a time: the lists of its short terms are summed into accumulators. The k-th best sum is a first cutoff.
2. Document at a time: the accumulators are one more list, with a bound in each window of ``WINDOW`` documents, as every
   long list has (the greatest contribution in that window). Windows follow in document order; one whose bounds add up
   to less than the cutoff is skipped unread. In the others the long lists are added by falling bound, until what is
   left can't reach the cutoff; what reaches it raises the cutoff.

Each shard sends k documents of an item at most. A term is a maximal run of letters, digits and all beyond ASCII, with
A-Z lower-cased. Numbers of documents and terms cover the whole table; a term's weight is computed in doubles, all else
in 64-bit integers (in Python's where products would pass them).

Edge cases: null and empty texts hold no term: they are in no number and in no result. Rows with a null doc_id are
documents and come last among equal scores; rows that repeat a doc_id are documents of their own. An item without a
term, or whose terms no document holds, has no row; repeated items and items with a null id have rows each. Scores of 0
are left out. Extra columns are not read; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import rows_of, slices, words
from tessera.sources.shared import cut

SHARD = 8 << 20  # bytes of text
ITEMS = 256  # items that travel together
WINDOW = 256  # documents of a shard whose bounds are taken together
SHORT = 16  # a term is short if at most one in so many documents of the shard holds it
LARGEST = (1 << 63) - 1
INDEX = "shard long, term string, held int, docs array<int>, times array<int>, ids array<long>, lengths array<long>"
_KEPT = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TERMS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, vocabulary) of the terms of each text."""
    texts = pc.fill_null(texts, "")
    _, ends, data = texts.buffers()
    start, stop = texts.offset, texts.offset + len(texts)
    plain = pa.py_buffer(data.to_pybytes().translate(_TERMS) if data is not None else b"")
    return words(pa.StringArray.from_buffers(stop, ends, plain).slice(start) if len(texts) else texts)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("held", pa.int32()), ("docs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
    shard = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, most=SHARD):
            part = part.take(pc.sort_indices(part.column("doc_id")))  # equal scores go by doc_id, so by place
            offsets, codes, vocabulary = terms(part.column("text"))
            keys, times = np.unique(codes.astype(np.int64) << 32 | rows_of(offsets), return_counts=True)
            term, doc = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
            held = np.bincount(term, minlength=len(vocabulary))
            ends = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
            used = held > 0
            none = pa.nulls(len(vocabulary), pa.list_(pa.int64()))
            found = pa.RecordBatch.from_arrays([pa.array(np.full(len(vocabulary), shard)), vocabulary.cast(pa.string()), pa.array(held.astype(np.int32)), lists(doc), lists(times), none, none], schema=schema)
            yield found.filter(pa.array(used))
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), x)
            empty = pa.nulls(1, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([""]), pa.array([0], pa.int32()), empty, empty, whole(part.column("doc_id")), whole(pa.array(np.diff(offsets)))], schema=schema)
            shard += 1


def index(docs: DataFrame) -> DataFrame:
    """The stored index of every row of ``docs`` (doc_id, text): shard, term, held (number of documents), docs (places in
    the shard), times; and a header of each shard with ids and lengths."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(_postings, INDEX), "index")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SHARD):
            offsets, codes, vocabulary = terms(part.column("text"))
            keys, times = np.unique(rows_of(offsets) << 32 | codes, return_counts=True)
            row = pa.array(keys >> 32)
            yield pa.RecordBatch.from_arrays([part.column("item").take(row), part.column("item_id").take(row), vocabulary.take(pa.array(keys & 0xFFFFFFFF)), pa.array(times.astype(np.int64))], names=["item", "item_id", "term", "times"])


def lengths_scaled(n: np.ndarray, held: int, total: int) -> np.ndarray:
    """100 - 25 + (25 * n * held) div total of each length."""
    if 25 * int(n.max(initial=0)) * held > LARGEST:
        return np.array([75 + 25 * int(x) * held // total for x in n], np.int64)
    return 75 + 25 * n * held // total


def impacts(times: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 12 * m) of each posting."""
    return 1_000_000_000 * times // (1000 * times + 12 * scaled)


class _Shard:
    """The lists of a shard that a block of items asks for, with the bounds of their windows."""

    def __init__(self, part: pa.Table, held: int, total: int):
        header = part.filter(pc.equal(part["term"], ""))
        lists = part.filter(pc.not_equal(part["term"], "")).combine_chunks()
        self.ids = header["ids"].combine_chunks().flatten()
        scaled = lengths_scaled(header["lengths"].combine_chunks().flatten().to_numpy(zero_copy_only=False), held, total)
        self.size, self.items = len(scaled), lists["items"].to_pylist()
        self.weight = lists["weight"].to_numpy()
        one = lambda c: lists[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if lists.num_rows else np.zeros(0, np.int64)
        self.doc, times = one("docs"), one("times")
        self.ends = np.concatenate([[0], np.cumsum(lists["held"].to_numpy().astype(np.int64))])
        self.impact = impacts(times, scaled[self.doc])
        self.windows = -(-self.size // WINDOW)
        self.edges = np.arange(self.windows + 1) * WINDOW
        self._bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, t: int) -> slice:
        return slice(int(self.ends[t]), int(self.ends[t + 1]))

    def windows_of(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each window of a list begins, and the list's greatest impact in it."""
        if t not in self._bounds:
            at = self.list_of(t)
            marks = np.searchsorted(self.doc[at], self.edges)
            most, full = np.zeros(self.windows, np.int64), marks[1:] > marks[:-1]
            most[full] = np.maximum.reduceat(self.impact[at], marks[:-1][full])
            self._bounds[t] = marks + at.start, most
        return self._bounds[t]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 1


def best_of(shard: _Shard, asked: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best documents of a shard for an item's (list, weight with repeats), best first, equal
    scores by place."""
    sums = np.zeros(shard.windows * WINDOW, np.int64)
    long = []
    for t, weight in asked:
        at = shard.list_of(t)
        if (at.stop - at.start) * SHORT <= shard.size:
            sums[shard.doc[at]] += weight * shard.impact[at]
        elif weight:
            long.append((t, weight))
    cutoff = max(1, _kth(sums[sums > 0], k))
    bound = sums.reshape(-1, WINDOW).max(axis=1) if shard.windows else np.zeros(0, np.int64)
    lists = [(weight, *shard.windows_of(t)) for t, weight in long]
    for weight, _, most in lists:
        bound = bound + weight * most
    place, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for w in np.flatnonzero(bound >= cutoff).tolist():
        if bound[w] < cutoff:  # it has risen since
            continue
        base = w * WINDOW
        own = sums[base : base + WINDOW].copy()
        here = sorted(((weight * int(most[w]), weight, int(marks[w]), int(marks[w + 1])) for weight, marks, most in lists if most[w]), reverse=True)
        left = sum(x[0] for x in here)
        for most, weight, a, b in here:
            if int(own.max()) + left < cutoff:
                break
            own[shard.doc[a:b] - base] += weight * shard.impact[a:b]
            left -= most
        else:
            reached = np.flatnonzero(own >= cutoff)
            place, score = np.concatenate([place, reached + base]), np.concatenate([score, own[reached]])
            if len(place) > k:
                order = np.lexsort((place, -score))[:k]
                place, score = place[order], score[order]
            if len(place) == k:
                cutoff = max(cutoff, int(score.min()))
    order = np.lexsort((place, -score))
    return place[order], score[order]


def _searched(k: int, held: int, total: int):
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        shard = _Shard(part, held, total)
        asked: dict[tuple, list[tuple[int, int]]] = {}
        for t, items in enumerate(shard.items):
            for x in items:
                asked.setdefault((x["item"], x["item_id"]), []).append((t, int(shard.weight[t]) * x["times"]))
        out = [pa.table([pa.array([], f.type) for f in schema], schema=schema)]
        for (item, item_id), lists in asked.items():
            place, score = best_of(shard, lists, k)
            out.append(pa.table([pa.array([item] * len(place), pa.int64()), pa.array([item_id] * len(place), pa.int64()), shard.ids.take(pa.array(place)), pa.array(score)], schema=schema))
        return pa.concat_tables(out)

    return run


def search(held_index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the index for each row of ``items`` (item_id, text)."""
    if k < 1:
        raise ValueError("k must be positive")
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id())
    asked = cut(named.mapInArrow(_asked, "item long, item_id long, term string, times long"), "asked")
    whole = held_index.where("term = ''").agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("held"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("total")).first()
    held, total = whole["held"] or 0, whole["total"] or 0
    number = held_index.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * held + 2)) / (2 * F.col("df") + 1).cast("double")))
    blocks = max(1, -(-asked.select("item").distinct().count() // ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    lists = asked.withColumn("block", block).groupBy("block", "term").agg(F.collect_list(F.struct("item", "item_id", "times")).alias("items")).join(number, "term").select("block", "term", weight.alias("weight"), "items")
    header = asked.sparkSession.range(blocks).select(F.col("id").alias("block"), F.lit("").alias("term"), F.lit(0).cast("long").alias("weight"), F.array().cast("array<struct<item:bigint,item_id:bigint,times:bigint>>").alias("items"))
    wanted = cut(lists.unionByName(header), "wanted")
    met = held_index.join(wanted, "term").groupBy("shard", "block")
    found = met.applyInArrow(_searched(k, held, total), "item long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``search`` over an index of ``docs``."""
    return search(index(docs), items, k)
