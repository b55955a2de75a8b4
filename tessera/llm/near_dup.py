"""Operator 10: near-duplicate groups by fast similarity sketching, banding and exact verification.

Each document's set holds its distinct shingles (``shingle`` words, A-Z lower-cased; a shorter text is
one shingle). Its sketch has ``BINS`` bins (Dahlgaard, Knudsen, Thorup 2017): in each of the first BINS
rounds every element falls into a hashed bin with a hashed value, in the next BINS rounds into a fixed
bin, until no bin is empty; a bin keeps its least (round, value), so every coordinate fills. Equal sets
collapse to one class first. Classes that share a band are candidates; only an exact comparison of full
sets makes a link.

Large groups: within a band's bucket, members are first compared with one pivot (a star). Linked members
share a component, which makes the pairs among them needless; further rounds compare only members of
different components, with another pivot each. What is left then meets by prefixes, not by buckets: with each
set's shingles ordered from rare to common, two sets as similar as asked for share one of the first
n - ceil(n * percent / 100) + 1, so a passage or template that many documents hold makes no pairs.
Before the pivots, shingles that few candidates have bound each member's similarity. Pairs that share such a rare
shingle are looked up by it and compared; a copy with so many rare shingles that nothing else in its bucket
can reach the threshold then leaves the bucket, which loses no link. So a group of copies costs about its
size.

Edge cases: null or empty text (or only white space) has an empty set: 0 shingles, linked with nothing.
Null doc_id: takes part, never kept, never a component's id unless no member has one. Rows that repeat a
doc_id are one document with the links of all its texts: kept or dropped together. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import merged
from tessera.llm.text import mix, ragged, rows_of, slices, words
from tessera.sources.shared import cut

BINS = 128
BAND_ROWS = 5
PIVOT_ROUNDS = 3
RARE = 8
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct 64-bit shingle hashes of each text."""
    offsets, codes, vocabulary = words(texts, lower=True)
    named = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.cast(pa.binary()).to_pylist()), np.uint64, len(vocabulary))
    own = named[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    counts = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    starts = offsets[:-1]
    sums = np.zeros(int(counts.sum()), np.uint64)
    at = ragged(starts, counts)
    room = np.repeat(np.minimum(n, shingle), counts)
    for k in range(shingle):
        full = room > k
        if full.all():
            sums += own[at + k] * _FACTORS[k % len(_FACTORS)] * np.uint64(2 * (k // len(_FACTORS)) + 1)
        else:
            sums[full] += own[at[full] + k] * _FACTORS[k % len(_FACTORS)] * np.uint64(2 * (k // len(_FACTORS)) + 1)
    hashes = mix(sums + room.astype(np.uint64), 1)
    rows = np.repeat(np.arange(len(n)), counts)
    ends = np.cumsum(counts)
    for a, b in zip(ends - counts, ends):
        hashes[a:b].sort()
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[first], rows[first]
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=len(n)), out=out[1:])
    return out, hashes


def sketches(offsets: np.ndarray, hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` (round << 56 | value) for each set; rows of empty sets mean nothing."""
    docs = len(offsets) - 1
    out = np.full((docs, bins), np.iinfo(np.uint64).max, np.uint64)
    empty = np.iinfo(np.uint64).max
    live, rows = hashes, rows_of(offsets)
    flat = out.reshape(-1)
    for r in range(2 * bins):
        if not len(live):
            break
        h = mix(live, 11 + r)
        b = (h % np.uint64(bins)).astype(np.int64) if r < bins else np.full(len(live), r - bins)
        np.minimum.at(flat, rows * bins + b, (np.uint64(r) << np.uint64(56)) | (h >> np.uint64(8)))
        short = (out == empty).any(axis=1)
        more = short[rows]
        live, rows = live[more], rows[more]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each document and band of ``rows`` bins."""
    bands = sketch.shape[1] // rows
    keys = np.zeros((len(sketch), bands), np.uint64)
    for k in range(rows):
        keys = mix(keys ^ sketch[:, k : bands * rows : rows], 31 + k)
    return mix(keys ^ np.arange(bands, dtype=np.uint64), 7).view(np.int64)


def _sketched(shingle: int, band_rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=8 << 20):
                offsets, hashes = shingle_sets(part.column("text"), shingle)
                keys = band_keys(sketches(offsets, hashes), band_rows)
                n = np.diff(offsets)
                fps = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(offsets, offsets[1:])]
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, keys.shape[1], 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("text_hash"), pa.array(n), pa.array(fps, pa.binary()), bands], schema=schema)

    return run, "doc_id long, text_hash long, n_shingles long, fp binary, bands array<long>"


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. The second set of a
    pair travels; the first meets it at its own key."""
    right = pairs.join(sets.select(F.col("fp").alias("b"), F.col("members").alias("mb")), "b")
    both = right.join(sets.select(F.col("fp").alias("a"), F.col("members").alias("ma")), "a")
    shared = F.size(F.array_intersect("ma", "mb"))
    return both.where(100 * shared >= percent * (F.size("ma") + F.size("mb") - shared)).select("a", "b")


def within(percent: int, n: str, u: str, other_n: str, other_u: str, shared: str | None = None) -> Column:
    """Whether two sets of n and other_n members, u and other_u of them rare, can be as similar if they share
    no rare member, or ``shared`` of them."""
    most = F.least(F.col(n) - F.col(u), F.col(other_n) - F.col(other_u)) + (F.col(shared) if shared else F.lit(0))
    return 100 * most >= percent * (F.col(n) + F.col(other_n) - most)


def reachable(live: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (key, fp, n, c) of ``live`` with u, the members of the set that ``RARE`` sets of ``live`` have
    at most, without those that no set of their bucket's sizes can match unless it shares a rare member; and
    the pairs (fp, q) of different components that share rare members and may be similar. A rare member is
    in few sets, so it makes few pairs."""
    nodes = live.select("fp", "n", "c").distinct()
    rows = sets.join(nodes.select("fp"), "fp", "left_semi").select("fp", F.explode("members").alias("x"))
    few = rows.groupBy("x").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= RARE)
    rare = cut(rows.join(few, "x"), "rare")
    counted = nodes.join(rare.groupBy("fp").agg(F.count(F.lit(1)).alias("u")), "fp", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    held = rare.where("m > 1").groupBy("x").agg(F.sort_array(F.collect_list("fp")).alias("f")).select("f", F.posexplode("f").alias("i", "fp"))
    met = held.select("fp", F.explode(F.slice("f", F.col("i") + 2, F.lit(RARE))).alias("q")).groupBy("fp", "q").agg(F.count(F.lit(1)).alias("shared"))
    other = counted.select(F.col("fp").alias("q"), F.col("n").alias("qn"), F.col("u").alias("qu"), F.col("c").alias("qc"))
    sharing = met.join(counted, "fp").join(other, "q").where((F.col("c") != F.col("qc")) & within(percent, "n", "u", "qn", "qu", "shared")).select("fp", "q")
    least = live.groupBy("key").agg(F.min("n").alias("least"))
    marked = live.join(counted.select("fp", "u"), "fp").join(least, "key")
    most = F.col("n") - F.col("u")
    return marked.where(100 * most >= percent * (F.col("n") + F.greatest("least", most) - most)).drop("least"), sharing


def prefix_pairs(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (fp, q) of sets in ``live`` (fp, n, u, c) whose components differ and that may be similar, all similar
    ones among them: they share a member of both prefixes and, from the first such member on, have enough members
    left. Prefix rows meet by member and size class, so very different sizes never meet."""
    nodes = live.select("fp", "n", "u", "c").distinct()
    rows = sets.join(nodes.select("fp"), "fp", "left_semi").select("fp", F.explode("members").alias("x"))
    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    place = F.row_number().over(Window.partitionBy("fp").orderBy("m", "x")) - 1
    ranked = rows.join(counts, "x").withColumn("i", place).join(nodes, "fp")
    first = ranked.where((F.col("m") > 1) & (F.col("i") <= F.col("n") - F.expr(f"(n * {percent} + 99) div 100")))
    step = math.log(100 / percent) * 1.001 if percent < 100 else 1.0  # a little wide: rounding loses no pair
    size = F.floor(F.log("n") / step) if percent < 100 else F.col("n")
    held = cut(first.select("x", "fp", "n", "u", "c", "i", size.alias("s")), "prefixes")
    near = held.withColumn("z", F.explode(F.array("s", F.col("s") + 1)))
    other = held.select("x", F.col("s").alias("z"), *[F.col(k).alias(f"q{k}") for k in ("n", "u", "c", "i")], F.col("fp").alias("q"))
    met = near.join(other, ["x", "z"]).where((F.col("c") != F.col("qc")) & ((F.col("z") > F.col("s")) | (F.col("fp") < F.col("q"))))
    most = F.least(F.col("n") - F.col("i"), F.col("qn") - F.col("qi"))
    return met.where((100 * most >= percent * (F.col("n") + F.col("qn") - most)) & within(percent, "n", "u", "qn", "qu")).select("fp", "q")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 85, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    if shingle < 1 or not 0 < percent <= 100:
        raise ValueError("shingle must be positive and percent in 1..100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    run, schema = _sketched(shingle, band_rows)
    marked = cut(docs.mapInArrow(run, schema), "sketches")

    filled = marked.where("fp is not null")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = cut(filled.groupBy("fp").agg(one.alias("one"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).select("fp", F.col("one.doc_id").alias("rep"), F.col("one.text_hash").alias("rep_hash"), "n", "bands"), "classes")
    rows = classes.select("fp", "n", F.explode("bands").alias("key"))
    # a bucket of one class can't link anything
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("fp", "n")).alias("pivot")).where("m > 1").select("key", "pivot")
    live = cut(rows.join(crowded, "key"), "buckets")
    wanted = classes.select("fp", "rep", "rep_hash").join(live.select("fp").distinct(), "fp", "left_semi")
    # by id and text, so that neither a null nor a repeated id pairs different texts
    own = docs.join(wanted, (docs["text_hash"] == wanted["rep_hash"]) & docs["doc_id"].eqNullSafe(wanted["rep"]))
    sets = cut(own.select("fp", "text").mapInArrow(_sets_of(shingle), "fp binary, members array<long>").dropDuplicates(["fp"]), "sets")

    def near(x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    def pairs_of(rows: DataFrame, other: str) -> DataFrame:
        return rows.select(F.least("fp", other).alias("a"), F.greatest("fp", other).alias("b")).distinct()

    # rows that repeat a doc_id with other texts are one document
    repeated = filled.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    same = filled.join(repeated, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    tested = cut(pairs_of(live.select("fp", "n", F.col("pivot.fp").alias("q"), F.col("pivot.n").alias("qn")).where((F.col("fp") != F.col("q")) & near("n", "qn")), "q"), "pairs")
    label = merged(None, cut(verified(tested, sets, percent).unionByName(same), "links"))
    live = live.select("key", "fp", "n")
    for turn in range(PIVOT_ROUNDS + 1):
        held = live.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp")).drop("component")
        apart = held.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
        live = cut(held.join(apart, "key", "left_semi"), "buckets")
        if live.isEmpty():
            break
        if turn == 0:
            live, sharing = reachable(live, sets, percent)
            live = cut(live, "reachable")
        if turn < PIVOT_ROUNDS:
            # first the member with the fewest shingles of its own, the likeliest centre; then any
            place = F.col("u") if turn == 0 else F.xxhash64("fp", "key", F.lit(turn))
            other = live.groupBy("key").agg(F.min(F.struct(place.alias("place"), F.col("fp").alias("q"), F.col("n").alias("qn"), F.col("u").alias("qu"), F.col("c").alias("qc"))).alias("p")).select("key", "p.q", "p.qn", "p.qu", "p.qc")
            met = live.alias("l").join(other.alias("o"), (F.col("l.key") == F.col("o.key")) & (F.col("c") != F.col("qc")) & near("n", "qn") & within(percent, "n", "u", "qn", "qu"))
            found = met.select("fp", "q").unionByName(sharing) if turn == 0 else met.select("fp", "q")
        else:
            found = prefix_pairs(live, sets, percent)
        pairs = cut(pairs_of(found, "q").join(tested, ["a", "b"], "left_anti"), "pairs")
        live = live.select("key", "fp", "n", "u")
        tested = tested.unionByName(pairs)
        links = cut(verified(pairs, sets, percent), "links")
        if not links.isEmpty():
            label = merged(label, links)

    grouped = classes.select("fp", "rep").join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = grouped.groupBy("c").agg(F.min("rep").alias("least"))
    named = grouped.join(least, "c").select("fp", "least")
    out = marked.drop("bands", "text_hash").join(named, "fp", "left").withColumn("component_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _sets_of(shingle: int):
    """Sets of the rows whose text has the fingerprint that is asked for (a doc_id may have several texts)."""
    schema = pa.schema([("fp", pa.binary()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                offsets, hashes = shingle_sets(part.column("text"), shingle)
                same = pa.array([b > a and xxhash.xxh3_128_digest(hashes[a:b].tobytes()) == fp for a, b, fp in zip(offsets, offsets[1:], part.column("fp").to_pylist())], pa.bool_())
                made = pa.RecordBatch.from_arrays([part.column("fp"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))], schema=schema)
                yield made.filter(same)

    return run
