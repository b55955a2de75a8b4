"""Operator 6: toxicity by class-conditional Kneser-Ney models over words and their stems.

Words (lower-cased, without ASCII punctuation around them) are spelled in steps: the first four bytes, the first six,
the whole word; a step that the word doesn't reach is left out. Two models, toxic and ordinary, give a step u after the
step h before it the probability

    P_c(u) = Q_c * e_c(u) / N_c + B * P_c(h) * S(u | h),     e_c(u) = max(0, n_c(u) - D_c(u))

n_c(u) is a continuation count: the different training texts of class c that hold u, not u's occurrences (ordinary ones
scaled to the number of toxic ones; of equal texts one counts). N_c is its sum over the steps of that depth, Q_c the
probability of their h, S(u | h) the share of u in the counts of both classes: the shared backoff, so that an expression
that is new as a word still has its stem's evidence. B is what the discounts leave, 1 - sum of e_c / N_c, of the class
that they leave less to; the other class gives the difference to a step that no text has. With that step, each class's
steps of a depth have the probability of what stands before them, and shared words cost both classes the same. As in modified
Kneser-Ney smoothing the discount depends on the counts: D_c(u) = ``least`` + ``TIED`` * (the other class's count).
``least`` grows with the logarithm of the number of toxic texts, as the number of texts of one class that share an
expression by chance does. So rare expressions, and all that both classes use about alike, back off to the shared counts.
A document's evidence is the difference of the two log-likelihoods over its number of words. A logistic curve turns it
into a score; it is fitted to all training texts, each weighed by models that did not count its own quarter.

Counts cover every labelled training row, are exact and stay in Spark tables (words of any length are keyed by a 64-bit
hash, stems by their bytes). Documents are read once, into slices that hold each document's words as codes of the
slice's vocabulary. Labels go to the slices for counting; the different steps of all slices meet the model's tables by
joins on their keys, and each slice gets back what its own steps need. No table has a fixed size, and a task holds a
slice and its steps.

Edge cases: null and empty texts (no word) have no evidence and get the score of evidence 0. A null doc_id
has no label and isn't held out. Several labels of one doc_id: toxic if any says so; null labels don't
count; equal texts with different labels are one toxic text. Without labels of both classes, or without any evidence that tells them apart, the score is the share of toxic
labels (0 if there are none). Repeated rows score alike, extra columns are not read, empty tables give empty results,
long texts are read in whole.
"""

from __future__ import annotations

import math
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import ragged, rows_of, slices, words
from tessera.sources.shared import cut

STEMS = (4, 6)  # bytes
GROWTH, TIED = 0.7, 5.0
FOLDS, HELD_OUT = 5, 0
PARTS = range(FOLDS)  # models: 0 counts all training rows, the others leave out one of the folds 1..4
CURVE_BINS = 40_000
EVIDENCE_RANGE = 2.0
SLICE = 8 << 20  # bytes of text at once


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def least(texts: int) -> float:
    """The discount of an expression that the other class doesn't have, for so many toxic texts."""
    return GROWTH * math.log1p(texts)


def steps(vocabulary: pa.Array) -> np.ndarray:
    """One row of keys for each word: its stems (0 where the word has no more bytes than the stem) and itself. Stems
    are positive keys that hold their bytes; words have negative ones."""
    raw = vocabulary.cast(pa.binary())
    n = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.zeros((len(n), len(STEMS) + 1), np.int64)
    keys[:, -1] = [-1 - (xxhash.xxh3_64_intdigest(w) >> 1) for w in raw.to_pylist()]
    most = max(STEMS)
    held = np.minimum(n, most)
    first = np.zeros((len(n), most), np.uint8)
    first[np.repeat(np.arange(len(n)), held), ragged(np.zeros(len(n), np.int64), held)] = np.frombuffer(b"".join(pc.binary_slice(raw, 0, most).to_pylist()), np.uint8)
    for j, k in enumerate(STEMS):
        key = np.full(len(n), k, np.int64)
        for i in range(k):
            key = (key << 8) | first[:, i]
        keys[n > k, j] = key[n > k]
    return keys


def _above(keys: np.ndarray) -> np.ndarray:
    """The step before each step of ``steps``; 0 is the root."""
    above = np.zeros_like(keys)
    for j in range(1, keys.shape[1]):
        above[:, j] = np.where(keys[:, j - 1] != 0, keys[:, j - 1], above[:, j - 1])
    return above


@dataclass
class Sliced:
    """Documents cut into slices: ``rows`` (doc, slice, row, text_hash) has each one's fields, ``parts`` (slice, sizes, codes,
    vocabulary) the words of each slice."""

    rows: DataFrame
    parts: DataFrame


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, vocabulary) of lower-cased words without ASCII punctuation around them."""
    offsets, codes, vocabulary = words(texts)
    encoded = pc.utf8_trim(pc.utf8_lower(vocabulary), string.punctuation).dictionary_encode()
    place, known = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    codes = place[codes] if len(codes) else codes
    gap = pc.index(known, "").as_py()
    if gap >= 0:
        kept = codes != gap
        before = np.concatenate([[0], np.cumsum(kept)])
        offsets, codes = before[offsets], codes[kept]
    return offsets, codes, known


def sliced(docs: DataFrame, fields: list[str]) -> Sliced:
    """Every row of ``docs`` with its ``fields``. Slices get random keys, so they are written once."""
    keep = docs.select(*fields).schema
    schema = T.StructType([T.StructField("doc", keep), T.StructField("slice", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("text_hash", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "codes", "vocabulary"))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                n, key = part.num_rows, uuid.uuid4().int >> 65
                offsets, codes, vocabulary = plain_words(part.column("text"))
                # frequent words get small codes, words that don't occur any more leave
                times = np.bincount(codes, minlength=len(vocabulary))
                order = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
                place = np.zeros(len(vocabulary), np.int64)
                place[order] = np.arange(len(order))
                blobs = [np.diff(offsets).astype(np.uint32).tobytes(), _packed(place[codes] if len(codes) else codes, offsets), b" ".join(vocabulary.take(pa.array(order)).cast(pa.binary()).to_pylist())]
                doc = pa.StructArray.from_arrays([part.column(f) for f in fields], fields=[part.schema.field(f) for f in fields])
                none, texts = pa.nulls(n, pa.binary()), part.column("text").cast(pa.binary()).to_pylist()
                hashes = pa.array([None if x is None else xxhash.xxh3_64_intdigest(x) >> 1 for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([doc, pa.array([key] * n), pa.array(np.arange(n, dtype=np.int32)), hashes, none, none, none], names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, doc.type), pa.array([key]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)], names=names)

    made = cut(docs.select(*dict.fromkeys([*fields, "text"])).mapInArrow(run, schema), "slices")
    return Sliced(made.where("row is not null").select("doc", "slice", "row", "text_hash"), made.where("row is null").select("slice", "sizes", "codes", "vocabulary"))


def _packed(codes: np.ndarray, offsets: np.ndarray) -> bytes:
    """The codes of each row in ascending order, as differences; bytes of equal weight stand together."""
    owner = rows_of(offsets) << 32
    codes = np.sort(owner | codes) - owner
    codes[1:] -= codes[:-1].copy()
    return pa.compress(np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").reshape(-1), dtype=np.int64)


def _words_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, vocabulary) of a slice."""
    sizes, codes, vocabulary = (part.column(c)[0].as_py() for c in ("sizes", "codes", "vocabulary"))
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))])
    return offsets, _unpacked(codes, int(offsets[-1])), _vocabulary(vocabulary)


def _vocabulary(held: bytes) -> pa.Array:
    return pa.array(held.split(b" ") if held else [], pa.binary()).cast(pa.string())


COUNTS = [f"{c}{k}" for c in "to" for k in PARTS if k]


def _counts(part: pa.Table, marks: pa.Table) -> pa.Table:
    """u, h, depth and, for toxic (t) and ordinary rows (o) of each fold, the number of a slice's labelled rows with u."""
    found = []
    if part.num_rows and marks.num_rows:
        offsets, codes, vocabulary = _words_of(part)
        kind = np.full(len(offsets) - 1, -1)
        kind[marks.column("row").to_numpy()] = (1 - marks.column("toxic").to_numpy()) * (FOLDS - 1) + marks.column("part").to_numpy() - 1
        owner = rows_of(offsets)
        labelled = kind[owner] >= 0
        pairs = np.unique(owner[labelled] << 32 | codes[labelled])
        row, word = pairs >> 32, pairs & 0xFFFFFFFF
        keys = steps(vocabulary)
        above = _above(keys)
        depths = np.cumsum(keys != 0, axis=1) - 1
        for j in range(keys.shape[1]):
            if j + 1 < keys.shape[1]:
                known, at = np.unique(keys[:, j], return_inverse=True)
                held = np.unique(row << 32 | at[word])
                rows, at = held >> 32, held & 0xFFFFFFFF
                parent, depth = np.zeros(len(known), np.int64), np.full(len(known), j)
                parent[np.searchsorted(known, keys[:, j])] = above[:, j]
            else:
                known, parent, depth, rows, at = keys[:, j], above[:, j], depths[:, j], row, word
            table = np.bincount(at * len(COUNTS) + kind[rows], minlength=len(known) * len(COUNTS)).reshape(-1, len(COUNTS))
            met = (known != 0) & (table.sum(axis=1) > 0)
            found.append((known[met], parent[met], depth[met], table[met]))
    u, h, d, n = (np.concatenate([x[i] for x in found]) if found else np.zeros((0, len(COUNTS)) if i == 3 else 0, np.int64) for i in range(4))
    return pa.table({"u": u.astype(np.int64), "h": h.astype(np.int64), "depth": d.astype(np.int64), **{c: n[:, i].astype(np.int64) for i, c in enumerate(COUNTS)}})


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, u): the different steps of each slice."""
    for batch in batches:
        for key, vocabulary in zip(batch.column("slice").to_pylist(), batch.column("vocabulary")):
            found = np.unique(steps(_vocabulary(vocabulary.as_py())))
            found = found[found != 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found)], names=["slice", "u"])


def word_ratios(keys: np.ndarray, entries: dict[str, np.ndarray], kept: list[float], k: int) -> np.ndarray:
    """log P_t - log P_o of each word, from the entries (u, t{k}, o{k}) of its steps and what each depth leaves to
    the backoff (``kept``)."""
    order = np.argsort(entries["u"])
    u = np.append(entries["u"][order], np.iinfo(np.int64).max)
    own = [np.append(entries[f"{c}{k}"][order], 0.0) for c in "to"]
    x, depth = np.ones((2, len(keys))), np.zeros(len(keys), np.int64)
    for j in range(keys.shape[1]):
        here = keys[:, j] != 0
        at = np.searchsorted(u, keys[:, j])
        known = here & (u[at] == keys[:, j])
        left = np.array(kept)[np.minimum(depth, keys.shape[1] - 1)]
        for c in (0, 1):
            x[c] = np.where(here, np.where(known, own[c][at], 0.0) + left * x[c], x[c])
        depth += here
    return np.log(x[0]) - np.log(x[1])


def _weighed(kept: list[list[float]]):
    def run(part: pa.Table, entries: pa.Table) -> pa.Table:
        """(slice, row, e0..) of a slice's rows: length-normalised log-likelihood differences by each model."""
        if not part.num_rows:
            return pa.table({"slice": pa.array([], pa.int64()), "row": pa.array([], pa.int32()), **{f"e{k}": pa.array([], pa.float64()) for k in PARTS}})
        offsets, codes, vocabulary = _words_of(part)
        held = {c: entries.column(c).to_numpy() for c in entries.column_names if c != "slice"}
        keys, owner, n = steps(vocabulary), rows_of(offsets), np.diff(offsets)
        out = {}
        for k in PARTS:
            ratio = word_ratios(keys, held, kept[k], k)
            sums = np.bincount(owner, weights=ratio[codes], minlength=len(n)) if len(codes) else np.zeros(len(n))
            out[f"e{k}"] = sums / np.maximum(1, n)
        key = part.column("slice")[0].as_py()
        return pa.table({"slice": pa.array(np.full(len(n), key)), "row": pa.array(np.arange(len(n), dtype=np.int32)), **out})

    return run


@dataclass
class Model:
    """``entries`` (u, t0.., o0..): Q_c e_c(u) / N_c over the shared probability of u, for each step that a class has more
    of than the discount; ``kept``: by model and depth, what is left to the backoff."""

    entries: DataFrame
    kept: list[list[float]]


@dataclass
class Fitted:
    """A model and the curve from its evidence to scores."""

    model: Model
    curve: tuple[float, float]


def model_of(counts: DataFrame, classes: dict[tuple[int, int], int]) -> Model:
    """From the documents with each step (u, h, depth), by class and fold; ``classes``: documents by (toxic, fold)."""
    total = lambda c: reduce(lambda a, b: a + b, [F.col(f"{c}{j}") for j in PARTS if j])
    made, beyond = {}, {}
    for k in PARTS:
        n = [sum(v for (toxic, f), v in classes.items() if toxic == y and f != k) for y in (0, 1)]
        made[f"nt{k}"] = (total("t") - F.col(f"t{k}") if k else total("t")).cast("double")
        made[f"no{k}"] = (total("o") - F.col(f"o{k}") if k else total("o")) * F.lit(n[1] / n[0] if n[0] else 0.0)
        t, o = F.col(f"nt{k}"), F.col(f"no{k}")
        beyond |= {f"et{k}": F.greatest(t - TIED * o - least(n[1]), F.lit(0.0)), f"eo{k}": F.greatest(o - TIED * t - least(n[1]), F.lit(0.0))}
    known = cut(counts.select("u", "h", "depth", *[v.alias(c) for c, v in made.items()]).withColumns(beyond), "steps")
    siblings = cut(known.groupBy("depth", "h").agg(*[F.sum(F.col(f"nt{k}") + F.col(f"no{k}")).alias(f"all{k}") for k in PARTS]), "siblings")
    above = counts.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"), *[F.lit(1.0).alias(f"{c}{k}") for k in PARTS for c in ("shared", "xt", "xo")])
    kept: list[list[float]] = [[] for _ in PARTS]
    entries = []
    for depth in range(len(STEMS) + 1):
        shared = {f"shared{k}": F.coalesce(F.try_divide(F.col(f"nt{k}") + F.col(f"no{k}"), F.col(f"all{k}")), F.lit(0.0)) * F.col(f"shared{k}") for k in PARTS}
        before = siblings.where(F.col("depth") == depth).drop("depth").join(above, "h")
        # all first steps follow the root: one row
        here = known.where(F.col("depth") == depth).join(before if depth else F.broadcast(before), "h").withColumns(shared)
        sums = here.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(n) for k in PARTS for c in "to" for n, x in ((f"n{c}{k}", F.col(f"n{c}{k}")), (f"e{c}{k}", F.col(f"e{c}{k}")), (f"q{c}{k}", F.col(f"shared{k}") * F.col(f"x{c}{k}")))]).first()
        own, reached = {}, {}
        for k in PARTS:
            left = 1 - max(sums[f"e{c}{k}"] / sums[f"n{c}{k}"] if sums[f"n{c}{k}"] else 0.0 for c in "to")
            kept[k].append(left)
            for c in "to":
                rate = sums[f"q{c}{k}"] / sums[f"n{c}{k}"] if sums[f"n{c}{k}"] else 0.0
                own[f"{c}{k}"] = F.coalesce(F.try_divide(F.col(f"e{c}{k}") * F.lit(rate), F.col(f"shared{k}")), F.lit(0.0))
                reached[f"x{c}{k}"] = F.col(f"{c}{k}") + left * F.col(f"x{c}{k}")
        here = cut(here.withColumns(own), "depth")
        entries.append(here.where(reduce(lambda a, b: a | b, [F.col(f"{c}{k}") > 0 for c in "to" for k in PARTS])).select("u", *own))
        above = here.select(F.col("u").alias("h"), *[f"shared{k}" for k in PARTS], *[v.alias(c) for c, v in reached.items()])
    return Model(cut(reduce(DataFrame.unionByName, entries), "model"), kept)


def evidence(parts: DataFrame, model: Model) -> DataFrame:
    """slice, row and the evidence e0.. by each model of every row of every slice."""
    needed = parts.select("slice", "vocabulary").mapInArrow(_different, "slice long, u long").join(model.entries, "u")
    met = parts.groupBy("slice").cogroup(needed.groupBy("slice"))
    return cut(met.applyInArrow(_weighed(model.kept), "slice long, row int, " + ", ".join(f"e{k} double" for k in PARTS)), "evidence")


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """slice, row, part (fold 1..4), toxic (0 or 1) of one row of each different labelled text outside the held-out fold.
    Labels grow with the documents, so both sides are dealt by doc_id at every size."""
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic")).where(fold(F.col("doc_id")) != HELD_OUT)
    named = rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "slice", "row", "text_hash").where(fold(F.col("doc_id")) != HELD_OUT)
    met = named.join(known.hint("merge"), "doc_id").select("text_hash", "toxic", F.struct("doc_id", "slice", "row").alias("first"))
    once = met.groupBy("text_hash").agg(F.min("first").alias("first"), F.max("toxic").alias("toxic"))
    return once.select("first.slice", "first.row", fold(F.col("first.doc_id")).cast("int").alias("part"), "toxic")


def fit_curve(x: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over bins at x with n documents, t of them toxic; a class weighs as
    the square root of its number of documents."""
    pos, neg = t / np.sqrt(max(1, t.sum())), (n - t) / np.sqrt(max(1, (n - t).sum()))
    pos, neg = pos / (pos + neg).sum(), neg / (pos + neg).sum()
    scale = max(1e-9, float(np.sqrt(np.average(x**2, weights=pos + neg))))
    z, w = x / scale, np.zeros(2)
    a = np.stack([np.ones_like(z), z], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (pos * (1 - p) - neg * p) - 1e-3 * w * [0, 1]
        hess = (a * ((pos + neg) * p * (1 - p))[:, None]).T @ a + np.diag([1e-9, 1e-3])
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1] / scale)


def fit(docs: DataFrame, labels: DataFrame) -> Fitted | float:
    """The model, or the share of toxic labels where nothing tells the classes apart."""
    return fit_and_weigh(sliced(docs, ["doc_id"]), labels)[0]


def counted(docs: Sliced, train: DataFrame) -> DataFrame:
    """u, h, depth and the counts of every step in the training rows."""
    found = docs.parts.groupBy("slice").cogroup(train.groupBy("slice")).applyInArrow(_counts, "u long, h long, depth long, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.groupBy("u", "h", "depth").agg(*[F.sum(c).alias(c) for c in COUNTS])


def fit_and_weigh(docs: Sliced, labels: DataFrame) -> tuple[Fitted | float, DataFrame | None]:
    """The model, and the evidence of all of ``docs`` by it."""
    train = cut(training_rows(docs.rows, labels), "labelled")
    classes = {(r["toxic"], r["part"]): r["n"] for r in train.groupBy("toxic", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = sum(n for (y, _), n in classes.items() if y)
    share = toxic / max(1, sum(classes.values()))
    if share in (0.0, 1.0):
        return share, None
    model = model_of(counted(docs, train), classes)
    weighed = evidence(docs.parts, model)
    apart = F.element_at(F.array(*[F.col(f"e{k}") for k in PARTS if k]), F.col("part"))
    place = F.least(F.greatest((F.col("e") + EVIDENCE_RANGE) / (2 * EVIDENCE_RANGE), F.lit(0.0)), F.lit(1 - 1e-9))
    bins = weighed.join(train, ["slice", "row"]).select(apart.alias("e"), "toxic").groupBy(F.floor(place * CURVE_BINS).alias("b")).agg(F.avg("e").alias("x"), F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).toPandas()
    x, n, t = (bins[c].to_numpy(float) for c in ("x", "n", "t"))
    a, b = fit_curve(x, n, t)
    if b <= 0 or a + b * np.average(x, weights=n - t) >= 0:  # the left-out evidence says nothing
        return share, None
    return Fitted(model, (a, b)), weighed


def scored(docs: DataFrame, labels: DataFrame, fields: list[str], into: str = "score") -> DataFrame:
    """The ``fields`` (doc_id among them) of every row of ``docs`` and ``into`` (0 to 1), which must be a new one, by
    a model of the labelled rows."""
    if into in docs.columns:
        raise ValueError(f"{into} is a column already")
    held = sliced(docs, fields)
    model, weighed = fit_and_weigh(held, labels)
    if weighed is None:
        return held.rows.select("doc.*", F.lit(model).alias(into))
    a, b = model.curve
    score = 1 / (1 + F.exp(-F.greatest(F.least(a + b * F.col("e0"), F.lit(60.0)), F.lit(-60.0))))
    return held.rows.join(weighed.select("slice", "row", "e0"), ["slice", "row"]).select("doc.*", score.alias(into))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = scored(rows, labels, ["doc_id"])
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return made.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
