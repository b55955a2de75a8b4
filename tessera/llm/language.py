"""Operator 9: language of a text by a linear-chain conditional random field over its words.

Every word has a label. Its features are affixes of one to three bytes, byte trigrams and membership in
each language's lexicon (the training sample's frequent words); transitions between labels are learned
too, from sequences that switch language between stretches of training texts. Forward-backward gives each
word's label probabilities in the context of its whole text; a text's language has the highest mean over
its words with letters, and that mean is the score.

The field is fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled rows, those of each language with
the least hash of (doc_id, text), and of their texts at most ``SAMPLE_STRETCHES`` stretches of ``STRETCH`` words (of
``STRETCH_CHARS`` characters, if words are longer), again those with the least hash. Tasks cut them, so what reaches the
driver is bounded whatever the length of a text. Everything else covers all rows and whole texts. All texts of a slice
move together, so a long one is read in whole.

Edge cases: null text or text without a letter is ``und`` with score 0. Without any word in a labelled row every text
is ``und``. A null doc_id isn't held out and isn't learned from. Rows with null lang are predicted, not
learned from. Repeated rows get equal results; extra columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import mix, ragged, slices, words
from tessera.llm.toxicity import HELD_OUT, fold
from tessera.sources.shared import cut

SAMPLE_ROWS = 480
SAMPLE_STRETCHES = 20_000
FEW_LANGUAGES = 10_000
SLOT_BITS = 15
LEXICON = 400
STEPS = 24
STRETCH = 24  # words of one language in a training sequence
STRETCH_CHARS = 4096
UNDETERMINED = "und"


def word_features(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(count per word, slots one after the other): hashed affixes and byte trigrams of lower-cased words."""
    raw = pc.utf8_lower(vocabulary).cast(pa.binary())
    n = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(n + 4) - (n + 4)
    padded = np.full(int((n + 4).sum()) + 1, 2, np.uint64)  # one more, for an empty word at the end
    padded[ragged(starts + 2, n)] = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    first, last = starts + 2, starts + 1 + n
    affixes, head, tail = [], np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    for k in range(3):
        head = (head << np.uint64(8)) | padded[first + k]
        tail = (tail << np.uint64(8)) | padded[np.maximum(last - k, starts)]
        affixes += [mix(head, 101 + k), mix(tail, 201 + k)]
    at = ragged(starts + 1, n)
    grams = mix((padded[at] << np.uint64(16)) | (padded[at + 1] << np.uint64(8)) | padded[at + 2], 301)
    counts = n + len(affixes)
    out = np.zeros(int(counts.sum()), np.uint64)
    begin = np.cumsum(counts) - counts
    out[ragged(begin, n)] = grams
    for k, a in enumerate(affixes):
        out[begin + n + k] = a
    return counts, (out >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def posteriors(x: np.ndarray, offsets: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word by forward-backward over each row's chain, and those that know
    its row up to the word only. x: words by labels, log potentials; step: transitions, exponentiated;
    start: likewise for a row's first label. All rows move together, one word a step, longest rows first,
    so the words of a step lie side by side."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    begin, size = offsets[:-1][order], n[order]
    most = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(most), side="left")  # rows longer than t
    after = np.cumsum(active)
    at = begin[ragged(np.zeros(most, np.int64), active)] + np.repeat(np.arange(most), active)
    phi = x[at].astype(np.float32)
    phi = np.exp(phi - phi.max(axis=1, keepdims=True)) + np.float32(1e-9)
    step = (step / step.max()).astype(np.float32)
    back = np.ascontiguousarray(step.T)
    ones = np.ones(phi.shape[1], np.float32)
    forward = np.empty_like(phi)
    for t in range(most):
        a, o = int(active[t]), int(after[t] - active[t])
        v = (v[:a] @ step if t else start.astype(np.float32)) * phi[o : o + a]
        v /= (v @ ones)[:, None]
        forward[o : o + a] = v
    both = forward.copy()
    for t in range(most - 2, -1, -1):
        a, o = int(active[t + 1]), int(after[t] - active[t])
        if t == most - 2:
            w = np.ones((a, phi.shape[1]), np.float32)
        elif a > len(w):
            w = np.concatenate([w, np.ones((a - len(w), phi.shape[1]), np.float32)])
        w = (w * phi[o + int(active[t]) : o + int(active[t]) + a]) @ back
        w /= (w @ ones)[:, None]
        both[o : o + a] *= w
    both /= (both @ ones)[:, None]
    out, filtered = np.empty_like(both), np.empty_like(both)
    out[at], filtered[at] = both, forward
    return out, filtered


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # slots by labels
    lexicon: pa.Array
    member: np.ndarray  # lexicon words by labels
    lexical: np.ndarray  # labels by labels
    step: np.ndarray
    start: np.ndarray

    def potentials(self, vocabulary: pa.Array) -> np.ndarray:
        counts, at = word_features(vocabulary)
        ends = np.cumsum(counts)
        sums = np.add.reduceat(self.weights[at], ends - counts, axis=0) if len(at) else np.zeros((0, len(self.languages)))
        known = pc.fill_null(pc.index_in(pc.utf8_lower(vocabulary), self.lexicon), len(self.lexicon)).to_numpy(zero_copy_only=False)
        return sums + (self.member @ self.lexical)[known]


def switches(before: np.ndarray, step: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Expected numbers of label pairs: sums of before x step x after, each normalised, a block of words at a time."""
    k, out = len(step), np.zeros_like(step)
    block = max(1, (1 << 22) // (k * k))
    for a in range(0, len(before), block):
        joint = before[a : a + block, :, None] * step[None] * after[a : a + block, None, :]
        out += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each text (text, lang, h), numbered."""
    for batch in batches:
        for part in slices(batch):
            offsets, codes, vocabulary = words(part.column("text"))
            held = -(-np.diff(offsets) // STRETCH)
            row, number = np.repeat(np.arange(len(held)), held), ragged(np.zeros(len(held), np.int64), held)
            edges = np.append(offsets[row] + number * STRETCH, len(codes))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), vocabulary.take(pa.array(codes))), " ")
            yield pa.RecordBatch.from_arrays([pc.utf8_slice_codeunits(joined, 0, STRETCH_CHARS), part.column("lang").take(pa.array(row)), part.column("h").take(pa.array(row)), pa.array(number)], names=["text", "lang", "h", "number"])


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, stretches: int = SAMPLE_STRETCHES) -> DataFrame:
    """text, lang of at most ``stretches`` stretches, in the order of their hashes, from at most ``rows`` labelled rows: of
    each language those with the least hash, dealt out evenly, so that a rare language has its share."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    hashed = known.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    # a frequent language's hashes are cut to about four times ``rows`` before they meet in one window
    counts = cut(known.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")), "languages")
    few = counts.count() <= FEW_LANGUAGES
    below = (F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("n") <= 4 * rows + 32
    least = hashed.select("lang", "h").join(F.broadcast(counts) if few else counts, "lang").where(below).select("lang", "h")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = least.withColumn("place", place).where(F.col("place") <= rows).orderBy("place", "h", "lang").limit(rows).select("lang", "h").distinct()
    # no more than ``rows`` keys go out; texts move only once they are chosen
    whole = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    cut_up = whole.select("text", "lang", "h").mapInArrow(_stretches, "text string, lang string, h long, number long")
    return cut_up.orderBy(F.xxhash64("h", "number"), "h", "lang", "number").limit(stretches).select("text", "lang")


def fit(sample: pa.Table) -> Field | None:
    """A field fitted to the sample's stretches (text, lang) by gradient steps on the conditional likelihood."""
    languages = sorted(set(sample["lang"].to_pylist()))
    if not languages:
        return None
    k = len(languages)
    lang = np.array([languages.index(x) for x in sample["lang"].to_pylist()])
    offsets, codes, vocabulary = words(sample["text"].combine_chunks())
    n = np.diff(offsets)
    label = np.repeat(lang, n)
    low = pc.utf8_lower(vocabulary)
    per = np.stack([np.bincount(codes[label == j], minlength=len(vocabulary)) for j in range(k)], 1) if len(codes) else np.zeros((0, k))
    common: dict[str, int] = {}
    for j in range(k):
        for i in np.argsort(-per[:, j], kind="stable")[:LEXICON]:
            if per[i, j] > 2:
                common.setdefault(low[int(i)].as_py(), len(common))
    member = np.zeros((len(common) + 1, k))
    for j in range(k):
        for i in np.argsort(-per[:, j], kind="stable")[:LEXICON]:
            if per[i, j] > 2:
                member[common[low[int(i)].as_py()], j] = 1
    lexicon = pa.array(list(common), pa.string())
    field = Field(languages, np.zeros((1 << SLOT_BITS, k)), lexicon, member, np.zeros((k, k)), np.ones((k, k)) / k, np.ones(k) / k)
    if k == 1 or not len(codes):
        return field
    # sequences of two stretches each, whose order mixes languages
    marks = np.concatenate([[0], np.cumsum(n[n > 0])])
    chains = np.unique(np.concatenate([marks[:: 2], marks[-1:]]))
    counts, at = word_features(vocabulary)
    word = np.repeat(np.arange(len(vocabulary)), counts)
    known = pc.fill_null(pc.index_in(low, lexicon), len(lexicon)).to_numpy(zero_copy_only=False)
    truth = np.eye(k)[label]
    inner = np.ones(len(label), bool)
    inner[chains[:-1]] = False
    prev = np.flatnonzero(inner) - 1
    here = prev + 1
    step_log, start_log = np.zeros((k, k)), np.zeros(k)
    params = [field.weights, field.lexical, step_log, start_log]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for i in range(1, STEPS + 1):
        field.step, field.start = np.exp(step_log), np.exp(start_log)
        x = field.potentials(vocabulary)[codes]
        p, seen = posteriors(x, chains, field.step, field.start)
        gap = truth - p
        by_word = np.stack([np.bincount(codes, weights=gap[:, j], minlength=len(vocabulary)) for j in range(k)], 1)
        w_grad = np.stack([np.bincount(at, weights=by_word[word, j], minlength=1 << SLOT_BITS) for j in range(k)], 1)
        l_grad = member[known].T @ by_word
        later = np.exp(x - x.max(axis=1, keepdims=True)) * p / np.maximum(seen, 1e-12)
        s_grad = truth[prev].T @ truth[here] - switches(seen[prev], field.step, later[here])
        grads = [w_grad - 0.05 * params[0], l_grad - 0.05 * params[1], s_grad - 0.5 * step_log, gap[chains[:-1]].sum(axis=0) - 0.5 * start_log]
        for q, g, m, v in zip(params, grads, first_moment, second_moment):
            g = g / len(label)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q += 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    field.step, field.start = np.exp(step_log), np.exp(start_log)
    return field


def _labelled(field: Field, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice with its rows' best language (-1: no letter) and mean probability."""
    for batch in batches:
        for part in slices(batch):
            offsets, codes, vocabulary = words(part.column("text"))
            best, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
            if len(codes):
                p, _ = posteriors(field.potentials(vocabulary)[codes], offsets, field.step, field.start)
                lettered = pc.match_substring_regex(vocabulary, r"\pL").to_numpy(zero_copy_only=False)[codes]
                sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p * lettered[:, None], axis=0)])
                held = np.concatenate([[0], np.cumsum(lettered)])
                n = held[offsets[1:]] - held[offsets[:-1]]
                mean = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, n)[:, None]
                best = np.where(n > 0, mean.argmax(axis=1), -1)
                score = np.where(n > 0, np.clip(mean.max(axis=1), 0, 1), 0.0)
            yield part, best, score


def identified(docs: DataFrame, field: Field | None, into: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with its columns and the two of ``into``, language and score, which must be new ones."""
    if set(into) & set(docs.columns):
        raise ValueError(f"{into} are columns already")
    fields = docs.schema.names
    if field is None:
        return docs.withColumns({into[0]: F.lit(UNDETERMINED), into[1]: F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*held.value.languages, UNDETERMINED])
        for part, best, score in _labelled(held.value, batches):
            yield pa.RecordBatch.from_arrays([*(part.column(f) for f in fields), names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(score)], names=[*fields, *into])

    return docs.mapInArrow(run, docs.withColumns({into[0]: F.lit(""), into[1]: F.lit(0.0)}).schema)


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang)."""
    field = fit(training_sample(docs).toArrow())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return identified(rows, field).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
