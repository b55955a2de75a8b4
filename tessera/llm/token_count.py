"""Operator 5: token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word of the text with the word mark before it. Its tokens are those of its best
segmentation: the pieces of a public vocabulary weigh ``-log(rank + 2)`` (Zipf's law over the vocabulary's
own order; nothing is trained), and a character that no piece covers falls back to its UTF-8 bytes, at a
fixed lower weight each. Equal weights: fewer tokens win.

Each slice of a partition inserts its different pre-tokens into a trie, walked in sorted order, so that
only the path to the current pre-token is held; the forward scores of a prefix are computed once for all
pre-tokens below it, and the number of tokens at a pre-token's end is its count. Documents then sum the
counts of their words: no shuffle, and memory follows the slice.

Edge cases: null or empty text has 0 words and 0 tokens; null or repeated doc_ids are rows like any other;
other columns aren't read; an empty table gives no rows; long texts and long words are read in whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import slices, words

MARK = "▁"
UNIT = 1_000_000  # weights are whole millionths, so that sums are exact
CACHED_WORDS = 200_000


class Pieces:
    """Weights of a vocabulary's pieces, reachable from a piece's last character to its first."""

    def __init__(self, weights: dict[str, int], byte_weight: int):
        self.weights, self.byte_weight, self.back = weights, byte_weight, {}
        for piece, weight in weights.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[0] = weight
        self.cache: dict[str, int] = {}

    def extend(self, text: str, best: list[int], count: list[int]) -> None:
        """Forward scores and token counts of the prefixes of ``text`` that aren't there yet."""
        back, byte_weight = self.back, self.byte_weight
        for end in range(len(best), len(text) + 1):
            c = text[end - 1]
            n = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
            b, k = best[end - 1] + n * byte_weight, count[end - 1] + n
            node, at = back, end
            while at and (node := node.get(text[at - 1])) is not None:
                at -= 1
                weight = node.get(0)
                if weight is not None:
                    v = best[at] + weight
                    if v > b or v == b and count[at] + 1 < k:
                        b, k = v, count[at] + 1
            best.append(b)
            count.append(k)

    def counts(self, found: list[str]) -> list[int]:
        """Tokens of each pre-token, computed once per prefix that they share."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        best, count, path = [0], [0], ""
        for w in sorted(w for w in found if w not in self.cache):
            text = MARK + w
            shared, most = 0, min(len(path), len(text))
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            self.extend(text, best, count)
            self.cache[w], path = count[-1], text
        return [self.cache[w] for w in found]


@functools.cache
def zipf_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece vocabulary, weighed by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    weights = {model.id_to_piece(i): -round(UNIT * math.log(rank + 2)) for rank, i in enumerate(plain)}
    return Pieces(weights, 2 * min(weights.values()))


def _counted(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = zipf_pieces(path)
        for batch in batches:
            for part in slices(batch):
                offsets, codes, vocabulary = words(part.column("text"))
                per = np.array(pieces.counts(vocabulary.to_pylist()), np.int64)
                sums = np.concatenate([[0], np.cumsum(per[codes])]) if len(codes) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])], schema=schema)

    return run


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted(vocabulary_path), "doc_id long, n_words long, n_tokens long")
