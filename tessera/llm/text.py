"""Words of whole texts, batch by batch, for functions that run inside Arrow tasks.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Each batch is cut into slices of bounded bytes, so memory
follows the slice (or one text, if that is longer), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 12 << 20


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts hold at most ``most`` bytes together (a longer text has its own)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, vocabulary): row i has the words ``vocabulary[codes[offsets[i]:offsets[i+1]]]``.
    Null counts as empty; ``lower`` changes A-Z only."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    gap = pc.index(encoded.dictionary, "").as_py()  # what stands before leading and after trailing space
    if gap >= 0:
        kept = codes != gap
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(kept, out=before[1:])
        offsets, codes = before[offsets], codes[kept]
    return offsets, codes, encoded.dictionary


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0].., starts[0]+lengths[0]-1, starts[1].., one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - first, lengths)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
