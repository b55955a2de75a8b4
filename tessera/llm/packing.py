"""Operator 7: best-fit packing of tokenised documents into sequences by bin completion.

A document is its token ids and one ``end_id``; only longer ones are cut, into pieces of ``capacity``
tokens, the last of which may be shorter. Full pieces are sequences of their own. The other pieces are
dealt at random into groups of about ``group_pieces``, and each group is packed by branch and bound:
best-fit decreasing gives the first incumbent; then the largest piece left is completed with every
undominated filling, least waste first, and a branch ends where its waste can't beat the incumbent or the
lower bound is met. The emptiest bins of ``MERGED`` groups are then packed together once more, and so on
until one group is left, so that dealing into groups doesn't cost bins; a group keeps its bins where that
finds no fewer. No list of fillings is cut; ``steps_a_piece`` bounds the whole search of a group, whose best
bins stand when it ends.

Edge cases: a null or empty text is one piece that holds ``end_id`` alone; null and repeated doc_ids are
packed like any others (each row is a document); other columns are not read; an empty table packs into
nothing; a very long text becomes many full pieces and one rest.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import ragged, slices, words
from tessera.sources.shared import cut

CACHED_WORDS = 100_000
#: groups whose emptiest bins, one in so many, are packed together in the next round
MERGED = 8
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.cache
def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary uses for each byte: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class WordTokens:
    """Token ids of single words by a tokenizer that drops white space and never joins across it.

    Plain words go to the model at once; all others take the tokenizer's whole path. A word that repeats
    is encoded once while the bounded cache holds it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, list[int]] = {}
        self.ends = {c: self._whole([c])[0] for c in ",."}

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, found: list[str]) -> list[list[int]]:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        cache, model, letters, rest = self.cache, self.tokenizer.model, _byte_letters(), []
        for w in found:
            if w in cache:
                continue
            if w.isascii() and w.isalpha():
                cache[w] = [t.id for t in model.tokenize(w.lower())]
            elif w.isalpha() and "Σ" not in w and "İ" not in w and unicodedata.is_normalized("NFC", w):
                cache[w] = [t.id for t in model.tokenize("".join([letters[b] for b in w.lower().encode()]))]
            else:
                rest.append(w)
        cache.update(zip(rest, self._whole(rest)))
        return [cache[w] for w in found]

    def of(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids one after the other) of each word. A comma or stop after a letter is a token of
        its own, so words that differ in it alone are encoded once."""
        special = pc.match_substring(vocabulary, "<|")  # special tokens are looked for before lower-casing
        low = pc.if_else(special, vocabulary, pc.ascii_lower(vocabulary))
        ended = pc.and_(pc.match_substring_regex(low, "[a-z][.,]$"), pc.invert(special))
        raw = low.cast(pa.binary())
        encoded = pc.if_else(ended, pc.binary_slice(raw, 0, -1), raw).cast(pa.string()).dictionary_encode()
        ids = self._each(encoded.dictionary.to_pylist())
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))
        stem = encoded.indices.to_numpy(zero_copy_only=False)
        tail = ended.to_numpy(zero_copy_only=False)
        lengths = n[stem] + tail if len(stem) else np.zeros(0, np.int64)
        out = np.zeros(int(lengths.sum()), np.uint32)
        ends = np.cumsum(lengths)
        body = ragged(ends - lengths, n[stem]) if len(stem) else np.zeros(0, np.int64)
        out[body] = flat[ragged((np.cumsum(n) - n)[stem], n[stem])] if len(stem) else 0
        if tail.any():
            comma = pc.ends_with(low, ",").to_numpy(zero_copy_only=False)[tail]
            for c, those in ((",", comma), (".", ~comma)):
                for back, token in enumerate(reversed(self.ends[c])):
                    out[ends[tail][those] - 1 - back] = token
        return lengths, out


@functools.cache
def _word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_ids(texts: pa.Array, tokens: WordTokens, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of each text, with ``end_id`` after it."""
    offsets, codes, vocabulary = words(texts)
    n, flat = tokens.of(vocabulary)
    per_word = n[codes] if len(codes) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(per_word)])
    counts = before[offsets[1:]] - before[offsets[:-1]]
    out = np.full(int(counts.sum()) + len(counts), end_id, np.uint32)
    if len(codes):
        out[np.arange(len(out) - len(counts)) + np.repeat(np.arange(len(counts)), counts)] = flat[ragged((np.cumsum(n) - n)[codes], per_word)]
    return np.concatenate([[0], np.cumsum(counts + 1)]), out


def _cut_up(path: str, capacity: int, end_id: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("deal", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, deal = _word_tokens(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, most=12 << 20):
                offsets, ids = token_ids(part.column("text"), tokens, end_id)
                n = np.diff(offsets)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = ragged(np.zeros(len(n), np.int64), pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                at = offsets[row] + start
                little = ids.astype("<u4")
                crc = [zlib.crc32(little[a:b]) for a, b in zip(at, at + length)]
                columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(deal + np.arange(len(row)))]
                deal += len(row)
                if with_ids:
                    columns.append(pa.array([little[a:b].tobytes() for a, b in zip(at, at + length)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run, PIECE + ", deal long" + ", ids binary" * with_ids


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins needed at least: by the sum, and by pieces too large to share (Martello and Toth's L2)."""
    counts = np.bincount(np.asarray(lengths), minlength=capacity + 1)
    below = np.cumsum(counts)
    weight = np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    best = -(-int(weight[-1]) // capacity)
    for k in range(half + 1):
        big = int(below[capacity] - below[capacity - k])
        mid = int(below[capacity - k] - below[half])
        small = int(weight[half] - (weight[k - 1] if k else 0))
        room = mid * capacity - int(weight[capacity - k] - weight[half])
        best = max(best, big + mid + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that can take it."""
    bins: list[list[int]] = []
    open_at: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin with room r is open
    for x in sorted(lengths, reverse=True):
        fits = rooms >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                rooms ^= 1 << r
            bins[b].append(x)
        else:
            r, b = capacity, len(bins)
            bins.append([x])
        if r > x:
            open_at.setdefault(r - x, []).append(b)
            rooms |= 1 << (r - x)
    return bins


def _sums(total: int, last: int, used: int, left: list[int], held: int, least: int, steps: list[int]) -> Iterator[list[int]]:
    """Multisets of pieces no longer than ``last`` that sum to ``total``, longest piece first. ``used`` pieces of
    length ``last`` are spoken for; ``held`` has the bits of the lengths at hand, ``least`` is the shortest. A length
    is tried with its pieces one after the other on a stack of the caller's own, so a filling may have any number of them."""
    # a level: what it has to sum to, the lengths that it may still try, and how many pieces of ``a`` stand below it
    todo, fits, same, longest = [total], [held & ((2 << min(total, last)) - 1)], [used], [last]
    taken: list[int] = []
    while todo:
        if not fits[-1] or steps[0] <= 0:
            todo.pop(), fits.pop(), same.pop(), longest.pop()
            if taken:
                taken.pop()
            continue
        rest, a = todo[-1], fits[-1].bit_length() - 1
        fits[-1] ^= 1 << a
        steps[0] -= 1
        below = same[-1] if a == longest[-1] else 0
        if a > rest - least:  # what is left must hold one piece more
            fits[-1] &= (2 << max(0, rest - least)) - 1
        if left[a] <= below:
            continue
        if a == rest:
            yield [*taken, a]
            continue
        taken.append(a)
        todo.append(rest - a)
        fits.append(held & ((2 << min(rest - a, a)) - 1))
        same.append(below + 1)
        longest.append(a)


def _undominated(filling: list[int], slack: int, unused: int) -> bool:
    """Whether no unused piece could take the place of some of the filling's pieces, none included, and fill it as
    well or better; a piece of the same length in place of one alone is no gain."""
    one, more = 0, 0  # bits: sums of one piece, of several
    for x in filling:
        more |= (one | more) << x
        one |= 1 << x
    spread, width = more, 0
    single, reach = one << 1 if slack else 0, 1
    while width < slack:
        step = min(width + 1, slack - width)
        spread, width = spread | spread << step, width + step
    while reach < slack:
        step = min(reach, slack - reach)
        single, reach = single | single << step, reach + step
    return not unused & (spread | single | ((2 << slack) - 1))


def _fillings(x: int, room: int, left: list[int], held: int, steps: list[int]) -> Iterator[list[int]]:
    """All undominated fillings of the room beside a piece of length x, least waste first. While one is in use,
    its pieces may be out of ``left``; they have to be back when the next is asked for."""
    fits = held & ((2 << room) - 1)
    least = (fits & -fits).bit_length() - 1 if fits else room + 1
    for slack in range(room + 1):
        total = room - slack
        for filling in _sums(total, x, 1, left, held, least, steps) if total else [[]]:
            unused = held
            for a in {x, *filling}:
                if left[a] == filling.count(a) + (a == x):
                    unused &= ~(1 << a)
            if _undominated(filling, slack, unused):
                yield filling
        if steps[0] <= 0:
            return


def complete_bins(lengths: list[int], capacity: int, most_steps: int) -> list[list[int]]:
    """Bins of the fewest pieces found: bin completion with best-fit's bins as the first incumbent. A step is one
    piece tried in a filling."""
    best = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if len(best) <= bound:
        return best
    left, held = [0] * (capacity + 1), 0
    for x in lengths:
        left[x] += 1
        held |= 1 << x
    spare = (len(best) - 1) * capacity - sum(lengths)  # waste that a better solution may have
    steps = [most_steps]

    def take(pieces: list[int]) -> None:
        nonlocal held
        for x in pieces:
            left[x] -= 1
            if not left[x]:
                held ^= 1 << x

    def put_back(pieces: list[int]) -> None:
        nonlocal held
        for x in pieces:
            left[x] += 1
            held |= 1 << x

    def branch() -> Iterator[list[int]]:
        x = held.bit_length() - 1
        return ([x, *f] for f in _fillings(x, capacity - x, left, held, steps))

    path: list[list[int]] = []
    stack, waste = [branch()], 0
    while stack:
        bin_ = next(stack[-1], None)
        if steps[0] <= 0:
            break
        # fillings come by rising waste: the first that wastes too much ends its branch
        if bin_ is None or waste + capacity - sum(bin_) > spare:
            stack.pop()
            if path:
                undone = path.pop()
                put_back(undone)
                waste -= capacity - sum(undone)
            continue
        take(bin_)
        path.append(bin_)
        waste += capacity - sum(bin_)
        if held:
            stack.append(branch())
            continue
        best = [list(b) for b in path]
        spare = (len(best) - 1) * capacity - sum(lengths)
        if len(best) <= bound:
            break
        undone = path.pop()
        put_back(undone)
        waste -= capacity - sum(undone)
    return best


def _packed(capacity: int, steps_a_piece: int, turn: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "deal"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = group["length"].tolist()
        bins = complete_bins(lengths, capacity, steps_a_piece * len(lengths) + 1024)
        if turn and len(bins) >= group["sequence_id"].nunique():
            sequence, offset = group["sequence_id"].to_numpy(), group["offset"].to_numpy()
        else:
            rows: dict[int, list[int]] = {}
            for i, x in enumerate(lengths):
                rows.setdefault(x, []).append(i)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for number, bin_ in enumerate(bins):
                at = 0
                for x in bin_:
                    i = rows[x].pop()
                    sequence[i], offset[i] = turn << 56 | int(key[0]) << 32 | number, at
                    at += x
        out = group[["doc_id", "piece", "start", "length", "ids_crc32", "deal", "g"]].assign(sequence_id=sequence, offset=offset)
        fill = out.groupby("sequence_id")["length"].sum().sort_values(kind="stable")
        again = fill.index[: -(-len(fill) // MERGED)]
        return out.assign(again=out["sequence_id"].isin(again))

    return run, PIECE + ", deal long, g long, sequence_id long, offset long, again boolean"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, deal and, if asked for, ids (little-endian uint32) per piece."""
    run, schema = _cut_up(tokenizer_path, capacity, end_id, with_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, group_pieces: int = 8192, steps_a_piece: int = 24) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the place of every piece."""
    if capacity < 2:
        raise ValueError("capacity must be 2 at least")
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    place = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("deal"), "offset": F.lit(0).cast("long")}).select(*place)
    rest = pieces.where(F.col("length") < capacity)
    groups, turn = max(1, -(-rest.count() // group_pieces)), 0
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("deal"), F.lit(groups)))
    while True:
        run, schema = _packed(capacity, steps_a_piece, turn)
        packed = dealt.groupBy("g").applyInPandas(run, schema)
        if groups == 1:
            return out.unionByName(packed.select(*place))
        packed = cut(packed, "packed")
        out = out.unionByName(packed.where("not again").select(*place))
        groups, turn = -(-groups // MERGED), turn + 1
        dealt = packed.where("again").drop("again").withColumn("g", F.floor(F.col("g") / MERGED))
