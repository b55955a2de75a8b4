"""Operators 11 to 13 against brute force and on edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text, lexical, negatives
from tests.conftest import SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_search(docs, items, k):
    """(item place, rank, doc_id, score) by scoring every document."""
    held = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for place, (item, text) in enumerate(items):
        scores = []
        for doc, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text or "")) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, d[3], -d[0]) for r, d in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


# -- 11


def test_terms_are_runs_of_letters_and_digits():
    texts = pa.array(["A1-b_C", None, "", "ÉÀ x\x7fy\x00z", "  ", "x" * 9 + "." + "ß2"])
    offsets, codes, vocabulary = lexical.terms(texts)
    assert [[vocabulary[int(c)].as_py() for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [TERM.findall(lower(t or "")) for t in texts.to_pylist()]
    sliced = texts.slice(3, 2)
    offsets, codes, vocabulary = lexical.terms(sliced)
    assert [vocabulary[int(c)].as_py() for c in codes] == ["ÉÀ", "x", "y", "z"]


@pytest.mark.parametrize("seed", range(3))
def test_search_against_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = [(i if i % 17 else None, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.choice([0, 1, 5, 40, 300]))) if i % 13 else None) for i in range(700)]
    docs += docs[:5] + [(9000, "W1 " * 40_000)]
    items = [(1, "w1 w1 w50"), (2, "w0"), (2, "w59 W58, w57"), (None, "w3 w40 w41 w42"), (4, None), (5, "none of these"), (6, " ".join(words))]
    monkeypatch.setattr(lexical, "SHARD", 20_000)
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("term", F.lit("y")).repartition(3)
    got = lexical.ranked(rows, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items, 7)


def test_windows_and_accumulators_find_the_same(monkeypatch):
    """A shard's search with skipping against all its scores, over many windows, short and long lists."""
    rng = np.random.default_rng(5)
    size = 5000
    shares = [0.9, 0.4, 0.2, 0.01, 0.002]
    lists = [np.flatnonzero(rng.random(size) < s).astype(np.int32) for s in shares]
    times = [rng.integers(1, 9, len(x)).astype(np.int32) for x in lists]
    lengths = rng.integers(20, 400, size)
    none = [[] for _ in lists]
    part = pa.table({"term": ["", *"abcde"], "held": pa.array([0, *map(len, lists)], pa.int32()), "docs": pa.array([None, *lists], pa.list_(pa.int32())), "times": pa.array([None, *times], pa.list_(pa.int32())), "ids": pa.array([list(range(size)), *[None] * 5], pa.list_(pa.int64())), "lengths": pa.array([lengths.tolist(), *[None] * 5], pa.list_(pa.int64())), "weight": [0, 150, 900, 1600, 4000, 6000], "items": [[], *none]})
    shard = lexical._Shard(part, size, int(lengths.sum()))
    for asked in ([0, 1, 2, 3, 4], [0], [0, 4], [3, 4], [1, 2]):
        pairs = [(t, int(shard.weight[t]) * (1 + t % 2)) for t in asked]
        whole = np.zeros(size, np.int64)
        for t, w in pairs:
            whole[shard.doc[shard.list_of(t)]] += w * shard.impact[shard.list_of(t)]
        order = np.lexsort((np.arange(size), -whole))[:20]
        place, score = lexical.best_of(shard, pairs, 20)
        want = order[whole[order] > 0]
        assert place.tolist() == want.tolist() and score.tolist() == whole[want].tolist()


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs, items).count() == 0
    assert lexical.ranked(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0
    assert lexical.ranked(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), items).count() == 0


def test_long_lengths_stay_exact():
    assert lexical.lengths_scaled(np.array([10**9]), 10**12, 10**13).tolist() == [75 + 25 * 10**9 * 10**12 // 10**13]


# -- 12


def brute_negatives(rows, anchor, positives=5, negatives_=5):
    out = []
    for a, va, la in rows:
        if a % anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, v, lab in rows if i != a)
        best = [(i, -s) for s, i, lab in scored if lab == la][:positives]
        for p, ps in best:
            hard = [(i, -s) for s, i, lab in scored if lab != la and 80 * ps <= -100 * s <= 100 * ps][:negatives_]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,block", [(0, 1 << 19), (1, 64), (2, 40)])
def test_negatives_against_brute_force(spark, seed, block):
    rng = random.Random(seed)
    centre = [[rng.choice([-1, 0, 0.5, 1]) for _ in range(8)] for _ in range(4)]
    data = [(i, [float(rng.choice(centre)[d] + rng.choice([-0.25, 0, 0, 0.25])) for d in range(8)], rng.randrange(4)) for i in range(260)]
    data += [(300, [0.0] * 8, 1), (310, [1.0] * 8, 2)]
    frame = spark.createDataFrame([*data, (1000, None, 1), (1010, [1.0, None] + [0.0] * 6, 1), (1020, [float("nan")] * 8, 1), (1030, [1.0] * 8, None), (None, [1.0] * 8, 1), (1040, [1.0, 2.0], 3)], "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x"))
    got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, block_values=block)
    want = brute_negatives([(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in data], 10)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_reading_stops_before_the_end():
    """Clustered rows: the threshold falls below the best of the anchor's cluster long before all rows are met."""
    rng = np.random.default_rng(0)
    far = rng.normal(0, 20, (20_000, 16))
    v = np.floor(np.concatenate([far, rng.normal(0, 5, (40, 16)) + 300]))
    lists = negatives.Lists(np.arange(len(v)), v)
    met = 0
    for rows, scores, threshold in lists.reads(v[-1]):
        met = len(rows)
        if threshold is None or np.sort(scores)[-6] > threshold:
            break
    assert met < len(v) / 10
    want = sorted(((-int(s), int(i)) for i, s in enumerate(v @ v[-1]) if i != len(v) - 1))[:5]
    assert negatives.nearest(lists, len(v) - 1, v[-1], 5) == [(i, -s) for s, i in want]


def test_many_rows_of_one_label_fill_many_blocks(spark):
    same = spark.range(3000).select(F.col("id").alias("vec_id"), F.array([F.lit(1.0) + F.col("id") % 5, F.lit(2.0)]).cast("array<float>").alias("embedding"), F.when(F.col("id") < 2900, 1).otherwise(2).alias("label"))
    rows = negatives.usable(same, F.col("label"), 4)
    assert negatives._packed(rows, 256, ["vec_id", "label", "q"]).count() > 20
    got = negatives.hard_negatives(same, F.col("vec_id") % 1000 == 0, scale=4, block_values=256)
    data = [(i, [4 * (1 + i % 5), 8], 1 if i < 2900 else 2) for i in range(3000)]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(data, 1000)


def test_wide_numbers_stay_exact(spark):
    frame = spark.createDataFrame([(0, [2e6, 1.0], 1), (1, [2e6, 2.0], 1), (2, [2e6, -1.0], 2), (3, [1.9e6, 7.0], 2)], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in negatives.hard_negatives(frame, F.col("vec_id") == 0).collect()]
    q = {i: [math.floor(256 * x) for x in v] for i, v in ((0, [2e6, 1.0]), (1, [2e6, 2.0]), (2, [2e6, -1.0]), (3, [1.9e6, 7.0]))}
    dot = lambda a, b: sum(x * y for x, y in zip(q[a], q[b]))
    assert sorted(got) == [(0, 1, 1, 2, dot(0, 1), dot(0, 2)), (0, 1, 2, 3, dot(0, 1), dot(0, 3))]


# -- 13

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div><article><h1>Headline &amp; more</h1><p>First paragraph, which is long enough to be one.
 It has two lines &copy 2024.<p>Second <b>bold<br>text</b> with 1 < 2 and <a href="x>y">a link</a>.<script>var x = "</p>";</script></p></article>
<!-- no <p>text</p> --><aside><h3>Popular</h3><p>Another story that is popular now.</p></aside><section id="comments"><p>I liked it, thanks for this. Good work!</p></section>
<form><label>Name</label><input><button>Send</button></form><footer>&copy; 2024 The site &middot; All rights reserved.</footer>"""


def test_blocks_of_a_page():
    got = [(b.text, b.path[-1]) for b in html_text.blocks_of(PAGE)]
    assert got[:3] == [("Home", "li"), ("More", "li"), ("We use cookies to make this site better for you.", "p")]
    assert ("First paragraph, which is long enough to be one. It has two lines © 2024.", "p") in got
    assert ("Second bold text with 1 < 2 and a link.", "p") in got and ("Name", "form") in got
    assert not any("var x" in t or "no <p>" in t or t == "T" for t, _ in got)


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<<<>>>", "<p", "<p class=\"x", "</p></div>", "<!--", "<script>x", "<a href='>'>y", "a<b", "<p>x</p>" * 5, "<div>" * 500 + "deep", "\x00<p>\x00", "<br/><hr/><img src=x>t", "<table><tr><td>1<td>2<tr><td>3</table>", "&#x41;&#66;&bogus;&am"])
def test_any_page_has_blocks(html):
    made = html_text.blocks_of(html)
    assert all(b.text and b.text == " ".join(b.text.split()) for b in made)
    assert len(html_text.features_of(made)) == len(made)


def test_broken_pages_take_time_in_proportion():
    import time

    for piece in ('<a "', "<p title='", "<script", "<!--", "</", "<p><b>"):
        began = time.time()
        html_text.blocks_of(piece * 30_000)
        assert time.time() - began < 6, piece


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 0, 6, 3]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    x, step, start = rng.normal(size=(sum(sizes), 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    got = html_text.viterbi(x, offsets, step, start)
    import itertools

    for a, b in zip(offsets, offsets[1:]):
        if a == b:
            continue
        best = max(itertools.product((0, 1), repeat=int(b - a)), key=lambda y: start[y[0]] + sum(x[a + i, v] for i, v in enumerate(y)) + sum(step[u, v] for u, v in zip(y, y[1:])))
        assert got[a:b].tolist() == list(best)


def test_chain_gradient_by_differences():
    """The fitted field's conditional likelihood is at a maximum in its transitions, up to the penalty."""
    rng = np.random.default_rng(1)
    labels = np.repeat(rng.integers(0, 2, 60), 5)
    slots = [[int(y) if rng.random() < 0.7 else 1 - int(y), 7] for y in labels]
    offsets = np.arange(0, 301, 30)
    field = html_text.fit_chain(slots, labels, offsets, steps=300)

    def likelihood(step):
        x, total = field.potentials(slots), 0.0
        for a, b in zip(offsets, offsets[1:]):
            v = field.start + x[a]
            score = v[labels[a]]
            for t in range(a + 1, b):
                score += step[labels[t - 1], labels[t]] + x[t, labels[t]]
                v = np.logaddexp.reduce(v[:, None] + step, axis=0) + x[t]
            total += score - np.logaddexp.reduce(v)
        return total - 0.25 * (step**2).sum()

    best = likelihood(field.step)
    for i in range(2):
        for j in range(2):
            for d in (-0.3, 0.3):
                other = field.step.copy()
                other[i, j] += d
                assert likelihood(other) < best + 0.05


def test_main_text_of_labelled_pages(spark):
    """Held-out accuracy: pages of the given table, the article by its tags; and a page that has other mark-up."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    extra = spark.createDataFrame([(9001, None, None), (9002, "u", ""), (None, "u", PAGE), (None, "u", PAGE), (9003, "v", PAGE.replace("article>", "div>").replace("<div><h1>", '<div class="post-content"><h1>'))], "page_id long, url string, html string")
    got = {(r.page_id, r.url): r for r in html_text.main_text(pages.unionByName(extra, allowMissingColumns=True)).collect()}
    assert got[9001, None].text == "" and got[9002, "u"].text == "" and got[9001, None].n_chars == 0
    want = "Headline & more\n\nFirst paragraph, which is long enough to be one. It has two lines © 2024.\n\nSecond bold text with 1 < 2 and a link."
    assert got[None, "u"].text == want and got[9003, "v"].text == want and got[9003, "v"].n_chars == len(want)
    right = 0
    rows = pq.read_table(f"{SMALL}/pages.parquet").to_pylist()
    for r in rows:
        blocks = html_text.blocks_of(r["html"])
        right += got[r["page_id"], r["url"]].text == "\n\n".join(b.text for b in blocks if "article" in b.path)
    assert right >= 0.98 * len(rows)


def test_pages_without_mark_up_and_empty_tables(spark):
    plain = "<html><body><div><a href=x>Home</a></div><p>A paragraph of text, which has some length to it.</p><p>And another one, also long enough.</p></body></html>"
    rows = spark.createDataFrame([(1, "u", plain)], "page_id long, url string, html string")
    assert "A paragraph of text" in html_text.main_text(rows).first().text
    assert html_text.main_text(rows.limit(0)).count() == 0
    assert [tuple(r) for r in html_text.main_text(spark.createDataFrame([(1, "u", None)], rows.schema)).collect()] == [(1, "u", "", 0)]


# -- 7 and 10 on many short texts and on null or repeated ids


def test_packing_many_short_texts(spark):
    """Fillings of thousands of pieces: documents of one and two tokens beside a few long ones."""
    import public_tokenizers

    from tessera.llm import packing

    texts = ["the " * 679] * 6 + ["the"] * 2053 + ["the the"] * 700 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), group_pieces=4096).collect()
    assert sorted((r.doc_id, r.piece) for r in got) == [(i, 0) for i in range(len(texts))]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(by) == -(-sum(r.length for r in got) // 2048)


def test_fillings_of_thousands_of_pieces():
    from tessera.llm import packing

    lengths = [700] * 9 + [1] * 2500 + [2] * 1500
    bins = packing.complete_bins(lengths, 2048, 24 * len(lengths) + 1024)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= 2048
    left, held = [0] * 2049, 0
    for x in lengths:
        left[x] += 1
        held |= 1 << x
    first = next(packing._sums(1500, 2, 0, left, held & 7, 1, [10**6]))
    assert sum(first) == 1500 and first == [2] * 750


@pytest.mark.parametrize("kind", ["null", "one"])
def test_near_duplicates_of_null_and_repeated_ids(spark, kind):
    """Every row of a null or shared id has near copies; classes and sizes as with unique ids, in no more joins."""
    from tessera.llm import near_dup

    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(40)] for _ in range(150)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "end"]) for b in base] + [" ".join(b) for b in base]
    unique = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    shared = spark.createDataFrame([(None if kind == "null" else 7, t) for t in texts], "doc_id long, text string")
    got = near_dup.near_duplicates(shared).collect()
    assert sorted(r.n_shingles for r in got) == sorted(n for n, _ in unique.values())
    if kind == "null":
        assert all(r.component_id is None and not r.kept for r in got)
    else:
        assert all(r.component_id == 7 and r.kept for r in got)
    mixed = spark.createDataFrame([(None if i >= 150 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = near_dup.near_duplicates(mixed).collect()
    assert Counter(r.component_id for r in found) == Counter(c for _, c in unique.values())
