"""The corpus operators against brute force, round trips and edge cases."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, media, mixing, near_dup, packing, stages, text, token_count, top_k, toxicity, url_filter, warc
from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, score double, fp string, p double"


def small(name):
    p = f"{SMALL}/{name}.parquet"
    return pq.read_table(p)


def docs_with_edges(spark, n=60):
    """Some documents, then nulls, empty and blank texts, repeats, a long text, and columns with odd names."""
    t = small("documents").slice(0, n).to_pylist()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], 0.5, "x", 1.0) for r in t]
    rows += [(9001, None, None, None, None, None, None), (9002, "", "en", "", 0.1, "y", 2.0), (9003, " \t\n", "en", "src0", 0.1, "y", 2.0), (None, "the one that has no id at all", None, "src1", None, None, None)]
    rows += [rows[0], (9004, " ".join(f"word{i % 97}" for i in range(30_000)), "en", "src0", 1.0, "z", 3.0), (9005, "12 34 !!", "fr", "src2", 1.0, "z", 3.0)]
    return spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        p = f"{SMALL}/{t}.parquet"
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert ours == sorted(map(repr, duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        pq.write_table(small(t).slice(0, 0), tmp_path / f"{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_words_by_batch():
    t = pa.array([" a  B\tc\x0b", None, "", "\x1c x y", "a"])
    offsets, codes, vocabulary = text.words(t, lower=True)
    got = [[vocabulary[int(c)].as_py() for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])]
    assert got == [WORD.findall((x or "").replace("B", "b")) for x in t.to_pylist()]


# -- 1


def test_mix_hits_targets_and_repeats(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    source = {r.doc_id: r.source for r in docs.collect()}
    by = defaultdict(list)
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
        by[source[r.doc_id]].append(r)
    total = sum(r.size for r in got)
    assert abs(sum(rows[0].target for rows in by.values()) - total) < 1e-6 * total
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows)
        longest = max(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= longest


def test_targets_stop_at_three_times(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1), ("d", 0), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got["b"] == 3 and got["c"] == 3 and got["d"] == 0
    assert abs(sum(got.values()) - 152) < 1e-9 and abs(got[None] / 2 - got["a"]) < 1e-9


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, z = rng.random(500), rng.integers(1, 900, 500).astype(float)
    out = mixing.flight(p, z, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ z - p @ z) < 1e-3


def test_equal_rows_are_dealt_over_blocks(spark):
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text of five words").alias("text"), F.when(F.col("id") < 15_000, "a").otherwise("b").alias("source"))
    got = mixing.mix(same, block=256)
    rows = Counter((r.source_size, r.copies) for r in got.select("source_size", "copies").collect())
    assert sum(rows.values()) == 20_000
    parts = same.select("source", "doc_id", F.lit(5).cast("long").alias("size"), F.monotonically_increasing_id().alias("place")).withColumn("part", F.shiftright("place", 33))
    counts = {r.source: (r.n, r.d, r.m) for r in mixing.numbered(parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("again").alias("d"), F.max("again").alias("m")).collect()}
    assert counts == {"a": (15_000,) * 3, "b": (5_000,) * 3}
    taken = {s: sum(n * c for (x, c), n in rows.items() if x == s) * 5 for s in (75_000, 25_000)}
    assert abs(taken[75_000] - 100_000 / 3) < 50 and abs(taken[25_000] - 200_000 / 3) < 50


def _water_level(sizes, weights=(1, 2, 3), cap=3.0):
    """Targets by repeated sharing out: what is above a cap is dealt again to those below, by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        share = {s: cap * sizes[s] if s in full else left * w[s] / rest for s in names} if rest else {s: cap * sizes[s] for s in names}
        over = {s for s in names if s not in full and share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return share
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {**{f"s{i}": rng.choice([0, 1, 5, 40, 900, 10_000]) for i in range(rng.randrange(1, 9))}, None: 7}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = _water_level(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_edges(spark):
    got = mixing.mix(docs_with_edges(spark)).collect()
    assert len(got) == 67 and all(r.taken == 0 for r in got if r.size == 0)


# -- 2


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0]), (8, [-1.0, 0.3])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k.top_k(v, F.col("vec_id") % 50 == 0, k=2).collect()}
    assert got == {(0, 1): (1, 65536), (0, 2): (2, 65536), (50, 1): (0, 32768), (50, 2): (1, 32768)}


def test_top_k_with_many_equal_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (np.ones(8) if i % 3 else rng.normal(size=8))]) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows}
    want = {(a, n): (b, s) for a in q if a % 50 == 0 for n, (s, b) in enumerate(sorted(((int(q[a] @ q[b]), b) for b in q if b != a), key=lambda x: (-x[0], x[1]))[:5], 1)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k.top_k(v, F.col("vec_id") % 50 == 0).collect()}
    assert got == want


def _brute_top_k(rows, k=5):
    """The ranking of each query id over whole integer scores, rows one by one."""
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = {}
    for i in {i for i, _ in q if i % 50 == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), j) for n, a in q if n == i for j, b in q if j != i and len(a) == len(b))
        out |= {(i, r): (j, -s) for r, (s, j) in enumerate(found[:k], 1)}
    return out


def test_top_k_in_many_blocks_with_repeated_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 180)), [float(x) for x in rng.normal(size=6)]) for _ in range(420)]  # repeated ids, other vectors
    rows += [(200, [1.0] * 6), (201, [1.0] * 6), (201, [1.0] * 6), (202, [-3.0] * 6), (50, []), (203, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = _brute_top_k(rows)
    for block_values in (300, 6):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k.top_k(v, F.col("vec_id") % 50 == 0, block_values=block_values).collect()}
        assert got == want


def test_top_k_keeps_the_best_of_rows_that_repeat_an_id(spark):
    v = spark.createDataFrame([(50, [1.0, 0.0]), (2, [0.1, 0.0]), (2, [0.9, 0.0]), (3, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k.top_k(v, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(2, 58880), (3, 32768), (2, 6400)]


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [2.0, 1e7]), (4, [1e9, -1e9]), (50, [1e7, 2e9]), (5, [0.5, 0.25])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k.top_k(v, F.col("vec_id") % 50 == 0).collect()}
    assert got[0, 1] == (1, 2**63 - 1) and (2, -(2**63)) not in [got[0, r] for r in range(1, 6)]
    exact = {(i, r): x for (i, r), x in _brute_top_k([r for r in rows if r[0] > 2]).items() if abs(x[1]) < 2**63}
    assert exact and all(x in [got[50, r] for r in range(1, 6)] for (i, _), x in exact.items() if i == 50)


# -- 3


def test_media_round_trip(spark):
    df = docs_with_edges(spark)
    got = {}
    for r in media.round_trip(spark, df).collect():
        got.setdefault(r.doc_id, r)
    for r in df.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_media_ranges_read_each_member_once(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    manifest = media.write_media(docs, f"file://{tmp_path}/m")
    whole = media.read_media(spark, manifest).count()
    pieces = media.read_media(spark, manifest, range_bytes=3000)
    assert pieces.count() == whole == docs.count() and pieces.select("archive", "member").distinct().count() == whole


def test_a_member_is_fetched_again_after_a_failure(tmp_path, monkeypatch):
    import zipfile

    import pyarrow.fs as pafs

    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x", b"abc")
    with zipfile.ZipFile(path) as z:
        (member,) = z.infolist()
    calls = []

    class Flaky:
        def open_input_file(self, p):
            calls.append(p)
            if len(calls) == 1:
                raise OSError("lost")
            return pafs.LocalFileSystem().open_input_file(p)

    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    assert media.fetch(Flaky(), path, member) == b"abc" and len(calls) == 2
    with open(path, "r+b") as f:
        f.truncate(10)
    with pytest.raises(OSError, match="no member header"):
        media.fetch(pafs.LocalFileSystem(), path, member)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x", b"abc")
    member.CRC ^= 1
    with pytest.raises(OSError, match="checksum"):
        media.fetch(pafs.LocalFileSystem(), path, member)


# -- 4


def test_warc_edges(spark):
    big = "x" * 1500
    rows = [(1, "http://a.b/\r\nX: y", big, 0), (7, None, big, 0), (None, "http://n", big, 0), (7, "http://again", big, 0), (3, "http://s", "tiny", 0), (4, "http://s", "tiny", 0), (5, "http://e", None, 0)]
    got = sorted(map(repr, (tuple(r) for r in warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect())))
    d = hashlib.sha1(big.encode()).hexdigest()
    t, e = hashlib.sha1(b"tiny").hexdigest(), hashlib.sha1(b"").hexdigest()
    want = [(1, 1500, d, "revisit", 7), (7, 1500, d, "response", None), (7, 1500, d, "response", None), (None, 1500, d, "revisit", 7), (3, 4, t, "response", None), (4, 4, t, "response", None), (5, 0, e, "response", None)]
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("groups", [1, warc.HOT_GROUPS])
def test_common_payloads_and_a_very_long_one(spark, monkeypatch, groups):
    """The copies of one page are most of all pages, some groups are pairs; with 1 only the first isn't met by digest."""
    monkeypatch.setattr(warc, "HOT_GROUPS", groups * 2)
    rng = random.Random(4)
    texts = ["y" * 1200] * 300 + [f"{i // 2}" * 1100 for i in range(20)] + ["short"] * 40 + [rng.randbytes(3 << 20).hex()]
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()}
    last = {t: i for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        to = last[t] if len(t) >= 1000 and last[t] != i else None
        assert got[i] == (len(t), hashlib.sha1(t.encode()).hexdigest(), "response" if to is None else "revisit", to)
    assert len(got) == len(texts)


def test_ranges_of_archives_are_read_by_many_tasks(spark):
    archives = spark.createDataFrame([(f"a{i}", 1000) for i in range(4)], "path string, bytes long")
    assert warc.read_warc(archives, "file:///tmp", 100).rdd.getNumPartitions() == 40


def test_every_record_has_one_owner(tmp_path):
    rng = random.Random(2)
    records = [warc.warc_record(i, f"http://h/{i}", rng.randbytes(rng.randrange(3000)) + warc.MAGIC * 3, None) for i in range(80)]
    path = tmp_path / "w.warc.gz"
    path.write_bytes(b"".join(records))
    size = path.stat().st_size
    import pyarrow.fs as pafs

    for step in (100, 777, 5000, size):
        seen = []
        with pafs.LocalFileSystem().open_input_file(str(path)) as f:
            for a in range(0, size, step):
                seen += [warc._parsed(c)["record_id"] for c in warc.scan(f, a, min(a + step, size))]
        assert seen == [f"urn:page:{i}" for i in range(80)]


# -- 5


def test_token_counts_against_brute_force(spark):
    pieces = token_count.zipf_pieces(public_tokenizers.path("piece_bpe_32k.model"))

    def brute(w):
        t = token_count.MARK + w
        best = [(0, 0)]
        for e in range(1, len(t) + 1):
            n = len(t[e - 1].encode())
            options = [(best[e - 1][0] + n * pieces.byte_weight, best[e - 1][1] - n)]
            options += [(best[s][0] + pieces.weights[t[s:e]], best[s][1] - 1) for s in range(e) if t[s:e] in pieces.weights]
            best.append(max(options))
        return -best[-1][1]

    df = docs_with_edges(spark, 15)
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in token_count.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).collect())
    memo = {}
    want = []
    for r in df.collect():
        ws = WORD.findall(r.text or "")
        want.append((str(r.doc_id), len(ws), sum(memo.setdefault(w, brute(w)) if w not in memo else memo[w] for w in ws)))
    assert got == sorted(want)


# -- 6


def test_toxicity_learns_from_labels(spark):
    rng = random.Random(4)
    clean = ["river", "stone", "cloud", "meadow", "lantern", "window", "harbour", "orchard"]
    rude = ["blockhead", "numbskull"]
    rows = []
    for i in range(800):
        bad = i % 4 == 0
        ws = [rng.choice(clean) for _ in range(rng.randrange(20, 60))]
        if bad:
            ws[rng.randrange(len(ws))] = rng.choice(rude)
            ws[rng.randrange(len(ws))] = rng.choice(rude) + "s"
        rows.append((i, " ".join(ws), int(bad)))
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(None, None, None), (900, "", "en")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(900, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i].predicted, x) for i, _, x in rows if got[i].held_out]
    assert len(held) > 100 and sum(p == x for p, x in held) / len(held) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert got[None].score == got[900].score and got[None].held_out is False
    assert toxicity.toxicity(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0] == 0.0


def _spelled(w):
    b = w.encode()
    return [b[:k] for k in toxicity.STEMS if len(b) > k] + [b + b"$"]


def _brute_kneser_ney(train):
    """P(word) by class of every word in ``train`` (doc_id, words, toxic), and the probability that the model
    gives to all steps of each depth, from the formula in the module's docstring."""
    rows = [set(ws) for _, ws, _ in train]
    toxic = [y for _, _, y in train]
    scale = sum(toxic) / (len(toxic) - sum(toxic))
    n, above, depth = defaultdict(lambda: [0.0, 0.0]), {}, {}
    for ws, y in zip(rows, toxic):
        for u in {u for w in ws for u in _spelled(w)}:
            n[u][0 if y else 1] += 1 if y else scale
    for ws in rows:
        for w in ws:
            for d, u in enumerate(_spelled(w)):
                above[u], depth[u] = (_spelled(w)[d - 1] if d else b""), d
    e = {u: [max(0, c[i] - toxicity.GROWTH * math.log(1 + sum(toxic)) - toxicity.TIED * c[1 - i]) for i in (0, 1)] for u, c in n.items()}
    siblings = defaultdict(float)
    for u, c in n.items():
        siblings[above[u], depth[u]] += sum(c)
    p, sums = {b"": [1.0, 1.0]}, []
    for d in range(3):
        at = [u for u in n if depth[u] == d]
        q = [sum(p[above[u]][i] * sum(n[u]) / siblings[above[u], d] for u in at) for i in (0, 1)]
        total, beyond = ([sum(x[u][i] for u in at) for i in (0, 1)] for x in (n, e))
        for u in at:
            shared = sum(n[u]) / siblings[above[u], d]
            left = 1 - max(beyond[i] / total[i] if total[i] else 0 for i in (0, 1))
            p[u] = [(q[i] * e[u][i] / total[i] if total[i] else 0) + left * p[above[u]][i] * shared for i in (0, 1)]
        unseen = [q[i] * (max(beyond[j] / total[j] if total[j] else 0 for j in (0, 1)) - (beyond[i] / total[i] if total[i] else 0)) for i in (0, 1)]
        sums.append(([sum(p[u][i] for u in at) + unseen[i] for i in (0, 1)], q))
    return p, sums


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(12)
    made = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    rows = []
    for i in range(300):
        bad = int(i % 3 == 0)
        ws = [rng.choice(made) for _ in range(20)] + [rng.choice(["insult", "insults", "insulting", "oaf"])] * bad + (["insulin", "oats"] if i % 7 == 0 and not bad else [])
        rows.append((i, ws, bad))
    rows += [(1000 + i, *rows[0][1:]) for i in range(40)]  # copies of a text count once
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = toxicity.sliced(docs, ["doc_id"])
    train = toxicity.training_rows(held.rows, labels)
    classes = Counter((r.toxic, r.part) for r in train.collect())
    model = toxicity.model_of(toxicity.counted(held, train), classes)
    entries = {c: np.array(v) for c, v in model.entries.toPandas().to_dict("list").items()}
    once = {}
    for i, ws, y in sorted(rows):
        if zlib.crc32(str(i).encode()) % 5:
            once.setdefault(tuple(ws), (i, ws, y))
    asked = sorted({w for _, ws, _ in rows for w in ws} | {"insultant", "insulted", "unseen"})
    for k in (0, 2):
        train = [r for r in once.values() if not k or zlib.crc32(str(r[0]).encode()) % 5 != k]
        p, sums = _brute_kneser_ney(train)
        for total, q in sums:
            assert all(abs(a - b) < 1e-9 for a, b in zip(total, q))
        got = toxicity.word_ratios(toxicity.steps(pa.array(asked)), entries, model.kept[k], k)
        assert max(got) > 1
        for w, ratio in zip(asked, got):
            if _spelled(w)[-1] in p:
                t, o = p[_spelled(w)[-1]]
                assert abs(ratio - (math.log(t) - math.log(o))) < 1e-9, w
    assert got[asked.index("insultant")] > 0.5  # by its stem


def test_toxicity_edges(spark):
    rng = random.Random(5)
    clean = ["river", "stone", "cloud", "meadow"]
    rows = [(i, " ".join([rng.choice(clean) for _ in range(20)] + ["oaf,", "(oafish)"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1, "a", "b") for i, t, _ in rows] + [(5000, " ".join(["stone"] * 40_000 + ["oaf"] * 20_000), 0, "", ""), (5001, "x" * 300_000, 0, "", ""), (5001, "x" * 300_000, 0, "", "")], "doc_id long, text string, toxic int, t string, slice string")
    labels = spark.createDataFrame([(i, 0, x, "u") for i, _, x in rows] + [(i, 0, 0, "u") for i, _, _ in rows], "doc_id long, quality int, toxic int, o string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[5000] == 1 and by[5001] == 0 and all(by[i] == x for i, _, x in rows)
    assert len({r.score for r in got if r.doc_id == 5001}) == 1


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    rank = {r.doc_id: i for i, r in enumerate(sorted(got, key=lambda r: (r.score, r.doc_id)))}
    bad = [rank[r.doc_id] for r in got if r.toxic]
    auc = (sum(bad) - len(bad) * (len(bad) - 1) / 2) / (len(bad) * (len(got) - len(bad)))
    assert auc > 0.95
    assert sum(r.predicted for r in got if not r.toxic) < 0.02 * len(got) and sum(r.predicted for r in got if r.toxic) > 0.85 * len(bad)


# -- 7


def test_tokens_equal_the_tokenizers_own():
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = small("documents")["text"].to_pylist()[:40] + ["It's A Test. a's, x'll! <|endoftext|> <|ENDOFTEXT|> a<|endoftext|>b. ÀÉ école ΣΑΣ İs 12,5 a.b. hello... ...a. 日本語。 ß é x y\x85z naïve, Ünï.", None, "", " \t"]
    offsets, ids = packing.token_ids(pa.array(texts), tokens, 0)
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert list(ids[a:b]) == tokens.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]


def test_packing_is_gapless_and_tight(spark):
    df = docs_with_edges(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(df, path, capacity=512).collect()
    tokens = packing.WordTokens(path)
    want = []
    for r in df.collect():
        ids = np.array(tokens.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(str(r.doc_id), i // 512, i, len(ids[i : i + 512]), zlib.crc32(ids[i : i + 512].tobytes())) for i in range(0, len(ids), 512)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 512
    assert len(by) <= math.ceil(sum(w[3] for w in want) / 512) + 2


def test_bin_completion_beats_best_fit():
    lengths = [6, 6, 5, 5, 4, 4] * 3 + [7, 3] * 2
    bins = packing.complete_bins(lengths, 15, 100_000)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= 15
    assert len(bins) == packing.lower_bound(lengths, 15) <= len(packing.best_fit(lengths, 15))


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_finds_the_optimum_of_small_cases(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 12) for _ in range(9)]

    def optimum(left, rooms):
        if not left:
            return len(rooms)
        x, best = left[0], len(rooms) + len(left)
        for i in range(len(rooms)):
            if rooms[i] >= x:
                best = min(best, optimum(left[1:], rooms[:i] + [rooms[i] - x] + rooms[i + 1 :]))
        return min(best, optimum(left[1:], [*rooms, 12 - x]))

    assert len(packing.complete_bins(lengths, 12, 50_000)) == optimum(sorted(lengths, reverse=True), [])


@pytest.mark.parametrize("seed", range(8))
def test_fillings_are_all_undominated_ones(seed):
    rng = random.Random(seed)
    x, room = 12, 18
    lengths = sorted((rng.randrange(1, 13) for _ in range(8)), reverse=True)
    want = set()
    for bits in itertools.product([0, 1], repeat=len(lengths)):
        filling = tuple(v for v, b in zip(lengths, bits) if b)
        unused = [v for v, b in zip(lengths, bits) if not b]
        slack = room - sum(filling)
        parts = [c for k in range(len(filling) + 1) for c in itertools.combinations(filling, k)]
        if slack >= 0 and not any(sum(c) <= y <= sum(c) + slack and c != (y,) for c in parts for y in unused):
            want.add(filling)
    left, held = [0] * 31, 0
    for v in [x, *lengths]:
        left[v] += 1
        held |= 1 << v
    got = [tuple(f) for f in packing._fillings(x, room, left, held, [10**6])]
    assert len(got) == len(set(got)) and set(got) == want
    assert [room - sum(f) for f in got] == sorted(room - sum(f) for f in got)


def test_packing_in_many_groups_packs_their_emptiest_bins_again(spark):
    rng = random.Random(11)
    texts = [" ".join(["word"] * rng.randrange(1, 60)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(df, path, capacity=64, group_pieces=12).toPandas()
    assert sorted(got["doc_id"]) == list(range(400))
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 64
    rest = packing.token_pieces(df, path, 64).where("length < 64")
    alone = rest.withColumn("g", F.pmod(F.xxhash64("deal"), F.lit(-(-rest.count() // 12)))).toPandas()
    bins = sum(len(packing.complete_bins(g["length"].tolist(), 64, 10**5)) for _, g in alone.groupby("g"))
    full = int((got["length"] == 64).sum())
    assert packing.lower_bound(got["length"].tolist(), 64) <= got["sequence_id"].nunique() < bins + full


# -- 8


def test_url_rules_against_all_rules(spark):
    rng = random.Random(6)
    labels = ["a", "b", "co", "x-y", "www"]
    rules = {(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(["/", "/p/", "/p/q", ""])): rng.choice(["allow", "block"]) for _ in range(40)}
    urls = [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))}{rng.choice(['', '/', '/p/z', '/p/q?r', '#f', '?a=/p/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "http://", "HTTP://WWW.A.B/p/", "ftp://a..b/", "http://a.b."]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], url_filter.RULE_SCHEMA)).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(-len(h) - len(p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = min(fit) if fit else (0, None, "allow")
        assert got[i] == (host, path, best[1], best[2]), u


def test_no_url_rules_and_a_very_long_host(spark):
    host = ".".join(["x" * 50] * 4000) + ".net"
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, f"http://{host}/es/1"), (3, None)], "page_id long, url string")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert {(r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, none).collect()} == {(1, None, "allow"), (2, None, "allow"), (3, None, "allow")}
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.default_rules(spark)).collect()}
    assert got == {1: ("a.com", "com/", "allow"), 2: (host, "net/es/", "block"), 3: ("", None, "allow")}


# -- 9


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    x, step, start = rng.normal(size=(6, 3)), np.exp(rng.normal(size=(3, 3))), np.exp(rng.normal(size=3))
    offsets = np.array([0, 0, 1, 4, 6])
    got, _ = language.posteriors(x, offsets, step, start)
    import itertools

    for a, b in zip(offsets, offsets[1:]):
        want = np.zeros((b - a, 3))
        for labels in itertools.product(range(3), repeat=int(b - a)):
            w = start[labels[0]] if labels else 0
            for t, l in enumerate(labels):
                w *= math.exp(x[a + t, l]) * (step[labels[t - 1], l] if t else 1)
            for t, l in enumerate(labels):
                want[t, l] += w
        if b > a:
            assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True), atol=1e-5)


def test_switches_in_blocks():
    rng = np.random.default_rng(2)
    b, s, a = rng.random((50, 3)), rng.random((3, 3)), rng.random((50, 3))
    want = sum((x[:, None] * s * y[None]) / (x[:, None] * s * y[None]).sum() for x, y in zip(b, a))
    assert np.allclose(language.switches(b, s, a), want)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_a_language_for_every_row(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{i} text of its own", f"l{i:02d}") for i in range(40)]
    got = language.language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    learned = {r.doc_id for r in got if not r.held_out}
    assert len(got) == 40 and all(int(r.lang_pred[1:]) in learned and 0 <= r.score <= 1 for r in got)


def test_training_stretches_are_bounded(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (1, 24, 25, 5000)] + ["x" * 50_000, "  ", ""]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)] + [(8, None, "a")], "doc_id long, text string, lang string")
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5]
    want = Counter(" ".join(w[k : k + 24])[: language.STRETCH_CHARS] for w in (t.split() for t in learned) for k in range(0, len(w), 24))
    got = [r.text for r in language.training_sample(docs).collect()]
    assert Counter(got) == want
    few = [r.text for r in language.training_sample(docs, stretches=10).collect()]
    assert few == got[:10] and sum(map(len, few)) <= 10 * language.STRETCH_CHARS


def test_language_edges(spark):
    got = {r.doc_id: r for r in language.language(docs_with_edges(spark)).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (9001, 9002, 9003, 9005))
    assert got[None].held_out is False and got[None].lang_pred != "und"
    assert {r.lang_pred for r in language.language(docs_with_edges(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# -- 10


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s = len(sets[a] & sets[b])
            if sets[a] and 100 * s >= percent * (len(sets[a]) + len(sets[b]) - s) and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(140):  # copies with more and more edits of their own: linked ones, and many that no other reaches
        ws = list(base)
        for _ in range(rng.randrange(0, 7)):
            ws[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    rows += [(200 + i, "same text of a few words that repeats") for i in range(30)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE two"), (304, "two one"), (305, " ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_prefix_pairs_lose_no_similar_pair(spark, percent):
    rng = random.Random(percent)
    template = list(range(40))  # every set holds it; most pairs stay below the threshold
    made = [sorted({*template, *rng.sample(range(100, 160), rng.choice([3, 8, 20, 60]))}) for _ in range(60)]
    made += [sorted(set(rng.sample(range(100, 130), 25)) | {1000 + i % 2}) for i in range(20)]
    made = [list(m) for m in {tuple(m) for m in made}]
    sets = spark.createDataFrame([(bytes([i]), m) for i, m in enumerate(made)], "fp binary, members array<long>")
    live = spark.createDataFrame([(bytes([i]), len(m), 0, bytes([i])) for i, m in enumerate(made)], "fp binary, n long, u long, c binary")
    got = {tuple(sorted((bytes(r.fp), bytes(r.q)))) for r in near_dup.prefix_pairs(live, sets, percent).collect()}
    alike = lambda a, b: 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))
    assert got >= {(bytes([i]), bytes([j])) for j, b in enumerate(made) for i, a in enumerate(made[:j]) if alike(a, b)}
    one = live.withColumn("c", F.lit(b"x"))
    assert near_dup.prefix_pairs(one, sets, percent).isEmpty()


def test_near_duplicate_edges(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "p q r s t"), (1, "a b c d e f")]
    got = sorted(map(repr, (tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    want = [(1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 2, 1, False), (None, 1, None, False)]
    assert got == sorted(map(repr, want))


def test_every_bin_of_a_sketch_fills():
    for n in (1, 2, 40, 5000):
        s = near_dup.sketches(np.array([0, n]), text.mix(np.arange(n, dtype=np.uint64)))
        assert (s != np.iinfo(np.uint64).max).all()


def test_sketches_estimate_similarity():
    x = text.mix(np.arange(3000, dtype=np.uint64))
    for shared in (0.5, 0.9):
        a, b = x[:2000], x[int(2000 * (1 - shared)) : int(2000 * (1 - shared)) + 2000]
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s, t = (near_dup.sketches(np.array([0, 2000]), np.sort(y))[0] for y in (a, b))
        assert abs((s == t).mean() - j) < 0.15


# -- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = docs_with_edges(spark).withColumn("times", F.lit(1)).withColumn("rank_in_id", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SMALL)
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = {r.doc_id for r in docs.collect()}
    assert not kept & {9001, 9002, 9003, 9005}
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in placed.select("doc_id").distinct().collect()} == kept


def test_stages_keep_clean_documents_and_drop_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = stages.keep_known_languages(spark, docs, "/root/testdata/sf0.01")
    assert known.count() >= 0.995 * docs.count()
    left = stages.drop_near_duplicates(spark, docs, SMALL)
    rows = [(r.doc_id, r.text) for r in docs.limit(300).collect()]
    few = docs.where(F.col("doc_id").isin([i for i, _ in rows]))
    assert {r.doc_id for r in stages.drop_near_duplicates(spark, few, SMALL).collect()} == {c for _, c in brute_components(rows, 80).values()}
    assert left.count() < docs.count()


def test_near_duplicate_stage_keeps_different_texts_of_one_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    df = spark.createDataFrame([(7, texts[0], "s"), (7, texts[1], "s"), (8, texts[0], "s"), (None, texts[1], "s")], "doc_id long, text string, source string")
    left = stages.drop_near_duplicates(spark, df, SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(7, texts[0]), (7, texts[1])]


def test_near_duplicate_stage_keeps_a_row_of_every_group(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for j in range(rng.randrange(1, 5)):
            ws = list(base)
            ws[-1] = f"edit{j}"
            rows.append((rng.choice([None, 1, 2, 100 * g + j]), " ".join(ws), g))
    rows += [(None, None, 98), (None, "", 99), (5, " ", 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key long")
    left = stages.drop_near_duplicates(spark, df, SMALL).collect()
    assert sorted(r.row_key for r in left) == [*range(12), 98, 99, 100]
    assert all(r in [tuple(x) for x in rows] for r in map(tuple, left))


def test_mixing_stage_without_ids(spark):
    rows = [(None, f"some words number {i} " * (i % 7 + 1), "en", "ab"[i % 2]) for i in range(200)] + [(None, "the same text", None, None)] * 50 + [(None, None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = Counter(map(tuple, stages.mix_sources(spark, df, SMALL).collect()))
    assert set(taken) <= set(rows) and all(n <= 3 * rows.count(r) for r, n in taken.items()) and sum(taken.values()) > 200


def test_stages_on_empty_and_unlabelled_tables(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        pq.write_table(small(t).slice(0, 0), tmp_path / f"{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(i, f"word{i} and other words of text {i}", None, "s") for i in range(30)] + [(None, "no id here at all", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(map(repr, docs.collect())) == sorted(repr(r) for r in spark.createDataFrame(rows, docs.schema).collect())


def test_language_stage_without_labelled_rows_keeps_documents_with_letters(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in stages.keep_known_languages(spark, df, SMALL).collect()] == [1]
