"""Each operator against a plain version, and on every awkward table."""

import hashlib
import math
import os
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import helpers as H
from pricelattice.llm import bpe, common, licenses, mixing, neardup, pii, quality, sharding, substrings, vectors
from pricelattice.llm.common import Work

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
both = pytest.mark.parametrize("clashing", [False, True])


def pairs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# 10


def plain_jump(key, shards):
    b, j, mask = -1, 0, (1 << 64) - 1
    x = (key + 0x9E3779B97F4A7C15) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    x ^= x >> 31
    while j < shards:
        b = j
        x = (x * 2862933555777941757 + 1) & mask
        j = int((b + 1) * ((1 << 31) / ((x >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, 2, 7, 10**12, -5, 2**63 - 1])
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k) & ((1 << 64) - 1), n) for k in keys]


def test_jump_moves_little():
    keys = np.arange(50_000)
    a, b = sharding.jump_hash(keys, 8), sharding.jump_hash(keys, 9)
    assert ((a == b) | (b == 8)).all()
    assert abs((b == 8).mean() - 1 / 9) < 0.01 and np.bincount(a).min() > 0.95 * 50_000 / 8


@both
def test_shards(spark, clashing):
    rows = H.awkward(spark, clashing).drop("text")
    out = sharding.shard_rows(rows, 4).collect()
    assert len(out) == 18
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    assert all(r.grown_shard in (r.shard, 4) for r in out)
    assert sharding.shard_rows(H.empty(spark), 4).count() == 0


@data
def test_shard_query(spark):
    out = sharding.query(spark, SF).collect()
    texts = dict(pairs(spark))
    assert len(out) == len(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)


# 1


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    """Rounds: share out, clamp, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= epochs * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(rows):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    target = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6) and 0 <= r.taken <= 2 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)


def mixed(docs):
    out = mixing.take_mix(*mixing.mix_plan(docs))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def test_mix(spark):
    r = random.Random(5)
    rows = [(k, H.text(r.randrange(0, 60), k), "en", r.choice(["a", "b", "Z", "é", None, "hot", "hot", "hot"]), 1) for k in range(400)]
    docs = spark.createDataFrame(rows, H.DOCUMENTS)
    first = mixed(docs).collect()
    check_mix(first)
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, mixed(docs.repartition(7)).collect()), key=repr)
    assert {r.size for r in first} == {len(H.WORDS.findall(t)) for _, t, *_ in rows}


@both
def test_mix_awkward(spark, clashing):
    docs = H.awkward(spark, clashing)
    assert mixed(docs).count() == 18
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix_documents(H.empty(spark)).count() == 0 and mixed(H.empty(spark)).count() == 0


# 2


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_near(spark, n, num):
    r = random.Random(n)
    rows = []
    for g in range(12):
        base = H.text(60, g).split()
        for _ in range(9):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    docs = spark.createDataFrame(rows, H.DOCUMENTS)
    want = H.near_groups([(i, t) for i, t, *_ in rows], n, num, 100)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(docs, n, num, 100).collect()}
    assert got == want
    kept = {x.doc_id for x in neardup.drop_near_duplicates(docs, shingle=n, num=num, den=100).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_near_chunks(spark, monkeypatch):
    """Clusters that need several chunks give the same groups."""
    monkeypatch.setattr(neardup, "CHUNK", 300)
    base = H.text(60, 3).split()
    r = random.Random(4)
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(100)}"
        rows.append((k, " ".join(w), "en", "s", 1))
    want = H.near_groups([(i, t) for i, t, *_ in rows], 3, 85, 100)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, H.DOCUMENTS), 3, 85, 100).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


@both
def test_near_awkward(spark, clashing):
    docs = H.awkward(spark, clashing)
    out = neardup.near_duplicates(docs, 3, 85, 100).collect()
    assert len(out) == 18
    of = {r.doc_id: r.component_id for r in out}
    assert of[0] == of[1] == of[2] == of[-3] == -3 and of[6] == of[7] == 6 and of[9] == of[10] == 9 and of[3] == 3 and of[4] == 4 and of[5] == 5 and of[8] == 8
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {-3, 3, 4, 5, 6, 8, 9, 11, 12, 13, None}
    assert neardup.near_duplicates(H.empty(spark)).count() == 0


@data
def test_near_query(spark):
    want = H.near_groups(pairs(spark), 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.query(spark, SF).collect()} == want


def test_bands_hold_links():
    """Pairs at the threshold share a bucket."""
    r = np.random.default_rng(1)
    own = neardup.sketch(neardup.band_rows(85, 100))
    for size in (7, 20, 100, 400):
        cut = max(1, int(size * 0.075))
        for _ in range(40):
            common = r.integers(0, 2**63, size - cut, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, r.integers(0, 2**63, cut if size > 7 else k, dtype=np.uint64)])) for k in (0, 1))
            both_ = len(np.intersect1d(a, b))
            if 100 * both_ >= 85 * (len(a) + len(b) - both_):
                assert (own.bands(a) == own.bands(b)).any()


def test_links_of_a_cell():
    """The forest joins what all pairs would join; unlike sets cost little."""
    import time

    r = np.random.default_rng(0)
    for _ in range(200):
        n, some = int(r.integers(1, 14)), r.integers(0, 2**62, 30).astype(np.uint64)
        sets, num = [np.unique(r.choice(some, r.integers(1, 25))) for _ in range(n)], int(r.choice([50, 80, 85, 100]))

        def groups(edges, n=n):
            label = list(range(n))
            for a, b in edges:
                label = [label[a] if x == label[b] else x for x in label]
            return {frozenset(k for k in range(n) if label[k] == x) for x in label}

        both = lambda a, b: len(np.intersect1d(a, b))
        alike = [(i, j) for i in range(n) for j in range(i) if 100 * both(sets[i], sets[j]) >= num * (len(sets[i]) + len(sets[j]) - both(sets[i], sets[j]))]
        got = neardup.link(list(range(n)), sets, num, 100)
        assert groups(got) == groups(alike) and len(got) == n - len(groups(got))
    took = []
    for n in (400, 3200):
        sets = [np.unique(r.integers(0, 2**62, 200).astype(np.uint64)) for _ in range(n)]
        at = time.perf_counter()
        assert neardup.link(list(range(n)), sets, 85, 100) == []
        took.append(time.perf_counter() - at)
    assert took[1] < 30 * took[0]


# 3


def plain_cut(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        stays = bytearray(b"\1") * len(b)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                stays[s : s + 100] = bytes(100)
            seen.add(w)
        kept = bytes(x for x, k in zip(b, stays, strict=True) if k)
        out[i] = (len(b), len(b) - len(kept), sum(not k and (n == 0 or bool(stays[n - 1])) for n, k in enumerate(stays)), hashlib.sha256(kept).hexdigest())
    return out


def cut(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()}


@pytest.mark.parametrize("hot", [4096, 2])
def test_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    r = random.Random(9)
    passages = [H.text(n, 100 + n) for n in (14, 16, 25, 60)]
    rows = []
    for k in range(60):
        parts = [H.text(r.randrange(0, 40), k)] + [x for _ in range(r.randrange(0, 3)) for x in (r.choice(passages), H.text(r.randrange(1, 20), 999 * k + r.randrange(9)))]
        rows.append((k * 3 % 61, " ".join(parts), "en", "s", 1))
    rows += [(100, "ab" * 400, "en", "s", 1), (101, "é" * 300, "en", "s", 1), (102, "x" * 99, "en", "s", 1), (103, "x" * 100, "en", "s", 1), (104, "x" * 101, "en", "s", 1), (105, None, None, None, None), (106, "", "", "", 0)]
    docs = spark.createDataFrame(rows, H.DOCUMENTS)
    assert cut(docs) == plain_cut([(i, t) for i, t, *_ in rows])


def test_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 500)
    rows = [(k, H.text(400, k % 3), "en", "s", 1) for k in range(6)]
    assert cut(spark.createDataFrame(rows, H.DOCUMENTS)) == plain_cut([(i, t) for i, t, *_ in rows])


@both
def test_substrings_awkward(spark, clashing):
    out = substrings.dedup_substrings(H.awkward(spark, clashing)).collect()
    assert len(out) == 18 and all(r.n_removed == 0 for r in out if r.doc_id is None)
    assert substrings.dedup_substrings(H.empty(spark)).count() == 0


@both
@pytest.mark.parametrize("hot", [4096, 2])
def test_substrings_that_repeat_an_id(spark, monkeypatch, clashing, hot):
    """Rows of one id and text are one document, rows of other texts documents of their own, by a hash of the text."""
    monkeypatch.setattr(substrings, "HOT", hot)
    t1, t2, t3 = (H.text(n, n) for n in (60, 61, 62))
    rows = [(1, t1), (7, t1), (7, t2), (7, t2), (9, t3), (9, t3[:200] + t2), (9, t1 + t3), (4, t3), (4, t3 + t3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], H.DOCUMENTS).withColumn("tie", F.xxhash64("text"))
    order = sorted({(r.doc_id, r.tie, r.text) for r in docs.collect()})
    want = plain_cut([(k, t) for k, (_, _, t) in enumerate(order)])
    want = sorted((order[k][0], *v) for k, v in want.items() for _ in range(rows.count((order[k][0], order[k][2]))))
    docs = docs.withColumns({c: F.lit("x") for c in ("doc", "digest", "gone", "n", "sha", "kept")}) if clashing else docs.drop("tie")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect())
    assert got == want and (7, len(t2.encode()), 0, 0, hashlib.sha256(t2.encode()).hexdigest()) in got


@data
def test_substrings_query(spark):
    want = plain_cut(pairs(spark))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.query(spark, SF).collect()} == want


def test_suffix_array():
    r = random.Random(3)
    for n, letters in [(1, 1), (9, 1), (300, 2), (500, 4), (700, 255)]:
        b = bytes(r.randrange(letters) for _ in range(n))
        t = np.frombuffer(b, np.uint8)
        order = substrings.suffix_array(t)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        lcp = substrings.common_prefixes(t, order)
        for k in range(1, n):
            assert lcp[k] == len(os.path.commonprefix([b[order[k] :], b[order[k - 1] :]]))


# 4


def plain_license(t):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(H.LOWER))
    hits = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license(spark):
    texts = ["CC BY", "a cc-by b CC  by.", "ccby cc byx", "The GENERAL public, license! General Public License", "all rights reserved; All Rights\nReserved cc by-nc", "émit cc by é", "", None, "x" * 10, "MIT License", "ccc by", "cc by cc by cc", "0cc by"]
    r = random.Random(1)
    texts += ["".join(r.choice(["cc", "by", "CC", " ", "-", "all", "rights", "reserved", "general", "public", "license", "é", "1", "\n"]) for _ in range(30)) for _ in range(300)]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    out = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame(rows, H.DOCUMENTS)).collect()}
    for k, t in enumerate(texts):
        x = out[k]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == plain_license(t), t
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1


@pytest.mark.parametrize(("text", "label"), [("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), ("GNU General Public License, version 3", "gpl-3.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause")])
def test_license_rules(text, label):
    assert label in licenses.scan_text(text)["labels"].split(",")


def test_license_settles():
    # of one rule's detections those inside another go, those that overlap in part stay
    assert [d[:2] for d in licenses.settle([(0, 10, 3, "a", 0.5), (2, 5, 3, "a", 0.5), (8, 14, 3, "a", 0.5), (0, 10, 3, "a", 0.5), (13, 20, 4, "b", 0.5), (14, 20, 5, "c", 0.5)])] == [(0, 10), (8, 14), (14, 20)]
    r = random.Random(5)
    for _ in range(300):
        found = [(a, a + r.randrange(1, 9), r.randrange(4), "x", 0.5) for a in (r.randrange(40) for _ in range(r.randrange(12)))]
        kept = []
        for d in sorted(set(found), key=lambda d: (d[2], d[0] - d[1], d[0])):  # longest first within a rule
            if not any((k[2] < d[2] and k[0] < d[1] and d[0] < k[1]) or (k[2] == d[2] and k[0] <= d[0] and d[1] <= k[1]) for k in kept):
                kept.append(d)
        assert licenses.settle(found) == sorted(kept)
    assert [d[3] for d in licenses.settle([(0, 10, 1, "wide", 0.5), (2, 5, 2, "inside", 0.5), (9, 12, 0, "first", 0.5), (20, 25, 5, "far", 0.5)])] == ["inside", "first", "far"]
    assert [d[3] for d in licenses.settle([(0, 10, 1, "wide", 0.5), (2, 5, 2, "inside", 0.5)])] == ["wide"]
    assert sum(map(len, licenses.rules()[1].values())) >= 300


def test_many_detections_take_little_time():
    import time

    hits, spans = [], []
    for n in (5_000, 50_000):
        at = time.perf_counter()
        licenses.scan_text("Released under the MIT License. " * n)
        hits.append(time.perf_counter() - at)
        at = time.perf_counter()
        t = "call 212-555-0101 or me@x.org. " * n
        pii.candidates(t, pii.base_spans(t))
        spans.append(time.perf_counter() - at)
    assert hits[1] < 40 * hits[0] and spans[1] < 40 * spans[0]


@pytest.mark.parametrize("text", ["Released under the MIT Licence.", "Released under the MIT\nLicense.", "Released under  the  MIT  License."])
def test_license_wrapped(text):
    assert "mit" in licenses.scan_text(text)["labels"].split(",")
    assert "gpl-3.0" in licenses.scan_text("GNU General\n * Public License version 3")["labels"].split(",")


@both
def test_license_awkward(spark, clashing):
    assert licenses.scan_licenses(H.awkward(spark, clashing)).count() == 18
    assert licenses.scan_licenses(H.empty(spark)).count() == 0


# 5 and 7


def vector_rows(n=300, dim=8, seed=2):
    r = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in r.normal(size=dim).astype(np.float32)]) for k in range(n)]
    rows += [(n + k, rows[5][1]) for k in range(60)]  # one common vector
    return rows


BAD = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [1.0] * 8)]


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def plain_best(rows, every, k, of):
    """Every row is a candidate; query rows of one id are one query, which takes the best that any of them has."""
    out = []
    for i in {i for i, _ in rows if i % every == 0}:
        found = sorted((min(of(q, x) for n, q in rows if n == i), j) for j, x in rows if j != i)[:k]
        out += [(i, n + 1, j, s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def plain_topk(rows, every, k):
    q = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows]
    return [(i, n, j, -s) for i, n, j, s in plain_best(q, every, k, lambda a, b: -int(a @ b))]


def plain_nearest(rows, every, k):
    v = [(i, np.array(x, np.float32).astype(np.float64)) for i, x in rows if any(x)]
    return plain_best(v, every, k, lambda a, b: float(vectors.euclid(a, b[None, :])[0]))


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2048)
    rows = vector_rows()
    got = vectors.top_products(vector_frame(spark, rows + BAD), 20, 20)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == plain_topk(rows, 20, 20)


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2048)
    rows = vector_rows()
    got = vectors.nearest(vector_frame(spark, rows + BAD + [(1004, [0.0] * 8)]), 20, 10)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == plain_nearest(rows, 20, 10)


@pytest.mark.parametrize("clashing", [False, True])
def test_vectors_that_repeat_an_id(spark, monkeypatch, clashing):
    """Copies of a query, other vectors under its id, copies of candidates; columns named like those used inside."""
    monkeypatch.setattr(vectors, "BLOCK", 512)
    monkeypatch.setattr(vectors, "CELL_BLOCKS", 2)
    rows = vector_rows(90)
    rows += [rows[20], rows[20], (20, rows[33][1]), (40, rows[7][1]), (60, rows[60][1]), rows[7], rows[7], (7, rows[8][1])]
    df = vector_frame(spark, rows)
    if clashing:
        for c in ("id", "rid", "v", "cell", "part", "place", "score", "rank", "query_id", "dist", "annulus"):
            df = df.withColumn(c, F.lit("x"))
    got = [sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in x.collect()) for x in (vectors.top_products(df, 20, 20), vectors.nearest(df, 20, 10))]
    assert got == [plain_topk(rows, 20, 20), plain_nearest(rows, 20, 10)]


def test_annuli_are_left_out(spark, monkeypatch):
    """On clustered vectors a query meets less than half of all, and still finds the best."""
    monkeypatch.setattr(vectors, "BLOCK", 1024)
    monkeypatch.setattr(vectors, "SAMPLE", 256)
    monkeypatch.setattr(vectors, "LEAST", 32)
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    rows = [(n, [float(x) for x in (centres[n % 12] * (1 + n % 3) + r.normal(size=16) * 0.05).astype(np.float32)]) for n in range(1500)]
    seen = spark.sparkContext.accumulator(0)
    got = vectors.top_products(vector_frame(spark, rows), 20, 20, visited=seen)
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()) == plain_topk(rows, 20, 20)
    share = seen.value / (75 * 1500)
    print(f"visited {share:.2f}")
    assert share < 0.5


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 0.0, 2.0])]
    wide = [(i, v + [0.0] * (3 - len(v))) for i, v in rows]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.top_products(vector_frame(spark, rows)).collect()) == plain_topk(wide, 20, 20)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.nearest(vector_frame(spark, rows), 20).collect())
    assert got == plain_nearest(wide, 20, 10)
    for f in (vectors.top_products, vectors.nearest):
        assert f(vector_frame(spark, [])).count() == 0 and f(vector_frame(spark, BAD)).count() == 0


def test_large_components(spark):
    rows = [(k, [float(2**40 + k * 3), float(k)]) for k in (0, 1, 2, 20)]
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want = sorted((r[0], r[1], r[2]) for r in plain_nearest(exact, 20, 10))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in vectors.nearest(vector_frame(spark, rows), 20).collect()) == want


# 6


@data
def test_quality(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = quality.query(spark, sf).collect()
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.95


def test_quality_by_a_plain_version(spark):
    """Vectors, pooling and score, word by word, for the weights that were fitted."""
    from pricelattice.llm.words import word_hashes

    texts = ["the cat sat on the mat", "a dog, a DOG and the Cat", "", "one", "no no no!", "the cat the dog 12 a1"] * 3 + [H.text(30, k) for k in range(20)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, H.DOCUMENTS)
    model = quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, quality int"))
    code = lambda w: int(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])
    index = lambda h: quality.index_vectors(np.array([h], np.uint64))[0]
    lists = [[w for w in H.WORDS.findall(t)] for t in texts]
    sums: dict = {}
    for ws in lists:
        for k, w in enumerate(ws):
            v = sums.setdefault(code(w.translate(H.LOWER)), np.zeros(quality.WIDTH))
            for n in (k - 1, k + 1):
                if 0 <= n < len(ws):
                    v += index(code(ws[n].translate(H.LOWER))) * np.sqrt(quality.PLACES)
    vocabulary, vectors, shapes, network = model
    assert set(vocabulary.tolist()) == set(sums)
    plain_vector = {h: v / max(1e-9, np.sqrt((v**2).sum())) for h, v in sums.items()}
    assert all(np.allclose(vectors[k], plain_vector[h], atol=1e-6) for k, h in enumerate(vocabulary.tolist()))
    import pyarrow as pa

    got = quality.pool(pa.array(texts), vocabulary, vectors, shapes)
    for k, ws in enumerate(lists):
        n = max(1, len(ws))
        mean = sum((plain_vector[code(w.translate(H.LOWER))] for w in ws), np.zeros(quality.WIDTH)) / n
        repeats = sum(a.translate(H.LOWER) == b.translate(H.LOWER) for a, b in zip(ws, ws[1:], strict=False)) / n
        assert np.allclose(got[k, : quality.WIDTH], mean, atol=1e-6) and np.isclose(got[k, -2], repeats) and np.isclose(got[k, -1], np.log(1 + len(ws)) / 10)
    z = [float(np.tanh(((x - network.mean) / network.scale) @ network.p[0] + network.p[1]) @ network.p[2] + network.p[3][0]) for x in got]
    want = {k: 1 / (1 + np.exp(-v / network.temperature)) for k, v in enumerate(z)}
    scored = {r.doc_id: r._score for r in quality.score_quality(docs, model).collect()}
    assert all(np.isclose(scored[k], want[k], atol=1e-9) for k in want)
    # words beyond the vocabulary keep their index vectors
    few = quality.pool(pa.array(["cat zebra"]), vocabulary[:0], vectors[:0], shapes)[0]
    assert np.allclose(few[: quality.WIDTH], (index(code("cat")) + index(code("zebra"))) / 2, atol=1e-6)


def test_quality_repeated_ids(spark):
    """Ids that repeat count once in the fit, whatever the order of rows."""
    rows = [(k % 40, H.text(20 + k % 7, k) if k % 2 else "bad!! " * (20 + k % 5), "en", "s", 1) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    one, other = (quality.fit(spark.createDataFrame(r, H.DOCUMENTS).repartition(n), labels)[-1] for r, n in ((rows, 3), (rows[::-1], 5)))
    assert np.allclose(one.p[0], other.p[0]) and one.temperature == other.temperature


def test_quality_learns_from_its_fold(spark):
    """Labels of the held-out fold change nothing."""
    rows = [(k, H.text(40, k) if k % 2 else "bad!! " * 40, "en", "s", 1) for k in range(120)]
    docs = spark.createDataFrame(rows, H.DOCUMENTS)
    held = [k for k in range(120) if zlib.crc32(str(k).encode()) % 5 == 0]
    a = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    b = spark.createDataFrame([(k, 1 - k % 2 if k in held else k % 2) for k in range(120)], "doc_id long, quality int")
    x, y = ({r.doc_id: r._score for r in quality.score_quality(docs, quality.fit(docs, t)).collect()} for t in (a, b))
    assert x == y and all((x[k] > 0.5) == bool(k % 2) for k in held)


def test_quality_sends_a_text_once(spark, monkeypatch):
    """What goes to the workers for a document has its text once, not beside a row that holds it too."""
    sent, score = [], quality.score_quality
    monkeypatch.setattr(quality, "score_quality", lambda docs, model, text="text", keep=("doc_id",): (sent.append(docs.select(*dict.fromkeys([*keep, text]))), score(docs, model, text, keep))[1])
    docs = spark.createDataFrame([(k, f"marker{k} some words", "en", "a", 1) for k in range(3)], H.DOCUMENTS)
    out = quality.keep_quality(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"), 0.0)
    assert sorted(out.collect()) == sorted(docs.collect())
    assert [str(r).count("marker") for r in sent[0].collect()] == [1, 1, 1]


@both
def test_quality_awkward(spark, clashing):
    docs = H.awkward(spark, clashing)
    for labels in ([], [(0, 1)], [(0, 1), (8, 0), (6, 1), (3, None), (None, 1)]):
        t = spark.createDataFrame(labels, "doc_id long, quality int")
        out = quality.keep_quality(docs, t, 0.0)
        assert out.columns == docs.columns and out.count() == 18
    t = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(H.empty(spark), quality.fit(H.empty(spark), t)).count() == 0


# 8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_bpe(library):
    own = bpe.load(bpe.vocabulary())
    r = random.Random(1)
    texts = ["", " ", "a<|endoftext|>b <|startoftext|>", "Σας ΣΑΣ İstanbul ﬁ é ẞ ＡＢＣ 日本語 🎉🎉 café", "x" * 5000, "'sssss can't I'LL we've", "a\x85b\xa0c\x1cd\x1fe f", "\x00\x01", H.text(2000, 4)]
    texts += ["a" + chr(c) + "b " + chr(c) + " " for c in range(1, 0x250)]
    texts += ["".join(r.choice([chr(r.randrange(1, 0x250)), chr(r.randrange(0x20, 0x7F)), " ", "the", "ing", chr(r.randrange(0x250, 0x3000)), chr(r.randrange(0x10000, 0x1F900))]) for _ in range(60)) for _ in range(500)]
    rows = [np.frombuffer(own.encode(t), np.int32) for t in texts]
    assert [x.tolist() for x in rows] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    off = np.cumsum([0, *map(len, rows)])
    assert [b.decode() for b in own.decode_all(np.concatenate(rows), off)] == [library.decode(x.tolist(), skip_special_tokens=False) for x in rows]


def test_bpe_parts_by_bytes(library):
    """Long texts do not wait for each other: a part has about a megabyte, and one longer text stands alone."""
    texts = ["", None, "a short one", *["some words of a long text " * 12_000] * 4, "b " * 700_000, "last"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = list(bpe._encode(bpe.vocabulary(), "text", ["doc_id"])([batch]))
    assert len(parts) > 2 and all(p.num_rows == 1 or sum(len(t or "") for t in p.column("decoded").to_pylist()) <= 2 << 20 for p in parts)
    got = {k: ids for p in parts for k, ids in zip(p.column("doc_id").to_pylist(), p.column("ids").to_pylist(), strict=True)}
    assert list(got) == list(range(len(texts)))
    assert all(got[k] == library.encode(texts[k] or "", add_special_tokens=False).ids for k in got)


def test_bpe_task_leaves_nothing(monkeypatch):
    """A worker that is used again holds the tables, but not the answers of the task before, nor Arrow's unused memory."""
    own, calls = bpe.load(bpe.vocabulary()), []
    held = lambda: sum(len(v) for v in vars(own).values() if isinstance(v, dict))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(f"unheard{k}of, Word{k}" for k in range(500))])], ["doc_id", "text"])
    own.encode("unheard of")
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: calls.append(1)))
    assert len(list(bpe._encode(bpe.vocabulary(), "text", ["doc_id"])([batch]))) == 1
    assert held() <= sum(len(v) for v in vars(bpe.BacktrackingBpe(bpe.vocabulary())).values() if isinstance(v, dict))
    assert calls == [1]


@both
def test_bpe_awkward(spark, library, clashing):
    docs = H.awkward(spark, clashing)
    out = bpe.encode_documents(docs, bpe.vocabulary(), keep=("doc_id", "n_chars")).collect()
    want = sorted([library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()])
    assert sorted(list(r.ids) for r in out) == want
    assert bpe.encode_documents(H.empty(spark), bpe.vocabulary()).count() == 0


# 9


def plain_spans(t):
    import re

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(pii.digits(m.group())) <= 19 and pii.luhn(pii.digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(pii.digits(m.group())) <= 15]
    return sorted(out)


def test_base_spans():
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("ab.@-+1234567890 .@-(%é") for _ in range(80))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("4111 1111-1111 1111 and 0001.2.3.255")[0][1] == 2
    pii.base_spans("a" * 200_000 + "@" + "1" * 200_000)


def test_added_spans(spark):
    rows = [(k, f"word {k} token = \"04dbebab91ab85687d33eeaaf9ac{k:02d}ab\" call me@x.org", "en", "s", 1) for k in range(30)] + [(99, "Version 123-45-6789 of nothing", "en", "s", 1)]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, H.DOCUMENTS)).collect()}
    assert all("secret:" in out[k].spans and out[k].base in out[k].spans and out[k].n_email == 1 for k in range(30))
    shown = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, H.DOCUMENTS)).collect()}
    assert all("[EMAIL]" in shown[k] and "[SECRET]" in shown[k] and "@" not in shown[k] for k in range(30))


def plain_chosen(t, weights):
    """The spans of one text by the definitions, one pair of spans against another."""
    base, more = plain_spans(t), []
    found = sorted((m.start(), k, m.end()) for k, _, p in pii.WIDE for m in p.finditer(t))
    for a, k, b in found:
        if (k == 8 and not t[a:b].split(" ")[0].lower() in pii.FIRST_NAMES and not t[a:b].split(" ")[0].rstrip(".") in ("Mr", "Mrs", "Ms", "Dr", "Prof", "Mme", "Mlle", "Herr", "Frau", "Sr", "Sra")):
            continue
        if not any(x < b and a < y for x, _, y in base + more):
            more.append((a, k, b))
    score = lambda a, k, b: pii.features(k, pii.votes(t, k, a, b), min(60, b - a), int(len(pii.digits(t[a:b])) / (b - a) * 20) / 20 * min(60, b - a), *pii.context(t, a, b)) @ weights
    return pii.joined(sorted(base + [s for s in more if 1 / (1 + np.exp(-score(*s))) >= pii.CUT]))


def test_added_spans_by_a_plain_version(spark):
    r = random.Random(3)
    bits = ["Dr. Anna Schmidt", "contact Peter Miller", "Louvain Parc", "12 Main Street", "rue de la Loi 16", "token=04dbebab91ab85687d33eeaaf9ac", "password: hunter", "DE89370400440532013000", "123-45-6789", "00:1a:2b:3c:4d:5e", "call (212) 555-0101", "version 212-555-0101", "me [at] home [dot] org", "a@b.org", "10.1.2.3", "4111 1111 1111 1111", "the", "of.", "and,", "\n"]
    rows = [(k, " ".join(r.choice(bits) for _ in range(r.randrange(1, 25))), "en", "s", 1) for k in range(150)]
    docs = spark.createDataFrame(rows, H.DOCUMENTS)
    weights = pii.fit(pii.look(docs))
    got = {x.doc_id: x.spans for x in pii.find_pii(docs).collect()}
    assert got == {i: plain_chosen(t, weights) for i, t, *_ in rows} and any("person:" in s for s in got.values()) and any("iban:" in s for s in got.values())


def test_reliabilities():
    """Labelers that agree are trusted more than one that votes at random."""
    r = random.Random(7)
    counts = {}
    for _ in range(4000):
        y = r.random() < 0.4
        v = tuple((1 if (y if r.random() < p else not y) else -1) for p in (0.95, 0.9, 0.9, 0.5, 0.85, 0.9))
        counts[v] = counts.get(v, 0) + 1
    prior, t = pii.reliabilities(counts)
    assert abs(prior - 0.4) < 0.05 and t[1, 0, 2] > 0.85 and abs(t[1, 3, 2] - 0.5) < 0.1
    assert pii.posterior((1, 1, 1, 0, 1, 1), prior, t) > 0.9 > 0.1 > pii.posterior((-1, -1, -1, 0, -1, -1), prior, t)


@both
def test_pii_awkward(spark, clashing):
    docs = H.awkward(spark, clashing)
    assert pii.find_pii(docs).count() == 18
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == 18
    assert pii.find_pii(H.empty(spark)).count() == 0 and pii.redact(H.empty(spark)).count() == 0


# Shared parts


def test_components(spark):
    from pricelattice.llm.graph import components

    edges = [(k, k + 1) for k in range(50)] + [(200, k) for k in range(201, 260)] + [(300, 300), (401, 400), (400, 401)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Work(spark, "t")).collect()}
    assert out == {**{k: 0 for k in range(51)}, **{k: 200 for k in range(200, 260)}, 400: 400, 401: 400}
    assert components(spark.createDataFrame([], "a long, b long"), Work(spark, "t")).count() == 0
