"""Exact, line, fingerprint and vector deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import components, embedding_dedup, exact_dedup, line_dedup, simhash

DOCS = "doc_id long, text string, k string, n long, body string, fp string, value string"


def frame(spark, texts):
    """Documents with other columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "k", 1, "b", None, "v") for i, t in texts], DOCS)


def groups_of(n, linked):
    """Least reachable number of each of n things."""
    out = list(range(n))
    for a, b in linked:
        a, b = sorted((out[a], out[b]))
        if a != b:
            out = [a if x == b else x for x in out]
    return out


TEXTS = [None, "", "a", "A", "a", "x" * 200_000, "x" * 200_000, "a\n", "é", None, " ", "a"]


def test_exact_dedup(spark):
    rows = list(enumerate(TEXTS)) + [(11, "a")]
    got = {}
    for r in exact_dedup.exact_dedup(frame(spark, rows), bucket_capacity=2).collect():
        got.setdefault(r.doc_id, []).append(r)
    members = defaultdict(list)
    for i, t in rows:
        members[t or ""].append(i)
    for i, t in rows:
        for r in got[i]:
            want = members[t or ""]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(want), len(want), i == max(want), hashlib.sha256((t or "").encode()).hexdigest())
    assert sum(map(len, got.values())) == len(rows)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_equal_slots_with_other_texts_are_told_apart(spark, monkeypatch):
    real = exact_dedup.F.unhex
    monkeypatch.setattr(exact_dedup.F, "unhex", lambda c: exact_dedup.F.substring(real(c), 1, 0))
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: exact_dedup.F.lit(7).cast("long"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame(spark, [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c")])).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_directory_splits_overfull_buckets(spark):
    from pyspark.sql import functions as F

    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    depth, slots = exact_dedup.directory(keys, 50)
    rows = {r.slot: (r.bucket, r.depth) for r in slots.collect()}
    assert len(rows) == 1 << depth
    bits = (1000 // 50).bit_length() + 4
    sizes = Counter(rows[(r.k & ((1 << 64) - 1)) >> (64 - depth)] for r in keys.collect())
    assert max(sizes.values()) <= 50 and len(sizes) > 16
    for slot, (bucket, d) in rows.items():
        assert slot >> (depth - d) << (bits - d) == bucket
    # a bucket that isn't overfull keeps its depth while the directory doubles around it
    assert exact_dedup.grow({0: 9, 1: 1, 12: 3}, 4, 5) == (4, [(0, 4), (1, 4), (2, 3), (2, 3), *[(4, 2)] * 4, *[(8, 1)] * 8])
    assert exact_dedup.grow({3: 100}, 3, 5)[0] == 3  # no bit is left to split on


def test_a_bucket_file_that_is_lost_is_an_error(spark, monkeypatch):
    from pathlib import Path

    real = exact_dedup.write_buckets

    def lose(entries):
        index = real(entries)
        files = {r.f for r in index.selectExpr("input_file_name() AS f").collect()}
        Path(sorted(files)[0].removeprefix("file:").replace("///", "/")).unlink()
        spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
        return index

    monkeypatch.setattr(exact_dedup, "write_buckets", lose)
    try:
        with pytest.raises(Exception, match="has no entry"):
            exact_dedup.exact_dedup(frame(spark, [(i, f"text {i}") for i in range(200)]), bucket_capacity=4).collect()
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")


def brute_lines(rows, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    found = Counter()
    for _, t in rows:
        found.update({key(x) for x in (t or "").split("\n")} - {""})
    return [([x for x in (t or "").split("\n") if found[key(x)] < least], len((t or "").split("\n"))) for _, t in rows]


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = ["", " ", "Home", "home\t", "\x1chome", "HOME", "É", "é", "x" * 50_000, "a b", " a b"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.4 else f"line {rng.random()}" for _ in range(rng.randrange(1, 8)))) for i in range(80)] + [(80, None), (81, ""), (82, "home\nhome"), (82, "home\nhome")]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped, r.k) for r in line_dedup.line_dedup(frame(spark, rows), min_docs=5).collect())
    want = sorted((i, "\n".join(kept), n, n - len(kept), "k") for (i, _), (kept, n) in zip(rows, brute_lines(rows, 5), strict=True))
    assert got == want
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_minimal_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    h1[:5] = h1[10]  # keys that no level can part
    n = rng.integers(1, 1000, 5000)
    shard = line_dedup.Shard(line_dedup.build_shard(h1, h2, n))
    assert len(shard.prints) + len(shard.tail1) == 5000
    assert (shard.count(h1, h2) == n).all()
    assert not shard.count(*rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)).any()
    assert not line_dedup.Shard(line_dedup.build_shard(h1[:0], h2[:0], n[:0])).count(h1, h2).any()


def near_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            base = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 30, 200]))))
    return texts


def brute_fingerprint(text, k=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_simhash_against_brute_force(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 20)  # so that buckets are cut into blocks
    texts = near_texts(3, 250) + [None, "", " \n", "A\x0bB", "a b", "a b", "y" * 200_000, "z z"]
    prints = [brute_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    want = groups_of(len(texts), links)
    got = {r.doc_id: (int.from_bytes(r.fp, "little"), r.component_id) for r in simhash.simhash_groups(frame(spark, list(enumerate(texts))), radius=radius).collect()}
    assert got == {i: (p, c) for i, (p, c) in enumerate(zip(prints, want, strict=True))}


def test_wide_fingerprints_are_verified(spark):
    texts = near_texts(5, 150)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.simhash_groups(frame(spark, list(enumerate(texts))), shingle=5, radius=12, words=4, verify=48).collect()}
    prints = [np.frombuffer(got[i][0], dtype="<u8") for i in range(len(texts))]
    differ = lambda x, y: int(np.bitwise_count(x ^ y).sum())
    links = [(i, j) for i in range(len(texts)) for j in range(i) if differ(prints[i][:1], prints[j][:1]) <= 12 and differ(prints[i], prints[j]) <= 48]
    assert [got[i][1] for i in range(len(texts))] == groups_of(len(texts), links)
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_thresholds_obey_the_generalised_pigeonhole(radius):
    rng = np.random.default_rng(radius)
    x = (rng.random((500, 64)) < 0.5).astype(float)
    x[:, 1] = x[:, 0]
    both = x.T @ x
    for n in (500, 10**7, 10**10):
        plan = simhash.allot(n, both, radius)
        assert sum(t + 1 for _, _, t in plan) == radius + 1
        bits = [b for _, g, _ in plan for b in g]
        assert len(bits) == len(set(bits))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(300)] + [(rng.randrange(400, 800), rng.randrange(400, 800)) for _ in range(250)] + [(5, 5), (900, 900), (1, 0)]
    want = groups_of(1000, pairs)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert all(want[n] == c for n, c in got.items())
    assert {n for p in pairs for n in p if p[0] != p[1]} <= set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [16, 1024])
def test_embedding_groups_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "TASK_VECTORS", 4 * block)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16)) * rng.choice([0.05, 0.25], 300)[:, None]).astype(np.float32)
    x[250:] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15]
    rows += [(300 + i, v, 1) for i, v in enumerate(bad)] + [(306, (x[7] * 2).tolist(), 0)]
    frame_ = spark.createDataFrame([(*r, "n", "key") for r in rows], "vec_id long, embedding array<float>, label int, node string, key string")
    got = {r.vec_id: r for r in embedding_dedup.embedding_groups(frame_).collect()}
    full = np.zeros((307, 16))
    full[:300], full[306] = x, x[7].astype(np.float64) * 2
    size = np.sqrt((full**2).sum(axis=1))
    with np.errstate(invalid="ignore"):
        near = (full @ full.T) / np.outer(size, size) >= 0.95
    np.fill_diagonal(near, False)
    want = groups_of(307, [(i, j) for i, j in zip(*np.nonzero(near), strict=True)])
    for i in range(307):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), want[i], want[i] == i)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_groups(empty).count() == 0
