from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessel.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, radius=4):
    """Smallest member of each fingerprint's component."""
    fps = np.unique(np.array(fps, dtype=np.uint64))
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ f) <= radius):
            parent[root(i)] = root(int(j))
    return {int(f): root(i) for i, f in enumerate(fps)}


def check_components(rows):
    """rows: (id, fingerprint as unsigned, component)."""
    group = brute_roots([f for _, f, _ in rows])
    least = {}
    for i, f, _ in rows:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    for i, f, c in rows:
        assert c == least.get(group[f]), (i, c)


def test_query_equals_brute_force(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op5_simhash(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert int(r.fingerprint, 16) == brute_fingerprint(docs[r.doc_id]) and len(r.fingerprint) == 16
    check_components([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows])


def test_hash_is_that_of_sql(spark):
    text = "one two three four"
    (h,) = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()
    assert simhash.fingerprint(text.encode(), 4) == h % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("n_noise", [50, 3000])
def test_links_of_dense_groups(spark, monkeypatch, n_noise):
    """A chain, a ball and noise; keys over the light limit go through blocks."""
    monkeypatch.setattr(simhash, "LIGHT_BUCKET", 8)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(n_noise)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)}
    at = rng.getrandbits(64)
    for _ in range(60):
        at ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(at)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp bigint")
    edges = simhash.links(df).collect()
    assert all(bin((e.a ^ e.b) % (1 << 64)).count("1") for e in edges) and len(edges) < 40 * len(fps)
    tree = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    got, want = {}, {}
    for f, root in brute_roots(list(fps)).items():
        want.setdefault(root, set()).add(f)
    for f in fps:
        got.setdefault(tree.get(simhash.signed(f), simhash.signed(f)), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    for n in (1000, 10**6, 10**9):
        parts = simhash.plan(sample, n, 4)
        # any way of spreading 4 differing bits over all groups leaves one group within its threshold
        sizes = [len(g) for g, _ in parts]
        assert sum(t + 1 for _, t in parts) >= 5 and all(t >= 0 for _, t in parts) and sum(sizes) <= 64
        assert len({b for g, _ in parts for b in g}) == sum(sizes)
    best = simhash.allocate([[0, 5, 9], [0, 1, 30], [0, 4, 5]], 0)
    assert best == (min(5 + 1 + 4, 0 + 1 + 5, 9 + 1 + 0, 0 + 30 + 4), best[1]) and sum(best[1]) == 0


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, (500, 32))
    bits = np.concatenate([base, base], axis=1).astype(float)
    groups = simhash.group_bits(bits, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert sum((b + 32) % 64 in g for g in groups for b in g) >= 60


def brute_sketch(text, k=5):
    """Node, fingerprint of words and sketch as one number, bit by bit."""
    words = [lower(w).encode() for w in WORD.findall(text or "")]
    if not words:
        return 0, 0, 0
    most = lambda hashes: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    shingles = {xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))}
    weighed = [xxhash.xxh64_intdigest(w, j) for w in set(words) for j in range(1 + int(math.log2(words.count(w))))]

    def plane(h, j):
        m, full = 0xD6E8FEB86659FD93, (1 << 64) - 1
        h = ((h ^ h >> 32) * m + j) & full
        h = (h ^ h >> 32) * m & full
        return h ^ h >> 32

    return most(shingles), most(weighed), sum(most([plane(h, j) for h in shingles]) << 64 * j for j in range(16))


def brute_similar(texts):
    """Groups of places in ``texts``, by all pairs."""
    made = [brute_sketch(t) for t in texts]
    nodes = {}
    for m in made:  # texts with one node stand for each other
        nodes[m[0]] = min(nodes.get(m[0], m), m, key=lambda x: (simhash.signed(x[1]), [simhash.signed(x[2] >> 64 * j & (1 << 64) - 1) for j in range(16)]))
    names = list(nodes)
    fps, sks = np.array([nodes[x][1] for x in names], np.uint64), [nodes[x][2] for x in names]
    parent = {x: x for x in names}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 6).tolist():
            if (sks[i] ^ sks[j]).bit_count() <= 170:
                parent[root(names[i])] = root(names[j])
    return [root(m[0]) for m in made]


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


@pytest.mark.parametrize("block", [1024, 3])
def test_similar_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "LIGHT_BUCKET", 32 if block > 3 else 1)
    monkeypatch.setattr(simhash, "LIGHT_TIMES", 4 if block > 3 else 0)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rng = random.Random(8)
    for k, i in enumerate(list(docs)[:60]):  # copies with a few other words
        words = docs[i].split(" ")
        for _ in range(rng.randint(0, 1 + len(words) // 30)):
            words[rng.randrange(len(words))] = rng.choice(words) + "x"
        docs[10**6 + k] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    group, least = dict(zip(docs, brute_similar(docs.values()), strict=True)), {}
    for i, g in group.items():
        least[g] = min(i, least.get(g, i))
    got = {r["__id"]: r.component_id for r in simhash.similar(df).collect()}
    assert got == {i: least[g] for i, g in group.items()} and len(set(got.values())) < len(got) - 30


def test_similar_texts_are_found_and_others_are_not(spark, prose):
    """Pairs with a known share of equal shingles, each pair of other words."""
    rng, rows, true = random.Random(6), [], {}
    for k in range(300):
        words = [f"{w}{rng.randrange(9)}" for w in prose(k, rng.choice([60, 150, 400])).split()]
        other = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 12))):
            other[rng.randrange(len(other))] = "new" + str(rng.randrange(1000))
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        true[2 * k] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r["__id"]: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == i and got[i + 1] in (i, i + 1) for i in true)  # no two pairs meet
    alike = [got[i + 1] == i for i, j in true.items() if j >= 0.8]
    apart = [got[i + 1] == i for i, j in true.items() if j < 0.65]
    assert len(alike) > 50 and sum(alike) >= 0.9 * len(alike), (sum(alike), len(alike))
    assert len(apart) > 50 and sum(apart) <= 0.02 * len(apart), (sum(apart), len(apart))


def test_long_chain_of_components(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(1000, 1001)], "a bigint, b bigint"))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {got[k] for k in range(1, 301)} == {0} and got[1001] == 1000


def test_odd_rows(odd_documents, no_documents, spark):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    check_components([(r["__id"], r.fp % (1 << 64), r.component_id) for r in rows])
    kept = simhash.representatives(odd_documents)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 9 not in ids and kept.columns == odd_documents.columns
    assert simhash.near_duplicates(no_documents).collect() == [] and simhash.representatives(no_documents).collect() == []
    only_null = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id bigint, text string")
    assert len(simhash.representatives(only_null).collect()) == 1


def test_different_texts_that_share_an_id_stay(spark, prose):
    rows = [(None, prose(1, 60)), (None, prose(2, 60)), (None, prose(3, 60)), (None, prose(3, 60)), (5, prose(4, 60)), (5, prose(5, 60)), (6, prose(5, 60)), (7, prose(1, 60)), (8, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.representatives(df).collect()), key=str)
    assert kept == sorted([rows[1], rows[2], rows[4], rows[5], rows[7], rows[8]], key=str)
