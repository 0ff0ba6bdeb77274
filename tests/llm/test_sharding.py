from __future__ import annotations

import hashlib
import re
from collections import Counter

from tessel.llm import queries, sharding


def brute(rows, limit):
    """Buckets split bit by bit while they are over the limit."""
    hashed = []
    for i, t in rows:
        inner = hashlib.md5((t or "").encode()).hexdigest()
        h = int(hashlib.md5(f"{'' if i is None else i}:{inner}".encode()).hexdigest()[:15], 16)
        hashed.append((i, len((t or "").encode()), h))
    out, todo = [], [("", hashed)]
    while todo:
        bits, own = todo.pop()
        if sum(b for _, b, _ in own) <= limit or len(bits) == 60:
            out += [(i, b, bits) for i, b, _ in own]
            continue
        for x in (0, 1):
            part = [r for r in own if r[2] >> (59 - len(bits)) & 1 == x]
            if part:
                todo.append((bits + str(x), part))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["__id"], r.n_bytes, r.shard) for r in df.collect()), key=str)


def test_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for limit in (200_000, 60_000, 1 << 30):
        got = sharding.assign(docs, limit)
        assert found(got) == brute(rows, limit)
        sizes = Counter()
        for r in got.collect():
            sizes[r.shard] += r.n_bytes
            assert r.depth == len(r.shard)
        assert all(r.shard_bytes == sizes[r.shard] <= limit for r in got.collect() if not r.oversized)


def test_equal_rows_are_dealt_by_number(spark):
    rows = [(1, "x" * 100)] * 57 + [(2, "y" * 1000), (3, "z")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 350).collect()
    assert len(got) == 59
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
        assert r.oversized == (r["__id"] == 2)
    assert all(v <= 350 for k, v in sizes.items() if not any(r.shard == k and r.oversized for r in got))
    assert all(r.shard_bytes == sizes[r.shard] for r in got) and len(sizes) >= 19 + 2


def test_plan_is_native(spark, folder):
    plan = queries.op9_sharding(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_odd_rows(odd_documents, no_documents):
    assert sharding.assign(odd_documents, 60_000).count() == odd_documents.count()
    assert sharding.assign(no_documents, 1000).collect() == []


def test_written_shards_hold_all_rows_and_fit(spark, odd_documents, no_documents, tmp_path):
    limit = 40_000
    rows = [(k, "é" * (k % 900), f"src{k % 7}", [k, k]) for k in range(600)] + [(7, "same", "s", None)] * 5000
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, list array<int>")
    directory = {r.shard: r for r in sharding.write(df, str(tmp_path / "a"), limit).collect()}
    back = spark.read.parquet(str(tmp_path / "a" / "shards"))
    got = back.collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == sorted(map(str, rows))
    size = lambda r: len(r.text.encode()) + len(str(r.doc_id)) + len(r.shard) + len(f"[{r.doc_id},{r.doc_id}]" if r.list else "")
    total = {}
    for r in got:
        total[r[sharding.SHARD_COLUMN][1:]] = total.get(r[sharding.SHARD_COLUMN][1:], 0) + size(r)
    assert {k: r.bytes for k, r in directory.items()} == total and max(total.values()) <= limit and len(total) > 5
    for folder in (tmp_path / "a" / "shards").glob("*=*"):
        assert len(list(folder.glob("*.parquet"))) == 1
    for k, docs in enumerate((odd_documents, no_documents)):
        sharding.write(docs, str(tmp_path / str(k)), limit)
    assert spark.read.parquet(str(tmp_path / "0" / "shards")).count() == odd_documents.count()
