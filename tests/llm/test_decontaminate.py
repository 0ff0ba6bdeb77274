from __future__ import annotations

import random

import numpy as np
import pytest

from tessel.llm import decontaminate as d
from tessel.llm import queries
from tessel.llm.common import without_ids


def infix_distance(item, text):
    """Least edits between the item and any stretch of the text, by the whole matrix."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, t in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("qxzjk")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("qxzjk"))
    return "".join(out)


def test_qgrams_tell_runs_apart():
    a = d.characters("abcabcabd")
    for q in (1, 2, 3, 5, 7):
        h = d.qgrams(a, q)
        runs = ["abcabcabd"[i : i + q] for i in range(10 - q)]
        assert len(h) == len(runs) and all((h[i] == h[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(len(runs)))
    assert len(d.qgrams(a, 10)) == 0


def test_equals_brute_force(prose):
    rng = random.Random(9)
    items = [(k, prose(100 + k, rng.randint(8, 25))) for k in range(6)]
    index = d.Index.of(items, d.Q, d.EDIT_SHARE)
    texts = []
    for k in range(40):
        i, item = items[k % 6]
        budget = int(index.budget[[x for x, _ in enumerate(index.ids) if index.ids[x] == i][0]])
        leak = edited(rng, item, rng.choice([0, 1, budget, budget + 1, 2 * budget + 3]))
        texts.append(prose(500 + k, 12) + " " + leak + " " + prose(700 + k, 8) if k % 5 else prose(k, 30))
    got = {(t, i): e for t, i, _, _, e in d.occurrences(texts, index)}
    norm = lambda t: "".join(map(chr, d.characters(t)))
    want = {}
    for t, text in enumerate(texts):
        for i in range(6):
            e = infix_distance(norm(items[i][1]), norm(text))
            if e <= index.budget[i]:
                want[t, i] = e
    assert got == want and len(want) > 15


def test_spans_and_case(prose):
    item = prose(1, 20)
    index = d.Index.of([(5, item)], d.Q, d.EDIT_SHARE)
    text = "Before it. " + item.upper().replace(" ", "\n") + " after. " + item + item
    got = d.occurrences([text, "", item], index)
    assert [(t, e) for t, _, _, _, e in got] == [(0, 0), (0, 0), (0, 0), (2, 0)] or sum(t == 0 for t, *_ in got) >= 2
    assert text[got[0][2] : got[0][3]].replace("\n", " ").lower() == item.lower()


def test_neighbouring_texts_do_not_mix(prose):
    item = prose(1, 20)
    index = d.Index.of([(5, item)], d.Q, d.EDIT_SHARE)
    half = len(item) // 2
    assert d.occurrences([prose(2, 20) + item[:half], item[half:] + prose(3, 20)], index) == []


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_blocks_give_the_same(spark, folder, block):
    docs, bench = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "benchmark"))
    got = sorted(tuple(r) for r in d.leaks(docs, bench.limit(12), block_chars=block).collect())
    texts = {r.doc_id: "".join(map(chr, d.characters(r.text))) for r in docs.collect()}
    exact = {(i, r.item_id) for r in bench.limit(12).collect() for i, t in texts.items() if "".join(map(chr, d.characters(r.text))) in t}
    assert exact <= {(r[0], r[1]) for r in got}


def test_query_finds_every_verbatim_item(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    rows = queries.op8_decontaminate(spark, folder).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert {(i, k) for i, t in docs.items() for k, b in items.items() if b in t} <= found
    norm = lambda t: "".join(map(chr, d.characters(t)))
    for r in rows:
        n = len(items[r.item_id])
        assert infix_distance(norm(items[r.item_id]), norm(docs[r.doc_id][r.start : r.end])) <= r.edits <= d.EDIT_SHARE * n


def apart(item, text):
    """The least number of edits with which the item stands anywhere, from the whole matrix."""
    return infix_distance("".join(map(chr, d.characters(item))), "".join(map(chr, d.characters(text))))


def test_monotonous_items_equal_brute_force():
    rng = random.Random(4)
    items = [(0, "-" * 60), (1, "=-" * 40), (2, "." * 25 + " the contents of this page " + "." * 30), (3, "ab" * 9 + "c" + "ab" * 20), (4, "x" * 12)]
    index = d.Index.of(items, d.Q, d.EDIT_SHARE)
    assert len(index.monotonous) >= 3
    texts = [edited(rng, items[k % 5][1], k % 4) for k in range(30)]
    texts += ["-" * 300, "-" * 55, "-" * 58 + "\n" + "-" * 57, "=-" * 90, "." * 400 + " the contents of this page " + "." * 400, "ab" * 300, "the " + "-" * 20 + " " + "-" * 39 + " end", "x" * 11, "xx y " * 30]
    got = {(t, i) for t, i, *_ in d.occurrences(texts, index)}
    at = {x: k for k, x in enumerate(index.ids)}
    want = {(t, at[i]) for t, text in enumerate(texts) for i, item in items if apart(item, text) <= index.budget[at[i]]}
    assert got == want
    for t, i, start, end, edits in d.occurrences(texts, index):
        assert apart(items[index.ids[i]][1], texts[t][start:end]) <= edits <= index.budget[i]


def test_monotonous_text_in_bounded_time_and_memory():
    import resource
    import time

    index = d.Index.of([(k, f"{'-' * 60} {k} question number {k}" if k % 2 else "-" * (60 + k)) for k in range(10)], d.Q, d.EDIT_SHARE)
    d.occurrences(["-" * 1000], index)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    got = d.occurrences(["-" * 10_000_000], index)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert {i for _, i, *_ in got} == {i for i, k in enumerate(index.ids) if k % 2 == 0} and grown < 1000, grown
    assert time.time() - began < 60


def test_small_portions_give_the_same(prose, monkeypatch):
    rng = random.Random(2)
    items = [(k, prose(100 + k, 12)) for k in range(5)] + [(9, "-" * 40)]
    texts = [" ".join(prose(10 * t + k, 25) + " " + edited(rng, items[(t + k) % 6][1], k % 3) for k in range(12)) for t in range(6)]
    index = d.Index.of(items, d.Q, d.EDIT_SHARE)
    want = d.occurrences(texts, index)
    monkeypatch.setattr(d, "WINDOW", 300)
    monkeypatch.setattr(d, "PAIRS", 50)
    assert d.occurrences(texts, index) == want and len(want) > 40


def test_white_space_and_short_items(spark):
    text = "Intro\n\n  What   is the\tcapital\n    of France today?  It is:\n Paris, she said.  Parisian"
    bench = spark.createDataFrame([(1, "what is the capital of France\n today?"), (2, " PARIS "), (2, "paris"), (3, "cap"), (4, " \n ")], "item_id bigint, text string")
    docs = spark.createDataFrame([(7, text)], "doc_id bigint, text string")
    got = sorted((r.item, r.edits, text[r.start : r.end]) for r in d.leaks(docs, bench).collect())
    assert got == [(1, 0, "What   is the\tcapital\n    of France today?"), (2, 0, "Paris"), (2, 0, "Paris")]


def test_odd_rows(spark, odd_documents, no_documents, prose):
    bench = spark.createDataFrame([(1, prose(1, 60)), (1, prose(1, 60)), (2, None), (3, ""), (4, "short"), (None, prose(3, 40))], "item_id bigint, text string")
    got = sorted({(r["__id"], r["item"]) for r in d.leaks(odd_documents, bench).collect()}, key=str)
    assert got == [(4, 1), (9, 1), (None, None)]
    assert d.leaks(no_documents, bench).collect() == [] and d.leaks(odd_documents, bench.limit(0)).collect() == []
    kept = d.clean(odd_documents, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6, 7, 8] and kept.columns == odd_documents.columns


def test_long_lists_of_ids_go_through_a_shuffle(spark, odd_documents):
    gone = spark.createDataFrame([(4,), (None,)], "x bigint")
    want = [1, 2, 3, 5, 6, 7, 8, 9]
    assert sorted(r.doc_id for r in without_ids(odd_documents, gone, "doc_id").collect()) == want
    assert sorted(r.doc_id for r in without_ids(odd_documents, gone, "doc_id", limit=0).collect()) == want


def test_only_rows_that_hold_an_item_go(spark, prose):
    bench = spark.createDataFrame([(1, prose(1, 60))], "item_id bigint, text string")
    held = f"{prose(2, 30)} {prose(1, 60)}"
    rows = [(None, held), (None, prose(3, 60)), (None, None), (4, held), (4, held), (4, prose(5, 60)), (9, prose(6, 60))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, key string")
    kept = d.clean(docs, bench, rowwise=True)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], rows[2], rows[5], rows[6]], key=str)
    assert kept.columns == docs.columns
