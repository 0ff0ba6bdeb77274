from __future__ import annotations

import re
import time

import pytest

from tessel.llm import line_dedup, queries


def split(text):
    """Units of each line, as lists of tokens with their places; told by looking at one token after the other."""
    out = []
    for m in re.finditer(r"[^\n]+", text):
        line = []
        for t in re.finditer(r"\S+", m[0]):
            word = t[0]
            capital = lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×"
            fresh = not line or line[-1][-1][0][-1] in ".!?" or len(word) > 1 and capital(word[0]) and not capital(word[1])
            if fresh:
                line.append([])
            line[-1].append((word, m.start() + t.start(), m.start() + t.end()))
        if line:
            out.append(line)
    return out


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def brute(rows, unit_words=5, span_words=1, across=False):
    """``(id, words of the span, n_units, first_id)`` by one pass in order of (id, place in the table), without hashing."""
    firsts, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    pieces = {}
    for k in order:
        no = 0
        for line in split(rows[k][1] or ""):
            words = [[lower(w) for w, *_ in u] for u in line]
            text = [" ".join(u).strip(" \t\r\n.,;:!?\"'") or " ".join(u) for u in words]
            many = lambda i, j: len({w for u in words[i:j] for w in u})  # noqa: B023, E731
            for a in range(len(line)):
                b = next((j for j in range(a + 1, len(line) + 1) if many(a, j) >= unit_words), None)
                i = a if b else next((i for i in range(a, 0, -1) if many(i, len(line)) >= unit_words), 0)
                i, b = (a, b) if b else (i, len(line))
                key = tuple(text[i:b])
                firsts.setdefault(key, (k, no + i, no + b - 1))
                pieces.setdefault(k, []).append((no + i, no + b - 1, key))
            no += len(line)
    for k in order:
        flat = [u for line in split(rows[k][1] or "") for u in line]
        gone = {}
        for i, last, key in sorted(pieces.get(k, [])):
            f = firsts[key]
            if f[0] != k or not across and i > f[2]:
                for x in range(i, last + 1):
                    gone.setdefault(x, f)
        x = 0
        while x < len(flat):
            if x not in gone:
                x += 1
                continue
            y = x
            while y in gone:
                y += 1
            tokens = [t for u in flat[x:y] for t in u]
            n = sum(len(u) for u in flat[x:y] if any(re.search(r"\w", t[0]) for t in u))
            if n >= span_words:
                out.append((rows[k][0], tuple(t[0] for t in tokens), n, y - x, rows[gone[x][0]][0]))
            x = y
    return sorted(out, key=str)


def found(df, **how):
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, r.text)
    return sorted(((r["__id"], tuple(texts[r["__id"]][r.start : r.end].split()), r.n_words, r.n_units, r.first_id) for r in line_dedup.repeated_spans(df, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"span_words": 20}, {"span_words": queries.SPAN_WORDS, "across": True}, {"unit_words": 1}])
def test_equals_brute_force(spark, how):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], **how)
    assert found(docs, **how) == want and len(want) > 5


def test_query_equals_brute_force(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    texts = dict(docs)
    got = [(r.doc_id, tuple(texts[r.doc_id][r.start : r.end].split()), r.n_words, r.n_units, r.kept_doc_id) for r in queries.op2_line_dedup(spark, folder).collect()]
    assert sorted(got, key=str) == brute(docs, 5, queries.SPAN_WORDS, True)


def test_query_leaves_no_repeat_out(spark, folder, prose, tmp_path):
    """Neither short lines nor what one text says twice."""
    line = "Please share this page with your friends"
    rows = [(1, f"{prose(1, 40)}\n{line}"), (2, f"{line}\n{prose(2, 40)}"), (3, f"{prose(3, 40)}\n{prose(4, 40)}\n{prose(3, 40)}")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, rows[r.doc_id - 1][1][r.start : r.end], r.kept_doc_id) for r in got) == [(2, line, 1), (3, prose(3, 40), 3)]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    texts = dict(docs)
    got = [(r.doc_id, tuple(texts[r.doc_id][r.start : r.end].split()), r.n_words, r.n_units, r.kept_doc_id) for r in queries.op2_line_dedup(spark, folder).collect()]
    assert sorted(got, key=str) == brute(docs)


def test_passage_within_other_text(spark, prose):
    passage = prose(7, 60)
    rows = [(1, prose(1, 50)[:-1] + " " + passage + " " + prose(2, 30)), (2, prose(3, 40)[:-1] + " " + passage + "\n" + prose(4, 30)), (3, prose(5, 90))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    (got,) = line_dedup.repeated_spans(df, span_words=20).collect()
    assert got["__id"] == 2 and got.first_id == 1
    assert rows[1][1][got.start : got.end] == passage
    texts = {r.doc_id: r.text for r in line_dedup.remove_spans(df).collect()}
    assert texts[1] == rows[0][1] and texts[3] == rows[2][1]
    assert texts[2] == rows[1][1].replace(passage, "")


def test_normalisation_and_thresholds(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    df = spark.createDataFrame([(1, line), (2, f"{line.upper().replace(' ', '   ')}!"), (3, " ".join(line.split()[:19])), (4, " ".join(line.split()[:19]))], "doc_id bigint, text string")
    assert [(r[0], r[4]) for r in found(df, span_words=20)] == [(2, 1)]
    assert [(r[0], r[4]) for r in found(df)] == [(2, 1), (4, 3)]


def test_a_line_of_seven_words_in_fifty_documents(spark, prose):
    line = "Please share this page with your friends"
    rows = [(k, f"{prose(k, 40)}\n{line}\n{prose(k + 100, 20)}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [(r[0], " ".join(r[1])) for r in sorted(found(df))] == [(k, line) for k in range(1, 50)]
    assert found(df, span_words=8) == []


def test_odd_rows(odd_documents, no_documents):
    spans = line_dedup.repeated_spans(odd_documents).collect()
    assert {r["__id"] for r in spans} >= {9} and all(r["first_id"] is not None for r in spans)
    kept = line_dedup.remove_spans(odd_documents)
    assert kept.count() == odd_documents.count() and kept.columns[:2] == ["doc_id", "text"]
    assert line_dedup.repeated_spans(no_documents).collect() == []


def test_short_lines_and_title_case(spark, prose):
    title = "Free Shipping On All Orders Today"
    verse = "tiger tiger\nburning bright\nin the forests"
    rows = [(1, f"{prose(1, 30)}\nHome\n{title}\n{verse}\n}}"), (2, f"{prose(2, 30)}\nhome.\n{title}\nnew here\n{verse}\n}}"), (3, f"{title.lower()}\n{prose(3, 30)}\n}}"), (4, f"Then {title} it said"), (5, prose(4, 30) + " Home")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id: r.text.split() for r in line_dedup.remove_spans(df).collect()}
    assert left[1] == rows[0][1].split() and left[5] == rows[4][1].split()
    assert left[2] == [*prose(2, 30).split(), "new", "here"]  # the brace follows repeated lines
    assert left[4] == ["Then", "Today", "it", "said"]


def test_what_stands_once_breaks_a_span(spark):
    label = "the value of this very long label number"
    table = lambda *values: "\n".join(x for k, v in enumerate(values) for x in (f"{label} {k} is as follows here", v))
    df = spark.createDataFrame([(1, table("4711", "0815", "x")), (2, table("1234", "99 b", "y"))], "doc_id bigint, text string")
    for how in ({}, {"span_words": 12}, {"across": True}):
        left = {r.doc_id: r.text.split("\n") for r in line_dedup.remove_spans(df, **how).collect()}
        assert {"1234", "99 b", "y"} <= set(left[2]), how
    assert [r.n_words for r in line_dedup.repeated_spans(df, span_words=12).collect()] == [13] * 3


def test_rows_without_own_ids_are_documents_of_their_own(spark, prose):
    passage = prose(7, 60)
    for i in (None, 5):
        texts = [passage, f"{prose(1, 40)}\n{passage}", prose(2, 90), f"{prose(3, 50)}\n{passage}\n{prose(4, 40)}", passage]
        df = spark.createDataFrame([(i, t) for t in texts], "doc_id bigint, text string").coalesce(1)
        got = [r.text for r in line_dedup.remove_spans(df).collect()]
        assert sorted(map(str.split, got)) == sorted(map(str.split, [passage, prose(1, 40), prose(2, 90), f"{prose(3, 50)} {prose(4, 40)}", ""]))


def test_long_lines_of_short_units_take_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        assert len(line_dedup.marks("Of " * n + "a b c d")) <= n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 0.5
