from __future__ import annotations

import re
from collections import Counter

from tessel.llm import quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_measures_equal_brute_force(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op4_quality_rules(spark, folder).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_measures_of_odd_texts():
    for t in ["", "a", "a b c d e f g h", "a " * 9, "a b " * 40, "é ß\x1c😀 #\n\x0b\n#\n#", "x y z w v u t s r x y z w v u t s q", "line\nline\n\n\nline \n"]:
        assert quality_rules.measures(t.encode()) == brute(t)


def test_host_verdict(spark, prose):
    good, bad = prose(1, 60), "too short"
    rows = [(k, bad if k % 10 else good, "https://Bad.example/x") for k in range(40)] + [(100 + k, good, f"https://good{k % 4}.example/{k}") for k in range(80)] + [(300, bad, "https://one.example/"), (301, good, None)]
    got = {r["__id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[0]["__host"] == "bad.example" and got[0].host_rejected and not got[0].base_failed and not got[0].kept
    assert got[100].kept and got[301].kept
    # shrunk by moments, as by hand
    docs = {}
    for _, t, h in rows:
        if h:
            docs.setdefault(h.split("/")[2].lower(), []).append(t == bad)
    n, k = [len(v) for v in docs.values()], [sum(v) for v in docs.values()]
    m = sum(k) / sum(n)
    beyond = sum(y * (x / y - m) ** 2 for x, y in zip(k, n, strict=True)) - m * (1 - m) * (len(n) - 1)
    alike = min(1, beyond / (m * (1 - m) * (sum(n) - sum(y * y for y in n) / sum(n) - (len(n) - 1))))
    weight = 1 / alike - 1
    verdicts = {r["__of"]: r for r in quality_rules.host_verdicts(quality_rules.measured(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source").selectExpr("*", "n_words < 20 AS base_failed")).collect()}
    for h, v in docs.items():
        assert abs(verdicts[h].rate_base - (sum(v) + m * weight) / (len(v) + weight)) < 1e-9
        assert abs(verdicts[h].limit_base - min(0.5, max(0.25, m + 2 * (m * (1 - m) * alike) ** 0.5))) < 1e-9


def test_query_rejects_a_host_as_its_sql_does(spark, prose, tmp_path):
    import duckdb

    rows = []
    for h in range(9):
        name = [f"https://User@Host{h}.example:80/p{{}}?q", f"SRC{h}", f"http://host{h}.example"][h % 3]
        for k in range(30 + 10 * h):
            failing = k % 3 < 2 if h == 4 else k % 12 == 0
            rows.append((1000 * h + k, "too short" if failing else prose(h * 100 + k, 30), name.format(k)))
    rows += [(1, "too short", "https://one.example/"), (2, prose(1, 30), None), (3, None, "src4"), (4, prose(2, 30), "")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_quality_rules(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = c.execute(queries.OP4_SQL)
    names = [x[0] for x in cur.description]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(cur.fetchall())
    gone = {r.doc_id for r in got if not r.base_failed and not r.kept}
    assert gone == {i for i, t, h in rows if h == "SRC4" and len((t or "").split()) >= 20} and len(gone) > 20


def test_salted_verdicts_are_the_same(spark, prose, monkeypatch):
    rows = [(k, "short" if k % 10 else prose(1, 60), f"h{k % 3}") for k in range(60)] + [(None, prose(2, 60), "h1")] + [(100 + k, prose(2, 60), "good") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = sorted(map(str, quality_rules.judge(df).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", 0)
    assert sorted(map(str, quality_rules.judge(df).collect())) == want and "kept=True" in str(want)


def test_odd_rows(odd_documents, no_documents):
    assert quality_rules.judge(odd_documents).count() == odd_documents.count()
    assert quality_rules.judge(no_documents).collect() == []
