from __future__ import annotations

import math

import pytest

from tessel.errors import AmbiguousColumn, ColumnError, DuplicateAlias, NoSuchTable, SqlSyntaxError, SqlTypeError, UnknownColumn
from tessel.session import EngineSession


@pytest.fixture(scope="module")
def s(spark):
    s = EngineSession(spark)
    make = spark.createDataFrame
    s.register("bits", make([(1, 1), (1, 0), (0, 1), (0, 0)], "a bigint, b bigint"))
    s.register("nulls", make([(None, 0), (None, 1), (1, None), (0, None), (None, None)], "v1 bigint, v2 bigint"))
    s.register("fruit", make([("apple",), ("Apricot",), ("banana",), ("a\\b",), (None,)], "s string"))
    s.register("sales", make([(1, "A", 10), (2, "A", 20), (3, "B", 30), (4, "B", 40), (5, None, 50)], "id bigint, category string, amount bigint"))
    s.register("l", make([(1, 5), (2, 10), (3, None)], "id bigint, val bigint"))
    s.register("r", make([(1, 3), (2, 8), (4, None)], "id bigint, val bigint"))
    s.register("docs", make([(1, '{"a":{"b":2},"d":[10,20],"n":null,"s":"x","t":2.5,"1":"one"}'), (2, "[7,8]"), (3, "no json"), (4, None)], "id bigint, j string"))
    s.register("mixed", make([("5", 5, 5.0, True), ("1.5", 1, 1.5, False), (" 5 ", 5, 5.0, True), ("x", 9, 9.0, True), (None, 1, None, None)], "t string, i bigint, f double, b boolean"))
    s.register("empty", make([], "x bigint"))
    return s


def rows(s, text, params=None):
    return [tuple(r) for r in s.sql(text, params).collect()]


def one(s, text):
    return rows(s, text)[0][0]


def test_and_binds_tighter_than_or(s):
    assert len(rows(s, "SELECT * FROM bits WHERE a = 1 OR b = 1 AND a = 0")) == 3
    assert len(rows(s, "SELECT * FROM bits WHERE (a = 1 OR b = 1) AND a = 0")) == 1


def test_three_valued_logic(s):
    assert rows(s, "SELECT v1 FROM nulls WHERE v1 = 1 OR v2 = 1 ORDER BY v1") == [(None,), (1,)]
    assert rows(s, "SELECT v1 FROM nulls WHERE NOT v1 = 1") == [(0,)]
    assert one(s, "SELECT NULL AND FALSE AS x") is False
    assert one(s, "SELECT NULL OR TRUE AS x") is True
    assert one(s, "SELECT NULL = NULL AS x") is None
    assert rows(s, "SELECT 1 IN (1, NULL), 2 IN (1, NULL), 2 NOT IN (1, 3), NULL IN (1)") == [(True, None, True, None)]


def test_conditions_need_booleans(s):
    for text in ("SELECT 1 AND TRUE", "SELECT NOT 1", "SELECT 'a' OR FALSE", "SELECT 'a' + 1", "SELECT 1 LIKE 'a'", "SELECT SUM(category) FROM sales"):
        with pytest.raises(SqlTypeError):
            s.sql(text)


def test_like_folds_ascii_only_and_has_no_escape(s):
    assert sorted(rows(s, "SELECT s FROM fruit WHERE s LIKE 'AP%'")) == [("Apricot",), ("apple",)]
    assert rows(s, "SELECT s FROM fruit WHERE s LIKE 'b_nana'") == [("banana",)]
    assert rows(s, "SELECT s FROM fruit WHERE s LIKE 'a\\\\b'") == [("a\\b",)]
    assert rows(s, "SELECT 'É' LIKE 'é', NULL LIKE 'a'") == [(False, None)]


def test_arithmetic(s):
    assert rows(s, "SELECT 7 / 2 AS a, 6 / 3 AS b, 2 * 3 - -1 AS c, 1.5 + 1 AS d") == [(3.5, 2.0, 7, 2.5)]
    assert math.isnan(one(s, "SELECT 1 / 0")) and math.isnan(one(s, "SELECT 0.0 / 0"))
    assert one(s, "SELECT NULL / 0") is None
    assert one(s, "SELECT 9007199254740993 + 0") == 9007199254740993


def test_texts_meet_numbers_as_what_they_spell(s):
    assert rows(s, "SELECT t FROM mixed WHERE t = 5") == [("5",)]
    assert rows(s, "SELECT t FROM mixed WHERE t = 1.5") == [("1.5",)]
    assert sorted(rows(s, "SELECT t FROM mixed WHERE t > 1000")) == [(" 5 ",), ("1.5",), ("x",)]
    assert rows(s, "SELECT '1.0' = 1, '' = 0, '1abc' = 1, '+5' = 5, NULL = '1', 5 > 'x', 5 < 'x'") == [(False, False, False, True, None, False, True)]
    assert rows(s, "SELECT b = 1, b <> 1, b < 1 FROM mixed WHERE t = '5'") == [(False, True, False)]


def test_truth_of_values_in_where(s):
    assert rows(s, "SELECT id FROM l WHERE val") == [(1,), (2,)]
    assert len(rows(s, "SELECT * FROM bits WHERE a")) == 2
    assert len(rows(s, "SELECT * FROM bits WHERE ''")) == 0
    assert len(rows(s, "SELECT * FROM bits WHERE NULL")) == 0


def test_json(s):
    assert rows(s, "SELECT j->'a' AS a, j->'a'->>'b' AS b, j->>'s' AS c, j->'s' AS d, j->>'n' AS e, j->'n' AS f, j->>'1' AS g, j->'zz' AS h FROM docs WHERE id = 1") == [('{"b":2}', "2", "x", '"x"', None, "null", "one", None)]
    assert rows(s, "SELECT j->1 AS a, j->>'0' AS b FROM docs WHERE id = 2") == [("8", "7")]
    assert rows(s, "SELECT id FROM docs WHERE j->'a' IS NULL ORDER BY id") == [(2,), (3,), (4,)]
    assert rows(s, "SELECT JSON_EXTRACT(j, '$.d[1]') AS a FROM docs WHERE id = 1") == [("20",)]
    assert rows(s, "SELECT id FROM docs WHERE j->'t' = j->'t'") == [(1,)]
    assert s.sql("SELECT j->'a'->>'b' FROM docs").columns == ["j->'a'->>'b'"]


def test_functions(s):
    assert rows(s, "SELECT COALESCE(NULL, NULL, 3), ifnull(NULL, 'x'), UPPER('ab'), COALESCE(NULL, 1, 2.5)") == [(3, "x", "AB", 1.0)]
    with pytest.raises(SqlSyntaxError, match="Unknown function: NOPE"):
        s.sql("SELECT NOPE(1)")
    with pytest.raises(SqlSyntaxError):
        s.sql("SELECT IFNULL(1)")
    with pytest.raises(SqlSyntaxError, match="group function"):
        s.sql("SELECT id FROM sales WHERE SUM(amount) > 1")


def test_names_of_columns(s):
    assert s.sql("SELECT id, 1, COUNT(*), SUM(amount), id + 1, category AS c FROM sales GROUP BY id, category").columns == ["id", "1", "COUNT(*)", "SUM(...)", "?", "c"]
    assert s.sql("SELECT * FROM l A JOIN r b ON A.id = b.id").columns == ["a.id", "a.val", "b.id", "b.val"]
    assert s.sql("SELECT b.*, a.id FROM l a JOIN r b ON a.id = b.id").columns == ["id", "val", "id"]
    assert s.sql("SELECT ID FROM l").columns == ["ID"]


def test_joins(s):
    assert rows(s, "SELECT l.id, r.val FROM l JOIN r ON l.id = r.id ORDER BY l.id") == [(1, 3), (2, 8)]
    assert rows(s, "SELECT l.id, r.val FROM l LEFT JOIN r ON l.id = r.id ORDER BY l.id") == [(1, 3), (2, 8), (3, None)]
    assert len(rows(s, "SELECT * FROM l JOIN r ON l.val > r.val")) == 3
    assert len(rows(s, "SELECT * FROM l JOIN r ON l.val = r.val")) == 0  # null keys don't meet
    assert rows(s, "SELECT r.id FROM l RIGHT JOIN r ON l.id = r.id WHERE l.id IS NULL") == [(4,)]
    assert len(rows(s, "SELECT * FROM l FULL OUTER JOIN r ON l.id = r.id")) == 4
    assert len(rows(s, "SELECT * FROM l CROSS JOIN r")) == 9
    assert rows(s, "SELECT a.id FROM l a LEFT ANTI JOIN r b ON a.id = b.id") == [(3,)]
    assert rows(s, "SELECT c.id FROM l a JOIN l b ON a.id = b.id LEFT JOIN r c ON b.id = c.id AND c.val > 5 ORDER BY a.id") == [(None,), (2,), (None,)]


def test_self_join_keeps_sides(s):
    assert rows(s, "SELECT a.id, b.id FROM l a JOIN l b ON b.id = a.id + 1 ORDER BY 1") == [(1, 2), (2, 3)]


def test_resolution_errors(s):
    with pytest.raises(UnknownColumn, match="Unknown column 'zz' in 'field list'"):
        s.sql("SELECT zz FROM l")
    with pytest.raises(UnknownColumn, match="Unknown column 'l.zz' in 'where clause'"):
        s.sql("SELECT id FROM l WHERE l.zz = 1")
    with pytest.raises(AmbiguousColumn, match="Column 'id' in field list is ambiguous"):
        s.sql("SELECT id FROM l JOIN r ON l.id = r.id")
    with pytest.raises(ColumnError, match="Unknown table 'x'"):
        s.sql("SELECT x.* FROM l")
    with pytest.raises(DuplicateAlias) as e:
        s.sql("SELECT 1 FROM l a JOIN r A ON 1 = 1")
    assert e.value.code == 1066
    with pytest.raises(NoSuchTable) as e:
        s.sql("SELECT 1 FROM L")  # table names keep their case
    assert e.value.code == 1146


def test_aggregates(s):
    assert rows(s, "SELECT COUNT(*), COUNT(category), SUM(amount), AVG(amount), MIN(category), MAX(amount) FROM sales") == [(5, 4, 150, 30.0, "A", 50)]
    assert sorted(rows(s, "SELECT category, SUM(amount) FROM sales GROUP BY category"), key=str) == [("A", 30), ("B", 70), (None, 50)]
    assert rows(s, "SELECT COUNT(*), SUM(x), MIN(x) FROM empty") == [(0, None, None)]
    assert rows(s, "SELECT COUNT(*) FROM empty GROUP BY x") == []
    assert rows(s, "SELECT category c, SUM(amount * 2) + 1 n FROM sales GROUP BY c HAVING n > 61 ORDER BY n DESC LIMIT 1") == [("B", 141)]
    assert rows(s, "SELECT COALESCE(SUM(x), 0) FROM empty") == [(0,)]
    assert rows(s, "SELECT l.id, COUNT(r.id) FROM l LEFT JOIN r ON l.id = r.id GROUP BY l.id ORDER BY l.id") == [(1, 1), (2, 1), (3, 0)]
    assert rows(s, "SELECT COUNT(DISTINCT category) FROM sales") == [(2,)]
    with pytest.raises(SqlSyntaxError):
        s.sql("SELECT * FROM sales GROUP BY id")


def test_order_limit_offset_distinct(s):
    assert [r[0] for r in rows(s, "SELECT val FROM l ORDER BY val")] == [None, 5, 10]
    assert [r[0] for r in rows(s, "SELECT val FROM l ORDER BY val DESC")] == [10, 5, None]
    assert rows(s, "SELECT id AS k FROM sales ORDER BY category DESC, k LIMIT 2 OFFSET 1") == [(4,), (1,)]
    assert rows(s, "SELECT id FROM sales ORDER BY 1 DESC LIMIT 1, 2") == [(4,), (3,)]
    assert rows(s, "SELECT * FROM sales ORDER BY 3 DESC LIMIT 1") == [(5, None, 50)]
    assert rows(s, "SELECT DISTINCT a FROM bits ORDER BY a DESC") == [(1,), (0,)]
    with pytest.raises(UnknownColumn):
        s.sql("SELECT id FROM sales ORDER BY 2")


def test_set_operations(s):
    assert rows(s, "SELECT 1 UNION SELECT 1 UNION ALL SELECT 2 ORDER BY 1 DESC") == [(2,), (1,)]
    assert rows(s, "SELECT id FROM l INTERSECT SELECT id FROM r ORDER BY id") == [(1,), (2,)]
    assert rows(s, "(SELECT id FROM l ORDER BY id DESC LIMIT 1) EXCEPT SELECT id FROM r") == [(3,)]
    with pytest.raises(ColumnError):
        s.sql("SELECT 1 UNION SELECT 1, 2")


def test_prepared(s):
    p = s.prepare("SELECT id, ? AS c FROM sales WHERE category = ? AND amount > ? ORDER BY id LIMIT ?")
    assert p.n_params == 4
    assert [tuple(r) for r in p.execute([True, "A", 5, 1]).collect()] == [(1, True)]
    assert [tuple(r) for r in p.execute(["x", "B", 35.5, 9]).collect()] == [(4, "x")]
    assert s.prepare("SELECT id, category FROM sales WHERE id = ?").schema().names == ["id", "category"]
    with pytest.raises(SqlSyntaxError):
        p.execute([1])


def test_server_variables(s, spark):
    assert rows(s, "SELECT @@version") == [(spark.version,)]
    assert rows(s, "SELECT @@nope") == [(None,)]
    assert rows(s, "SELECT DATABASE() AS d, VERSION() AS v") == [("default", spark.version)]
    assert s.sql("SET NAMES utf8").rows_affected == 0


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v", "cast(id as string) AS t").write.parquet(f"{tmp_path}/x")
    s = EngineSession(spark)
    s.register("x", spark.read.parquet(f"{tmp_path}/x"))
    plan = s.sql("SELECT id FROM x WHERE v > 10 AND t = '7'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,10)" in plan and "EqualTo(t,7)" in plan


def test_compat(s, spark):
    c = EngineSession(spark, compat=True)
    c.views = s.views
    assert len(rows(c, "SELECT * FROM l JOIN r ON l.val = r.val")) == 1
    assert len(rows(c, "SELECT * FROM l JOIN r ON l.val = r.val AND 1 = 1")) == 0
    assert rows(c, "SELECT COUNT(*) FROM empty") == [] and rows(c, "SELECT COUNT(*) FROM l") == [(3,)]
    assert len(rows(c, "SELECT * FROM bits WHERE a")) == 4
