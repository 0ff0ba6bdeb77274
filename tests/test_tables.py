from __future__ import annotations

import json
import pathlib

import pytest

from tessel.errors import ColumnError, Conflict, ConstraintError, NoSuchTable, SqlSyntaxError, SqlTypeError, TableError, TableExists, TransactionError
from tessel.session import EngineSession


@pytest.fixture
def s(spark, tmp_path):
    return EngineSession(spark, str(tmp_path / "w"))


def rows(s, text):
    return [tuple(r) for r in s.sql(text).collect()]


def people(s, engine="durable"):
    s.sql(f"CREATE TABLE p (id INT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(5) NOT NULL, age INT, score FLOAT, ok BOOL, j JSON) ENGINE={engine}")
    return s.sql("INSERT INTO p (name, age) VALUES ('ann', 30), ('bob', 20), ('cyd', NULL)")


def test_insert_and_auto_increment(s):
    got = people(s)
    assert (got.rows_affected, got.last_insert_id) == (3, 1)
    got = s.sql("INSERT INTO p (id, name) VALUES (10, 'x'), (0, 'y'), (NULL, 'longer than five')")
    assert got.last_insert_id == 11
    assert rows(s, "SELECT id FROM p ORDER BY id") == [(1,), (2,), (3,), (10,), (11,), (12,)]
    assert rows(s, "SELECT LAST_INSERT_ID()") == [(11,)]
    s.sql("DELETE FROM p WHERE id = 12")
    assert s.sql("INSERT INTO p (name) VALUES ('z')").last_insert_id == 13


def test_coercion(s):
    people(s)
    s.sql("INSERT INTO p (name, age, score, ok, j) VALUES ('q', '42', 1 / 0, 'YES', '{\"a\": [1, 2]}'), ('r', 3.9, '2.5', 0, NULL), ('t', 1 / 0, 7, TRUE, '3')")
    assert rows(s, "SELECT age, score, ok, j->'a' FROM p WHERE id > 3 ORDER BY id") == [(42, None, True, "[1,2]"), (3, 2.5, False, None), (None, 7.0, True, None)]
    for bad in ("age) VALUES ('x', '1.5'", "ok) VALUES ('x', 'maybe'", "j) VALUES ('x', '{'", "score) VALUES ('x', 'y'"):
        with pytest.raises(SqlTypeError, match="Cannot parse"):
            s.sql(f"INSERT INTO p (name, {bad})")
    assert len(rows(s, "SELECT id FROM p")) == 6


def test_constraints_leave_nothing_behind(s):
    people(s)
    for bad in ("INSERT INTO p (id, name) VALUES (50, 'a'), (1, 'b')", "INSERT INTO p (id, name) VALUES (60, 'a'), (60, 'b')", "UPDATE p SET id = 5", "UPDATE p SET id = 1 WHERE id = 2"):
        with pytest.raises(ConstraintError, match="Duplicate entry '.*' for key 'PRIMARY'"):
            s.sql(bad)
    for bad in ("INSERT INTO p (age) VALUES (1)", "UPDATE p SET name = NULL WHERE id = 1"):
        with pytest.raises(ConstraintError, match="cannot be NULL"):
            s.sql(bad)
    with pytest.raises(ColumnError):
        s.sql("INSERT INTO p VALUES (1, 'x')")
    with pytest.raises(ColumnError):
        s.sql("INSERT INTO p (nope) VALUES (1)")
    assert rows(s, "SELECT id, name FROM p ORDER BY id") == [(1, "ann"), (2, "bob"), (3, "cyd")]


def test_composite_key(s):
    s.sql("CREATE TABLE c (a INT PRIMARY KEY, b INT PRIMARY KEY, v TEXT)")
    s.sql("INSERT INTO c VALUES (1, 1, 'x'), (1, 2, 'y')")
    with pytest.raises(ConstraintError, match="'1-2'"):
        s.sql("INSERT INTO c VALUES (1, 2, 'z')")


def test_update_reads_old_values(s):
    people(s)
    assert s.sql("UPDATE p SET age = score, score = age WHERE age IS NOT NULL").rows_affected == 2
    assert rows(s, "SELECT age, score FROM p ORDER BY id") == [(None, 30.0), (None, 20.0), (None, None)]
    assert s.sql("UPDATE p SET age = 1 WHERE id > 99").rows_affected == 0
    assert s.sql("UPDATE p SET age = '7'").rows_affected == 3
    with pytest.raises(SqlTypeError):
        s.sql("UPDATE p SET age = name")


def test_update_keeps_other_segments(s):
    people(s)
    s.sql("INSERT INTO p (name) VALUES ('new')")
    before = s.catalog.table("p").segments
    s.sql("UPDATE p SET age = 1 WHERE name = 'new'")
    after = s.catalog.table("p").segments
    assert before[0] in after and before[1] not in after


def test_delete(s):
    people(s)
    assert s.sql("DELETE FROM p WHERE age < 25").rows_affected == 1  # unknown isn't true
    assert rows(s, "SELECT name FROM p ORDER BY id") == [("ann",), ("cyd",)]
    assert s.sql("DELETE FROM p").rows_affected == 2
    assert rows(s, "SELECT * FROM p") == []


def test_insert_select(s):
    people(s)
    s.sql("CREATE TABLE q (id INT PRIMARY KEY AUTO_INCREMENT, name TEXT)")
    assert s.sql("INSERT INTO q (name) SELECT name FROM p WHERE age > 0").rows_affected == 2
    assert len({r[0] for r in rows(s, "SELECT id FROM q")}) == 2
    s.sql("INSERT INTO q (name) VALUES ('next')")
    assert rows(s, "SELECT name FROM q ORDER BY id DESC LIMIT 1") == [("next",)]


def test_loose_grouping_takes_the_first_row(s):
    s.sql("CREATE TABLE g (k TEXT, v INT)")
    s.sql("INSERT INTO g VALUES ('a', 3), ('b', 9), ('a', 1)")
    s.sql("INSERT INTO g VALUES ('b', 2)")
    assert rows(s, "SELECT k, v, COUNT(*) FROM g GROUP BY k ORDER BY k") == [("a", 3, 2), ("b", 9, 2)]
    assert rows(s, "SELECT v FROM g ORDER BY k") == [(3,), (1,), (9,), (2,)]  # ties as stored


def test_definitions(s):
    people(s)
    with pytest.raises(TableExists):
        s.sql("CREATE TABLE p (a INT)")
    s.sql("CREATE TABLE IF NOT EXISTS p (a INT)")
    assert rows(s, "DESCRIBE p")[:3] == [("id", "INTEGER", "NO", "PRI"), ("name", "VARCHAR(5)", "NO", ""), ("age", "INTEGER", "YES", "")]
    s.sql("CREATE INDEX i ON p (name, age)")
    with pytest.raises(TableError):
        s.sql("CREATE INDEX i ON p (name)")
    with pytest.raises(ColumnError):
        s.sql("CREATE INDEX k ON p (nope)")
    s.sql("DROP INDEX i ON p")
    with pytest.raises(TableError):
        s.sql("DROP INDEX i")
    s.sql("DROP INDEX IF EXISTS i")
    s.sql("TRUNCATE TABLE p")
    assert s.sql("INSERT INTO p (name) VALUES ('a')").last_insert_id == 1
    s.sql("DROP TABLE p")
    with pytest.raises(NoSuchTable):
        s.sql("SELECT * FROM p")
    assert rows(s, "SHOW TABLES") == []


@pytest.mark.parametrize("columns", ["a TEXT PRIMARY KEY AUTO_INCREMENT", "a INT AUTO_INCREMENT", "a INT PRIMARY KEY AUTO_INCREMENT, b INT PRIMARY KEY AUTO_INCREMENT"])
def test_auto_increment_rules(s, columns):
    with pytest.raises(TableError):
        s.sql(f"CREATE TABLE t ({columns})")


@pytest.mark.parametrize("name", ["../x", "a/b", "a\\b", "x" * 256])
def test_names_that_could_leave_the_folder(s, name):
    with pytest.raises(SqlSyntaxError):
        s.sql(f"CREATE TABLE `{name}` (a INT)")


def test_defaults(s):
    s.sql("CREATE TABLE d (a INT, b TEXT DEFAULT 'x')")
    s.sql("INSERT INTO d (a) VALUES (1)")
    assert rows(s, "SELECT * FROM d") == [(1, "x")]


def test_transactions(s, spark):
    people(s)
    other = EngineSession(spark, s.warehouse)
    s.sql("BEGIN")
    s.sql("DELETE FROM p WHERE id = 1")
    s.sql("INSERT INTO p (name) VALUES ('dan')")
    assert len(rows(s, "SELECT * FROM p")) == 3 and ("ann",) in rows(other, "SELECT name FROM p")
    with pytest.raises(TransactionError):
        s.sql("BEGIN")
    with pytest.raises(TransactionError):
        s.sql("VACUUM")
    s.sql("ROLLBACK")
    assert rows(s, "SELECT name FROM p ORDER BY id") == [("ann",), ("bob",), ("cyd",)]
    s.sql("START TRANSACTION")
    s.sql("UPDATE p SET age = 1")
    s.sql("COMMIT")
    assert rows(other, "SELECT DISTINCT age FROM p") == [(1,)]
    s.sql("COMMIT")  # nothing is open


def test_failed_statement_leaves_transaction_usable(s):
    people(s)
    s.sql("BEGIN")
    s.sql("DELETE FROM p WHERE id = 1")
    with pytest.raises(ConstraintError):
        s.sql("INSERT INTO p (id, name) VALUES (2, 'dup')")
    s.sql("COMMIT")
    assert len(rows(s, "SELECT * FROM p")) == 2


def test_conflict(s, spark):
    people(s)
    other = EngineSession(spark, s.warehouse)
    s.sql("BEGIN")
    s.sql("UPDATE p SET age = 1")
    other.sql("UPDATE p SET age = 2")
    with pytest.raises(Conflict) as e:
        s.sql("COMMIT")
    assert (e.value.code, e.value.sqlstate) == (1213, "40001")
    assert rows(s, "SELECT DISTINCT age FROM p") == [(2,)]


def test_close_rolls_back(s, spark):
    people(s)
    s.sql("BEGIN")
    s.sql("DELETE FROM p")
    s.close()
    assert len(rows(s, "SELECT * FROM p")) == 3


def test_restart_ignores_what_was_not_committed(s, spark):
    people(s)
    pathlib.Path(s.warehouse, "p", "orphan").mkdir()
    pathlib.Path(s.warehouse, "_catalog", "catalog.999.json.tmp").write_text("{")
    again = EngineSession(spark, s.warehouse)
    assert len(rows(again, "SELECT * FROM p")) == 3
    again.sql("CHECKPOINT")
    assert pathlib.Path(s.warehouse, "p", "orphan").exists()  # it could be another session's that isn't done
    EngineSession(spark, s.warehouse, retention=0).sql("CHECKPOINT")
    assert not pathlib.Path(s.warehouse, "p", "orphan").exists()
    assert json.loads(sorted(pathlib.Path(s.warehouse, "_catalog").glob("catalog.*.json"))[-1].read_text())["tables"]["p"]["next_auto"] == 4


def test_vacuum(s):
    people(s)
    s.sql("DELETE FROM p WHERE id = 2")
    s.sql("INSERT INTO p (name) VALUES ('dan')")
    s.sql("VACUUM")
    table = s.catalog.table("p")
    assert len(table.segments) == 1 and [r[0] for r in s.store(table).rows(table).select("_row_id").orderBy("_row_id").collect()] == [1, 2, 3]
    assert rows(s, "SELECT id, name FROM p ORDER BY id") == [(1, "ann"), (3, "cyd"), (4, "dan")]
    assert s.sql("INSERT INTO p (name) VALUES ('e')").last_insert_id == 5


def test_memory_engine(s):
    people(s, "memory")
    s.sql("BEGIN")
    s.sql("DELETE FROM p WHERE id = 1")
    s.sql("ROLLBACK")  # such tables aren't undone
    assert rows(s, "SELECT id FROM p ORDER BY id") == [(2,), (3,)]
    s.sql("INSERT INTO p (id, name) VALUES (2, 'dup')")  # nor are their keys checked
    s.sql("UPDATE p SET age = 99 WHERE name = 'dup'")
    s.sql("ALTER TABLE p ENGINE=memory")
    s.sql("DELETE FROM p WHERE age = 99")
    s.sql("ALTER TABLE p ENGINE=durable")
    assert rows(s, "SELECT id, age FROM p ORDER BY id") == [(2, 20), (3, None)]
    with pytest.raises(TableError, match="not enabled"):
        s.sql("ALTER TABLE p ENGINE=nope")


def test_engine_names_can_be_added(spark, tmp_path):
    s = EngineSession(spark, str(tmp_path / "w"), engines={"stone": "memory"})
    s.sql("CREATE TABLE t (a INT) ENGINE=Stone")
    assert s.catalog.table("t").engine == "memory"


def test_session_without_warehouse(spark):
    with pytest.raises(TableError):
        EngineSession(spark).sql("CREATE TABLE t (a INT)")


def test_checkpoint_leaves_what_another_session_has_not_committed(s, spark):
    people(s)
    other = EngineSession(spark, s.warehouse)
    other.sql("BEGIN")
    other.sql("INSERT INTO p (name) VALUES ('new')")
    s.sql("CHECKPOINT")
    s.sql("VACUUM")
    with pytest.raises(Conflict):
        other.sql("COMMIT")  # VACUUM changed the table
    other.sql("BEGIN")
    other.sql("INSERT INTO p (name) VALUES ('new')")
    s.sql("CHECKPOINT")
    other.sql("COMMIT")
    assert len(rows(s, "SELECT * FROM p")) == 4


def test_commit_after_its_files_were_cleaned_up_fails(s, spark):
    people(s)
    other = EngineSession(spark, s.warehouse)
    other.sql("BEGIN")
    other.sql("INSERT INTO p (name) VALUES ('new')")
    EngineSession(spark, s.warehouse, retention=0).sql("CHECKPOINT")
    with pytest.raises(Conflict, match="cleaned up"):
        other.sql("COMMIT")
    assert len(rows(s, "SELECT * FROM p")) == 3


def test_readers_keep_their_files(s):
    people(s)
    before = s.sql("SELECT name FROM p")
    for k in range(4):
        s.sql(f"UPDATE p SET age = {k}")
    s.sql("VACUUM")
    assert before.count() == 3


def test_of_racing_commits_of_one_version_one_wins(s, spark):
    import threading

    people(s)
    name, made = f"{s.warehouse}/_catalog/catalog.900.json", []
    start = threading.Barrier(6)

    def work(k):
        start.wait()
        made.append(s.catalogs.files.create(name, str(k)))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [False] * 5 + [True]
    assert not [x for x in s.catalogs.files.names(f"{s.warehouse}/_catalog") if x.startswith("catalog.900.json.")]


def test_old_versions_go_by_themselves(s, monkeypatch):
    from tessel import session

    monkeypatch.setattr(session, "CHECKPOINT_EVERY", 5)
    s.retention = 0
    people(s)
    for k in range(9):
        s.sql(f"UPDATE p SET age = {k}")
    numbers = s.catalogs._numbers()
    assert len(numbers) < 8 and len(list(pathlib.Path(s.warehouse, "p").iterdir())) < 8
    assert rows(s, "SELECT DISTINCT age FROM p") == [(8,)]


def test_update_of_one_row_writes_one_row(s, spark):
    s.sql("CREATE TABLE m (k INT, v TEXT) ENGINE=memory")
    for k in range(10):
        s.sql(f"INSERT INTO m VALUES ({2 * k}, 'a'), ({2 * k + 1}, 'b')")
    before = s.catalog.table("m").segments
    assert s.sql("UPDATE m SET v = 'c' WHERE k = 7").rows_affected == 1
    table = s.catalog.table("m")
    assert table.segments == before and len(table.deltas) == 1
    assert spark.read.parquet(f"{s.warehouse}/{table.deltas[0]}").count() == 1
    for k in range(8):  # folded, first into one, then into the table
        s.sql(f"UPDATE m SET v = 'd' WHERE k = {k}")
    assert len(s.catalog.table("m").deltas) < 8
    assert rows(s, "SELECT k FROM m WHERE v = 'd' ORDER BY k") == [(k,) for k in range(8)]
    assert len(rows(s, "SELECT * FROM m")) == 20


def test_new_keys_go_to_the_table_and_not_the_table_to_them(s, spark):
    s.sql("CREATE TABLE big (k INT PRIMARY KEY, v INT)")
    s.register("many", spark.range(200_000).selectExpr("id AS k", "id AS v"))
    s.sql("INSERT INTO big SELECT k, v FROM many")
    seen = []
    table, store = s.catalog.table("big"), s.store(s.catalog.table("big"))
    kind = type(spark.range(1))
    first = kind.first
    try:
        kind.first = lambda self: seen.append(self._jdf.queryExecution().executedPlan().toString()) or first(self)
        store.check_keys(table, spark.range(1).selectExpr("1L AS _row_id", "inline(array(struct(-7L AS k, 1L AS v)))"), store.rows(table))
    finally:
        kind.first = first
    assert "BroadcastHashJoin" in seen[0] and "LeftSemi" in seen[0]
    with pytest.raises(ConstraintError, match="'7'"):
        s.sql("INSERT INTO big VALUES (7, 1)")


def test_index_lays_files_out(s, spark):
    import glob

    import pyarrow.parquet as pq

    s.sql("CREATE TABLE i (a INT, b INT, v TEXT)")
    s.register("many", spark.range(60_000).selectExpr("id * 7919 % 60000 AS a", "id AS b", "'x' AS v").repartition(6))
    s.sql("INSERT INTO i SELECT a, b, v FROM many")
    s.sql("CREATE INDEX ab ON i (a, b)")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one file
    try:
        s.sql("VACUUM")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (segment,) = s.catalog.table("i").segments
    groups = met = 0
    for f in glob.glob(f"{s.warehouse}/{segment}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = next(meta.row_group(g).column(c).statistics for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == "a")
            groups += 1
            met += stats.min <= 4321 <= stats.max
    assert met == 1 and groups > 1
    assert [r[0] for r in rows(s, "SELECT a FROM i WHERE a = 4321 AND b >= 0")] == [4321]
    plan = s.sql("SELECT b FROM i WHERE a = 4321")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,4321)" in plan
    s.sql("DROP INDEX ab")
    assert s.catalog.table("i").layout == []


def test_stores_that_overwrite_are_refused(spark, monkeypatch):
    from tessel.sources.files import Files

    class Overwriting:
        def getUri(self):
            return self

        def getScheme(self):
            return "s3a"

    files = Files(spark)
    monkeypatch.setattr(files, "_path", lambda path: (Overwriting(), path))
    with pytest.raises(TableError, match="s3a"):
        files.create("s3a://bucket/x", "{}")


def test_closed_statement(s):
    p = s.prepare("SELECT ? AS a")
    assert p.schema([1])[0].dataType.simpleString() == "bigint" and p.schema(["x"])[0].dataType.simpleString() == "string"
    p.close()
    with pytest.raises(SqlSyntaxError, match="closed"):
        p.execute([1])
