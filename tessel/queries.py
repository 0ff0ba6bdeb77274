"""Queries that show each operator on the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .operators import lww
from .session import EngineSession
from .sources import formats, results
from .streaming import lww as lww_stream
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Lazy(dict):
    """Views that are read when a query names them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__()
        self.spark, self.folder = spark, folder

    def __contains__(self, name: object) -> bool:
        return name in TABLES or super().__contains__(name)

    def __missing__(self, name: str) -> DataFrame:
        return self.setdefault(name, self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


def session(spark: SparkSession, sf_dir: str, writable: bool = False) -> EngineSession:
    """A session over the tables of a folder; if writable, with a warehouse of its own in the shared one."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/tessel-{uuid.uuid4().hex}" if writable else None
    s = EngineSession(spark, folder)
    s.views = Lazy(spark, sf_dir)
    return s


# name: (text in the dialect, text for DuckDB or None where it is the same)
SQL: dict[str, tuple[str, str | None]] = {
    "scan_star": ("SELECT * FROM nation", None),
    "project_alias": ("SELECT n_name AS name, n_regionkey region FROM nation", None),
    "project_arith": ("SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS a, l_extendedprice - l_tax AS b, -l_linenumber AS c, (l_orderkey + 3) * 2 AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS a, l_extendedprice - l_tax AS b, -l_linenumber AS c, (l_orderkey + 3) * 2 AS d FROM lineitem"),
    "dual_select": ("SELECT 1 + 1 AS a, 'x' AS b, 2.5 AS c, TRUE AS d, COALESCE(NULL, 7) AS e", "SELECT CAST(2 AS BIGINT) AS a, 'x' AS b, CAST(2.5 AS DOUBLE) AS c, true AS d, CAST(7 AS BIGINT) AS e"),
    "table_alias": ("SELECT o.o_orderkey AS k, o.o_totalprice FROM orders o WHERE o.o_custkey = 7", None),
    "index_point_filter": ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77", None),
    "index_prefix_filter": ("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 1 AND l_linenumber >= 3", None),
    "filter_compare": ("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_custkey <> 5 AND o_orderstatus != 'F'", None),
    "filter_and_or": ("SELECT o_orderkey FROM orders WHERE o_custkey < 10 OR o_custkey > 1490 AND o_orderstatus = 'O' OR NULL", "SELECT o_orderkey FROM orders WHERE o_custkey < 10 OR (o_custkey > 1490 AND o_orderstatus = 'O')"),
    "filter_not": ("SELECT o_orderkey FROM orders WHERE NOT (o_custkey = 1 OR o_custkey > 20)", None),
    "filter_range": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12", None),
    "filter_between": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_linenumber NOT BETWEEN 2 AND 9", None),
    "filter_is_null": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL", None),
    "filter_is_not_null": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL", None),
    "filter_in": ("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_name IN ('JAPAN', 'CHINA', 'NATION_1', 'NATION_3')", None),
    "filter_not_in": ("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')", None),
    "filter_in_null3vl": ("SELECT n_nationkey, n_regionkey IN (1, NULL) AS a, n_regionkey NOT IN (1, NULL) AS b FROM nation", "SELECT n_nationkey, n_regionkey IN (1, NULL) AS a, n_regionkey NOT IN (1, NULL) AS b FROM nation"),
    "filter_like_ci": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%BLUE%' OR p_name LIKE 'red_%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BLUE%' OR p_name ILIKE 'red_%'"),
    "filter_not_like": ("SELECT c_custkey FROM customer WHERE c_name NOT LIKE 'CUSTOMER#%1'", "SELECT c_custkey FROM customer WHERE c_name NOT ILIKE 'CUSTOMER#%1'"),
    "filter_truthy": ("SELECT n_nationkey FROM nation WHERE n_regionkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0"),
    "filter_string_affinity": (
        "SELECT e.event_id, e.props->>'k' = 5 AS eq, e.props->>'k' < 50 AS lt, e.event_type > 3 AS gt FROM events e WHERE e.props->>'k' >= 40",
        "SELECT event_id, CAST(props->>'$.k' AS BIGINT) = 5 AS eq, CAST(props->>'$.k' AS BIGINT) < 50 AS lt, true AS gt FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 40",
    ),
    "division_float": ("SELECT l_orderkey, l_linenumber, l_orderkey / l_linenumber AS r, l_extendedprice / l_quantity AS u FROM lineitem", None),
    "division_by_zero": ("SELECT n_nationkey, n_nationkey / n_regionkey AS r FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN CAST('nan' AS DOUBLE) ELSE n_nationkey / n_regionkey END AS r FROM nation"),
    "coalesce_ifnull": ("SELECT d.doc_id, COALESCE(l.quality, l.toxic, -1) AS q, IFNULL(l.toxic, 9) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, CAST(coalesce(l.quality, l.toxic, -1) AS BIGINT) AS q, CAST(coalesce(l.toxic, 9) AS BIGINT) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "json_get_text": ("SELECT event_id, props->>'k' AS k FROM events", "SELECT event_id, props->>'$.k' AS k FROM events"),
    "json_get": ("SELECT event_id, props->'k' AS k, props->'none' AS x FROM events", "SELECT event_id, CAST(props->'$.k' AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS x FROM events"),
    "json_filter": ("SELECT event_id FROM events WHERE props->>'k' = '5' OR props->>'k' = 6", "SELECT event_id FROM events WHERE props->>'$.k' IN ('5', '6')"),
    "json_extract": ("SELECT event_id, JSON_EXTRACT(props, '$.k') AS k FROM events", "SELECT event_id, CAST(props->'$.k' AS VARCHAR) AS k FROM events"),
    "join_inner_hash": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_left": ("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT OUTER JOIN labels l ON d.doc_id = l.doc_id", None),
    "join_left_unmatched": ("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL", None),
    "join_self": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a INNER JOIN region b ON a.n_regionkey > b.r_regionkey", None),
    "join_multi3": ("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_multi4_mixed": ("SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, c.c_name, s.s_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal > 0", None),
    "join_qualified_star": ("SELECT r.*, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_star_names": ("SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", 'SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey", r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey'),
    "join_right": ("SELECT n.n_name, r.r_name FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20", None),
    "join_full": ("SELECT n.n_name, r.r_name FROM nation n FULL OUTER JOIN region r ON n.n_regionkey = r.r_regionkey + 2", None),
    "join_semi": ("SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 300000)"),
    "join_anti": ("SELECT d.doc_id FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "agg_global": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_shipdate) AS a, MAX(l_shipdate) AS b FROM lineitem", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem"),
    "agg_count_star": ("SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 100000", None),
    "agg_count_col": ("SELECT COUNT(*) AS a, COUNT(l.quality) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", None),
    "agg_sum_int": ("SELECT l_returnflag, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag"),
    "agg_sum_double": ("SELECT l_linestatus, ROUND(SUM(l_quantity), 2) AS s FROM lineitem GROUP BY l_linestatus", None),
    "agg_avg": ("SELECT l_returnflag, ROUND(AVG(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag", None),
    "agg_min_max": ("SELECT o_orderstatus, MIN(o_orderpriority) AS a, MAX(o_totalprice) AS b, MIN(o_orderdate) AS d FROM orders GROUP BY o_orderstatus", None),
    "agg_expr": ("SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) + 1 AS n FROM lineitem GROUP BY l_returnflag", None),
    "agg_group_one": ("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type", None),
    "agg_group_many": ("SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_discount), 8) AS d, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_group_expr": ("SELECT l_linenumber * 10 AS k, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber * 10", "SELECT CAST(l_linenumber * 10 AS BIGINT) AS k, count(*) AS n FROM lineitem GROUP BY 1"),
    "agg_group_null": ("SELECT l.quality AS q, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality", None),
    "agg_over_join": ("SELECT r.r_name AS r_name, COUNT(*) AS n, ROUND(SUM(c.c_acctbal), 2) AS b FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", None),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0"),
    "agg_distinct": ("SELECT COUNT(DISTINCT o_custkey) AS c, SUM(DISTINCT o_custkey) AS s FROM orders", "SELECT count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders"),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 15 AND MAX(o_totalprice) > 1000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 1000"),
    "agg_order_limit": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10", None),
    "sort_multi": ("SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderpriority, o_orderkey LIMIT 100", None),
    "sort_nulls": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality, d.doc_id LIMIT 50", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id LIMIT 50"),
    "sort_nulls_desc": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC, d.doc_id LIMIT 450", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id LIMIT 450"),
    "sort_expr": ("SELECT p_partkey, p_size FROM part ORDER BY p_size * -1, p_partkey LIMIT 20", None),
    "sort_join": ("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey ORDER BY r.r_name DESC, n.n_nationkey LIMIT 7", None),
    "topk": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10", None),
    "limit_ordered": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 5 OFFSET 10", None),
    "distinct_select": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "default_names": ("SELECT n_name, COUNT(*), MAX(n_nationkey), 7, 'x' FROM nation GROUP BY n_name", "SELECT n_name, count(*) AS \"COUNT(*)\", max(n_nationkey) AS \"MAX(...)\", CAST(7 AS BIGINT) AS \"7\", 'x' AS \"x\" FROM nation GROUP BY n_name"),
    "json_chained": ("SELECT event_id, CONCAT('{\"a\": {\"b\": [10, ', props, ']}}')->'a'->'b'->'1'->>'k' AS k, CONCAT('{\"a\": [', event_id, ']}')->'a'->>0 AS e FROM events", "SELECT event_id, props->>'$.k' AS k, CAST(event_id AS VARCHAR) AS e FROM events"),
    "json_null": ("SELECT n_nationkey, '{\"a\": null}'->>'a' IS NULL AS a, '{\"a\": null}'->'a' IS NULL AS b, '{'->'a' IS NULL AS c, '{\"a\": 1}'->'z' IS NULL AS d FROM nation", "SELECT n_nationkey, true AS a, false AS b, true AS c, true AS d FROM nation"),
    "set_union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", None),
    "set_union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "set_intersect": ("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels", None),
    "set_except": ("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels", None),
    "scalar_functions": ("SELECT n_nationkey, UPPER(n_name) AS u, LENGTH(n_name) AS n, ABS(n_regionkey - 3) AS a, SUBSTRING(n_name, 1, 3) AS s, CONCAT(n_name, '!') AS c FROM nation", "SELECT n_nationkey, upper(n_name) AS u, CAST(length(n_name) AS INT) AS n, CAST(abs(n_regionkey - 3) AS BIGINT) AS a, substring(n_name, 1, 3) AS s, concat(n_name, '!') AS c FROM nation"),
    "pricing_summary": (
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, ROUND(AVG(l_quantity), 6) AS avg_qty, COUNT(*) AS n FROM lineitem WHERE l_quantity < 48 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
        None,
    ),
}


def of_sql(text: str) -> Query:
    return lambda spark, sf_dir: session(spark, sf_dir).sql(text)


# operators that are more than a query


def prepared_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).prepare("SELECT o_orderkey, o_totalprice * ? AS p FROM orders WHERE o_custkey = ? AND o_orderstatus IN (?, ?) LIMIT ?").execute([2, 7, "O", "F", 100000])


def agg_first_value_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, True)
    s.sql("CREATE TABLE n (k INT, name TEXT, region INT)")
    s.sql("INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey")
    return s.sql("SELECT region, name, COUNT(*) AS n FROM n GROUP BY region")


def nation_table(spark: SparkSession, sf_dir: str, engine: str = "durable") -> EngineSession:
    s = session(spark, sf_dir, True)
    s.sql(f"CREATE TABLE n (k INT PRIMARY KEY, name TEXT NOT NULL, region INT) ENGINE={engine}")
    s.sql("INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return s


def dml_insert_select_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir)
    s.sql("INSERT INTO n (name, k) VALUES ('it''s', 100), ('b', 101)")
    return s.sql("SELECT * FROM n")


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir)
    s.sql("UPDATE n SET name = CONCAT(name, '!'), region = k + region WHERE region >= 3")
    return s.sql("SELECT * FROM n")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir)
    s.sql("DELETE FROM n WHERE region IN (1, 2) AND k <> 3")
    return s.sql("SELECT * FROM n")


def dml_auto_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, True)
    s.sql("CREATE TABLE a (id INT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(9))")
    s.sql("INSERT INTO a (name) VALUES ('x'), ('y')")
    s.sql("INSERT INTO a VALUES (10, 'z'), (0, 'w'), (NULL, 'v')")
    return s.sql("SELECT id, name, LAST_INSERT_ID() AS last FROM a")


def pk_violation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, failed = nation_table(spark, sf_dir), 0
    for text in ("INSERT INTO n VALUES (3, 'x', 1)", "INSERT INTO n VALUES (200, 'x', 1), (200, 'y', 1)", "UPDATE n SET k = 7 WHERE k = 8", "INSERT INTO n VALUES (300, NULL, 1)"):
        try:
            s.sql(text)
        except Exception as e:
            failed += "Duplicate" in str(e) or "NULL" in str(e)
    return s.sql(f"SELECT COUNT(*) AS n, {failed} AS failed FROM n")


def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir)
    for text in ("BEGIN", "DELETE FROM n WHERE region = 1", "UPDATE n SET name = 'gone'", "ROLLBACK"):
        s.sql(text)
    return s.sql("SELECT * FROM n")


def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir)
    for text in ("START TRANSACTION", "DELETE FROM n WHERE region = 1", "INSERT INTO n VALUES (50, 'new', 9)", "COMMIT"):
        s.sql(text)
    return s.sql("SELECT * FROM n")


def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, True)
    s.sql("CREATE TABLE n (k INT PRIMARY KEY AUTO_INCREMENT, name TEXT)")
    s.sql("INSERT INTO n (name) SELECT n_name FROM nation")
    s.sql("TRUNCATE TABLE n")
    s.sql("INSERT INTO n (name) VALUES ('a'), ('b')")  # numbers begin anew
    return s.sql("SELECT * FROM n")


def vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir)
    s.sql("DELETE FROM n WHERE k < 5")
    s.sql("VACUUM")
    return s.sql("SELECT * FROM n")


def alter_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir, "memory")
    s.sql("UPDATE n SET region = 7 WHERE k = 1")
    s.sql("ALTER TABLE n ENGINE=durable")
    return s.sql("SELECT * FROM n")


def memory_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir, "memory")
    for text in ("BEGIN", "DELETE FROM n WHERE region = 1", "ROLLBACK"):
        s.sql(text)
    return s.sql("SELECT * FROM n")


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, True)
    s.sql("CREATE TABLE d (id INT PRIMARY KEY, a VARCHAR(20) NOT NULL, b FLOAT, c JSON, e BOOL, f TEXT)")
    return s.sql("DESCRIBE d")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, True)
    s.views = {}
    for name in ("b", "a"):
        s.sql(f"CREATE TABLE {name} (id INT)")
    s.sql("DROP TABLE b")
    return s.sql("SHOW TABLES")


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/tessel-{uuid.uuid4().hex}"
    formats.write(df, path, "jsonl")
    return formats.read(spark, path, "jsonl", df.schema)


def event_changes(df: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", lww.DELETE).otherwise(lww.UPSERT)
    return df.select(F.col("user_id").alias(lww.ID), op.alias(lww.OP), F.unix_seconds(F.col("ts").cast("timestamp")).alias(lww.TS), F.col("event_id").alias(lww.ARRIVAL), "value", "event_type")


def lww_merge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lww.live(lww.winners(event_changes(spark.read.parquet(f"{sf_dir}/events.parquet")))).select("row_id", "ts", "value", "event_type")


def lww_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lww.winners(event_changes(spark.read.parquet(f"{sf_dir}/events.parquet"))).filter(F.col("op") == lww.DELETE).select("row_id", "ts")


def lww_stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's state, and what becomes of it when the same changes are sent again."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/tessel-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = EngineSession(spark, folder)
    s.sql("CREATE TABLE state (value FLOAT, event_type TEXT) ENGINE=memory")
    stream = lww_stream.read_changes(spark, f"{sf_dir}/events.parquet*", events.schema)
    lww_stream.merge_into(event_changes(stream), lambda df: s.merge_changes("state", df), f"{folder}/_stream").awaitTermination()
    s.merge_changes("state", event_changes(events))
    table = s.catalog.table("state")
    return s.store(table).rows(table).select(F.col("_row_id").alias("row_id"), F.col("_row_ts").alias("ts"), "value", "event_type")


def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windows.tumbling(events, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v")])


def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.withColumn("r", F.row_number().over(best)).filter("r <= 2").select("o_custkey", "o_orderkey", "r")


def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean-up while another session has written and not yet committed."""
    s = nation_table(spark, sf_dir)
    other = EngineSession(spark, s.warehouse)
    for text in ("BEGIN", "DELETE FROM n WHERE region = 1", "INSERT INTO n VALUES (60, 'late', 9)"):
        other.sql(text)
    s.sql("CHECKPOINT")
    other.sql("COMMIT")
    return s.sql("SELECT * FROM n")


def commit_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of transactions that change one table from one version the first wins, those on other tables don't mind."""
    s = nation_table(spark, sf_dir)
    s.sql("CREATE TABLE log (w INT)")
    both, lost = [EngineSession(spark, s.warehouse) for _ in range(3)], 0
    for k, one in enumerate(both):
        one.sql("BEGIN")
        one.sql(f"UPDATE n SET region = {100 + k} WHERE region = 2" if k < 2 else "INSERT INTO log VALUES (2)")
    for one in both:
        try:
            one.sql("COMMIT")
        except EngineError as e:
            lost += e.code == 1213
    return s.sql(f"SELECT n.k, n.region, log.w, {lost} AS lost FROM n JOIN log ON n.k >= 0")


def second_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session reads that starts anew: all that is committed, nothing else."""
    s = nation_table(spark, sf_dir)
    s.sql("DELETE FROM n WHERE k > 20")
    s.sql("BEGIN")
    s.sql("DELETE FROM n")
    return EngineSession(spark, s.warehouse).sql("SELECT * FROM n")


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix lookup in a table that VACUUM laid out by its index."""
    s = session(spark, sf_dir, True)
    s.sql("CREATE TABLE l (o INT, line INT, part INT)")
    s.sql("CREATE INDEX by_order ON l (o, line)")
    s.sql("INSERT INTO l SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
    s.sql("VACUUM")
    return s.sql("SELECT o, line, part FROM l WHERE o = 1 AND line >= 3")


def index_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir)
    for text in ("CREATE INDEX a ON n (region, k)", "CREATE INDEX IF NOT EXISTS a ON n (k)", "CREATE INDEX b ON n (name)", "DROP INDEX b", "DROP INDEX IF EXISTS b"):
        s.sql(text)
    found = [(i.name, ",".join(i.columns), i.primary) for i in s.catalog.indexes.values()]
    return spark.createDataFrame(found, "index_name string, columns string, is_primary boolean")


def row_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir)
    s.sql("INSERT INTO n VALUES (70, 'last', 1)")
    (last,) = [r[0] for r in s.table("n").filter("k = 70").select("_row_id").collect()]
    return s.row("n", last)


def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small inserts, put together as they come."""
    s = nation_table(spark, sf_dir)
    s.stores["durable"].COMPACT_AT = 4
    for k in range(7):
        s.sql(f"INSERT INTO n VALUES ({100 + k}, 'x', {k})")
    few = len(s.catalog.table("n").segments) < 4
    return s.sql(f"SELECT k, name, region, {str(few).upper()} AS few FROM n")


def memory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many changes of a memory table; what they touch is written, not the table."""
    s = nation_table(spark, sf_dir, "memory")
    base = s.catalog.table("n").segments
    for k in range(5):
        s.sql(f"UPDATE n SET region = region + 10 WHERE k <= {k}")
    s.sql("DELETE FROM n WHERE k = 2 OR k = 24")
    s.sql("UPDATE n SET name = 'gone' WHERE k = 24")
    table = s.catalog.table("n")
    kept = table.segments == base and len(table.deltas) == 6
    return s.sql(f"SELECT k, name, region, {str(kept).upper()} AS kept FROM n")


def memory_resident(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nation_table(spark, sf_dir, "memory")
    s.resident = True
    s.sql("SELECT COUNT(*) FROM n").collect()
    held = s.cached["n"][1].is_cached
    s.sql("DELETE FROM n WHERE k < 3")
    return s.sql(f"SELECT k, {str(held).upper()} AS held FROM n")


def deltas_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that one replica drains in portions and another merges, twice and out of order."""
    a, b = nation_table(spark, sf_dir, "memory"), session(spark, sf_dir, True)
    b.sql("CREATE TABLE n (k INT PRIMARY KEY, name TEXT NOT NULL, region INT) ENGINE=memory")
    first = a.drain("n")
    a.sql("UPDATE n SET region = 50 WHERE k = 3")
    a.sql("DELETE FROM n WHERE k = 4")
    second, none = a.drain("n"), a.drain("n")
    for changes in (second, first, second, none):
        b.merge_changes("n", changes)
    return b.sql("SELECT * FROM n")


def deltas_of_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delta an hour with all its operations; of one time the first in it counts."""
    events = event_changes(spark.read.parquet(f"{sf_dir}/events.parquet"))
    hour = F.floor(F.col("ts") / 3600) * 3600
    one = F.struct(F.col("arrival"), F.col("op"), F.col("row_id"), F.col("value"))
    deltas = events.groupBy(hour.alias("ts")).agg(F.sort_array(F.collect_list(one)).alias("operations"))
    ops = F.transform("operations", lambda o: F.struct(o["op"].alias("op"), o["row_id"].alias("row_id"), o["value"].alias("value")))
    return lww.live(lww.winners(lww.exploded(deltas.select("ts", ops.alias("operations"))))).select("row_id", "ts", "value")


def prepared_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a prepared statement before it runs, and that a closed one doesn't."""
    p = session(spark, sf_dir).prepare("SELECT o_orderkey, o_totalprice * ? AS p, ? AS t, COUNT(*) AS n FROM orders WHERE o_custkey = ? GROUP BY o_orderkey, o_totalprice")
    rows = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(p.schema([2, "x", 7]))]
    p.close()
    try:
        p.execute([2, "x", 7])
    except EngineError as e:
        rows.append((len(rows), "closed", str(e.code)))
    return spark.createDataFrame(rows, "place int, name string, type string")


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of mistake is answered with."""
    s, found = nation_table(spark, sf_dir), []
    s.sql("BEGIN")
    for text in ERRORS:
        try:
            s.sql(text)
            found.append((text, 0, ""))
        except EngineError as e:
            found.append((text, e.code, e.sqlstate))
    return spark.createDataFrame(found, "statement string, code int, state string")


# Statements that fail, with code and state.
ERRORS = {
    "SELEC 1": (1064, "42000"),
    "SELECT * FROM n GROUP BY k": (1064, "42000"),
    "SELECT 1 WHERE TRUE": (1064, "42000"),
    "SELECT NO_SUCH_FUNCTION(k) FROM n": (1064, "42000"),
    "SELECT SUM(k) FROM n WHERE SUM(k) > 1": (1064, "42000"),
    "SELECT nope FROM n": (1054, "42S22"),
    "SELECT k FROM n a JOIN n b ON a.k = b.k": (1054, "42S22"),
    "SELECT x.* FROM n": (1054, "42S22"),
    "SELECT 1 FROM n a JOIN n a ON 1 = 1": (1066, "42S02"),
    "SELECT 1 FROM N": (1146, "42S02"),
    "CREATE TABLE n (k INT)": (1050, "42S02"),
    "CREATE TABLE m (a INT, a TEXT)": (1054, "42S22"),
    "CREATE TABLE m (a INT AUTO_INCREMENT)": (1050, "42S02"),
    "CREATE TABLE m (a TEXT PRIMARY KEY AUTO_INCREMENT)": (1050, "42S02"),
    "CREATE TABLE m (a INT PRIMARY KEY AUTO_INCREMENT, b INT PRIMARY KEY AUTO_INCREMENT)": (1050, "42S02"),
    "CREATE TABLE `../m` (a INT)": (1064, "42000"),
    "CREATE TABLE m (a INT) ENGINE=nothing": (1050, "42S02"),
    "CREATE INDEX i ON n (nope)": (1054, "42S22"),
    "DROP INDEX nope": (1050, "42S02"),
    "DROP TABLE nope": (1146, "42S02"),
    "INSERT INTO n VALUES (1)": (1054, "42S22"),
    "INSERT INTO n VALUES (300, NULL, 1)": (1047, "HY000"),
    "INSERT INTO n VALUES (7, 'x', 1)": (1047, "HY000"),
    "INSERT INTO n VALUES (301, 'x', 'y')": (1047, "HY000"),
    "BEGIN": (1047, "40001"),
    "VACUUM": (1047, "40001"),
}


def results_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.as_text(session(spark, sf_dir).sql("SELECT n_nationkey, n_nationkey > 5 AS b, n_nationkey / 2 AS h, NULLIF(n_name, 'CHINA') AS n, '{\"a\": [1, 2]}'->'a' AS j FROM nation"))


def results_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as Arrow and back, with the types it had."""
    df = session(spark, sf_dir).sql("SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus = 'F' AS f FROM orders WHERE o_custkey < 20")
    return spark.createDataFrame(results.typed_batches(df))


def async_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables written at the same time."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/tessel-{uuid.uuid4().hex}"
    writes = [formats.write_async(spark.read.parquet(f"{sf_dir}/{x}.parquet"), f"{folder}/{x}", kind) for x, kind in (("nation", "parquet"), ("region", "jsonl"))]
    for w in writes:
        w.result(600)
    regions = formats.read(spark, f"{folder}/region", "jsonl", "r_regionkey int, r_name string")
    return formats.read(spark, f"{folder}/nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of one's own, called by name."""
    s = session(spark, sf_dir)
    s.register_aggregate("spread", lambda c: F.max(c) - F.min(c))
    s.register_aggregate("Evens", lambda c: F.count_if(c % 2 == 0))
    return s.sql("SELECT n_regionkey AS r, SPREAD(n_nationkey) AS s, EVENS(n_nationkey) AS e FROM nation GROUP BY n_regionkey HAVING SPREAD(n_nationkey) >= 0")


def sort_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with equal keys come as they are stored."""
    s = session(spark, sf_dir, True)
    s.sql("CREATE TABLE t (g INT, v INT)")
    for v in (5, 3, 9):
        s.sql(f"INSERT INTO t VALUES (1, {v}), (0, {v + 1}), (1, {v + 2})")
    rows = s.sql("SELECT g, v FROM t ORDER BY g").collect()
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place int, g bigint, v bigint")


def compat_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In compat mode nulls meet in a join by one equality."""
    s = session(spark, sf_dir)
    s.compat = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    s.register("a", docs.filter("doc_id % 10 < 3").select("doc_id", "quality"))
    s.register("b", spark.createDataFrame([(0, "bad"), (1, "good"), (None, "unknown")], "q int, word string"))
    return s.sql("SELECT a.doc_id, b.word FROM a JOIN b ON a.quality = b.q")


def server_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, True)
    s.sql("SET NAMES utf8mb4")
    before = s.sql("SELECT @@autocommit").first()[0]
    s.sql("BEGIN")
    return spark.createDataFrame([(before, s.sql("SELECT @@autocommit").first()[0], s.sql("SELECT DATABASE()").first()[0])], "before string, within string, database string")


def flush_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, lww_stream.flush(k)["processingTime"]) for k in lww_stream.FLUSH], "preset string, every string")


def background_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that come while a stream flushes them to a table, with the quickest preset."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/tessel-{uuid.uuid4().hex}"
    events = event_changes(spark.read.parquet(f"{sf_dir}/events.parquet"))
    s = EngineSession(spark, folder)
    s.sql("CREATE TABLE state (value FLOAT, event_type TEXT) ENGINE=memory")
    for k in range(3):
        events.filter(F.coalesce(F.pmod("arrival", F.lit(3)), F.lit(0)) == k).coalesce(1).write.parquet(f"{folder}/_changes/{k}")
        if k == 0:
            stream = lww_stream.read_changes(spark, f"{folder}/_changes/*", events.schema)
            running = lww_stream.merge_into(stream, lambda df: s.merge_changes("state", df), f"{folder}/_stream", **lww_stream.flush("latency"))
    running.processAllAvailable()
    running.stop()
    table = s.catalog.table("state")
    return s.store(table).rows(table).select(F.col("_row_id").alias("row_id"), F.col("_row_ts").alias("ts"), "value", "event_type")


SPECIAL = [
    prepared_select, agg_first_value_loose, dml_insert_select_back, dml_update, dml_delete, dml_auto_increment, pk_violation_count, txn_rollback, txn_commit, truncate, vacuum, alter_engine, memory_rollback, describe, show_tables, jsonl_round_trip,
    lww_merge_batch, lww_tombstone, lww_stream_merge, window_tumbling, window_rank, checkpoint, commit_race, second_session, index_lookup, index_definitions, row_by_id, compaction, memory_changes, memory_resident, deltas_drained, deltas_of_operations,
    prepared_schema, error_codes, results_as_text, results_typed, async_write, user_aggregate, sort_ties, compat_join, server_variables, flush_presets, background_flush,
]

NATION = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"
LWW = "SELECT * FROM (SELECT user_id AS row_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) DESC, event_id) AS r FROM events) WHERE r = 1"

SPECIAL_SQL = {
    "prepared_select": "SELECT o_orderkey, o_totalprice * 2 AS p FROM orders WHERE o_custkey = 7 AND o_orderstatus IN ('O', 'F')",
    "agg_first_value_loose": "SELECT CAST(n_regionkey AS BIGINT) AS region, arg_min(n_name, n_nationkey) AS name, count(*) AS n FROM nation GROUP BY n_regionkey",
    "dml_insert_select_back": f"{NATION} UNION ALL SELECT 100, 'it''s', NULL UNION ALL SELECT 101, 'b', NULL",
    "dml_update": f"SELECT k, CASE WHEN region >= 3 THEN name || '!' ELSE name END AS name, CASE WHEN region >= 3 THEN k + region ELSE region END AS region FROM ({NATION})",
    "dml_delete": f"SELECT * FROM ({NATION}) WHERE NOT (region IN (1, 2) AND k <> 3)",
    "dml_auto_increment": "SELECT CAST(id AS BIGINT) AS id, name, CAST(11 AS BIGINT) AS last FROM (VALUES (1, 'x'), (2, 'y'), (10, 'z'), (11, 'w'), (12, 'v')) t(id, name)",
    "pk_violation_count": "SELECT count(*) AS n, CAST(4 AS BIGINT) AS failed FROM nation",
    "txn_rollback": NATION,
    "txn_commit": f"SELECT * FROM ({NATION}) WHERE region <> 1 UNION ALL SELECT 50, 'new', 9",
    "truncate": "SELECT CAST(k AS BIGINT) AS k, name FROM (VALUES (1, 'a'), (2, 'b')) t(k, name)",
    "checkpoint": f"SELECT * FROM ({NATION}) WHERE region <> 1 UNION ALL SELECT 60, 'late', 9",
    "commit_race": f"SELECT k, CASE WHEN region = 2 THEN 100 ELSE region END AS region, CAST(2 AS BIGINT) AS w, CAST(1 AS BIGINT) AS lost FROM ({NATION})",
    "second_session": f"SELECT * FROM ({NATION}) WHERE k <= 20",
    "index_lookup": "SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part FROM lineitem WHERE l_orderkey = 1 AND l_linenumber >= 3",
    "index_definitions": "SELECT * FROM (VALUES ('PRIMARY_n', 'k', true), ('a', 'region,k', false)) t(index_name, columns, is_primary)",
    "row_by_id": "SELECT CAST(70 AS BIGINT) AS k, 'last' AS name, CAST(1 AS BIGINT) AS region",
    "compaction": f"SELECT *, true AS few FROM ({NATION} UNION ALL SELECT 100 + i, 'x', i FROM range(7) r(i))",
    "memory_changes": f"SELECT k, name, region + 10 * greatest(0, 5 - k) AS region, true AS kept FROM ({NATION}) WHERE k NOT IN (2, 24)",
    "memory_resident": f"SELECT k, true AS held FROM ({NATION}) WHERE k >= 3",
    "deltas_drained": f"SELECT k, name, CASE WHEN k = 3 THEN 50 ELSE region END AS region FROM ({NATION}) WHERE k <> 4",
    "deltas_of_operations": "SELECT row_id, ts, value FROM (SELECT user_id AS row_id, event_type, value, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(e.ts) / 3600) DESC, event_id) AS r FROM events e) WHERE r = 1 AND event_type <> 'error'",
    "prepared_schema": "SELECT * FROM (VALUES (0::INT, 'o_orderkey', 'bigint'), (1, 'p', 'double'), (2, 't', 'string'), (3, 'n', 'bigint'), (4, 'closed', '1064')) t(place, name, type)",
    "error_codes": "SELECT * FROM (VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', {c}, '{state}')" for k, (c, state) in ERRORS.items()) + ") t(statement, code, state)",
    "results_as_text": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CAST(CAST(n_nationkey > 5 AS INT) AS VARCHAR) AS b, CAST(n_nationkey / 2 AS VARCHAR) AS h, nullif(n_name, 'CHINA') AS n, '[1,2]' AS j FROM nation",
    "results_typed": "SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus = 'F' AS f FROM orders WHERE o_custkey < 20",
    "async_write": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "user_aggregate": "SELECT n_regionkey AS r, max(n_nationkey) - min(n_nationkey) AS s, count(*) FILTER (n_nationkey % 2 = 0) AS e FROM nation GROUP BY n_regionkey",
    "sort_ties": "SELECT place, CAST(g AS BIGINT) AS g, CAST(v AS BIGINT) AS v FROM (VALUES (0, 0, 6), (1, 0, 4), (2, 0, 10), (3, 1, 5), (4, 1, 7), (5, 1, 3), (6, 1, 5), (7, 1, 9), (8, 1, 11)) t(place, g, v)",
    "compat_join": "SELECT doc_id, CASE quality WHEN 0 THEN 'bad' WHEN 1 THEN 'good' ELSE 'unknown' END AS word FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 10 < 3",
    "server_variables": "SELECT '1' AS before, '0' AS within, 'default' AS database",
    "flush_presets": "SELECT * FROM (VALUES ('default', '1000 milliseconds'), ('throughput', '5000 milliseconds'), ('latency', '500 milliseconds')) t(preset, every)",
    "background_flush": f"SELECT row_id, ts, value, event_type FROM ({LWW}) WHERE event_type <> 'error'",
    "vacuum": f"SELECT * FROM ({NATION}) WHERE k >= 5",
    "alter_engine": f"SELECT k, name, CASE WHEN k = 1 THEN 7 ELSE region END AS region FROM ({NATION})",
    "memory_rollback": f"SELECT * FROM ({NATION}) WHERE region <> 1",
    "describe": "SELECT * FROM (VALUES ('id', 'INTEGER', 'NO', 'PRI'), ('a', 'VARCHAR(20)', 'NO', ''), ('b', 'FLOAT', 'YES', ''), ('c', 'JSON', 'YES', ''), ('e', 'BOOLEAN', 'YES', ''), ('f', 'TEXT', 'YES', '')) t(\"Field\", \"Type\", \"Null\", \"Key\")",
    "show_tables": "SELECT 'a' AS \"Tables\"",
    "jsonl_round_trip": "SELECT * FROM nation",
    "lww_merge_batch": f"SELECT row_id, ts, value, event_type FROM ({LWW}) WHERE event_type <> 'error'",
    "lww_tombstone": f"SELECT row_id, ts FROM ({LWW}) WHERE event_type = 'error'",
    "lww_stream_merge": f"SELECT row_id, ts, value, event_type FROM ({LWW}) WHERE event_type <> 'error'",
    "window_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL",
    "window_rank": "SELECT o_custkey, o_orderkey, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2",
}


def queries() -> dict[str, Query]:
    return {k: of_sql(text) for k, (text, _) in SQL.items()} | {f.__name__: f for f in SPECIAL}


def oracle_sql() -> dict[str, str]:
    return {k: other or text for k, (text, other) in SQL.items()} | SPECIAL_SQL
