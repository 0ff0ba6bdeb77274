from __future__ import annotations

import pytest

from tessel.errors import SqlSyntaxError
from tessel.plans import nodes as n
from tessel.plans.parser import parse
from tessel.plans.tokens import tokenize


def where(text):
    return parse(f"SELECT a FROM t WHERE {text}").statement.where


def test_tokens_quote_and_escape():
    got = [(t.kind, t.value) for t in tokenize("`a``b` \"c\"\"d\" 'it''s \\n \\q' 1.5 7 -- end\n/* x */ ->>")]
    assert got == [("name", "a`b"), ("name", 'c"d'), ("text", "it's \n \\q"), ("float", "1.5"), ("int", "7"), ("op", "->>"), ("end", "")]


def test_unknown_character():
    with pytest.raises(SqlSyntaxError):
        tokenize("SELECT a % b")


def test_precedence():
    a, b, c = n.Name("a"), n.Name("b"), n.Name("c")
    assert where("a OR b AND c") == n.Binary("or", a, n.Binary("and", b, c))
    assert where("NOT a = 1 AND b") == n.Binary("and", n.Unary("not", n.Binary("=", a, n.Literal(1))), b)
    assert where("a + b * c < 3") == n.Binary("<", n.Binary("+", a, n.Binary("*", b, c)), n.Literal(3))
    assert where("a - b - c") == n.Binary("-", n.Binary("-", a, b), c)
    assert where("a->'x'->>'y' = 'z'") == n.Binary("=", n.Arrow(n.Arrow(a, "x", False), "y", True), n.Literal("z"))


def test_predicates():
    a = n.Name("a")
    assert where("a IS NOT NULL") == n.Unary("is not null", a)
    assert where("a NOT IN (1, NULL)") == n.In(a, (n.Literal(1), n.Literal(None)), True)
    assert where("a NOT LIKE 'x%'") == n.Like(a, n.Literal("x%"), True)
    assert where("a BETWEEN 1 AND 2 AND b") == n.Binary("and", n.Between(a, n.Literal(1), n.Literal(2)), n.Name("b"))


def test_parameters_are_numbered():
    got = parse("INSERT INTO t VALUES (?, ?), (?, 1)")
    assert got.params == 3
    assert n.bind(got.statement, [7, 8, 9]).rows == ((n.Literal(7), n.Literal(8)), (n.Literal(9), n.Literal(1)))


@pytest.mark.parametrize(
    "text",
    ["", "SELECT", "SELECT FROM t", "SELECT a FROM", "SELECT a b c FROM t", "SELECT 1 WHERE 1", "SELECT 1 ORDER BY 1", "SELECT a FROM t LIMIT x", "SELECT a FROM t x y", "SELECT a < b < c FROM t", "CREATE TABLE t (key INT)", "CREATE TABLE t (a DATE)", "INSERT INTO t VALUES", "UPDATE t WHERE a = 1", "DELETE t", "DROP VIEW t", "SELECT a FROM t; SELECT 1", "SELECT a FROM t JOIN u"],
)
def test_errors(text):
    with pytest.raises(SqlSyntaxError) as e:
        parse(text)
    assert (e.value.code, e.value.sqlstate) == (1064, "42000")


def test_set_operation_takes_the_tail():
    got = parse("SELECT a FROM t UNION ALL SELECT b FROM u ORDER BY 1 LIMIT 3").statement
    assert (got.op, got.all, len(got.order), got.limit, got.right.order) == ("union", True, 1, n.Literal(3), ())


def test_definitions():
    t = parse("CREATE TABLE IF NOT EXISTS t (`key` INT PRIMARY KEY AUTO_INCREMENT, b VARCHAR(5) NOT NULL DEFAULT 'x', c JSON UNIQUE KEY NULL) ENGINE = memory").statement
    assert t.if_not_exists and t.engine == "memory"
    assert t.columns[0] == n.ColumnSpec("key", "int", None, False, True, True)
    assert t.columns[1] == n.ColumnSpec("b", "varchar", 5, False, False, False, n.Literal("x"))
    assert parse("DROP INDEX i ON t").statement == n.Drop("index", "i")
    assert parse("CREATE INDEX i ON t (a, b)").statement == n.CreateIndex("i", "t", ("a", "b"))
