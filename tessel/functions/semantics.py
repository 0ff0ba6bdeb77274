"""What operators mean in the dialect, as plain Column expressions.

All of it stays within code generation; columns are wrapped only where operand
types ask for it, so comparisons of equal types still reach the scan.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of value: what a comparison between two columns needs to know of them.
INT, FLOAT, TEXT, BOOL, JSON, NULL, OTHER = "int", "float", "text", "bool", "json", "null", "other"
NUMBERS = {INT, FLOAT}

WHOLE = r"^[+-]?[0-9]+$"
NUMBER = r"(?i)^[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)$"

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
MIRROR = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, T.VariantType):
        return JSON
    return NULL if isinstance(data_type, T.NullType) else OTHER


def unless_null(a: Column, b: Column, value: Column | bool) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(value if isinstance(value, Column) else F.lit(value))


def text_as_number(text: Column, kind: str) -> Column:
    """The number that the whole text spells, without surrounding blanks; null where it spells none."""
    shape, target = (WHOLE, "bigint") if kind == INT else (NUMBER, "double")
    return F.when(text.rlike(shape), text.try_cast(target))


def compare(op: str, a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
    """Three-valued comparison.  A text meets a number as the number it spells; one that spells none is unequal to, and greater than, any number."""
    if NULL in (a_kind, b_kind):
        return F.lit(None).cast("boolean")
    if a_kind == b_kind == JSON:
        return COMPARE[op](F.to_json(a), F.to_json(b)) if op in ("=", "<>") else unless_null(a, b, False)
    if a_kind == b_kind or {a_kind, b_kind} <= NUMBERS or OTHER in (a_kind, b_kind):
        return COMPARE[op](a, b)
    if a_kind in NUMBERS and b_kind == TEXT:
        return compare(MIRROR[op], b, b_kind, a, a_kind)
    if a_kind == TEXT and b_kind in NUMBERS:
        return unless_null(a, b, F.coalesce(COMPARE[op](text_as_number(a, b_kind), b), F.lit(op in ("<>", ">", ">="))))
    return unless_null(a, b, op == "<>")


def like_ci(text: Column, pattern: Column) -> Column:
    """LIKE with ``%`` and ``_``, blind to the case of ASCII letters only, without an escape character."""
    fold = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.like(fold(text), F.replace(fold(pattern), F.lit("\\"), F.lit("\\\\")))


def safe_divide(a: Column, b: Column) -> Column:
    """Division in doubles; by zero it gives NaN."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, F.lit(float("nan"))).otherwise(a / b)


def truth(c: Column, kind: str) -> Column:
    """Whether a row passes: booleans as they are; numbers but zero; texts but the empty one; any JSON or other value."""
    if kind == BOOL:
        return c
    if kind == NULL:
        return F.lit(False)
    if kind in NUMBERS:
        return c != 0
    return c != "" if kind == TEXT else c.isNotNull()


def as_variant(c: Column, kind: str) -> Column:
    """JSON values as they are, texts parsed; anything else, and what doesn't parse, is null."""
    if kind == JSON:
        return c
    return F.try_parse_json(c) if kind == TEXT else F.lit(None).cast("variant")


def paths(key: str) -> list[str]:
    """A key names a field; one in digits may also be the place in an array."""
    quoted = key.replace("\\", "\\\\").replace('"', '\\"')
    return [f'$["{quoted}"]', *([f"$[{key}]"] if key.isdigit() else [])]


def json_get(variant: Column, key: str) -> Column:
    """``->``: the value at a key, as JSON; null where there is none."""
    return F.coalesce(*[F.try_variant_get(variant, p, "variant") for p in paths(key)])


def json_text(variant: Column, key: str) -> Column:
    """``->>``: the value at a key as text; JSON's null is null."""
    return F.coalesce(*[F.try_variant_get(variant, p, "string") for p in paths(key)])
