"""Errors with the code and SQLSTATE that MySQL clients expect."""

from __future__ import annotations


class EngineError(Exception):
    code = 1047
    sqlstate = "HY000"


class SqlSyntaxError(EngineError):
    code, sqlstate = 1064, "42000"


class TableError(EngineError):
    code, sqlstate = 1050, "42S02"


class NoSuchTable(TableError):
    code = 1146

    def __init__(self, name: str) -> None:
        super().__init__(f"Table '{name}' doesn't exist")


class TableExists(TableError):
    def __init__(self, name: str) -> None:
        super().__init__(f"Table '{name}' already exists")


class DuplicateAlias(TableError):
    code = 1066

    def __init__(self, alias: str) -> None:
        super().__init__(f"Not unique table/alias: '{alias}'")


class ColumnError(EngineError):
    code, sqlstate = 1054, "42S22"


class UnknownColumn(ColumnError):
    def __init__(self, name: str, where: str = "field list") -> None:
        super().__init__(f"Unknown column '{name}' in '{where}'")


class AmbiguousColumn(ColumnError):
    def __init__(self, name: str, where: str = "field list") -> None:
        super().__init__(f"Column '{name}' in {where} is ambiguous")


class SqlTypeError(EngineError):
    pass


class TransactionError(EngineError):
    sqlstate = "40001"


class Conflict(TransactionError):
    """Another writer changed a table that this transaction also changed."""

    code = 1213


class ConstraintError(EngineError):
    pass
