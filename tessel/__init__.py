"""A SQL engine with a compact MySQL-flavoured dialect, on Spark."""
