"""Files as tables and tables as files."""

from __future__ import annotations

from concurrent.futures import Future

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Any format that Spark reads; JSON lines and CSV want a schema, else they are read twice."""
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format("json" if kind == "jsonl" else kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    df.write.options(**options).format("json" if kind == "jsonl" else kind).mode(mode).save(path)


def write_async(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options: str) -> Future[None]:
    """Start a write and go on; ``result()`` waits for it and raises what it raised."""
    done: Future[None] = Future()

    def work() -> None:
        try:
            write(df, path, kind, mode, **options)
            done.set_result(None)
        except BaseException as e:
            done.set_exception(e)

    InheritableThread(target=work, daemon=True, session=df.sparkSession).start()
    return done


def values(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A table of literal rows."""
    return spark.createDataFrame(rows, schema)
