"""Last-writer-wins merge of a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import lww


def read_changes(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """Change files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def current(changes: DataFrame, id_col: str = lww.ID, ts_col: str = lww.TS, arrival_col: str | None = lww.ARRIVAL) -> DataFrame:
    """The state as a streaming aggregation (output mode update or complete); it keeps one record a row, tombstones included."""
    return lww.winners(changes, id_col, ts_col, arrival_col)


# How often changes go to the table, by what matters more.
FLUSH = {"default": "1000 milliseconds", "throughput": "5000 milliseconds", "latency": "500 milliseconds"}


def flush(preset: str = "default") -> dict[str, str]:
    """Trigger of a stream that flushes in the background, again and again."""
    return {"processingTime": FLUSH[preset]}


def merge_into(changes: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Merge each batch into a table, by default all there is, or as ``flush`` says.  A batch that is sent again changes nothing, so the result is as of exactly one delivery."""
    writer = changes.writeStream.foreachBatch(lambda df, _: merge(df)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
