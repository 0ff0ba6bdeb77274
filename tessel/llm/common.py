"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker handles at a time; bounds its memory.
SLICE_BYTES = 2 << 20

#: Bytes of rows that go to a Python worker at a time, unless the session names a limit; bounds what the JVM holds for it beside its heap.
BATCH_BYTES = 4 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Upper-case ASCII to lower case, for ``bytes.translate``.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all of {master} shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessel-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, kept in the shared checkpoint folder so that a lost executor costs no recomputation."""
    folder = checkpoint_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared checkpoint folder: compressed, and later steps read only the columns they use.

    Any column names will do, as the file numbers them.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/tessel-{uuid.uuid4().hex}"
    df.toDF(*[f"c{k}" for k in range(len(df.columns))]).write.parquet(folder)
    return df.sparkSession.read.parquet(folder).toDF(*df.columns)


def tidy(spark: SparkSession) -> None:
    """Give back what the driver no longer uses: Arrow's free memory, and garbage of plans and results, for which the JVM would rather grow.

    Spark's cleaner then also drops shuffles, broadcasts and checkpoints that nothing refers to.
    """
    gc.collect()  # references into the JVM go first
    pa.default_memory_pool().release_unused()
    spark._jvm.java.lang.System.gc()


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of ``BATCH_BYTES``; a session that names a limit of its own keeps it."""
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


#: What a Python worker keeps from one task to the next, for the operator it last ran.
KEPT: dict[Any, Any] = {}


def forget() -> None:
    """Drop what an operator kept; a function that is pickled by value reaches the worker's own ``KEPT`` only through one that isn't."""
    KEPT.clear()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def spare() -> None:
    """Give back the memory that a Python worker no longer uses: it lives on, and what is free in it counts as the executor's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: Ids that may go to every executor (some 16 bytes each, keys of rows some 40); a longer list meets the rows through a shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(df: DataFrame, ids: DataFrame, id_col: str, limit: int | None = None) -> DataFrame:
    """Rows of ``df`` whose id isn't in the only column of ``ids`` (distinct); null counts as an id.

    A short list is broadcast, so the texts stay where they are.
    """
    ids = cut(ids.toDF("__gone"))
    if ids.count() <= (BROADCAST_IDS if limit is None else limit):
        ids = F.broadcast(ids)
    return df.join(ids, df[f"`{id_col}`"].eqNullSafe(ids["__gone"]), "left_anti")


def by_row(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key``, ``text`` and ``row`` of every row; only rows with the same id and text share a key, and keys order by id, null last."""
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return df.select(F.struct(own.isNull().alias("last"), own.alias("id"), F.xxhash64(text).alias("hash")).alias("key"), text.alias("text"), F.struct("*").alias("row"))


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``__id`` and ``__text``, so other columns of ``df`` can have any name."""
    return df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in consecutive pieces of about ``limit`` bytes of text; a longer text makes a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, text: str = "__text", keeps: bool = False) -> DataFrame:
    """Apply ``fn`` to slices of each partition, batch by batch; no shuffle, memory bounded by the slice.

    What an operator has put into ``KEPT`` stays for its next task only if it ``keeps``.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            for piece in slices(batches, text):
                yield fn(piece)
        finally:
            spare()

    return df.mapInArrow(run, schema)


def crc_fold(id_col: str | Column) -> Column:
    """Fold of a document: crc32 of its id as text, modulo 3; null ids fall into fold 0."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(3)), F.lit(0))


def without_spans(text: Column, spans: Column, instead: str) -> Column:
    """A text with each of its sorted, disjoint spans (``start``, ``end`` in code points) replaced."""
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda c: c["end"]))
    ends = F.concat(F.transform(spans, lambda c: c["start"]), F.array(F.length(text)))
    between = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda p: F.substring(text, p["b"] + 1, p["e"] - p["b"]))
    return F.array_join(between, instead)
