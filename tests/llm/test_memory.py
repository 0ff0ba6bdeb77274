from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import functions as F

from tessel.llm import queries, sentencepieces
from tessel.llm.common import keyed_text, map_slices


def test_rows_go_to_workers_in_small_batches(spark):
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:  # a slice shares the buffers of its batch
        return pa.RecordBatch.from_arrays([pa.array([piece.num_rows]), pa.array([sum(b.size for b in piece.column("__text").buffers() if b)])], ["n", "held"])

    got = map_slices(keyed_text(docs, "doc_id", "text"), run, "n bigint, held bigint").collect()
    assert sum(r.n for r in got) == 3000
    assert max(r.held for r in got) < 9 << 20


def test_workers_drop_the_encoder_of_an_operator_that_is_over(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(400).repartition(8)
    sentencepieces.encode(docs, sentencepieces.load(queries.VOCABULARY)).collect()

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Encoder" and hasattr(x, "tokens") for x in gc.get_objects())])], ["n"])

    assert {r.n for r in map_slices(keyed_text(docs, "doc_id", "text"), run, "n bigint").collect()} == {0}
