"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of a hash of each row.  Only buckets
over the byte limit split, each on its next bit, until every shard fits.  The
split depths come from a histogram over hash prefixes, so the rows themselves
are never re-dealt level by level.

Defined results: a null text has no bytes; a null id hashes like an empty one;
rows with one id are told apart by their text; rows that are equal in both
share all bits, so they are dealt by number into shards that fit; a single row
over the limit has a shard of its own, marked ``oversized``; an empty table
gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

BITS = 60
#: Names the folders of written shards.
SHARD_COLUMN = "__shard"
#: Bits that a round looks at beyond those that even buckets would need.
MARGIN = 4


def row_hash(row_id: str | Column, text: str | Column) -> Column:
    """Leading 60 bits of an md5 over id and text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    row_id = F.coalesce((F.col(row_id) if isinstance(row_id, str) else row_id).cast("string"), F.lit(""))
    digest = F.md5(F.concat(row_id, F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def prefix(h: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def shard_name(bits: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(bits), depth, F.lit("0")))


def weight(df: DataFrame, columns: list[str]) -> Column:
    """Bytes of the columns of a row as they would be written as text."""
    total = F.lit(0).cast("bigint")
    for f in (df.schema[c] for c in columns):
        col = F.col(f"`{f.name}`")
        text = col if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(col) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else col.cast("string")
        total = total + F.coalesce(F.octet_length(text), F.lit(0))
    return total


def assign(df: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", weigh: list[str] | None = None) -> DataFrame:
    """``__id``, ``n_bytes``, ``shard`` (its bits), ``depth``, ``shard_bytes`` and ``oversized`` of every row; ``weigh`` names the columns whose bytes count, else the text's do."""
    return assigned(df, limit_bytes, id_col, text_col, weigh, False)


def write(df: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write whole rows as Parquet, each shard in a folder of its own under ``path``/shards, and their directory, which is returned: ``shard``, ``depth``, ``bytes``, ``n_rows``.

    Bytes of all columns count.  One task writes one shard, which fits the limit.
    """
    rows = cut(assigned(df, limit_bytes, id_col, text_col, df.columns, True))
    # the folder is named by the shard; the rows keep their columns, whatever these are called
    rows.select("row.*", F.concat(F.lit("s"), "shard").alias(SHARD_COLUMN)).repartition(SHARD_COLUMN).write.partitionBy(SHARD_COLUMN).parquet(f"{path}/shards")
    rows.groupBy("shard", "depth").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows")).write.parquet(f"{path}/directory")
    return df.sparkSession.read.parquet(f"{path}/directory")


def assigned(df: DataFrame, limit_bytes: int, id_col: str, text_col: str, weigh: list[str] | None, whole: bool) -> DataFrame:
    """``assign``; with ``whole``, each row itself stays beside as ``row``."""
    own, text = F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")
    kept = [F.struct("*").alias("row")] if whole else []
    also = ["row"] if whole else []
    rows = df.select(own, text, weight(df, weigh or [text_col]).alias("n_bytes"), *kept)
    rows = cut(rows.select("__id", "n_bytes", row_hash("__id", "__text").alias("h"), *also))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + MARGIN)
    done: list[DataFrame] = []
    left, above = rows, 0
    while True:
        cells = left.groupBy(prefix(F.col("h"), depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        levels = F.explode(F.sequence(F.lit(above), F.lit(depth)))
        sized = cells.select("cell", "bytes", levels.alias("depth")).withColumn("bits", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")))
        fits = sized.groupBy("depth", "bits").agg(F.sum("bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit_bytes)
        cell_of = sized.select("cell", "depth", "bits").join(fits, ["depth", "bits"]).groupBy("cell").agg(F.min(F.struct("depth", "bits", "shard_bytes")).alias("leaf"))
        placed = cut(left.join(cell_of, prefix(left["h"], depth) == cell_of["cell"], "left").select("__id", "n_bytes", "h", "leaf", *also))
        done.append(placed.filter(F.col("leaf").isNotNull()).select("__id", "n_bytes", shard_name(F.col("leaf.bits"), F.col("leaf.depth")).alias("shard"), F.col("leaf.depth").alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"), F.lit(False).alias("oversized"), *also))
        left = placed.filter(F.col("leaf").isNull()).select("__id", "n_bytes", "h", *also)
        if left.isEmpty():
            break
        if depth == BITS:
            done.append(numbered(left, limit_bytes))
            break
        # a bucket that nothing has split so far is looked at from its next bit on
        above, depth = depth + 1, min(BITS, depth + 12)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def numbered(left: DataFrame, limit_bytes: int) -> DataFrame:
    """Rows that share all bits, dealt into shards by number: counted within each partition, then offset by the partitions before."""
    left = cut(left.withColumn("p", F.spark_partition_id()).withColumn("n", F.row_number().over(Window.partitionBy("h", "p").orderBy(F.lit(1)))).repartition("h", "p"))
    before = left.groupBy("h", "p").agg(F.count(F.lit(1)).alias("c"), F.max("n_bytes").alias("most"))
    each = Window.partitionBy("h")
    before = before.select("h", "p", (F.sum("c").over(each.orderBy("p")) - F.col("c")).alias("offset"), F.max("most").over(each).alias("most"), F.sum("c").over(each).alias("all"))
    room = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest("most", F.lit(1))))
    k = F.floor((F.col("n") - 1 + F.col("offset")) / room).cast("bigint")
    held = F.least(room, F.col("all") - k * room)
    also = ["row"] if "row" in left.columns else []
    return left.join(before, ["h", "p"]).select("__id", "n_bytes", F.concat(shard_name(F.col("h"), F.lit(BITS)), F.lit("+"), k.cast("string")).alias("shard"), F.lit(BITS).alias("depth"), (held * F.col("most")).cast("bigint").alias("shard_bytes"), (F.col("most") > limit_bytes).alias("oversized"), *also)
