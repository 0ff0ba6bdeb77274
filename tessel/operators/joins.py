"""Join helpers that the planner can't choose by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a side may have at most to be sent to every executor.
BROADCAST_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's upper estimate of a plan's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if its estimated size allows, else as it is."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, extra: Column | None = None) -> DataFrame:
    """Rows with ``low <= point < high``: intervals are dealt into bins of ``width``, so the join is by bin and not all against all."""
    bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    cond = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    a, b = left.withColumn("__bin", F.floor(F.col(point) / width)), right.filter(F.col(low) < F.col(high)).withColumn("__bin", bins)
    return a.join(b, "__bin").filter(cond if extra is None else cond & extra).drop("__bin")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Each left row with the last right values at or before it: both sides in one sorted stream per key, no pairs."""
    from pyspark.sql import Window

    rows = left.select("*", F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    other = right.select(F.col(by), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    both = rows.unionByName(other, allowMissingColumns=True)
    before = Window.partitionBy(by).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__v", F.last("__v", ignorenulls=True).over(before)).filter("__side = 1")
    return out.select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])
