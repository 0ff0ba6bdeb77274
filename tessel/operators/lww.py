"""Last-writer-wins merge of changes.

A change is ``row_id``, ``op`` (upsert or delete), ``ts`` (a Lamport time) and
the columns of the row.  Of a row's changes the one with the greatest time
counts; of equal times the one that arrived first, so merging again, in
another order or in other portions gives the same.  A deleted row leaves a
tombstone, which a later upsert overrides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID, OP, TS, ARRIVAL = "row_id", "op", "ts", "arrival"
DELETE, UPSERT = "delete", "upsert"


def winners(changes: DataFrame, id_col: str = ID, ts_col: str = TS, arrival_col: str | list[str] | None = ARRIVAL) -> DataFrame:
    """The change that counts of each row: one aggregation with partial results, so a hot row costs one record a task."""
    rest = [c for c in changes.columns if c != id_col]
    arrivals = [arrival_col] if isinstance(arrival_col, str) else arrival_col or []
    rank = F.struct(F.col(ts_col), *[-F.col(c) for c in arrivals])
    return changes.groupBy(id_col).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("__w")).select(id_col, "__w.*")


def live(state: DataFrame, op_col: str = OP) -> DataFrame:
    """The rows of a state: what isn't a tombstone."""
    return state.filter(F.col(op_col) != DELETE)


def merge(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after changes; a change as old as what the state has for its row is too late."""
    first = F.lit(-1).cast("bigint")
    both = state.withColumn(ARRIVAL, first).unionByName(changes)
    return winners(both).drop(ARRIVAL)


def exploded(deltas: DataFrame) -> DataFrame:
    """Changes of deltas ``(ts, operations array<struct<op,row_id,...>>)``; the place within a delta is the arrival."""
    return deltas.select("ts", F.posexplode("operations").alias(ARRIVAL, "o")).select("ts", F.col(ARRIVAL).cast("bigint").alias(ARRIVAL), "o.*")
