"""Stores: how a table's segments are read and changed.

A segment is a folder of Parquet files that never changes.  INSERT adds one;
UPDATE and DELETE of a durable table rewrite only the segments that hold rows they
touch, those of a memory table add one with the rows they change.  Which
segments are current is in the catalog, so a change is visible when that is.
"""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConstraintError
from ..operators import lww
from ..operators.joins import small
from .catalog import Catalog, Table
from .files import Files

ROW_ID, SEGMENT, TS, OP, ARRIVED = "_row_id", "_row_segment", "_row_ts", "_row_op", "_row_arrival"
ORDER = "_row_order"
#: The arrival of a change that gives a null for it: after all others of its time.
LAST = (1 << 63) - 1


class Store(ABC):
    """What a table can do, whatever keeps it."""

    transactional = True

    def __init__(self, spark: SparkSession, warehouse: str) -> None:
        self.spark, self.warehouse, self.files = spark, warehouse, Files(spark)

    # segments

    def new_segment(self, table: Table, df: DataFrame) -> str:
        """Rows in files of their own, sorted by the table's layout, with a Bloom filter over its first column, so a lookup skips row groups."""
        name = f"{table.name}/{uuid.uuid4().hex}"
        if not table.layout:
            df.write.parquet(f"{self.warehouse}/{name}")
            return name
        by = [F.col(f"`{x}`") for x in table.layout]
        df.sortWithinPartitions(*by).write.option(f"parquet.bloom.filter.enabled#{table.layout[0]}", "true").parquet(f"{self.warehouse}/{name}")
        return name

    def stored(self, table: Table) -> T.StructType:
        return T.StructType([T.StructField(ROW_ID, T.LongType()), *table.schema().fields])

    def segments(self, table: Table, names: list[str] | None = None) -> DataFrame:
        names = table.segments if names is None else names
        if not names:
            return self.spark.createDataFrame([], self.stored(table)).withColumn(SEGMENT, F.lit(""))
        df = self.spark.read.schema(self.stored(table)).parquet(*[f"{self.warehouse}/{x}" for x in names])
        folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
        return df.withColumn(SEGMENT, F.concat(F.lit(f"{table.name}/"), folder))

    @abstractmethod
    def rows(self, table: Table) -> DataFrame:
        """Current rows: hidden columns and those of the table, as stored."""

    @abstractmethod
    def insert(self, catalog: Catalog, table: Table, rows: DataFrame) -> str:
        """Add rows; the segment that holds them."""

    @abstractmethod
    def update(self, catalog: Catalog, table: Table, cond: Column, sets: dict[str, Column]) -> int: ...

    @abstractmethod
    def delete(self, catalog: Catalog, table: Table, cond: Column) -> int: ...

    def truncate(self, table: Table) -> None:
        table.segments, table.next_auto = [], 1

    # shared

    def visible(self, table: Table) -> DataFrame:
        """What a query sees: JSON parsed, the row's id hidden beside."""
        df = self.rows(table)
        return df.select(F.col(ROW_ID), *[F.try_parse_json(F.col(f"`{c.name}`")).alias(c.name) if c.kind == "json" else F.col(f"`{c.name}`") for c in table.columns])

    def check(self, table: Table, rows: DataFrame) -> None:
        """NOT NULL of all columns in one pass."""
        strict = [c.name for c in table.columns if not c.nullable]
        if strict:
            broken = rows.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in strict]).first()
            for c in strict:
                if broken[c]:
                    raise ConstraintError(f"Column '{c}' cannot be NULL")

    def check_keys(self, table: Table, new: DataFrame, others: DataFrame | None) -> None:
        """No two rows with one primary key; a key with a null in it is never a duplicate."""
        if not table.keys:
            return
        keys = [F.col(f"`{k}`") for k in table.keys]
        named = new.select(*keys).dropna()
        twice = named.groupBy(*keys).count().filter("count > 1").select(*keys)
        if others is not None:
            # the table's keys stay where they are if the new ones are few
            twice = twice.union(others.select(*keys).join(small(named.distinct()), table.keys, "left_semi").select(*keys))
        row = twice.first()
        if row is not None:
            raise ConstraintError(f"Duplicate entry '{'-'.join(map(str, row))}' for key 'PRIMARY'")


class DurableStore(Store):
    """Copy-on-write segments, primary keys, transactions."""

    def rows(self, table: Table) -> DataFrame:
        return self.segments(table)

    #: Segments of a table from which small ones are put together, and bytes up to which one is small.
    COMPACT_AT, SMALL_BYTES = 32, 32 << 20

    def insert(self, catalog: Catalog, table: Table, rows: DataFrame) -> str:
        self.check(table, rows)
        self.check_keys(table, rows, self.rows(table) if table.segments else None)
        name = self.new_segment(table, rows)
        table.segments.append(name)
        if len(table.segments) >= self.COMPACT_AT:
            self.compact(table)
        return name

    def compact(self, table: Table) -> None:
        """Put a table's small segments together in one, so many small inserts don't leave as many files to open."""
        few = [x for x in table.segments if self.files.bytes(f"{self.warehouse}/{x}") <= self.SMALL_BYTES]
        if len(few) > 1:
            self.replace(table, few, self.segments(table, few).coalesce(max(1, len(few) // 32)))

    def touched(self, table: Table, cond: Column) -> tuple[list[str], int]:
        """Segments with rows that the condition picks, and how many rows."""
        found = self.rows(table).filter(cond).groupBy(SEGMENT).count().collect()  # as many rows as segments
        return [r[0] for r in found], sum(r[1] for r in found)

    def replace(self, table: Table, names: list[str], rows: DataFrame) -> None:
        new = self.new_segment(table, rows.drop(SEGMENT))
        table.segments = [x for x in table.segments if x not in names] + [new]

    def update(self, catalog: Catalog, table: Table, cond: Column, sets: dict[str, Column]) -> int:
        names, n = self.touched(table, cond)
        if not n:
            return 0
        old = self.segments(table, names)
        new = old.withColumn("_row_hit", cond).withColumns({c: F.when(cond, e).otherwise(F.col(f"`{c}`")) for c, e in sets.items()})
        self.check(table, new.filter("_row_hit"))
        if set(table.keys) & set(sets):
            rest = self.segments(table, [x for x in table.segments if x not in names])
            self.check_keys(table, new, rest)
        self.replace(table, names, new.drop("_row_hit"))
        return n

    def delete(self, catalog: Catalog, table: Table, cond: Column) -> int:
        names, n = self.touched(table, cond)
        if n:
            self.replace(table, names, self.segments(table, names).filter(~F.coalesce(cond, F.lit(False))))
        return n


class ChangeStore(Store):
    """Rows by last writer: every change is stamped by the table's clock and merged; keys aren't checked, transactions don't undo it.

    A change is kept with its arrival, so of equal times the first to arrive counts whichever
    was merged first; statements, and changes that come without an arrival, have 0.  Of equal
    arrivals too, what the table has stays.

    INSERT adds a segment of new rows.  UPDATE, DELETE and changes of other replicas
    add a small one that overrides rows, merged as the table is read.  Many of these
    are folded into one, and into the table's once they hold a good part of it, so a
    row is rewritten a few times and not with every statement.
    """

    transactional = False
    #: Overriding segments that are folded into one, and how much smaller than the table that may be before it is folded in.
    FOLD_AT, FOLD_SHARE = 8, 4

    def stored(self, table: Table) -> T.StructType:
        return T.StructType([*super().stored(table).fields, T.StructField(TS, T.LongType()), T.StructField(OP, T.StringType()), T.StructField(ARRIVED, T.LongType())])

    def segments(self, table: Table, names: list[str] | None = None) -> DataFrame:
        """Segments of before arrivals were kept hold none."""
        return super().segments(table, names).withColumn(ARRIVED, F.coalesce(ARRIVED, F.lit(0).cast("bigint")))

    def changed(self, table: Table, names: list[str]) -> DataFrame:
        """The change that counts of each row in overriding segments; of equal times and arrivals that of the earlier segment."""
        order = F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(name), F.lit(k).cast("bigint"))])
        return lww.winners(self.segments(table, names).withColumn(ORDER, order[F.col(SEGMENT)]), ROW_ID, TS, [ARRIVED, ORDER]).drop(ORDER)

    def current(self, table: Table) -> DataFrame:
        """Rows and tombstones: rows that nothing overrides as they are, the others merged."""
        base = self.segments(table)
        if not table.deltas:
            return base
        over = self.changed(table, table.deltas)
        ids = small(over.select(ROW_ID))
        first = F.lit(-1).cast("bigint")
        met = base.join(ids, ROW_ID, "left_semi").withColumn(ORDER, first).unionByName(over.withColumn(ORDER, F.lit(0).cast("bigint")))
        merged = lww.winners(met, ROW_ID, TS, [ARRIVED, ORDER]).drop(ORDER)
        return base.join(ids, ROW_ID, "left_anti").unionByName(merged)

    def rows(self, table: Table) -> DataFrame:
        return lww.live(self.current(table), OP)

    def changes(self, table: Table, since: int = 0) -> DataFrame:
        """What happened after a time of the clock, for another replica to merge."""
        renamed = {ROW_ID: lww.ID, TS: lww.TS, OP: lww.OP, ARRIVED: lww.ARRIVAL}
        return self.current(table).filter(F.col(TS) > since).drop(SEGMENT).withColumnsRenamed(renamed)

    def stamp(self, table: Table) -> dict[str, Column]:
        return {TS: F.lit(table.clock).cast("bigint"), ARRIVED: F.lit(0).cast("bigint")}

    def insert(self, catalog: Catalog, table: Table, rows: DataFrame) -> str:
        self.check(table, rows)
        table.clock += 1
        table.segments.append(self.new_segment(table, rows.withColumns(self.stamp(table) | {OP: F.lit(lww.UPSERT)})))
        return table.segments[-1]

    def override(self, table: Table, changed: DataFrame) -> int:
        """Add changed rows as a segment of their own; how many they are."""
        name = self.new_segment(table, changed.select([f.name for f in self.stored(table)]))
        new = self.segments(table, [name])
        n = new.count()
        if n:
            self.check(table, new.filter(F.col(OP) != lww.DELETE))
            table.deltas.append(name)
            self.fold(table)
        return n

    def fold(self, table: Table) -> None:
        if len(table.deltas) < self.FOLD_AT:
            return
        own = [f.name for f in self.stored(table)]
        together = self.new_segment(table, self.changed(table, table.deltas).select(own))
        table.deltas = [together]
        if self.segments(table, [together]).count() * self.FOLD_SHARE >= self.segments(table).count():
            table.segments, table.deltas = [self.new_segment(table, self.current(table).select(own))], []

    def update(self, catalog: Catalog, table: Table, cond: Column, sets: dict[str, Column]) -> int:
        table.clock += 1
        return self.override(table, self.rows(table).filter(cond).withColumns(sets | self.stamp(table)))

    def delete(self, catalog: Catalog, table: Table, cond: Column) -> int:
        table.clock += 1
        return self.override(table, self.rows(table).filter(cond).withColumns(self.stamp(table) | {OP: F.lit(lww.DELETE)}))

    def truncate(self, table: Table) -> None:
        super().truncate(table)
        table.deltas = []

    def merge(self, catalog: Catalog, table: Table, changes: DataFrame) -> None:
        """Merge another replica's changes (``row_id``, ``op``, ``ts``, ``arrival`` and the table's columns)."""
        arrival = F.coalesce(F.col(lww.ARRIVAL).cast("bigint"), F.lit(LAST)) if lww.ARRIVAL in changes.columns else F.lit(0).cast("bigint")
        changes = changes.withColumn(lww.ARRIVAL, arrival)
        new = lww.winners(changes.select(lww.ID, *[F.col(f"`{c.name}`") for c in table.columns], lww.TS, lww.OP, lww.ARRIVAL))
        name = self.new_segment(table, new.withColumnsRenamed({lww.ID: ROW_ID, lww.TS: TS, lww.OP: OP, lww.ARRIVAL: ARRIVED}).select([f.name for f in self.stored(table)]))
        top = self.segments(table, [name]).agg(F.max(TS), F.max(ROW_ID)).first()
        if top[1] is not None:
            table.deltas.append(name)
            table.clock = max(table.clock, top[0] or 0)
            catalog.next_row = max(catalog.next_row, top[1] + 1)
            self.fold(table)


def placed(df: DataFrame, by: str) -> DataFrame:
    """Rows in the order of ``by``, each with its partition and a number that rises within it; write it before ``numbered``."""
    ranged = df.repartitionByRange(F.col(by)).sortWithinPartitions(by)
    return ranged.withColumn("_row_part", F.spark_partition_id()).withColumn("_row_pos", F.monotonically_increasing_id())


def numbered(part: DataFrame, first: int) -> DataFrame:
    """``_row_id`` from ``first`` upwards without gaps: numbers within partitions, offset by the sizes of those before."""
    counts = part.groupBy("_row_part").agg(F.count(F.lit(1)).alias("_row_n"), F.min("_row_pos").alias("_row_min"))
    # one row a partition
    offsets = counts.withColumn("_row_before", F.sum("_row_n").over(Window.orderBy("_row_part").rowsBetween(Window.unboundedPreceding, -1)))
    joined = part.join(F.broadcast(offsets.drop("_row_n")), "_row_part")
    return joined.withColumn(ROW_ID, F.lit(first) + F.coalesce("_row_before", F.lit(0)) + F.col("_row_pos") - F.col("_row_min")).drop("_row_part", "_row_pos", "_row_min", "_row_before")
