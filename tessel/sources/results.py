"""Results on their way to a client."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text: booleans as 1 and 0, JSON as its text, null as it is."""

    def text(f: T.StructField):  # noqa: ANN202
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            return col.cast("int").cast("string")
        return F.to_json(col) if isinstance(f.dataType, (T.VariantType, T.StructType, T.ArrayType, T.MapType)) else col.cast("string")

    places = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # names may repeat
    return places.select(*[text(f) for f in places.schema.fields]).toDF(*df.columns)


def text_rows(df: DataFrame) -> Iterator[tuple]:
    """Rows as text, partition by partition, so the driver holds one partition at most."""
    return map(tuple, as_text(df).toLocalIterator())


def typed_batches(df: DataFrame):  # noqa: ANN201
    """The whole result as an Arrow table, typed; for results that fit the driver."""
    return df.toArrow()
