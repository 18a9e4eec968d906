"""How results are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def array_text(column: str) -> Column:
    """'(a, b)' of an array; null stays null."""
    return F.when(F.col(column).isNotNull(), F.concat(F.lit("("), F.array_join(F.transform(column, lambda x: x.cast("string")), ", "), F.lit(")")))


def arrays_as_text(df: DataFrame) -> DataFrame:
    return df.select([array_text(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema])


def similarity_percent(distance: Column) -> Column:
    """A cosine distance as a percentage with 4 decimals, 100 above 99.9999 and 0 below 0.0001; null stays null."""
    p = (1 - distance) * 100
    return F.when(p > 99.9999, 100.0).when(p < 0.0001, 0.0).otherwise(F.round(p, 4))


def percent(distance: float | None) -> float | None:
    """similarity_percent of one value."""
    if distance is None:
        return None
    p = (1 - distance) * 100
    return 100.0 if p > 99.9999 else 0.0 if p < 0.0001 else round(p, 4)
