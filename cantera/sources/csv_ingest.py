"""CSV files into typed tables: types are inferred in one pass over all rows, in any order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.lang.ast import ColumnDef, Index

INT, NUMBER, POINT = r"^-?[0-9]+$", r"^-?[0-9]*\.?[0-9]+$|^-?[0-9]+\.$", r"^\(.*,.*\)$"
LEAST_INT, MOST_INT = -(2**31), 2**31 - 1


class EmptyFile(ValueError):
    """The CSV file has no rows."""


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes over a line break: then some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).agg(F.bool_or(quotes % 2 == 1)).first()[0])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed strings; null and empty cells are ''. Files are read in splits, but for those with line breaks in cells, which are a task each."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=has_line_breaks(spark, path), encoding="UTF-8", mode="PERMISSIVE")
    return raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.strip()) for c in raw.columns])


def infer(df: DataFrame, key: str, indexes: dict[str, Index]) -> tuple[list[ColumnDef], int]:
    """The columns' types, and how many rows there are: the narrowest of INT, FLOAT, VARCHAR that fits every non-empty cell, ARRAY when all are '(…,…)'; a column without any is VARCHAR[1]."""

    def every(c: str, pattern: str) -> Column:
        cell = F.col(f"`{c}`")
        return F.coalesce(F.bool_and(F.when(cell != "", cell.rlike(pattern))), F.lit(False))

    measures = [F.count("*")] + [m for c in df.columns for m in (every(c, INT), every(c, NUMBER), every(c, POINT), F.max(F.length(f"`{c}`")))]
    rows, *found = df.agg(*measures).first()
    if not rows:
        raise EmptyFile("the file has no rows")
    columns = []
    for i, c in enumerate(df.columns):
        whole, number, point, longest = found[4 * i : 4 * i + 4]
        index = indexes.get(c)
        forced = dict(index.options).get("type", "").upper() if index else ""
        common = {"key": c == key, "index": index}
        if forced in ("IMAGE", "AUDIO"):
            columns.append(ColumnDef(c, forced, **common))
        elif point:
            columns.append(ColumnDef(c, "ARRAY", 2, "FLOAT", **common))
        elif whole or number:
            columns.append(ColumnDef(c, "INT" if whole else "FLOAT", **common))
        else:
            columns.append(ColumnDef(c, "VARCHAR", max(1, int(1.1 * (longest or 0))), **common))
    return columns, rows


def typed(df: DataFrame, columns: list[ColumnDef]) -> DataFrame:
    """Cells by type: an empty one is 0, 0.0 or ''; rows with an INT out of range are left out whole; strings are cut to their size."""
    fits, out = F.lit(True), []
    for c in columns:
        cell = F.col(f"`{c.name}`")
        if c.type == "INT":
            value = F.when(cell == "", F.lit(0)).otherwise(cell.try_cast("decimal(38,0)"))
            fits = fits & F.coalesce(value.between(LEAST_INT, MOST_INT), F.lit(False))
            out.append(value.try_cast("int").alias(c.name))
        elif c.type == "FLOAT":
            out.append(F.when(cell == "", 0.0).otherwise(cell.try_cast("double")).cast("float").alias(c.name))
        elif c.type == "ARRAY":
            parts = F.split(F.regexp_replace(cell, r"[()\s]", ""), ",")
            numbers = F.transform(parts, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
            out.append(F.when(F.size(parts) == c.size, numbers).otherwise(F.array_repeat(F.lit(0.0), c.size)).alias(c.name))
        elif c.type == "VARCHAR":
            out.append(F.rtrim(F.substring(cell, 1, c.size)).alias(c.name))
        else:
            out.append(cell.alias(c.name))
    return df.filter(fits).select(*out)
