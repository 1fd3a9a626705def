"""Workbook tabs as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_empty_rows(tab: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows with a value in any column besides ``keys``."""
    columns = [c for c in tab.columns if c not in (keys or [])]
    return tab.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in columns], F.lit(False)))


def filled_columns(tab: DataFrame, keys: list[str] | None = None) -> list[str]:
    """Columns with any value, found in one pass; ``keys`` stay."""
    columns = [c for c in tab.columns if c not in (keys or [])]
    if not columns:
        return list(keys or [])
    counts = tab.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return [c for c in tab.columns if c in (keys or []) or counts[f"n{columns.index(c)}"]]


def drop_empty_columns(tab: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return tab.select(*[f"`{c}`" for c in filled_columns(tab, keys)])


def clean_tab(tab: DataFrame, has_header: bool, keys: list[str] | None = None) -> DataFrame:
    """A header tab loses its empty rows and keeps empty columns; a layout tab loses both."""
    rows = drop_empty_rows(tab, keys)
    return rows if has_header else drop_empty_columns(rows, keys)


def is_empty(tab: DataFrame) -> bool:
    return not tab.columns or tab.isEmpty()


def numbered(tab: DataFrame, header_rows: int = 1) -> DataFrame:
    """``tab`` with ``row``, the 1-based sheet row of each record in the file's order.

    A record's number is its place in its partition after the records of earlier
    partitions, of which one count each is joined; no task sees all records.
    """
    placed = tab.withColumn("__id", F.monotonically_increasing_id())
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each partition of the file
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    joined = placed.withColumn("__part", part).join(before, "__part")
    return joined.select(*[joined[f"`{c}`"] for c in tab.columns], (F.col("__before") + at + header_rows + 1).alias("row"))
