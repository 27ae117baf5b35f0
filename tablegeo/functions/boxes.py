"""The boxes that a table's cells were read from, carried along with their rows.

``BOXES`` is a column of entries (column name, boxes of its cell in order); a column without an entry has none.  A box
is named by its page's keys and item_index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegeo.schema import BOXES


def has_boxes(df: DataFrame) -> bool:
    return BOXES in df.columns


def boxes_of(entries: Column, name: str) -> Column:
    """The boxes of a column's cell, maybe none."""
    return F.flatten(F.transform(F.filter(entries, lambda e: e["column"] == name), lambda e: e["boxes"]))


def without(entries: Column, *names: str) -> Column:
    return F.filter(entries, lambda e: ~e["column"].isin(*names))


def entry(name: str, boxes: Column) -> Column:
    return F.array(F.struct(F.lit(name).alias("column"), boxes.alias("boxes")))


def replaced(entries: Column, gone: list[str], new: dict[str, Column]) -> Column:
    """Entries without those of some columns, and with new ones."""
    return F.concat(without(entries, *gone, *new), *(entry(n, b) for n, b in new.items()))


def with_entries(df: DataFrame, change) -> DataFrame:
    """``change`` of the entries, where the table has them."""
    return df.withColumn(BOXES, change(F.col(BOXES))) if has_boxes(df) else df
