"""Reading page tables, cells and their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegeo.functions.text import text_of
from tablegeo.schema import PAGE, data_columns, on_page, page_keys


def page_slice(table: DataFrame, page: int | tuple[str, int]) -> DataFrame:
    """The rows of one page; of many documents, ``page`` is (doc_key, page_number)."""
    return table.filter(on_page(table, page)).drop(*PAGE)


def cell_lookup(table: DataFrame, cells: DataFrame) -> DataFrame:
    """The long table with each cell's hull and sources, by document, page, row and column."""
    keys = page_keys(table)
    found = cells.select(*keys, F.col("row_index").alias("row_number"), "col_index", "x0", "y0", "x1", "y1", "source_item_indexes")
    return table.join(found, [*keys, "row_number", "col_index"], "left")


def lineage_items(cells: DataFrame, row_number: int | None = None, col_index: int | None = None) -> DataFrame:
    """(page, item_index): the boxes behind a row, a column, a cell or everything."""
    if row_number is not None:
        cells = cells.filter(F.col("row_index") == row_number)
    if col_index is not None:
        cells = cells.filter(F.col("col_index") == col_index)
    return cells.select(*PAGE, F.explode("source_item_indexes").alias("item_index")).distinct()


def workspace_payload(table: DataFrame, cells: DataFrame, items: DataFrame) -> DataFrame:
    """(page, part, position, payload): what an editor shows, as JSON lines: rows (null as empty
    text), cells and items, and the last row number.  A cell without boxes has a hull of nulls, not none."""
    names, keys = data_columns(table), page_keys(table)
    json = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload")
    rows = table.select(*keys, F.lit("row").alias("part"), F.col("row_number").alias("position"), json("row_number", *(text_of(F.col(c)).alias(c) for c in names)))
    boxes = items.select(*keys, F.lit("item").alias("part"), F.col("item_index").alias("position"), json("item_index", "text", "confidence", "x0", "y0", "x1", "y1"))
    found = cells.select(*keys, F.lit("cell").alias("part"), (F.col("row_index") * 1000 + F.col("col_index")).alias("position"), json("row_index", "col_index", "text", "x0", "y0", "x1", "y1", "source_item_indexes"))
    last = table.groupBy(*keys).agg(F.max("row_number").alias("n")).select(*keys, F.lit("max_row").alias("part"), F.lit(0).alias("position"), F.col("n").cast("string").alias("payload"))
    return rows.unionByName(found).unionByName(boxes).unionByName(last)


def preview(table: DataFrame, rows: int = 20) -> DataFrame:
    return table.orderBy(*page_keys(table), "row_number").limit(rows)


def table_metrics(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(data_columns(table))))
