"""Splits along a guide after other corrections.

``traced`` adds to a page table which boxes each cell was read from (``functions.boxes``).  All corrections carry that
along: merged cells and rows have the boxes of all, a moved cell's boxes go with it, inserted rows and columns have
none, and a split along a guide deals them out.  So a later guide meets the boxes of what a cell holds now, wherever it
stands; without ``traced``, guides look cells up by their present position, as if nothing had been inserted, moved or
deleted.  Typing into a cell keeps its boxes, and a split by a delimiter leaves them with both parts, as nothing tells
which characters belong to which box.

A cell without boxes keeps its text on the left or above.  Boxes that ``items`` does not have count as gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegeo.functions.boxes import boxes_of, has_boxes, replaced
from tablegeo.functions.geometry import center_x, center_y
from tablegeo.functions.text import strip_ws, text_of
from tablegeo.operators.edits import Page, normalize_row_numbers
from tablegeo.schema import BOXES, data_columns, on_page, page_keys


def traced(table: DataFrame, cells: DataFrame) -> DataFrame:
    """A page table as it was extracted, with the boxes of its cells; its columns are the cells' in order."""
    keys = page_keys(table)
    box = F.transform("source_item_indexes", lambda i: F.struct(*(F.col(k).alias(k) for k in keys), i.alias("item_index")))
    rows = cells.groupBy(*keys, F.col("row_index").alias("row_number")).agg(F.collect_list(F.struct("col_index", box.alias("boxes"))).alias("_cells"))
    joined = table.join(rows, [*keys, "row_number"], "left")
    of = lambda i: F.flatten(F.transform(F.filter("_cells", lambda c: c["col_index"] == i), lambda c: c["boxes"]))
    entries = F.array(*(F.struct(F.lit(n).alias("column"), of(i).alias("boxes")) for i, n in enumerate(data_columns(table), start=1)))
    nothing = F.filter(entries, lambda e: F.lit(False))
    return joined.withColumn(BOXES, F.when(F.col("_cells").isNull(), nothing).otherwise(entries)).select(*table.columns, BOXES)


def sides(table: DataFrame, items: DataFrame, axis: str, guide: float, columns: list[str] | None = None) -> DataFrame:
    """(page, row_number, column, n_before, n_after, before, after, boxes_before, boxes_after) of each cell that has
    boxes: those with their center on or before the guide, and the others."""
    if not has_boxes(table):
        raise ValueError("the table has no boxes; see traced")
    keys = page_keys(table)
    held = F.col(BOXES) if columns is None else F.filter(BOXES, lambda e: e["column"].isin(*columns))
    each = table.select(*keys, "row_number", F.explode(held).alias("e")).select(*keys, "row_number", "e.column", F.posexplode("e.boxes").alias("_order", "_box"))
    box_keys = [*keys, "item_index"]
    found = items.select(F.struct(*(F.col(k) for k in box_keys)).alias("_box"), F.col("text").alias("_text"), center_x().alias("_cx"), center_y().alias("_cy"))
    met = each.join(found, [each["_box"][k] == found["_box"][k] for k in box_keys]).select(*(each[c] for c in (*keys, "row_number", "column", "_order", "_box")), "_text", "_cx", "_cy")
    first = F.col("_cx" if axis == "x" else "_cy") <= F.lit(float(guide))
    own = lambda side: F.array_sort(F.collect_list(F.when(side, F.struct("_order", "_text", "_box"))))
    grouped = met.groupBy(*keys, "row_number", "column").agg(own(first).alias("_a"), own(~first).alias("_b"))
    text = lambda c: strip_ws(F.array_join(F.transform(c, lambda s: s["_text"]), " "))
    boxes = lambda c: F.transform(c, lambda s: s["_box"])
    counts = F.size("_a").alias("n_before"), F.size("_b").alias("n_after")
    return grouped.select(*keys, "row_number", "column", *counts, text("_a").alias("before"), text("_b").alias("after"), boxes("_a").alias("boxes_before"), boxes("_b").alias("boxes_after"))


def columns_crossing(table: DataFrame, items: DataFrame, guide_x: float) -> DataFrame:
    """(page, column): columns with a cell that has boxes on both sides."""
    return sides(table, items, "x", guide_x).filter("n_before > 0 and n_after > 0").select(*page_keys(table), "column").distinct()


def rows_crossing(table: DataFrame, items: DataFrame, guide_y: float) -> DataFrame:
    """(page, row_number): rows with boxes on both sides, over the whole row."""
    keys = [*page_keys(table), "row_number"]
    return sides(table, items, "y", guide_y).groupBy(*keys).agg(F.sum("n_before").alias("a"), F.sum("n_after").alias("b")).filter("a > 0 and b > 0").select(*keys)


def cells_crossing_rows(table: DataFrame, items: DataFrame, guide_y: float) -> DataFrame:
    """(page, row_number): rows with a cell that itself has boxes on both sides."""
    return sides(table, items, "y", guide_y).filter("n_before > 0 and n_after > 0").select(*page_keys(table), "row_number").distinct()


def _with_sides(table: DataFrame, some: DataFrame, items: DataFrame, axis: str, guide: float, columns: list[str]) -> DataFrame:
    """The table with ``_m``, a map from column to both sides, for the rows of ``some`` (of one page)."""
    keys = [*page_keys(table), "row_number"]
    value = F.struct("before", "after", "boxes_before", "boxes_after")
    by_row = sides(some, items, axis, guide, columns).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("column", value))).alias("_m"))
    return table.join(F.broadcast(by_row), keys, "left")  # one page's rows


def split_columns(table: DataFrame, items: DataFrame, page: Page, named: list[tuple[str, str, str]], guide_x: float) -> DataFrame:
    """Columns (name, left name, right name) replaced by their texts left and right of the guide on one page; rows of
    other pages stay left."""
    order = list(table.columns)
    for column, one, two in named:
        at = order.index(column)
        if one == two or {one, two} & (set(order) - {column}):
            raise ValueError(f"column {one} or {two} exists")
        order[at : at + 1] = [one, two]
    joined = _with_sides(table, table.filter(on_page(table, page)), items, "x", guide_x, [c for c, _, _ in named])
    new, entries = {}, F.col(BOXES)
    for column, one, two in named:
        side, own = F.try_element_at("_m", F.lit(column)), boxes_of(F.col(BOXES), column)
        new[one] = F.coalesce(side["before"], text_of(F.col(column)))
        new[two] = F.coalesce(side["after"], F.lit(""))
        nothing = F.filter(own, lambda b: F.lit(False))
        entries = replaced(entries, [column], {one: F.coalesce(side["boxes_before"], own), two: F.coalesce(side["boxes_after"], nothing)})
    new[BOXES] = entries
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in order))


def split_rows(table: DataFrame, items: DataFrame, page: Page, rows: list[int], guide_y: float) -> DataFrame:
    """Rows of a page split along a horizontal guide; a cell without boxes keeps its value above."""
    names = data_columns(table)
    chosen = on_page(table, page) & F.coalesce(F.col("row_number").isin(rows), F.lit(False))
    joined = _with_sides(table, table.filter(chosen), items, "y", guide_y, names)
    two = joined.withColumn("_half", F.explode(F.when(chosen, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new, upper, lower = {}, {}, {}
    for c in names:
        side, own = F.try_element_at("_m", F.lit(c)), boxes_of(F.col(BOXES), c)
        new[c] = F.when(~chosen, F.col(c)).when(F.col("_half") == 0, F.coalesce(side["before"], F.col(c))).otherwise(F.coalesce(side["after"], F.lit("")))
        upper[c] = F.coalesce(side["boxes_before"], own)
        lower[c] = F.coalesce(side["boxes_after"], F.filter(own, lambda b: F.lit(False)))
    entries = F.when(~chosen, F.col(BOXES)).when(F.col("_half") == 0, replaced(F.col(BOXES), [], upper)).otherwise(replaced(F.col(BOXES), [], lower))
    return normalize_row_numbers(two.withColumns(new | {BOXES: entries}), "_half").select(*table.columns)
