"""Splits along a guide line: boxes with their center on or before the guide go left or up, the others right
or down.  Cells are found by their present position in the table, as they were extracted; in a table that carries the
boxes of its cells (see ``provenance``) by those, and ``cells`` is not looked at.  Cells and boxes belong to the page of their document; a page is named as in ``edits``.  Splits of one page look only at that page's cells
and boxes, so frames that are made for one page (see ``plans.extract.page_frames``) are all they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegeo.functions.boxes import has_boxes
from tablegeo.functions.geometry import center_x, center_y
from tablegeo.functions.text import strip_ws, text_of
from tablegeo.operators import provenance as P
from tablegeo.operators.edits import Page, _require, normalize_row_numbers
from tablegeo.schema import SYSTEM_COLUMNS, data_columns, on_page, page_keys


def cell_keys(cells: DataFrame) -> list[str]:
    return [*page_keys(cells), "row_index", "col_index"]


def cell_boxes(cells: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each box of each cell, with its order in the cell."""
    keys = page_keys(cells)
    each = cells.select(*cell_keys(cells), F.posexplode("source_item_indexes").alias("_order", "item_index"))
    boxes = items.select(*keys, "item_index", F.col("text").alias("_text"), center_x().alias("_cx"), center_y().alias("_cy"))
    return each.join(boxes, [*keys, "item_index"])


def _before(axis: str, guide: Column | float) -> Column:
    return F.col("_cx" if axis == "x" else "_cy") <= (guide if isinstance(guide, Column) else F.lit(float(guide)))


def partition_cells(cells: DataFrame, items: DataFrame, axis: str, guide) -> DataFrame:
    """(page, row, col, n_before, n_after, before, after): both sides of each cell that has boxes."""
    first = _before(axis, guide)
    text = lambda side: strip_ws(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("_order", "_text")))), lambda s: s["_text"]), " "))
    count = lambda side: F.sum(F.when(side, 1).otherwise(0)).cast("int")
    return cell_boxes(cells, items).groupBy(*cell_keys(cells)).agg(count(first).alias("n_before"), count(~first).alias("n_after"), text(first).alias("before"), text(~first).alias("after"))


def crossed_columns(sides: DataFrame) -> DataFrame:
    """(page, col_index): of both sides of cells, the columns with a cell that has boxes on both."""
    return sides.filter("n_before > 0 and n_after > 0").select(*page_keys(sides), "col_index").distinct()


def crossed_rows(sides: DataFrame) -> DataFrame:
    """(page, row_index): rows with boxes on both sides, over the whole row."""
    rows = sides.groupBy(*page_keys(sides), "row_index").agg(F.sum("n_before").alias("a"), F.sum("n_after").alias("b"))
    return rows.filter("a > 0 and b > 0").select(*page_keys(sides), "row_index")


def rows_with_crossed_cells(sides: DataFrame) -> DataFrame:
    """(page, row_index): rows with a cell that itself has boxes on both sides."""
    return sides.filter("n_before > 0 and n_after > 0").select(*page_keys(sides), "row_index").distinct()


def columns_crossing(cells: DataFrame, items: DataFrame, guide_x) -> DataFrame:
    """(page, col_index): columns with a cell that has boxes on both sides."""
    return crossed_columns(partition_cells(cells, items, "x", guide_x))


def rows_crossing(cells: DataFrame, items: DataFrame, guide_y) -> DataFrame:
    """(page, row_index): rows with boxes on both sides, over the whole row."""
    return crossed_rows(partition_cells(cells, items, "y", guide_y))


def cells_crossing_rows(cells: DataFrame, items: DataFrame, guide_y) -> DataFrame:
    """(page, row_index): rows with a cell that itself has boxes on both sides."""
    return rows_with_crossed_cells(partition_cells(cells, items, "y", guide_y))


def _sides(table: DataFrame, cells: DataFrame, items: DataFrame, page: Page, some: Column, axis: str, guide) -> DataFrame:
    """Some cells of one page, with both sides where they have boxes, keyed as the table is."""
    here = cells.filter(on_page(cells, page) & some)
    sides = partition_cells(here, items.filter(on_page(items, page)), axis, guide)
    whole = here.select(*cell_keys(here)).join(sides, cell_keys(here), "left")
    return whole.select(*page_keys(table), F.col("row_index").alias("row_number"), "col_index", "before", "after")


def split_columns_visual(table: DataFrame, cells: DataFrame, items: DataFrame, page: Page, columns: list[str], guide_x, left: str = "", right: str = "") -> DataFrame:
    """Columns one after another, each at the position it then has; unknown columns are passed over.  The texts of
    all of them come from one look at the page's cells."""
    left, right = left.strip() or "left", right.strip() or "right"
    named = [(c, f"{c}_{left}", f"{c}_{right}") for c in columns if c in table.columns]
    if has_boxes(table):
        return P.split_columns(table, items, page, named, guide_x)
    return _split_columns(table, cells, items, page, named, guide_x)


def _split_columns(table: DataFrame, cells: DataFrame, items: DataFrame, page: Page, named: list[tuple[str, str, str]], guide_x) -> DataFrame:
    order, numbers = list(table.columns), {}
    for column, one, two in named:
        if column not in order:
            continue
        at = order.index(column)
        if one == two or {one, two} & (set(order) - {column}):
            raise ValueError(f"column {one} or {two} exists")
        numbers[column] = (data_of(order).index(column) + 1, one, two)
        order[at : at + 1] = [one, two]
    if not numbers:
        return table
    sides = _sides(table, cells, items, page, F.col("col_index").isin([n for n, _, _ in numbers.values()]), "x", guide_x)
    value = F.struct(F.coalesce("before", F.lit("")).alias("a"), F.coalesce("after", F.lit("")).alias("b"))
    keys = [*page_keys(table), "row_number"]
    by_row = sides.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col_index", value))).alias("_m"))
    joined = table.join(F.broadcast(by_row), keys, "left")  # one page's rows
    new = {}
    for column, (number, one, two) in numbers.items():
        own = F.try_element_at("_m", F.lit(number))
        new[one] = F.coalesce(own["a"], text_of(F.col(column)))
        new[two] = F.coalesce(own["b"], F.lit(""))
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in order))


def data_of(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in SYSTEM_COLUMNS]


def split_column_visual(table: DataFrame, cells: DataFrame, items: DataFrame, page: Page, column: str, guide_x, left: str = "", right: str = "") -> DataFrame:
    """Replaces a column by its texts left and right of the guide; rows of other pages stay left."""
    table.columns.index(column)
    if has_boxes(table):
        return P.split_columns(table, items, page, [(column, left.strip() or f"{column}_left", right.strip() or f"{column}_right")], guide_x)
    return _split_columns(table, cells, items, page, [(column, left.strip() or f"{column}_left", right.strip() or f"{column}_right")], guide_x)


def split_rows_visual(table: DataFrame, cells: DataFrame, items: DataFrame, page: Page, rows: list[int], guide_y) -> DataFrame:
    """Splits rows of a page along a horizontal guide, all in one pass; a column without a cell keeps its
    value above."""
    if not rows:
        return table
    _require(table, [(page, r) for r in rows], "no such row")
    if has_boxes(table):
        return P.split_rows(table, items, page, rows, guide_y)
    names, keys = data_columns(table), [*page_keys(table), "row_number"]
    sides = _sides(table, cells, items, page, F.col("row_index").isin(rows), "y", guide_y)
    value = F.struct(F.coalesce("before", F.lit("")).alias("a"), F.coalesce("after", F.lit("")).alias("b"))
    by_row = sides.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col_index", value))).alias("_m"))
    joined = table.join(F.broadcast(by_row), keys, "left")  # one page's rows
    chosen = on_page(table, page) & F.coalesce(F.col("row_number").isin(rows), F.lit(False))
    two = joined.withColumn("_half", F.explode(F.when(chosen, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new = {}
    for i, c in enumerate(names, start=1):
        own = F.try_element_at("_m", F.lit(i))
        new[c] = F.when(~chosen, F.col(c)).when(F.col("_half") == 0, F.coalesce(own["a"], F.col(c))).otherwise(F.coalesce(own["b"], F.lit("")))
    return normalize_row_numbers(two.withColumns(new), "_half").select(*table.columns)


def split_row_visual(table: DataFrame, cells: DataFrame, items: DataFrame, page: Page, row_number: int, guide_y) -> DataFrame:
    return split_rows_visual(table, cells, items, page, [row_number], guide_y)


def crossing_row_numbers(table: DataFrame, cells: DataFrame, items: DataFrame, page: Page, guide_y) -> list[int]:
    """The rows of one page that a guide crosses; as many as a page has at most."""
    here = lambda df: df.filter(on_page(df, page))
    return sorted(r.row_index for r in rows_crossing(here(cells), here(items), guide_y).collect())
