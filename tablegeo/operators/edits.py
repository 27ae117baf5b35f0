"""Corrections of page tables.  A page is its number or, in tables of many documents (with ``doc_key``), the
pair (doc_key, page_number); rows are named by (page, row_number).  Every operator is lazy, except for the checks
that name a row, which look for it first; no operator touches a document that it does not name.  Tables that carry
the boxes of their cells (see ``provenance``) keep them through every correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegeo.functions.boxes import boxes_of, has_boxes, replaced, with_entries, without
from tablegeo.functions.text import join_nonblank, join_stripped, partition, strip_ws, text_of
from tablegeo.schema import BOXES, data_columns, on_page, page_keys

Page = int | tuple[str, int]


def _key(df: DataFrame, page: Page, row_number: int) -> Column:
    return on_page(df, page) & F.col("row_number").eqNullSafe(F.lit(row_number))


def _keys(df: DataFrame, rows: list[tuple[Page, int]]) -> Column:
    by_page: dict[Page, list[int]] = {}
    for page, row in rows:
        by_page.setdefault(page, []).append(row)
    test = F.lit(False)
    for page, numbers in by_page.items():
        test = test | (on_page(df, page) & F.coalesce(F.col("row_number").isin(numbers), F.lit(False)))
    return test


def _require(df: DataFrame, rows: list[tuple[Page, int]], message: str) -> None:
    if df.filter(_keys(df, rows)).select(*page_keys(df), "row_number").distinct().count() < len(set(rows)):
        raise ValueError(message)


def _named(df: DataFrame, column: str) -> int:
    if column not in df.columns:
        raise KeyError(column)
    return df.columns.index(column)


def normalize_row_numbers(df: DataFrame, *before: str) -> DataFrame:
    """Row numbers 1..n of each page in present order; ``before``: columns that break ties of the number."""
    if "page_number" not in df.columns or "row_number" not in df.columns:
        return df
    place = Window.partitionBy(*page_keys(df)).orderBy("row_number", *before)
    return df.withColumn("row_number", F.row_number().over(place))


def merge_columns(df: DataFrame, columns: list[str], output: str = "") -> DataFrame:
    """One column of the non-blank values in the order of selection, at the first selected one's place."""
    if len(columns) < 2:
        raise ValueError("at least two columns are merged")
    at = _named(df, columns[0])
    rest = [c for c in df.columns if c not in columns]
    name = output.strip() or columns[0]
    if name in rest:
        raise ValueError(f"column {name} exists")
    value = join_nonblank(F.array(*(text_of(F.col(c)) for c in columns))).alias(name)
    at = min(at, len(rest))
    df = with_entries(df, lambda e: replaced(e, columns, {name: F.flatten(F.array(*(boxes_of(e, c) for c in columns)))}))
    return df.select(*rest[:at], value, *rest[at:])


def split_column(df: DataFrame, column: str, delimiter: str, left: str = "", right: str = "", regex: bool | None = None) -> DataFrame:
    """Splits at the first delimiter, on every page.  Longer delimiters are patterns unless ``regex`` says
    otherwise.  Where some row has the delimiter the others get null on the right, else all get empty text."""
    if not delimiter:
        raise ValueError("the delimiter is empty")
    at = _named(df, column)
    names = [left.strip() or f"{column}_left", right.strip() or f"{column}_right"]
    if set(names) & (set(df.columns) - {column}) or names[0] == names[1]:
        raise ValueError(f"column {names[0]} or {names[1]} exists")
    as_regex = len(delimiter) > 1 if regex is None else regex
    pattern = delimiter if as_regex else "\\Q" + delimiter + "\\E"
    df = with_entries(df, lambda e: replaced(e, [column], {n: boxes_of(e, column) for n in names}))
    text = text_of(F.col(column))
    parts = F.split(text, pattern, 2)
    any_hit = df.agg(F.coalesce(F.max(F.size(parts) > 1), F.lit(False)).alias("_hit"))  # one row
    marked = df.crossJoin(F.broadcast(any_hit))
    second = F.when(F.size(parts) > 1, strip_ws(F.get(parts, F.lit(1)))).when(~F.col("_hit"), F.lit(""))
    rest = [c for c in df.columns if c != column]
    return marked.select(*rest[:at], strip_ws(F.get(parts, F.lit(0))).alias(names[0]), second.alias(names[1]), *rest[at:])


def insert_column(df: DataFrame, after: str | None = None, name: str = "") -> DataFrame:
    name = name.strip() or f"col_{len(data_columns(df)) + 1}"
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    at = df.columns.index(after) + 1 if after in df.columns else len(df.columns)
    return df.select(*df.columns[:at], F.lit("").alias(name), *df.columns[at:])


def delete_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        raise ValueError("at least one column is removed")
    for c in columns:
        _named(df, c)
    return with_entries(df, lambda e: without(e, *columns)).drop(*columns)


def rename_column(df: DataFrame, column: str, name: str) -> DataFrame:
    name = name.strip()
    if not name:
        raise ValueError("the new name is empty")
    if name in df.columns and name != column:
        raise ValueError(f"column {name} exists")
    renamed = lambda b: F.struct(F.when(b["column"] == column, F.lit(name)).otherwise(b["column"]).alias("column"), b["boxes"].alias("boxes"))
    return with_entries(df, lambda e: F.transform(e, renamed)).withColumnRenamed(column, name)


def edit_cell(df: DataFrame, page: Page, row_number: int, column: str, value: str) -> DataFrame:
    _named(df, column)
    _require(df, [(page, row_number)], "no such cell")
    return df.withColumn(column, F.when(_key(df, page, row_number), F.lit(value)).otherwise(F.col(column)))


def move_cell(df: DataFrame, source: tuple[Page, int, str], target: tuple[Page, int, str]) -> DataFrame:
    """Appends the source's text to the target's and clears the source; a blank source changes no target."""
    if tuple(source) == tuple(target):
        raise ValueError("source and target are the same cell")
    (page, row, column), (to_page, to_row, to_column) = source, target
    _named(df, column)
    _named(df, to_column)
    _require(df, [(page, row), (to_page, to_row)], "no such source or target cell")
    own = [boxes_of(F.col(BOXES), column).alias("_moved_boxes")] if has_boxes(df) else []
    moved = df.filter(_key(df, page, row)).limit(1).select(strip_ws(text_of(F.col(column))).alias("_moved"), *own)  # one row
    both = df.crossJoin(F.broadcast(moved))
    if own:
        cleared = F.when(_key(df, page, row), without(F.col(BOXES), column)).otherwise(F.col(BOXES))
        grown = replaced(cleared, [], {to_column: F.concat(boxes_of(cleared, to_column), "_moved_boxes")})
        both = both.withColumn(BOXES, F.when(_key(df, to_page, to_row) & (F.col("_moved") != ""), grown).otherwise(cleared)).drop("_moved_boxes")
    clear = lambda c: F.when(_key(df, page, row), F.lit("")).otherwise(c)
    old = strip_ws(text_of(F.col(to_column)))
    joined = F.when(old != "", F.concat(old, F.lit(" "), F.col("_moved"))).otherwise(F.col("_moved"))
    fill = F.when(_key(df, to_page, to_row) & (F.col("_moved") != ""), joined).otherwise(F.col(to_column))
    if column == to_column:
        return both.withColumn(column, clear(fill)).drop("_moved")
    return both.withColumns({to_column: fill, column: clear(F.col(column))}).drop("_moved")


def split_row(df: DataFrame, page: Page, row_number: int, delimiter: str) -> DataFrame:
    """Splits every data column of a row at the first literal delimiter; the right parts make a new row."""
    if not delimiter:
        raise ValueError("the delimiter is empty")
    _require(df, [(page, row_number)], "no such row")
    here = _key(df, page, row_number)
    two = df.withColumn("_half", F.explode(F.when(here, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new = {}
    for c in data_columns(df):
        found, left, right = partition(text_of(F.col(c)), delimiter)
        new[c] = F.when(here & (F.col("_half") == 0), strip_ws(left)).when(here, F.when(found, strip_ws(right)).otherwise("")).otherwise(F.col(c))
    return normalize_row_numbers(two.withColumns(new), "_half").drop("_half")


def merge_rows(df: DataFrame, rows: list[tuple[Page, int]]) -> DataFrame:
    """Joins the stripped non-blank values of rows into the first of them and drops the others."""
    if len(set(rows)) < 2:
        raise ValueError("at least two rows are merged")
    _require(df, rows, "no such row")
    chosen, names, keys = _keys(df, rows), data_columns(df), [*page_keys(df), "row_number"]
    held = [BOXES] if has_boxes(df) else []
    ordered = F.array_sort(F.collect_list(F.struct(*keys, *names, *held)))
    joined = lambda c: join_stripped(F.transform("_all", lambda s: s[c])).alias(c)
    first = F.col("_all")[0]
    one = df.filter(chosen).agg(ordered.alias("_all"))
    together = lambda c: F.flatten(F.transform("_all", lambda s: boxes_of(s[BOXES], c)))
    kept = [replaced(first[BOXES], [], {c: together(c) for c in names}).alias(BOXES)] if held else []
    one = one.select(*(first[c].alias(c) for c in keys), *map(joined, names), *kept)
    return normalize_row_numbers(df.filter(~chosen).unionByName(one))


def insert_row(df: DataFrame, page: Page, after_row: int | None = None) -> DataFrame:
    """A blank row after a row of the page (0: at its top; none: at its end)."""
    after = 2147483647 if after_row is None else after_row
    kinds = {f.name: f.dataType for f in df.schema.fields}
    on_page(df, page)  # is it a page of this table?
    own = dict(zip(reversed(page_keys(df)), reversed(page if isinstance(page, tuple) else (page,)), strict=False)) | {"row_number": after}
    value = lambda c: F.array() if c == BOXES else F.lit(own.get(c, ""))
    blank = df.sparkSession.range(1).select(*(value(c).cast(kinds[c]).alias(c) for c in df.columns))
    both = df.withColumn("_sub", F.lit(0)).unionByName(blank.withColumn("_sub", F.lit(1)))
    return normalize_row_numbers(both, "_sub").drop("_sub")


def delete_rows(df: DataFrame, rows: list[tuple[Page, int]]) -> DataFrame:
    if not rows:
        raise ValueError("at least one row is removed")
    _require(df, rows, "no such row")
    return normalize_row_numbers(df.filter(~_keys(df, rows)))


def commit_page_edits(df: DataFrame, page: Page, edited: DataFrame) -> tuple[DataFrame, bool]:
    """The table with a page's cells overwritten by an edited page (row_number and data columns), and whether
    that changed anything.  A page of another number of rows is refused."""
    here = on_page(df, page)
    page = df.filter(here)
    if page.count() != edited.count():
        raise ValueError("the page has another number of rows; rows are added and removed by row operators")
    shared = [c for c in data_columns(df) if c in edited.columns]
    new = edited.select("row_number", *(F.col(c).alias(f"_new_{c}") for c in shared))
    joined = page.join(new, "row_number", "left")
    changed = joined.select(*(F.col(f"_new_{c}").alias(c) if c in shared else F.col(c) for c in df.columns))
    if not changed.exceptAll(page).limit(1).count() and not page.exceptAll(changed).limit(1).count():
        return df, False
    return df.filter(~here).unionByName(changed), True
