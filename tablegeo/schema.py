"""Schemas and names that all modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What identifies a page; every operator on boxes works page by page under these keys.
PAGE = ["doc_key", "page_number"]
#: Columns of a page table that are not data.
BOXES = "_boxes"
SYSTEM_COLUMNS = ["doc_key", "page_number", "row_number", BOXES]

POINT = "struct<x:double,y:double>"
ITEMS = f"doc_key string, page_number int, item_index int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, quad array<{POINT}>"
CELLS = "doc_key string, page_number int, row_index int, col_index int, text string, x0 double, y0 double, x1 double, y1 double, source_item_indexes array<int>"
OCR_RAW = f"page_number int, scale double, offset_x double, offset_y double, result array<struct<quad:array<{POINT}>,text:string,score:double>>"
OP_LOG = "session string, seq long, ts timestamp, action string, metadata string"


def page_keys(df: DataFrame) -> list[str]:
    """What identifies a page in a table: document and page, or the page alone in a table of one document."""
    return [c for c in PAGE if c in df.columns]


def on_page(df: DataFrame, page: int | tuple[str, int]) -> Column:
    """Rows of one page; in a table of many documents, ``page`` is (doc_key, page_number)."""
    parts = page if isinstance(page, tuple) else (page,)
    keys = page_keys(df)
    if len(parts) == 2 and len(keys) == 1:
        parts = parts[1:]
    if len(parts) != len(keys):
        raise ValueError("a page of a table of many documents is (doc_key, page_number)")
    test = F.lit(True)
    for key, part in zip(keys, parts, strict=True):
        test = test & F.col(key).eqNullSafe(F.lit(part))
    return test


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SYSTEM_COLUMNS]


def column_names(count: int) -> list[str]:
    """``col_1`` to ``col_n``, at least one."""
    return [f"col_{i}" for i in range(1, max(1, count) + 1)]
