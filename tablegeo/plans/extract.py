"""Page extraction: items to cells and page tables, for all pages in one plan.

Slant, rows, segments, columns and cells all work page by page.  Only the wide table needs to know the widest
page first (``max_columns``, the one action)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegeo.operators import columns as C
from tablegeo.operators import rows as R
from tablegeo.plans.parsed import working_folder
from tablegeo.schema import BOXES, PAGE, column_names, on_page


def analyzed(items: DataFrame, slant: DataFrame | float | None = None, carry: Sequence[str] = ("text",)) -> DataFrame:
    """Items with row_index, segment_id, boundaries, centers and columns, and their page's slant_angle.  ``slant`` is
    estimated from the quads, or given: a number for all pages, or (page, slant_angle).  Two shuffles by page: one
    before the step (none where the items are dealt by page already), one behind it, under which everything groups.
    Of the items' columns, keys, item_index, edges and those of ``carry`` go along."""
    return R.dealt_by_page(R.page_columns(items, slant, carry))


def cells(analysis: DataFrame) -> DataFrame:
    return C.cell_grid(analysis)


def page_cells(items: DataFrame, slant: DataFrame | float | None = None) -> DataFrame:
    """``cells`` of pages in one step, without the boxes in between; so are the others that take items."""
    return R.page_cells(items, slant)


def texts_long(items: DataFrame, slant: DataFrame | float | None = None) -> DataFrame:
    """``table_long`` of pages."""
    return _long(R.page_texts(items, slant))


def texts_wide(items: DataFrame, width: int | None = None, slant: DataFrame | float | None = None) -> DataFrame:
    """``page_table`` of pages."""
    return _wide(R.page_texts(items, slant).drop("boxes"), width)


def looked_up(items: DataFrame, slant: DataFrame | float | None = None) -> DataFrame:
    """The long page table with each cell's hull and sources (see ``lookup.cell_lookup``): rows and cells of a page
    come from one step, so there is nothing to join."""
    return R.page_lookup(items, slant)


def traced_table(items: DataFrame, width: int, slant: DataFrame | float | None = None) -> DataFrame:
    """The page table of a given width with the boxes of its cells (see ``provenance.traced``), without a join."""
    rows = R.page_texts(items, slant)
    box = lambda i: F.struct(*(F.col(k).alias(k) for k in PAGE), i.alias("item_index"))
    own = lambda i: F.transform(F.coalesce(F.get("boxes", F.lit(i)), F.array().cast("array<int>")), box)
    names = column_names(width)
    held = F.array(*(F.struct(F.lit(n).alias("column"), own(i).alias("boxes")) for i, n in enumerate(names)))
    return _wide(rows.withColumn(BOXES, held), width)


def stored(df: DataFrame) -> DataFrame:
    """The frame, written as Parquet to the checkpoint folder where there is one: what several later steps read is made
    once, and each reads the columns it needs.  Rows of a checkpoint would be many times as large on disk."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df
    folder = working_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def max_columns(analysis: DataFrame) -> int:
    return analysis.agg(F.max("n_cols")).first()[0] or 1


def page_table(analysis: DataFrame, width: int | None = None) -> DataFrame:
    """page_number, row_number, col_1 .. col_n: short rows padded with empty text.  Without a given width the
    texts are written to the checkpoint folder, if there is one, while the widest row is looked for, so that pages
    are analysed once and nothing stays in memory; else they are analysed twice."""
    return _wide(C.table_texts(analysis), width)


def _wide(texts: DataFrame, width: int | None) -> DataFrame:
    if width is None:
        texts = stored(texts)
        width = texts.agg(F.max("n_cols")).first()[0]
    names = column_names(width or 1)
    kept = [c for c in texts.columns if c == BOXES]
    return texts.select("doc_key", "page_number", "row_number", *(F.coalesce(F.get("texts", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)), *kept)


def page_frames(items: DataFrame, page: tuple[str, int], slant: DataFrame | float | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, cells) of one page: what splits along a guide need, read and analysed for that page only."""
    own = items.filter(on_page(items, page))
    return own, page_cells(own, slant.filter(on_page(slant, page)) if isinstance(slant, DataFrame) else slant)


def table_long(analysis: DataFrame) -> DataFrame:
    """The page table in long form: page, row_number, col_index, text."""
    return _long(C.table_texts(analysis))


def _long(texts: DataFrame) -> DataFrame:
    return texts.select(*PAGE, "row_number", F.posexplode("texts").alias("col_index", "text")).withColumn("col_index", F.col("col_index") + 1)


def page_meta(items: DataFrame, pages: DataFrame | tuple[float, float], analysis: DataFrame | None = None) -> DataFrame:
    """(page, page_width, page_height, slant_angle, band, column_centers, column_names).  Without an analysis, all of it
    comes from one row for each page.  Where all pages are of one size, ``pages`` may be its width and height: then the
    pages are those that have boxes, and there is nothing to join."""
    if isinstance(pages, tuple) and analysis is not None:
        pages = _sized(items.select(*PAGE).distinct(), pages)
    if analysis is None:
        found = R.page_summary(items).select(*PAGE, "slant_angle", F.col("n_cols").alias("w"), F.transform("segments", lambda s: C.middles(s["boundaries"], s["centers"], s["left"], s["right"])).alias("column_centers"), "lines")
        sized = _sized(found, pages) if isinstance(pages, tuple) else pages.join(found, PAGE, "left")
        out = sized.withColumn("band", F.when(F.col("lines").isNotNull(), R.longest_band(F.col("lines"), F.col("page_width"))))
        return _meta(out)
    centers = C.column_centers(analysis).groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "centers"))), lambda s: s["centers"]).alias("column_centers"))
    wide = analysis.groupBy(*PAGE).agg(F.max("n_cols").alias("w"), F.first("slant_angle").alias("slant_angle"))
    band = R.table_band(analysis, pages).select(*PAGE, F.struct(F.col("band_start").cast("int").alias("start"), F.col("band_end").cast("int").alias("end")).alias("band"))
    return _meta(pages.join(band, PAGE, "left").join(centers, PAGE, "left").join(wide, PAGE, "left"))


def _sized(pages: DataFrame, size: tuple[float, float]) -> DataFrame:
    return pages.withColumns({"page_width": F.lit(float(size[0])), "page_height": F.lit(float(size[1]))})


def _meta(out: DataFrame) -> DataFrame:
    names = F.transform(F.sequence(F.lit(1), F.coalesce("w", F.lit(1))), lambda i: F.concat(F.lit("col_"), i.cast("string")))
    nothing = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"))
    return out.select(*PAGE, "page_width", "page_height", F.coalesce("slant_angle", F.lit(0.0)).alias("slant_angle"), F.coalesce("band", nothing).alias("band"), F.coalesce("column_centers", F.array().cast("array<array<double>>")).alias("column_centers"), names.alias("column_names"))
