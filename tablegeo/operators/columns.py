"""Columns of segments, and the cells of rows.  Everything groups under the page keys, so frames dealt by page
stay where they are; a segment's boxes are one array while its columns are looked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegeo.functions.geometry import bucket, center_x, let, nearest
from tablegeo.functions.text import strip_ws
from tablegeo.schema import PAGE

SEGMENT = [*PAGE, "segment_id"]


def _median(values: Column) -> Column:
    """Median of a sorted array, null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2)


def cluster_means(values: Column, tolerance: Column) -> Column:
    """The ascending means of a sorted array clustered by single linkage: a value starts a cluster when it is more than
    the tolerance over the one before."""
    state = "struct<means: array<double>, total: double, n: int, last: double>"
    closed = lambda s: F.when(s["n"] > 0, F.concat(s["means"], F.array(s["total"] / s["n"]))).otherwise(s["means"])

    def step(s: Column, v: Column) -> Column:
        near = (s["n"] > 0) & (v - s["last"] <= tolerance)
        return F.when(near, F.struct(s["means"].alias("means"), (s["total"] + v).alias("total"), (s["n"] + 1).alias("n"), v.alias("last")).cast(state)).otherwise(
            F.struct(closed(s).alias("means"), v.alias("total"), F.lit(1).alias("n"), v.alias("last")).cast(state)
        )

    empty = F.struct(F.array().cast("array<double>").alias("means"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0.0).alias("last")).cast(state)
    return F.aggregate(values, empty, step, closed)


def segments(aligned: DataFrame) -> DataFrame:
    """One row for each segment: (page, segment_id, boxes, min_gap, merge_tolerance, spread, separators, boundaries,
    centers), ``boxes`` being its rows of ``aligned`` without the keys and ``separators`` the middles of the gaps to the
    next box of a row that are wide enough, with the row and box before them."""
    rest = [c for c in aligned.columns if c not in SEGMENT]
    grouped = aligned.groupBy(*SEGMENT).agg(F.collect_list(F.struct(*rest)).alias("boxes"))
    used = F.filter("boxes", lambda b: b["aligns"])
    widths = let(F.array_sort(F.filter(F.transform(used, lambda b: b["x1"] - b["x0"]), lambda w: w > 0)), _median)
    sized = grouped.withColumn("_width", widths)
    known = F.coalesce("_width", F.lit(24.0))
    sized = sized.withColumns({"min_gap": F.greatest(F.lit(10.0), known * 0.22), "merge_tolerance": F.greatest(F.lit(12.0), known * 0.35), "spread": F.greatest(F.lit(18.0), F.coalesce(F.col("_width") * 0.6, F.lit(24.0)))})
    keys = ["row_index", "x0", "rx", "ry", "item_index", "x1"]
    along = F.array_sort(F.transform(F.filter("boxes", lambda b: b["aligns"] & (b["row_n"] >= 2)), lambda b: F.struct(*(b[k].alias(k) for k in keys))))

    def gaps(line: Column) -> Column:
        after = F.slice(line, F.lit(2), F.size(line))
        pairs = F.zip_with(F.slice(line, F.lit(1), F.size(after)), after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        wide = F.filter(pairs, lambda p: (p["a"]["row_index"] == p["b"]["row_index"]) & (p["b"]["x0"] - p["a"]["x1"] >= F.col("min_gap")))
        return F.transform(wide, lambda p: F.struct(((p["a"]["x1"] + p["b"]["x0"]) / 2).alias("separator"), p["a"]["row_index"].alias("row_index"), p["a"]["item_index"].alias("item_index")))

    cut = sized.withColumn("separators", let(along, gaps))
    boundaries = cluster_means(F.array_sort(F.transform("separators", lambda s: s["separator"])), F.col("merge_tolerance"))
    centers = cluster_means(F.array_sort(F.transform(used, lambda b: (b["x0"] + b["x1"]) / 2)), F.col("spread"))
    return cut.withColumns({"boundaries": boundaries, "centers": centers}).drop("_width")


def with_columns(aligned: DataFrame) -> DataFrame:
    """Adds boundaries, centers, n_cols (of the segment), table_col and cell_col.

    A segment with boundaries has one column more than boundaries.  Without any, table texts go to the
    nearest center while cells take the whole row as column 1; both are kept as they are."""
    found = segments(aligned).select(*SEGMENT, "boundaries", "centers", F.inline("boxes")).select(*aligned.columns, "boundaries", "centers")
    has = F.size("boundaries") > 0
    by_boundary = bucket(center_x(), F.col("boundaries"))
    return found.withColumns({"n_cols": F.when(has, F.size("boundaries") + 1).otherwise(F.size("centers")), "table_col": F.when(has, by_boundary).otherwise(nearest(center_x(), F.col("centers"))), "cell_col": by_boundary})


def column_boundaries(columns: DataFrame) -> DataFrame:
    """(page, segment_id, boundaries): one row for each segment."""
    return columns.groupBy(*SEGMENT).agg(F.first("boundaries").alias("boundaries"))


def column_centers(columns: DataFrame) -> DataFrame:
    """(page, segment_id, centers): middles between the edges and boundaries, or the clustered centers."""
    edge = lambda f, c: f(F.when(F.col("aligns"), F.col(c)))
    grouped = columns.groupBy(*SEGMENT).agg(F.first("boundaries").alias("b"), F.first("centers").alias("c"), edge(F.min, "x0").alias("left"), edge(F.max, "x1").alias("right"))
    return grouped.select(*SEGMENT, middles(F.col("b"), F.col("c"), F.col("left"), F.col("right")).alias("centers"))


def middles(boundaries: Column, centers: Column, left: Column, right: Column) -> Column:
    """The middles between a segment's edges and boundaries; without boundaries, its clustered centers."""
    edges = F.concat(F.array(left), boundaries, F.array(right))
    between = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: (a + b) / 2)
    return F.when(F.size(boundaries) > 0, between).otherwise(centers)


def with_page_width(columns: DataFrame) -> DataFrame:
    """Adds max_cols, if it is missing: the widest segment of the page."""
    if "max_cols" in columns.columns:
        return columns
    return columns.withColumn("max_cols", F.max("n_cols").over(Window.partitionBy(*PAGE)))


def filled_cells(columns: DataFrame) -> DataFrame:
    """(page, row_index, col_index, text, hull, source_item_indexes) of the cells that hold boxes."""
    sides = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    grouped = columns.groupBy(*PAGE, "row_index", F.col("cell_col").alias("col_index"), "max_cols")
    along = grouped.agg(F.sort_array(F.collect_list(F.struct("x0", "rx", "ry", "item_index", "text"))).alias("_along"), *sides)
    text = strip_ws(F.array_join("_along.text", " "))
    return along.select(*PAGE, "row_index", "col_index", "max_cols", text.alias("text"), "x0", "y0", "x1", "y1", F.col("_along.item_index").alias("source_item_indexes"))


def cell_grid(columns: DataFrame) -> DataFrame:
    """All cells: every row padded to the page's width with empty text, no hull and no sources."""
    wide = filled_cells(with_page_width(columns))
    value = F.struct("text", "x0", "y0", "x1", "y1", "source_item_indexes")
    by_row = wide.groupBy(*PAGE, "row_index").agg(F.map_from_entries(F.collect_list(F.struct("col_index", value))).alias("m"), F.max("max_cols").alias("w"))
    each = by_row.select(*PAGE, "row_index", F.explode(F.sequence(F.lit(1), "w")).alias("col_index"), "m").withColumn("c", F.col("m")[F.col("col_index")])
    return each.select(*PAGE, "row_index", "col_index", F.coalesce("c.text", F.lit("")).alias("text"), "c.x0", "c.y0", "c.x1", "c.y1", F.coalesce("c.source_item_indexes", F.array().cast("array<int>")).alias("source_item_indexes"))


def table_texts(columns: DataFrame) -> DataFrame:
    """(page, row_number, n_cols, texts): the texts of each row by table column, short rows as they are."""
    parts = F.sort_array(F.collect_list(F.struct("x0", "rx", "ry", "item_index", "text", "table_col")))
    by_row = columns.groupBy(*PAGE, "row_index", "n_cols").agg(parts.alias("parts"))
    of = lambda i: F.transform(F.filter("parts", lambda p: p["table_col"] == i), lambda p: p["text"])
    texts = F.transform(F.sequence(F.lit(1), F.col("n_cols")), lambda i: strip_ws(F.array_join(of(i), " ")))
    return by_row.select(*PAGE, F.col("row_index").alias("row_number"), "n_cols", texts.alias("texts"))
