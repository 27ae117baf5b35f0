"""Deterministic page layouts made from relational tables (see FIXTURES.md): inputs for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegeo.functions.geometry import corners, point
from tablegeo.schema import PAGE

#: What a line is ordered by: all its columns, since order and line number repeat.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_number, rn, k, quantity, flag, status): the lines of each order."""
    lines = _table(spark, sf_dir, "lineitem").withColumn("page_number", F.col("l_orderkey").cast("int"))  # dealt by page from here on
    lines = lines.withColumn("rn", F.row_number().over(Window.partitionBy("page_number").orderBy(*LINE)))
    return lines.select("page_number", "rn", F.col("l_partkey").cast("int").alias("k"), F.col("l_quantity").cast("long").cast("string").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def _fields(lines: DataFrame) -> DataFrame:
    texts = F.array(F.col("k").cast("string"), "quantity", "flag", "status")
    each = lines.select("page_number", "rn", "k", F.posexplode(texts).alias("c", "text"))
    return each.withColumn("c", F.col("c") + 1)


def _boxes(fields: DataFrame, x0: Column, cy: Column) -> DataFrame:
    sized = fields.withColumns({"doc_key": F.lit("d"), "item_index": (4 * (F.col("rn") - 1) + F.col("c") - 1).cast("int"), "confidence": F.lit(1.0), "x0": x0.cast("double"), "_cy": cy.cast("double")})
    sized = sized.withColumns({"x1": F.col("x0") + 6.0 * F.length("text"), "y0": F.col("_cy") - 4.0, "y1": F.col("_cy") + 4.0}).withColumn("quad", corners())
    return sized.select(*PAGE, "item_index", "text", "confidence", "x0", "y0", "x1", "y1", "quad", "rn", "c", "k")


def _jitter() -> Column:
    return F.pmod(7 * F.col("k") + 3 * F.col("c"), F.lit(9)) - 4


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: a page for each order, a row for each line, four fields at fixed places with jittered heights."""
    return _boxes(_fields(numbered_lines(spark, sf_dir)), 60 * F.col("c"), 14 * F.col("rn") + _jitter())


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5: L1 with a gap after every fifth row, and only the first field in every fourth."""
    fields = _fields(numbered_lines(spark, sf_dir)).filter("rn % 4 <> 0 or c = 1")
    return _boxes(fields, 60 * F.col("c"), 14 * F.col("rn") + _jitter() + 40 * F.floor((F.col("rn") - 1) / 5))


def tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6: L1's texts 4 points apart, below every least gap."""
    fields = _fields(numbered_lines(spark, sf_dir))
    before = F.coalesce(F.sum(6 * F.length("text") + 4).over(Window.partitionBy("page_number", "rn").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _boxes(fields.withColumn("_before", before), 60 + F.col("_before"), 14 * F.col("rn") + _jitter())


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: three detections of L1's boxes, the later two shifted and incomplete."""
    k, c = F.col("k"), F.col("c")
    look = lambda priority, seen, confidence, dx, dy: F.when(seen, F.struct(F.lit(priority).alias("priority"), confidence.alias("confidence"), dx.alias("dx"), dy.alias("dy")))
    whole = look(1, F.lit(True), F.lit(1.0), F.lit(0.0), F.lit(0.0))
    second = look(2, (k + c) % 4 != 0, 0.5 + F.pmod(13 * k + c, F.lit(50)) / 100, (F.pmod(3 * k + c, F.lit(7)) - 3) * 0.5, (F.pmod(k + 2 * c, F.lit(5)) - 2) * 0.5)
    third = look(3, (k + c) % 3 != 0, 0.5 + F.pmod(17 * k + c, F.lit(50)) / 100, (F.pmod(5 * k + c, F.lit(11)) - 5) * 0.75, F.lit(0.0))
    base = report(spark, sf_dir).drop("confidence").withColumn("_look", F.explode(F.array(whole, second, third))).filter("_look is not null")  # dealt as it is
    whole = base.select(*PAGE, "text", "_look.confidence", "x0", "y0", "x1", "y1", "quad", "item_index", *(F.col(f"_look.{n}").alias(n) for n in ("dx", "dy", "priority")))
    moved = whole.withColumns({"x0": F.col("x0") + F.col("dx"), "x1": F.col("x1") + F.col("dx"), "y0": F.col("y0") + F.col("dy"), "y1": F.col("y1") + F.col("dy")}).withColumn("quad", corners())
    return moved.withColumn("seq", F.col("priority") * 100000 + F.col("item_index")).drop("dx", "dy", "item_index")


def slanted(spark: SparkSession, sf_dir: str, layout=report) -> DataFrame:
    """L4: L1 (or another layout) turned by (page mod 7 - 3) half degrees."""
    turn = F.radians((F.pmod(F.col("page_number"), F.lit(7)) - 3) * 0.5)
    items = layout(spark, sf_dir).withColumns({"_cos": F.cos(turn), "_sin": F.sin(turn)})
    places = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    xs, ys = {}, {}
    for i, (x, y) in enumerate(places):
        xs[f"_x{i}"] = F.col(x) * F.col("_cos") - F.col(y) * F.col("_sin")
        ys[f"_y{i}"] = F.col(x) * F.col("_sin") + F.col(y) * F.col("_cos")
    moved = items.withColumns(xs | ys).withColumn("quad", F.array(*(point(F.col(x), F.col(y)) for x, y in zip(xs, ys, strict=True))))
    return moved.withColumns({"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}).drop("_cos", "_sin", *xs, *ys)


def edit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7: page tables of two documents, whose page numbers repeat, with nulls, blanks and delimiters."""
    k, order = F.col("k"), F.col("page_number")
    return numbered_lines(spark, sf_dir).select(F.when(order % 2 == 0, "even").otherwise("odd").alias("doc_key"), F.floor(order / 2).cast("int").alias("page_number"), F.col("rn").alias("row_number"), k.cast("string").alias("col_1"), F.when(k % 2 == 0, F.concat("flag", F.lit(" "), "status")).otherwise(F.col("flag")).alias("col_2"), F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit(" ")).otherwise(F.col("quantity")).alias("col_3"), F.col("status").alias("col_4"))


def ocr_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L8: L1 as recogniser results of one tile at 300 dpi; every eleventh part has a blank text."""
    base = report(spark, sf_dir)
    quad = F.transform("quad", lambda p: point(p["x"] * 300 / 72 - 25, p["y"] * 300 / 72 - 50))
    entry = F.struct("item_index", quad.alias("quad"), F.when(F.col("k") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text")).alias("text"), (0.5 + F.pmod(13 * F.col("k") + F.col("c"), F.lit(50)) / 100).alias("score"))
    nested = base.groupBy("page_number").agg(F.array_sort(F.collect_list(entry)).alias("r"))
    return nested.select("page_number", F.lit(300 / 72).alias("scale"), F.lit(25.0).alias("offset_x"), F.lit(50.0).alias("offset_y"), F.transform("r", lambda e: F.struct(e["quad"].alias("quad"), e["text"].alias("text"), e["score"].alias("score"))).alias("result"))


def pixel_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L9: page images of different sizes."""
    orders = _table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").cast("int").alias("page_number"), (800 + F.pmod("o_custkey", F.lit(5)) * 700).cast("int").alias("width"), (1100 + F.pmod("o_orderkey", F.lit(4)) * 900).cast("int").alias("height"))


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L10: each user's events as operations, undos and redos."""
    kind = F.when(F.col("event_id") % 5 == 0, "undo").when(F.col("event_id") % 5 == 1, "redo").otherwise("apply")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), seq.alias("seq"), kind.alias("kind"))


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP_LOG: each user's events as cell edits, undos and redos."""
    from tablegeo.plans.replay import log_entries

    number = F.col("event_id")
    edit = F.struct(F.lit(1).alias("page"), (1 + number % 13).alias("row_number"), F.concat(F.lit("col_"), 1 + number % 3).alias("column"), F.concat_ws("-", "event_type", number).alias("value"))
    action = F.when(number % 5 == 0, "undo").when(number % 5 == 1, "redo").otherwise("edit_cell")
    return log_entries(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], action, F.when(number % 5 >= 2, edit)).fillna("{}", ["metadata"])


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page table for each session: the orders of the customer of that number."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"))
    return _table(spark, sf_dir, "orders").select((F.col("o_custkey") - 1).alias("session"), F.lit(1).alias("page_number"), place.alias("row_number"), F.col("o_orderkey").cast("string").alias("col_1"), F.col("o_orderstatus").alias("col_2"), F.col("o_orderpriority").alias("col_3"))


def pages_of(items: DataFrame, width: float = 480.0, height: float = 842.0) -> DataFrame:
    return items.select(*PAGE).distinct().withColumns({"page_width": F.lit(width), "page_height": F.lit(height)})
