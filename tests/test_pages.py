"""Hand-made pages: tolerance edges, ties, empty pages and fallbacks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tablegeo.functions.geometry import in_polygon, point, tile_starts
from tablegeo.operators import columns as C
from tablegeo.operators import items as I
from tablegeo.operators import rows as R
from tablegeo.plans import extract
from tablegeo.schema import ITEMS


def page(spark, boxes):
    """Items of page 1 from (text, x0, y0, x1, y1)."""
    data = [("d", 1, i, t, 1.0, float(a), float(b), float(c), float(d), [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]) for i, (t, a, b, c, d) in enumerate(boxes)]
    return spark.createDataFrame(data, ITEMS)


def row_numbers(spark, boxes):
    return [r.row_index for r in R.cluster_rows(page(spark, boxes)).orderBy("item_index").collect()]


def test_empty_page(spark):
    items = page(spark, [])
    found = extract.analyzed(items)
    assert extract.cells(found).count() == 0
    assert extract.page_table(found).columns == ["doc_key", "page_number", "row_number", "col_1"]
    pages = spark.createDataFrame([("d", 1, 480.0, 842.0)], "doc_key string, page_number int, page_width double, page_height double")
    meta = extract.page_meta(items, pages).first()
    assert meta.slant_angle == 0.0 and tuple(meta.band) == (0, -1) and meta.column_names == ["col_1"] and meta.column_centers == []


def test_one_box(spark):
    cells = extract.cells(extract.analyzed(page(spark, [("a", 1, 1, 5, 9)]))).collect()
    assert [(c.row_index, c.col_index, c.text, c.source_item_indexes) for c in cells] == [(1, 1, "a", [0])]


def test_row_tolerance_is_inclusive_and_chains(spark):
    assert row_numbers(spark, [("a", 0, 0, 5, 8), ("b", 9, 6, 12, 14)]) == [1, 1]
    assert row_numbers(spark, [("a", 0, 0, 5, 8), ("b", 9, 6.25, 12, 14.25)]) == [1, 2]
    # the mean moves: 0, 5 -> 2.5; 8.5 is within 6 of it, though not of the first
    assert row_numbers(spark, [("a", 0, 0, 5, 8), ("b", 9, 5, 12, 13), ("c", 20, 8.5, 25, 16.5)]) == [1, 1, 1]


def test_no_heights_or_widths_fall_back(spark):
    items = page(spark, [("a", 0, 0, 0, 0), ("b", 30, 8, 30, 8)])
    assert R.row_tolerance(items).first().y_tolerance == 8.0
    params = C.segments(R.page_rows(items)).first()
    assert (params.min_gap, params.merge_tolerance) == (10.0, 12.0)


def test_gap_at_minimum_and_center_on_boundary(spark):
    found = extract.analyzed(page(spark, [("aa", 0, 0, 10, 8), ("b", 20, 0, 30, 8), ("c", 10, 20, 20, 28), ("d", 40, 20, 50, 28)]))
    assert {tuple(r.boundaries) for r in found.collect()} == {(15.0, 30.0)}
    # the center of c lies on the boundary and stays left of it
    assert {r.text: r.cell_col for r in found.collect()} == {"aa": 1, "b": 2, "c": 1, "d": 3}


def test_no_boundaries_keep_table_and_cells_apart(spark):
    found = extract.analyzed(page(spark, [("a", 0, 0, 20, 8), ("b", 24, 0, 44, 8)]))
    table = extract.page_table(found).first()
    assert (table.col_1, table.col_2) == ("a", "b")
    assert [(c.col_index, c.text) for c in extract.cells(found).orderBy("col_index").collect()] == [(1, "a b"), (2, "")]


def test_nearest_center_prefers_the_first(spark):
    from tablegeo.functions.geometry import nearest

    assert spark.range(1).select(nearest(F.lit(5.0), F.array(F.lit(0.0), F.lit(10.0)))).first()[0] == 1


def test_first_of_equally_long_bands(spark):
    boxes = []
    for i in range(5):
        boxes.append((f"a{i}", 0, 20 * i, 10, 20 * i + 8))
        if i != 2:
            boxes.append((f"b{i}", 40, 20 * i, 50, 20 * i + 8))
    items = page(spark, boxes)
    pages = spark.createDataFrame([("d", 1, 480.0, 842.0)], "doc_key string, page_number int, page_width double, page_height double")
    band = R.table_band(R.cluster_rows(items), pages).first()
    assert (band.band_start, band.band_end) == (0, 1)


def test_structured_by_width_only(spark):
    items = page(spark, [("wide", 0, 0, 200, 8), ("narrow", 0, 20, 10, 28)])
    pages = spark.createDataFrame([("d", 1, 480.0, 842.0)], "doc_key string, page_number int, page_width double, page_height double")
    band = R.table_band(R.cluster_rows(items), pages).first()
    assert (band.band_start, band.band_end) == (0, 0)


def test_greedy_merge_depends_on_order(spark):
    def items(*centers):
        data = [("d", 1, "x", 1.0 - i / 10, c, 0.0, c + 6, 8.0, 1, i) for i, c in enumerate(centers)]
        return spark.createDataFrame(data, "doc_key string, page_number int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, priority int, seq int").withColumn("quad", F.array(point(F.col("x0"), F.col("y0"))))

    # A~B and B~C but not A~C: after A, B goes and C stays
    assert [r.seq for r in I.merge_items(items(0.0, 2.0, 4.0)).orderBy("item_index").collect()] == [0, 2]
    # with B first, both others go
    assert [r.seq for r in I.merge_items(items(2.0, 0.0, 4.0)).orderBy("item_index").collect()] == [0]


def test_merge_is_idempotent(spark, data):
    from tablegeo.sources import layouts

    once = I.merge_items(layouts.duplicates(spark, data)).cache()
    assert I.merge_items(once).count() == once.count()


def test_polygon_corners_and_edges(spark):
    square = F.array(*(point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))))
    inside = lambda x, y, p=square: spark.range(1).select(in_polygon(F.lit(float(x)), F.lit(float(y)), p)).first()[0]
    assert inside(5, 5) and not inside(15, 5) and not inside(-1, 5)
    assert inside(0, 5) and not inside(10, 5)  # the left edge belongs, the right one does not
    line = F.array(*(point(F.lit(float(x)), F.lit(0.0)) for x in (0, 10)))
    assert not inside(5, 0, line)


def test_tile_starts(spark):
    starts = lambda n: spark.range(1).select(tile_starts(F.lit(n), 1400, 220)).first()[0]
    assert starts(1400) == [0] and starts(1401) == [0, 1] and starts(2580) == [0, 1180] and starts(3000) == [0, 1180, 1600]


def test_blank_boxes_go(spark):
    entries = spark.createDataFrame([(" a ",), ("\t\n ",), ("",)], "text string").withColumn("quad", F.array(point(F.lit(3), F.lit(2)), point(F.lit(1), F.lit(5))))
    assert [(r.text, r.x0, r.y0, r.x1, r.y1) for r in I.build_boxes(entries).collect()] == [("a", 1.0, 2.0, 3.0, 5.0)]


def test_invariants(spark, data):
    from tablegeo.sources import layouts

    items = layouts.gaps(spark, data).filter("page_number < 200")
    found = extract.analyzed(items).cache()
    cells = extract.cells(found).cache()
    assert cells.select(F.explode("source_item_indexes")).count() == items.count()
    sizes = cells.groupBy("page_number").agg(F.countDistinct("row_index").alias("r"), F.max("col_index").alias("c"), F.count("*").alias("n"))
    assert sizes.filter("n <> r * c").count() == 0
    assert found.filter(F.exists(F.sequence(F.lit(1), F.size("boundaries") - 1), lambda i: (F.size("boundaries") > 1) & (F.get("boundaries", i) <= F.get("boundaries", i - 1)))).count() == 0


def test_streamed_pages_equal_batch(spark, data, tmp_path):
    from tablegeo.sources import layouts
    from tablegeo.streaming import extract as stream

    items = layouts.report(spark, data).filter("page_number < 60").select(*[c.split()[0] for c in ITEMS.split(", ")])
    items.write.parquet(str(tmp_path / "in"))
    stream.write_cells(stream.read_items(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = extract.cells(extract.analyzed(items))
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


def test_word_box_source(spark, tmp_path):
    from tablegeo.sources import words

    (tmp_path / "w.json").write_text('{"doc_key": "d", "page_number": 1, "text": " a ", "x0": 1, "y0": 2, "x1": 3, "y1": 4}\n{"doc_key": "d", "page_number": 2, "text": "b", "quad": [[0, 0], [2, 1]]}\n{"doc_key": "d", "page_number": 2, "text": " "}\n')
    words.register(spark)
    read = lambda **o: [(r.page_number, r.item_index, r.text, r.x1) for r in spark.read.format("wordboxes").options(paths=str(tmp_path / "w.json"), **o).load().orderBy("page_number").collect()]
    assert read() == [(1, 0, "a", 3.0), (2, 0, "b", 2.0)]
    assert read(pages="2") == [(2, 0, "b", 2.0)]
    parsed = I.build_boxes(words.boxes_from_json(spark.read.text(str(tmp_path / "w.json")))).orderBy("page_number").collect()
    assert [(r.page_number, r.text, r.x0, r.x1) for r in parsed] == [(1, "a", 1.0, 3.0), (2, "b", 0.0, 2.0)]


def test_escape_and_strip(spark):
    from tablegeo.functions.text import escape_html, strip_ws

    row = spark.range(1).select(strip_ws(F.lit("\t 　a b\n ")).alias("a"), escape_html(F.lit("<a & 'b'>")).alias("b")).first()
    assert (row.a, row.b) == ("a b", "&lt;a &amp; &#39;b&#39;&gt;")


def scattered(spark, n_pages: int, seed: int):
    """Pages of many sizes, two of them long, with ties, boxes without height, odd quads and a null document."""
    rng, out = random.Random(seed), []
    for p in range(n_pages):
        size = {3: 4000, 7: 2500}.get(p, rng.randrange(1, 60))
        for i in range(size):
            x, y = rng.randrange(200) / 2, rng.randrange(40 + size) * 2.5
            w, h = rng.choice([0, 4.5, 9, 30]), rng.choice([0, 6, 8, 8, 11])
            quad = [(x, y), (x + w, y + p % 3 * 0.25), (x + w, y + h), (x, y + h)][: 4 if rng.random() < 0.9 else 3]
            out.append((None if p % 11 == 5 else f"d{p % 4}", p, i, f"t{i}", 1.0, x, y, x + w, y + h, quad))
    rng.shuffle(out)
    return spark.createDataFrame(out, ITEMS)


def test_page_stage_agrees_with_single_steps(spark):
    """Slant, rows, segments and aligning rows in one dealing are those of the operators one by one, whatever the
    batches are."""
    items = scattered(spark, 40, 4).cache()
    steps = I.rotate_centers(items.fillna("", ["doc_key"]), I.estimate_slant(items.fillna("", ["doc_key"])))
    want = {}
    tolerance = {(r.doc_key, r.page_number): r.y_tolerance for r in R.row_tolerance(items.fillna("", ["doc_key"])).collect()}
    pages: dict = {}
    for r in steps.collect():
        pages.setdefault((r.doc_key, r.page_number), []).append((r.ry, r.item_index))
    for key, boxes in pages.items():
        row, total, n = 0, 0.0, 0
        for ry, item in sorted(boxes):
            if n and abs(ry - total / n) <= tolerance[key]:
                total, n = total + ry, n + 1
            else:
                row, total, n = row + 1, ry, 1
            want[(*key, item)] = row
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for batch in ("10000", "7"):
        spark.conf.set(name, batch)
        try:
            found = R.page_rows(items)
            assert {(r.doc_key or "", r.page_number, r.item_index): r.row_index for r in found.collect()} == want
        finally:
            spark.conf.unset(name)
    known = found.fillna("", ["doc_key"])
    stepwise = R.alignment_rows(R.segment_rows(known.drop("segment_id", "row_n", "aligns")))
    columns = ["doc_key", "page_number", "item_index", "segment_id", "row_n", "aligns"]
    assert known.select(*columns).exceptAll(stepwise.select(*columns)).count() == 0
    slants = {(r.doc_key, r.page_number): r.slant_angle for r in I.estimate_slant(items.fillna("", ["doc_key"])).collect()}
    assert all(slants[(r.doc_key, r.page_number)] == r.slant_angle for r in known.select("doc_key", "page_number", "slant_angle").collect())


def test_slant_given(spark):
    items = scattered(spark, 6, 9)
    given = spark.createDataFrame([("d0", 0, 2.0), ("d1", 1, 0.0)], "doc_key string, page_number int, slant_angle double")
    angles = {(r.doc_key, r.page_number): r.slant_angle for r in R.page_rows(items, given).collect()}
    assert angles[("d0", 0)] == 2.0 and set(angles.values()) == {0.0, 2.0}
    flat = R.page_rows(items.drop("quad"), 0.0, carry=["text"])
    assert flat.columns == ["doc_key", "page_number", "item_index", "text", "x0", "y0", "x1", "y1", *R.PAGE_ROWS]
    assert flat.filter("ry <> (y0 + y1) / 2 or rx <> (x0 + x1) / 2").count() == 0
    assert R.page_rows(items.limit(0)).count() == 0 and extract.table_long(extract.analyzed(items.limit(0))).count() == 0


def test_extraction_shuffles_twice(spark):
    items = scattered(spark, 3, 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = extract.table_long(extract.analyzed(items))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2
        assert extract.cells(extract.analyzed(items))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
