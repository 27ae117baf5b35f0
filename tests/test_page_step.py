"""Extraction deals boxes once: cells, texts, sides and segments come from one step, and equal the frames that are
grouped from the analysed boxes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tablegeo.operators import columns as C
from tablegeo.operators import guides as G
from tablegeo.operators import lookup as L
from tablegeo.operators import provenance as P
from tablegeo.operators import rows as R
from tablegeo.plans import extract
from tablegeo.schema import ITEMS, PAGE
from tablegeo.sources import layouts as lay
from tests.conftest import rows


@pytest.fixture(scope="module")
def items(spark):
    rng, out = random.Random(5), []
    for page in range(60):
        for i in range(rng.randint(1, 40)):
            x, y, w = rng.choice((40, 41, 120, 200, 290)) + rng.random(), 14 * rng.randint(0, 9) + rng.random() * 3, rng.choice((0, 6, 25, 60))
            quad = [(x, y), (x + w, y), (x + w, y + 8), (x, y + 8)] if rng.random() < 0.9 else None
            out.append(("a" if page % 3 else "b", page, i, rng.choice(("x", " y ", " z　", "", None, "long words")), 1.0, x, y, x + w, y + 8.0, quad))
    return spark.createDataFrame(out, ITEMS)


def test_direct_results_are_those_of_the_boxes(spark, items):
    a = extract.analyzed(items)
    assert rows(a.select(*PAGE, "item_index", "boundaries", "centers", "n_cols", "table_col", "cell_col")) == rows(C.with_columns(R.page_rows(items)).select(*PAGE, "item_index", "boundaries", "centers", "n_cols", "table_col", "cell_col"))
    assert rows(extract.page_cells(items)) == rows(extract.cells(a))
    assert rows(extract.texts_long(items)) == rows(extract.table_long(a))
    assert rows(extract.texts_wide(items)) == rows(extract.page_table(a))
    found = L.cell_lookup(extract.table_long(a), extract.cells(a))
    assert rows(extract.looked_up(items)) == rows(found)
    for axis, guide in (("x", 130.0), ("y", 40.0)):
        assert rows(R.page_sides(items, axis, guide)) == rows(G.partition_cells(extract.cells(a), items, axis, guide))
    width = 4
    assert rows(extract.traced_table(items, width)) == rows(P.traced(extract.page_table(a, width), extract.cells(a)))
    pages = lay.pages_of(items)
    assert rows(extract.page_meta(items, pages)) == rows(extract.page_meta(items, pages, a))


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_one_shuffle(spark, data):
    items = lay.gaps(spark, data)
    for found in (extract.page_cells(items), extract.texts_long(items), extract.looked_up(items), R.page_sides(items, "x", 85), R.page_segments(items), R.page_rows(lay.slanted(spark, data))):
        assert exchanges(found) == 1


def test_no_pages(items):
    none = items.filter(F.lit(False))
    assert not extract.page_cells(none).count() and not R.page_segments(none).count() and not R.page_sides(none, "x", 1.0).count()


def test_rows_of_pages_leave_together():
    """Small pages do not leave a task in a batch each."""
    import pyarrow as pa

    from tablegeo.sources import pages

    work = lambda document, key, page: iter([[(key, page, 0, "a", 1.0, 0.0, 0.0, 1.0, 1.0, [])]])
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(50)]), pa.array([b"x"] * 50), pa.nulls(50, pa.list_(pa.int32()))], ["doc_key", "content", "wanted"])
    found = list(pages._each_page(pages.text_pages(), work, ITEMS)(iter([batch, batch])))
    assert len(found) == 1 and found[0].num_rows == 100


def test_painting_keeps_its_tasks(spark, data):
    """Small documents are not put together into one task, which would paint and read all pages."""
    from tablegeo.sources import painted

    assert painted.documents(spark, data).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_separators_and_params_are_those_of_the_segments(items):
    found = C.segments(R.page_rows(items))
    assert rows(R.page_params(items)) == rows(found.select(*PAGE, "segment_id", "min_gap", "merge_tolerance"))
    each = found.select(*PAGE, "segment_id", F.inline("separators"))
    assert rows(R.page_separators(items)) == rows(each) and each.count() > 50


def test_separators_and_params_are_not_folded_box_by_box(spark, data):
    from tablegeo.queries import QUERIES

    for name in ("column_separators", "boundary_params"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and plan.count("Exchange hashpartitioning") == 1
