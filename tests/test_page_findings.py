"""Pages whose texts differ so much in length that a page has a fifth column, and the queries over them against SQL."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory) -> str:
    """Orders of few lines; the keys of a page's parts have one digit and seven."""
    folder, day = tmp_path_factory.mktemp("mixed"), datetime.datetime(2024, 1, 2)
    keys = {1: (5, 1000000, 7), 2: (12, 345), 3: (9, 2000000, 3000000, 4, 77, 6), 5: (1234567, 1), 8: (3,)}
    lines = [(order, key, i, i + 1, 3.0 * i + 1, 9.5, 0.1, 0.0, "NRA"[i % 3], "OF"[i % 2], day) for order, parts in keys.items() for i, key in enumerate(parts)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def found(spark, folder: str, name: str) -> tuple[list[str], list[tuple]]:
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    return columns, sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def by_sql(folder: str, name: str) -> tuple[list[str], list[tuple]]:
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    db.execute(f"CREATE TEMP TABLE o AS {entry.oracle_sql()[name]}")
    columns = sorted(r[0] for r in db.execute("DESCRIBE o").fetchall())
    return columns, sorted(db.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + " FROM o").fetchall(), key=repr)


def test_empty_cells_keep_their_hull(spark, mixed):
    columns, rows = found(spark, mixed, "workspace_payload")
    assert any('"x0":null' in r[columns.index("payload")] for r in rows)
    assert (columns, rows) == by_sql(mixed, "workspace_payload")


def test_page_table_has_the_columns_of_its_sql(spark, mixed):
    from tablegeo.plans import extract
    from tablegeo.sources import layouts as lay

    assert "col_5" in extract.texts_wide(lay.report(spark, mixed)).columns
    assert found(spark, mixed, "page_table") == by_sql(mixed, "page_table")


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_boxes_are_made_in_compiled_code(spark, data):
    """What a page's array collects is a column already: expressions inside the aggregate are interpreted."""
    from tablegeo.operators import rows as R
    from tablegeo.sources import layouts as lay

    for found in (R.page_sides(lay.tight(spark, data), "x", 85), R.page_rows(lay.slanted(spark, data))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "collect_list(" in plan and "collect_list(struct(" not in plan


def test_turned_centers_are_those_of_slant_and_rotation(spark, data):
    from tablegeo.operators import items as I
    from tablegeo.operators import rows as R
    from tablegeo.sources import layouts as lay

    items = lay.slanted(spark, data)
    keys = ["doc_key", "page_number", "item_index"]
    own = {tuple(r[:3]): (r.text, r.rx, r.ry) for r in R.turned_centers(items).select(*keys, "text", "rx", "ry").collect()}
    steps = {tuple(r[:3]): (r.text, r.rx, r.ry) for r in I.rotate_centers(items, I.estimate_slant(items)).select(*keys, "text", "rx", "ry").collect()}
    assert own.keys() == steps.keys() and all(own[k][0] == t and math.isclose(own[k][1], x, abs_tol=1e-6) and math.isclose(own[k][2], y, abs_tol=1e-6) for k, (t, x, y) in steps.items())
    plan = entry.queries()["rotate_points"](spark, data)
    assert exchanges(plan) == 1 and "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_known_corners_hold_what_an_array_of_them_holds(spark, data):
    from tablegeo.functions.geometry import in_polygon, point

    rng = random.Random(3)
    place = lambda: float(rng.choice((0, 1, 2, 3, 1.5)))
    points = spark.createDataFrame([(place(), place()) for _ in range(200)] + [(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("nan"))], "x double, y double")
    shapes = [[(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(n)] for n in (1, 2, 3, 3, 4, 6, 9, 70)]
    array = lambda shape: F.array(*(point(F.lit(float(a)), F.lit(float(b))) for a, b in shape))
    assert not points.filter(in_polygon(F.col("x"), F.col("y"), [])).count()
    for shape in shapes:
        pairs = points.select(in_polygon(F.col("x"), F.col("y"), shape).alias("a"), in_polygon(F.col("x"), F.col("y"), array(shape)).alias("b")).collect()
        assert all(r.a == r.b for r in pairs), shape
    plan = entry.queries()["selective_extract"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan


def test_pages_of_one_size_need_no_join(spark, data):
    from tablegeo.plans import extract
    from tablegeo.sources import layouts as lay
    from tests.conftest import rows

    items = lay.gaps(spark, data)
    one = extract.page_meta(items, (480.0, 842.0))
    assert rows(one) == rows(extract.page_meta(items, lay.pages_of(items))) == rows(extract.page_meta(items, (480.0, 842.0), extract.analyzed(items)))
    assert exchanges(extract.page_meta(items, (480.0, 842.0))) == 1


def test_parts_of_a_file_are_compressed(spark, tmp_path):
    from tablegeo import sinks

    text = '    {\n      "page_number": 7\n    }'
    with sinks.OneFile(spark, str(tmp_path / "out")) as file:
        parts = file.parts("rows", spark.range(20000).select(F.lit(text).alias("line")), ",\n")
        assert sum(file._at(p.toString())[1].getFileStatus(p).getLen() for p in parts) < 20000 * len(text) / 5
        file.copy(parts, without=2)
    assert (tmp_path / "out").read_text() == ",\n".join([text] * 20000)


def test_tables_are_stored_by_column(spark, data):
    from tablegeo.plans import extract
    from tablegeo.sources import layouts as lay
    from tests.conftest import rows

    table = extract.traced_table(lay.tight(spark, data), 4)
    kept = extract.stored(table)
    assert kept.dtypes == table.dtypes and rows(kept) == rows(table)
    assert "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()
