"""Corrections, sessions and exports on hand-made tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tablegeo import sinks
from tablegeo.operators import edits as E
from tablegeo.operators import guides as G
from tablegeo.operators import lookup as L
from tablegeo.plans.session import Session, Sessions, memoised, operation_log, state_key
from tests.conftest import rows


@pytest.fixture
def table(spark):
    data = [(1, 1, "a b", "x", None), (1, 2, "c", " ", "7"), (1, 3, "d", "y", ""), (2, 1, "e", "z", "8")]
    return spark.createDataFrame(data, "page_number int, row_number int, col_1 string, col_2 string, col_3 string")


def values(df):
    return [tuple(r) for r in df.orderBy("page_number", "row_number").collect()]


def test_merge_columns(table):
    merged = E.merge_columns(table, ["col_2", "col_1"], "  ")
    assert merged.columns == ["page_number", "row_number", "col_3", "col_2"] or merged.columns == ["page_number", "row_number", "col_2", "col_3"]
    assert [r.col_2 for r in merged.orderBy("page_number", "row_number").collect()] == ["x a b", "c", "y d", "z e"]
    late = E.merge_columns(table, ["col_3", "col_1"], "m")  # the place is held inside the table
    assert late.columns[-1] == "m"
    with pytest.raises(ValueError):
        E.merge_columns(table, ["col_1"])
    with pytest.raises(ValueError):
        E.merge_columns(table, ["col_1", "col_2"], "col_3")


def test_split_column_nulls(table):
    split = E.split_column(table, "col_1", " ")
    assert [(r.col_1_left, r.col_1_right) for r in split.orderBy("page_number", "row_number").collect()] == [("a", "b"), ("c", None), ("d", None), ("e", None)]
    none = E.split_column(table, "col_1", ".")  # one character is literal
    assert [(r.col_1_left, r.col_1_right) for r in none.orderBy("page_number", "row_number").collect()] == [("a b", ""), ("c", ""), ("d", ""), ("e", "")]
    pattern = E.split_column(table, "col_1", "[ ]", "l", "r")
    assert pattern.orderBy("page_number", "row_number").first().r == "b"
    with pytest.raises(ValueError):
        E.split_column(table, "col_1", "")
    with pytest.raises(ValueError):
        E.split_column(table, "col_1", " ", "col_2", "r")


def test_columns(table):
    assert E.insert_column(table).columns[-1] == "col_4"
    assert E.insert_column(table, "col_1", "new").columns[2:4] == ["col_1", "new"]
    assert E.insert_column(table, "unknown", "new").columns[-1] == "new"
    assert E.rename_column(table, "unknown", "x").columns == table.columns
    for wrong in (lambda: E.rename_column(table, "col_1", " "), lambda: E.rename_column(table, "col_1", "col_2"), lambda: E.delete_columns(table, [])):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        E.delete_columns(table, ["unknown"])


def test_cells(table):
    assert values(E.edit_cell(table, 1, 2, "col_2", " v "))[1][3] == " v "
    with pytest.raises(ValueError):
        E.edit_cell(table, 3, 1, "col_1", "v")
    moved = values(E.move_cell(table, (1, 1, "col_1"), (2, 1, "col_2")))
    assert moved[0][2] == "" and moved[3][3] == "z a b"
    blank = values(E.move_cell(table, (1, 2, "col_2"), (1, 1, "col_1")))
    assert blank[1][3] == "" and blank[0][2] == "a b"
    assert values(E.move_cell(table, (1, 1, "col_1"), (1, 2, "col_1")))[1][2] == "c a b"
    with pytest.raises(ValueError):
        E.move_cell(table, (1, 1, "col_1"), (1, 1, "col_1"))


def test_rows(table):
    merged = values(E.merge_rows(table, [(1, 3), (1, 1)]))
    assert merged == [(1, 1, "a b d", "x y", ""), (1, 2, "c", " ", "7"), (2, 1, "e", "z", "8")]
    split = values(E.split_row(table, 1, 1, " "))
    assert split[:2] == [(1, 1, "a", "x", ""), (1, 2, "b", "", "")] and split[2][:3] == (1, 3, "c")
    assert [r[:3] for r in values(E.insert_row(table, 1, 0))][:2] == [(1, 1, ""), (1, 2, "a b")]
    assert [r[:3] for r in values(E.insert_row(table, 1))][3] == (1, 4, "")
    gone = values(E.delete_rows(table, [(1, 1), (1, 2), (1, 3)]))
    assert gone == [(2, 1, "e", "z", "8")]
    for wrong in (lambda: E.delete_rows(table, []), lambda: E.delete_rows(table, [(9, 9)]), lambda: E.merge_rows(table, [(1, 1)]), lambda: E.split_row(table, 1, 1, "")):
        with pytest.raises(ValueError):
            wrong()


def test_insert_then_delete_is_identity(table):
    assert rows(E.delete_rows(E.insert_row(table, 1, 2), [(1, 3)])) == rows(table)


def test_renumber_twice_is_once(table):
    once = E.normalize_row_numbers(table.filter("row_number <> 2"))
    assert rows(E.normalize_row_numbers(once)) == rows(once)


def test_commit_page_edits(table, spark):
    page = table.filter("page_number = 1").drop("page_number")
    same, changed = E.commit_page_edits(table, 1, page)
    assert not changed and rows(same) == rows(table)
    edited, changed = E.commit_page_edits(table, 1, page.fillna("n"))
    assert changed and values(edited)[0][4] == "n"
    with pytest.raises(ValueError):
        E.commit_page_edits(table, 1, page.limit(1))


def test_guides(spark):
    items = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 10.0, 8.0), (1, 1, "b", 20.0, 2.0, 30.0, 10.0)], "page_number int, item_index int, text string, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([(1, 1, 1, "a b", [0, 1]), (1, 1, 2, "", [])], "page_number int, row_index int, col_index int, text string, source_item_indexes array<int>")
    table = spark.createDataFrame([(1, 1, "a b", "keep"), (2, 1, None, "other")], "page_number int, row_number int, col_1 string, col_2 string")
    assert [tuple(r) for r in G.columns_crossing(cells, items, 5).collect()] == [(1, 1)]  # a center on the guide goes left
    assert G.columns_crossing(cells, items, 30).count() == 0
    assert values(G.split_column_visual(table, cells, items, 1, "col_1", 5)) == [(1, 1, "a", "b", "keep"), (2, 1, "", "", "other")]
    # a cell without boxes blanks the value, as its cell exists
    assert values(G.split_rows_visual(table, cells, items, 1, [1], 5)) == [(1, 1, "a", ""), (1, 2, "b", ""), (2, 1, None, "other")]
    assert G.crossing_row_numbers(table, cells, items, 1, 5) == [1]
    with pytest.raises(ValueError):
        G.split_row_visual(table, cells, items, 1, 9, 5)


def test_session(table, spark):
    own = Session(table)
    own.undo()
    assert own.log == []
    own.stage("rename_column", "col_1 to a", E.rename_column, column="col_1", name="a")
    with pytest.raises(RuntimeError):
        own.stage("x", "", E.rename_column, column="a", name="b")
    own.reject()
    own.apply("rename_column", E.rename_column, column="col_1", name="a")
    own.apply("delete_columns", E.delete_columns, columns=["col_2"])
    after = own.current.columns
    own.undo()
    own.undo()
    assert own.current is table
    own.redo()
    own.redo()
    assert own.current.columns == after
    own.undo()
    own.apply("delete_columns", E.delete_columns, columns=["col_3"])
    own.redo()  # a new change forgets what was undone
    assert own.current.columns == ["page_number", "row_number", "a", "col_2"]
    report = json.loads(json.dumps(own.report()))
    assert report["corrected_columns"][2] == "a" and len(report["operation_history"]) == 8
    assert operation_log("s", own.log, spark).count() == 8
    assert state_key("k") == "k:all-pages" and state_key("k", [3, 1]) == "k:pages:3,1"


def test_exports(table, tmp_path):
    sinks.write_csv(table, str(tmp_path / "csv"), single_file=True)
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text.splitlines()[0] == "page_number,row_number,col_1,col_2,col_3" and len(text.splitlines()) == 5


@pytest.fixture
def two(spark):
    """Two documents whose page numbers repeat."""
    data = [("d1", 1, 1, "a b", "x"), ("d1", 1, 2, "c", "y"), ("d2", 1, 1, "e f", "z"), ("d2", 1, 2, "g", None), ("d2", 2, 1, "h", "w")]
    return spark.createDataFrame(data, "doc_key string, page_number int, row_number int, col_1 string, col_2 string")


def by_document(df):
    return [tuple(r) for r in df.orderBy("doc_key", "page_number", "row_number").collect()]


def test_edits_of_one_document_leave_others(two):
    d1, d2 = ("d1", 1), ("d2", 1)
    rest = [("d1", 1, 1, "a b", "x"), ("d1", 1, 2, "c", "y")]
    own = by_document(two)
    assert by_document(E.delete_rows(two, [(d2, 1)])) == [*rest, ("d2", 1, 1, "g", None), own[4]]
    assert by_document(E.edit_cell(two, d2, 1, "col_1", "n")) == [*rest, ("d2", 1, 1, "n", "z"), *own[3:]]
    assert by_document(E.move_cell(two, (d1, 1, "col_1"), (d2, 2, "col_2")))[0][3] == "" and by_document(E.move_cell(two, (d1, 1, "col_1"), (d2, 2, "col_2")))[3][4] == "a b"
    assert by_document(E.split_row(two, d2, 1, " ")) == [*rest, ("d2", 1, 1, "e", "z"), ("d2", 1, 2, "f", ""), ("d2", 1, 3, "g", None), own[4]]
    assert by_document(E.merge_rows(two, [(d2, 2), (d2, 1)])) == [*rest, ("d2", 1, 1, "e f g", "z"), own[4]]
    assert by_document(E.merge_rows(two, [(d2, 1), (d1, 2)])) == [rest[0], ("d1", 1, 2, "c e f", "y z"), ("d2", 1, 1, "g", None), own[4]]
    assert by_document(E.insert_row(two, d2, 1)) == [*rest, own[2], ("d2", 1, 2, "", ""), ("d2", 1, 3, "g", None), own[4]]
    edited = L.page_slice(two, d2).fillna("n")
    changed, yes = E.commit_page_edits(two, d2, edited)
    assert yes and by_document(changed) == [*own[:3], ("d2", 1, 2, "g", "n"), own[4]]
    assert L.page_slice(two, d2).columns == ["row_number", "col_1", "col_2"] and L.page_slice(two, d2).count() == 2
    assert by_document(E.normalize_row_numbers(two.filter("row_number > 1"))) == [("d1", 1, 1, "c", "y"), ("d2", 1, 1, "g", None)]
    assert E.insert_column(two).columns[-1] == "col_3"
    for wrong in (lambda: E.delete_rows(two, [(1, 1)]), lambda: E.edit_cell(two, ("d1", 2), 1, "col_1", "v"), lambda: E.insert_row(two, 1)):
        with pytest.raises(ValueError):
            wrong()


def test_guides_of_one_document_leave_others(two, spark):
    boxes = [(d, 1, i, t, x, y, x + 10, y + 8.0) for d in ("d1", "d2") for i, (t, x, y) in enumerate([("a", 0.0, 0.0), ("b", 20.0, 2.0), ("c", 0.0, 20.0)])]
    items = spark.createDataFrame(boxes, "doc_key string, page_number int, item_index int, text string, x0 double, y0 double, x1 double, y1 double")
    found = [("d1", 1, 1, 1, "a b", [0, 1]), ("d1", 1, 2, 1, "c", [2]), ("d2", 1, 1, 1, "a", [0]), ("d2", 1, 2, 1, "b c", [1, 2])]
    cells = spark.createDataFrame(found, "doc_key string, page_number int, row_index int, col_index int, text string, source_item_indexes array<int>").withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(0.0), "y1": F.lit(0.0)})
    assert sorted(tuple(r) for r in G.columns_crossing(cells, items, 10).collect()) == [("d1", 1, 1), ("d2", 1, 1)]
    assert sorted(tuple(r) for r in G.rows_crossing(cells, items, 10).collect()) == [("d2", 1, 2)]
    assert sorted(tuple(r) for r in G.cells_crossing_rows(cells, items, 10).collect()) == [("d2", 1, 2)]
    assert G.partition_cells(cells, items, "x", 10).count() == 4
    own = by_document(two)
    split = by_document(G.split_column_visual(two, cells, items, ("d2", 1), "col_1", 10))
    assert split == [("d1", 1, 1, "a b", "", "x"), ("d1", 1, 2, "c", "", "y"), ("d2", 1, 1, "a", "", "z"), ("d2", 1, 2, "c", "b", None), ("d2", 2, 1, "h", "", "w")]
    assert by_document(G.split_row_visual(two, cells, items, ("d2", 1), 2, 10)) == [*own[:3], ("d2", 1, 2, "b", None), ("d2", 1, 3, "c", ""), own[4]]
    assert G.crossing_row_numbers(two, cells, items, ("d2", 1), 10) == [2] and G.crossing_row_numbers(two, cells, items, ("d1", 1), 10) == []
    long = two.select("doc_key", "page_number", "row_number", F.lit(1).alias("col_index"), F.col("col_1").alias("text"))
    looked = {(r.doc_key, r.row_number): r.source_item_indexes for r in L.cell_lookup(long, cells).filter("page_number = 1").collect()}
    assert looked == {("d1", 1): [0, 1], ("d1", 2): [2], ("d2", 1): [0], ("d2", 2): [1, 2]}


def test_sessions_open_once(two):
    made, sessions = [], Sessions()

    def make():
        made.append(1)
        return two

    one = sessions.open(state_key("k"), make)
    one.apply("delete_columns", E.delete_columns, columns=["col_2"])
    assert sessions.open(state_key("k"), make) is one and len(made) == 1 and one.current.columns[-1] == "col_1"
    assert sessions.open(state_key("k", [1]), make) is not one and len(made) == 2
    assert one.draft("k", ("d2", 1)).columns == ["row_number", "col_1"]
    sessions.close(state_key("k"))
    assert sessions.open(state_key("k"), make).log == []


def test_parsed_once(two, spark, tmp_path):
    made = []

    def parse():
        made.append(1)
        return two

    for _ in range(2):
        assert rows(memoised(spark, str(tmp_path), "k", "v1", None, parse)) == rows(two)
    assert len(made) == 1
    memoised(spark, str(tmp_path), "k", "v2", None, parse)
    memoised(spark, str(tmp_path), "k", "v2", [1], parse)
    assert len(made) == 3
