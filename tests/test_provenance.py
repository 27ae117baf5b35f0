"""Boxes carried through corrections, and guides that meet them."""

from __future__ import annotations

import pytest

from tablegeo.operators import edits as E
from tablegeo.operators import guides as G
from tablegeo.operators import provenance as P
from tablegeo.schema import data_columns

ITEMS = "doc_key string, page_number int, item_index int, text string, x0 double, y0 double, x1 double, y1 double"
PAGE = ("d", 1)


def frames(spark):
    """Three rows of two cells; each cell is two boxes, the second one 10 to the right and 4 lower."""
    items, cells, table = [], [], []
    for doc in ("d", "e"):
        for r in (1, 2, 3):
            for c in (1, 2):
                first = 4 * (r - 1) + 2 * (c - 1)
                for k in (0, 1):
                    x, y = 100.0 * c + 10 * k, 20.0 * r + 4 * k
                    items.append((doc, 1, first + k, f"{doc}{r}{c}{'ab'[k]}", x, y, x + 4, y + 4))
                cells.append((doc, 1, r, c, [first, first + 1]))
            table.append((doc, 1, r, *(f"{doc}{r}{c}a {doc}{r}{c}b" for c in (1, 2))))
    return (
        spark.createDataFrame(table, "doc_key string, page_number int, row_number int, col_1 string, col_2 string"),
        spark.createDataFrame(cells, "doc_key string, page_number int, row_index int, col_index int, source_item_indexes array<int>"),
        spark.createDataFrame(items, ITEMS),
    )


def held(table, doc="d") -> dict:
    """Boxes by row and column of a document's only page, and by page where they come from elsewhere."""
    out = {}
    for r in table.filter(table.doc_key == doc).collect():
        for e in r["_boxes"]:
            if e.boxes:
                out[r.row_number, e.column] = [b.item_index if b.doc_key == doc else (b.doc_key, b.item_index) for b in e.boxes]
    return out


@pytest.fixture
def three(spark):
    table, cells, items = frames(spark)
    return P.traced(table, cells), items


def test_traced(spark, three):
    table, items = three
    assert held(table) == {(r, f"col_{c}"): [4 * (r - 1) + 2 * (c - 1), 4 * (r - 1) + 2 * (c - 1) + 1] for r in (1, 2, 3) for c in (1, 2)}
    assert data_columns(table) == ["col_1", "col_2"]
    plain, cells, _ = frames(spark)
    assert held(P.traced(plain, cells.limit(0))) == {} and P.traced(plain, cells).count() == 6
    with pytest.raises(ValueError):
        P.sides(plain, items, "x", 1.0)


def test_columns_keep_boxes(three):
    table, _ = three
    whole = held(table)
    merged = held(E.merge_columns(table, ["col_2", "col_1"], "both"))
    assert merged == {(r, "both"): whole[r, "col_2"] + whole[r, "col_1"] for r in (1, 2, 3)}
    split = held(E.split_column(table, "col_1", " "))
    assert split[1, "col_1_left"] == split[1, "col_1_right"] == [0, 1] and split[1, "col_2"] == [2, 3]
    assert held(E.insert_column(table, "col_1", "new")) == whole
    assert held(E.rename_column(table, "col_1", "x")) == {(r, "x" if c == "col_1" else c): v for (r, c), v in whole.items()}
    assert held(E.delete_columns(table, ["col_1"])) == {k: v for k, v in whole.items() if k[1] == "col_2"}


def test_rows_and_cells_keep_boxes(three):
    table, _ = three
    whole = held(table)
    assert held(E.edit_cell(table, PAGE, 1, "col_1", "typed")) == whole
    assert held(E.delete_rows(table, [(PAGE, 1)])) == {(r - 1, c): v for (r, c), v in whole.items() if r > 1}
    assert held(E.insert_row(table, PAGE, 1)) == {(r + (r > 1), c): v for (r, c), v in whole.items()}
    assert held(E.merge_rows(table, [(PAGE, 1), (PAGE, 3)])) == {(1, "col_1"): [0, 1, 8, 9], (1, "col_2"): [2, 3, 10, 11], (2, "col_1"): [4, 5], (2, "col_2"): [6, 7]}
    split = held(E.split_row(table, PAGE, 1, " "))
    assert split[1, "col_1"] == split[2, "col_1"] == [0, 1] and split[4, "col_2"] == [10, 11]
    moved = held(E.move_cell(table, (PAGE, 1, "col_1"), (PAGE, 2, "col_2")))
    assert (1, "col_1") not in moved and moved[2, "col_2"] == [6, 7, 0, 1]
    same = held(E.move_cell(table, (PAGE, 1, "col_1"), (PAGE, 1, "col_2")))
    assert same[1, "col_2"] == [2, 3, 0, 1] and (1, "col_1") not in same
    below = held(E.move_cell(table, (PAGE, 1, "col_1"), (PAGE, 3, "col_1")))
    assert below[3, "col_1"] == [8, 9, 0, 1] and (1, "col_1") not in below
    away = E.move_cell(table, (PAGE, 1, "col_1"), (("e", 1), 1, "col_1"))
    assert held(away, "e")[1, "col_1"] == [0, 1, ("d", 0), ("d", 1)]
    blank = E.move_cell(E.edit_cell(table, PAGE, 1, "col_1", " "), (PAGE, 1, "col_1"), (PAGE, 2, "col_1"))
    assert held(blank)[2, "col_1"] == [4, 5]
    page = table.filter("doc_key = 'd'").select("row_number", "col_1", "col_2").replace("d11a d11b", "typed")
    edited, changed = E.commit_page_edits(table, PAGE, page)
    assert changed and held(edited) == whole and edited.count() == 6


def cell_rows(table, *columns):
    return [tuple(r[c] for c in columns) for r in table.filter("doc_key = 'd'").orderBy("row_number").collect()]


def test_guides_after_edits(three):
    """Columns and rows are not where they were, yet the guides cut what the cells hold."""
    table, items = three
    shifted = E.delete_rows(E.insert_column(E.rename_column(table, "col_2", "value"), "col_1", "new"), [(PAGE, 1)])
    cut = G.split_columns_visual(shifted, None, items, PAGE, ["value", "new", "no_such"], 206.0)
    assert cell_rows(cut, "col_1", "new_left", "new_right", "value_left", "value_right") == [("d21a d21b", "", "", "d22a", "d22b"), ("d31a d31b", "", "", "d32a", "d32b")]
    assert held(cut)[1, "value_left"] == [6] and held(cut)[1, "value_right"] == [7]
    assert {r.value_left for r in cut.filter("doc_key = 'e'").collect()} == {"e12a e12b", "e22a e22b", "e32a e32b"} and held(cut, "e")[1, "value_left"] == [2, 3]
    again = G.split_column_visual(cut, None, items, PAGE, "value_right", 500.0, "p", "q")
    assert cell_rows(again, "p", "q") == [("d22b", ""), ("d32b", "")]
    rows = G.split_rows_visual(shifted, None, items, PAGE, [1], 44.0)
    assert cell_rows(rows, "col_1", "new", "value") == [("d21a", "", "d22a"), ("d21b", "", "d22b"), ("d31a d31b", "", "d32a d32b")]
    assert held(rows)[1, "col_1"] == [4] and held(rows)[2, "col_1"] == [5] and held(rows)[3, "col_1"] == [8, 9]
    with pytest.raises(ValueError):
        G.split_row_visual(shifted, None, items, PAGE, 3, 44.0)
    with pytest.raises(ValueError):
        G.split_column_visual(shifted, None, items, PAGE, "value", 1.0, "col_1", "x")
    assert cell_rows(G.split_rows_visual(shifted, None, items, PAGE, [], 44.0), "value") == cell_rows(shifted, "value")


def test_crossings_after_edits(three):
    table, items = three
    moved = E.move_cell(table, (PAGE, 1, "col_1"), (("e", 1), 2, "col_2"))
    assert sorted(map(tuple, P.columns_crossing(moved, items, 106.0).collect())) == [("d", 1, "col_1"), ("e", 1, "col_1"), ("e", 1, "col_2")]
    below = E.delete_rows(table, [(PAGE, 1)])
    assert [tuple(r) for r in P.rows_crossing(below, items, 44.0).orderBy("doc_key").collect()] == [("d", 1, 1), ("e", 1, 2)]
    both = E.merge_rows(table, [(PAGE, 1), (PAGE, 2)])
    assert sorted(map(tuple, P.cells_crossing_rows(both, items, 34.0).collect())) == [("d", 1, 1)]
    gone = items.filter("item_index <> 0")
    assert P.sides(table, gone, "x", 106.0).filter("doc_key = 'd' and row_number = 1 and column = 'col_1'").first()["n_before"] == 0


def test_untouched_tables_split_as_by_position(spark):
    """A first split, that is: by position a second one of the same call meets the cells of another column."""
    table, cells, items = frames(spark)
    own = P.traced(table, cells)
    one = G.split_columns_visual(table, cells, items, PAGE, ["col_2"], 206.0)
    two = G.split_columns_visual(own, None, items, PAGE, ["col_2"], 206.0).drop("_boxes")
    assert one.columns == two.columns and one.exceptAll(two).count() == 0
    one, two = G.split_rows_visual(table, cells, items, PAGE, [1, 3], 24.0), G.split_rows_visual(own, None, items, PAGE, [1, 3], 24.0).drop("_boxes")
    assert one.exceptAll(two).count() == 0 and one.count() == two.count()
