"""Workbooks and reports: what is in the file, in which order, and what is left beside it."""

from __future__ import annotations

import json
import os
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tablegeo import sinks

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WIDE = "doc_key string, page_number int, row_number int, col_1 string, amount double, flag boolean, price decimal(10,2)"


@pytest.fixture
def wide(spark):
    data = [("b", 1, 1, 'x & <y> "z"\n\x01é', 1.5, True, None), ("a", 2, 1, None, float("nan"), False, None), ("a", 1, 2, "", None, None, None), ("a", 1, 1, "1.0", 1e16, None, None)]
    return spark.createDataFrame(data, WIDE).withColumn("price", F.lit("12.50").cast("decimal(10,2)")).repartition(3)


def sheet(path) -> list[list]:
    """Cells by their order: numbers as numbers, texts as texts."""
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None
        root = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
        names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]

    def value(cell):
        if cell.get("t") == "inlineStr":
            return cell.find(f"{MAIN}is/{MAIN}t").text or ""
        number = cell.find(f"{MAIN}v")
        return None if number is None else float(number.text)

    return [names, *([value(c) for c in row] for row in root.iter(f"{MAIN}row"))]


def alone(folder, name) -> None:
    """Nothing but the file (and its checksum) is left."""
    assert {n for n in os.listdir(folder) if not n.endswith(".crc")} == {name}


def test_workbook(wide, tmp_path):
    path = str(tmp_path / "t.xlsx")
    sinks.write_xlsx(wide, path, 'a & "b"')
    assert sheet(path) == [
        ['a & "b"'], wide.columns, ["a", 1, 1, "1.0", 1e16, None, 12.5], ["a", 1, 2, "", None, None, 12.5],
        ["a", 2, 1, None, "NaN", "False", 12.5], ["b", 1, 1, 'x & <y> "z"\né', 1.5, "True", 12.5]]
    alone(tmp_path, "t.xlsx")
    sinks.write_xlsx(wide.limit(0), path)
    assert sheet(path) == [["corrected_table"], wide.columns]
    alone(tmp_path, "t.xlsx")


def test_workbook_of_many_parts_keeps_its_order(spark, tmp_path):
    table = spark.range(0, 50_000, 1, 12).select((F.col("id") % 97).cast("int").alias("page_number"), F.col("id").alias("row_number"), F.lit("x").alias("col_1"))
    sinks.write_xlsx(table, str(tmp_path / "t.xlsx"))
    found = [(r[0], r[1]) for r in sheet(tmp_path / "t.xlsx")[2:]]
    assert found == sorted(found) and len(found) == 50_000


def test_a_sheet_has_a_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 5)
    sinks.write_xlsx(spark.range(4), str(tmp_path / "t.xlsx"))
    before = sheet(tmp_path / "t.xlsx")
    with pytest.raises(ValueError, match="5 rows"):
        sinks.write_xlsx(spark.range(5), str(tmp_path / "t.xlsx"))
    assert sheet(tmp_path / "t.xlsx") == before
    alone(tmp_path, "t.xlsx")


def test_a_failing_row_leaves_nothing(spark, tmp_path):
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("a"))
    with pytest.raises(Exception, match="no"):
        sinks.write_xlsx(broken, str(tmp_path / "t.xlsx"))
    assert os.listdir(tmp_path) == []


def test_report(wide, tmp_path):
    path, log = str(tmp_path / "r.json"), [{"timestamp": "t", "action": "é", "metadata": {"columns": ["a"], "none": None}}]
    sinks.write_metadata(wide, wide.filter("doc_key = 'b'"), log, path)
    row = lambda *v: dict(zip(wide.columns, (*v, 12.5), strict=True))
    last = row("b", 1, 1, 'x & <y> "z"\n\x01é', 1.5, True)
    before = [row("a", 1, 1, "1.0", 1e16, None), row("a", 1, 2, "", None, None), row("a", 2, 1, None, None, False), last]
    with open(path, encoding="utf-8", newline="") as file:
        assert file.read() == json.dumps({"original_rows": before, "corrected_rows": [last], "operation_history": log}, indent=2)
    alone(tmp_path, "r.json")


def test_report_of_nothing(wide, tmp_path):
    path = str(tmp_path / "r.json")
    sinks.write_metadata(wide.limit(0), wide.limit(0), [], path)
    with open(path) as file:
        assert file.read() == json.dumps({"original_rows": [], "corrected_rows": [], "operation_history": []}, indent=2)
