"""Writing page tables: CSV, XLSX and the JSON report."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablegeo.schema import page_keys


def ordered(df: DataFrame) -> DataFrame:
    """By document, page and row, as far as the table has them."""
    keys = [c for c in ("doc_key", "page_number", "row_number") if c in df.columns]
    return df.orderBy(*keys) if keys else df


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """UTF-8 with a header; in order over many files, or in one file if asked."""
    out = ordered(df)
    (out.coalesce(1) if single_file else out).write.option("header", True).option("emptyValue", "").csv(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as its CSV line (null as nothing), with the page and row it belongs to."""
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.select(*page_keys(df), "row_number", F.concat_ws(",", *map(cell, df.columns)).alias("line"))


class OneFile:
    """One file made of what tasks have written: it is put together in blocks inside the JVM of the driver, on any
    store that Spark writes to, and gets its name when it is whole.  ``parts`` writes lines in their order, one file
    for each task by Spark's own commit, so a task that runs twice leaves no trace; they are compressed, as rows of a
    report repeat their names, and only the file itself holds them at length.  The folder of parts lies beside
    the file and is removed at the end, also after an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.mark = spark, path, uuid.uuid4().hex
        self.folder = f"{path}._parts-{self.mark}"

    def _at(self, path: str) -> tuple[Any, Any]:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self, name: str, lines: DataFrame, separator: str = "\n") -> list[Any]:
        """Write the lines (one text column), compressed; the files in their order, those without lines left out."""
        lines.write.option("lineSep", separator).option("compression", "lz4").text(f"{self.folder}/{name}")
        place, files = self._at(f"{self.folder}/{name}")
        found = [(int(f.getPath().getName().split("-")[1]), f.getPath(), f.getLen()) for f in files.listStatus(place) if f.getPath().getName().startswith("part-")]
        return [file for _, file, size in sorted(found, key=lambda f: f[0]) if size > 64 or self._bytes(file)]

    def _open(self, file: Any) -> Any:
        """What was written to a part, as a stream of the driver's JVM."""
        place, files = self._at(file.toString())
        codec = self.spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(self.spark.sparkContext._jsc.hadoopConfiguration()).getCodec(place)
        return codec.createInputStream(files.open(place))

    def _copied(self, file: Any, out: Any, size: int) -> int:
        source = self._open(file)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size)
        finally:
            source.close()

    def _bytes(self, file: Any) -> int:
        return self._copied(file, self.spark.sparkContext._jvm.java.io.OutputStream.nullOutputStream(), -1)

    def copy(self, parts: list[Any], without: int = 0) -> None:
        """Append the parts, the last one without its last bytes (a separator)."""
        for i, file in enumerate(parts, start=1):
            self._copied(file, self.out, self._bytes(file) - without if without and i == len(parts) else -1)

    def put(self, text: str) -> None:
        self.out.write(bytearray(text.encode()))

    def __enter__(self) -> OneFile:
        place, files = self._at(f"{self.path}._made-{self.mark}")
        self.out = files.create(place, True)
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        made, files = self._at(f"{self.path}._made-{self.mark}")
        try:
            self.out.close()
            if kind is None:
                jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext
                how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
                context.getFileContext(made.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(made, self._at(self.path)[0], how)
        finally:
            files.delete(made, False)
            files.delete(self._at(self.folder)[0], True)


#: Rows of a worksheet (fixed by the format), the header among them.
SHEET_ROWS = 1_048_576
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _xml_text(text: Column) -> Column:
    """Text inside XML: what XML cannot hold is left out."""
    legal = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        legal = F.replace(legal, F.lit(sign), F.lit(name))
    return legal


def _cell(value: Column, kind: str) -> Column:
    text = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _xml_text(F.initcap(value.cast("string")) if kind == "boolean" else value.cast("string")), F.lit("</t></is></c>"))
    if kind in NUMBERS or kind.startswith("decimal"):
        number = F.concat(F.lit("<c><v>"), value.cast("string"), F.lit("</v></c>"))
        text = F.when(F.isnan(value) | (F.abs(value) == float("inf")), text).otherwise(number) if kind in ("float", "double") else number
    return F.coalesce(text, F.lit("<c/>"))


def xlsx_rows(df: DataFrame) -> DataFrame:
    """Each row as a row of a worksheet: numbers as numbers, other values as text, null as an empty cell.  Cells are
    placed by their order, as the format allows, so that a row need not know its number."""
    cells = [_cell(F.col(f"`{c}`"), kind) for c, kind in df.dtypes]
    return df.select(*page_keys(df), *(c for c in ("row_number",) if c in df.columns), F.concat(F.lit("<row>"), *cells, F.lit("</row>")).alias("xml"))


def write_xlsx(df: DataFrame, path: str, sheet: str = "corrected_table") -> None:
    """One workbook of one sheet, in the order of the table, written over what is there.  Tasks write the rows; the
    driver zips them in blocks, whatever their number, up to the rows that a sheet can have."""
    spark, kinds = df.sparkSession, "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{kinds}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{kinds}/spreadsheetml/2006/main" xmlns:r="{kinds}/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    entry, head = spark.sparkContext._jvm.java.util.zip.ZipEntry, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    names = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in df.columns)
    counted = Observation()
    with OneFile(spark, path) as file:
        # Numbers of rows are seen on the way: Spark counts them as they are written.
        rows = file.parts("rows", xlsx_rows(ordered(df)).select("xml").observe(counted, F.count(F.lit(1)).alias("n")))
        if counted.get["n"] >= SHEET_ROWS:
            raise ValueError(f"{counted.get['n']} rows: a sheet has {SHEET_ROWS} with its header")
        file.out = spark.sparkContext._jvm.java.util.zip.ZipOutputStream(file.out)
        for name, body in parts.items():
            file.out.putNextEntry(entry(name))
            file.put(head + body)
        file.out.putNextEntry(entry("xl/worksheets/sheet1.xml"))
        file.put(f'{head}<worksheet xmlns="{kinds}/spreadsheetml/2006/main"><sheetData><row>{names}</row>\n')
        file.copy(rows)
        file.put("</sheetData></worksheet>")
        file.out.closeEntry()


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object; NaN becomes null."""
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*page_keys(df), "row_number", F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("json"))


def _indented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JSON objects as they stand in the report: two spaces a level, two levels deep."""
    for batch in batches:
        lines = [json.dumps(json.loads(text), indent=2).replace("\n", "\n    ") for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f"    {line}" for line in lines], pa.string())], names=["line"])


def write_metadata(original: DataFrame, corrected: DataFrame, log: list[dict[str, Any]], path: str) -> None:
    """The report of one table as a JSON file: rows before and after, and the operations (``log`` is the session's own
    list).  Tasks write the rows, indented; the driver joins their files in blocks."""
    with OneFile(original.sparkSession, path) as file:
        file.put("{")
        for name, table in (("original_rows", original), ("corrected_rows", corrected)):
            lines = json_rows(ordered(table)).select("json").mapInArrow(_indented, "line string")
            parts = file.parts(name, lines, ",\n")
            file.put(f'\n  "{name}": [' + ("\n" if parts else ""))
            file.copy(parts, without=2)
            file.put(("\n  ]" if parts else "]") + ",")
        file.put(json.dumps({"operation_history": log}, indent=2, default=str)[1:])


def png_data_uri(content: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(content))
