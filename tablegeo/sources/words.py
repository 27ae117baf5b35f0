"""Sources of positioned words: plain text in a fixed pitch and files of word boxes (pages and scans: ``pages``).

``register`` makes ``spark.read.format("wordboxes")`` available: JSON lines with doc_key, page_number, text,
confidence and either quad (list of [x, y]) or x0, y0, x1, y1, read in parallel by ranges of bytes, with
filters on document and page pushed down."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from tablegeo.schema import ITEMS
from tablegeo.sources.pruning import Pruned, listed, open_file, size_of, task_bytes

PITCH, LINE, HEIGHT = 6.0, 12.0, 8.0
#: Bytes of a file that one task reads.
TASK_BYTES = 64 << 20


def text_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words of texts laid out in a fixed pitch: lines at newlines, words at spaces, blanks dropped."""
    lines = df.select(F.col(key).alias("page_number"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    words = lines.select("page_number", "line_no", F.split("line", " ").alias("w"))
    each = words.select("page_number", "line_no", F.posexplode("w").alias("word_no", "text"), "w").filter("text <> ''")
    before = F.aggregate(F.slice("w", 1, F.col("word_no")), F.lit(0), lambda n, w: n + F.length(w) + 1)
    placed = each.withColumn("x0", PITCH * before).withColumn("x1", F.col("x0") + PITCH * F.length("text"))
    return placed.withColumn("y0", LINE * F.col("line_no")).withColumn("y1", F.col("y0") + HEIGHT).drop("w")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def _line_before(file: BinaryIO, end: int) -> tuple[bytes, int]:
    """The last line that is not blank among those that start before byte ``end``, whole, and where the next starts."""
    size = 1 << 12
    while True:
        start = max(0, end - size)
        file.seek(start)
        chunk = file.read(end - start) + file.readline()
        whole = chunk if start == 0 else chunk[chunk.find(b"\n") + 1 :] if b"\n" in chunk[:-1] else b""
        found = [line for line in whole.split(b"\n") if line.strip()]
        if found or start == 0:
            return (found[-1] if found else b""), start + len(chunk)
        size *= 4


class _Reader(DataSourceReader):
    """Files in ranges of bytes.  A range owns the pages whose first line starts in it, and reads those to their end, so
    boxes of a page are numbered by one task."""

    def __init__(self, options: dict[str, str]):
        self.paths, self.task_bytes, self.wanted = listed(options), task_bytes(options, TASK_BYTES), Pruned()
        if asked := options.get("pages", ""):
            self.wanted.only(int(p) for p in asked.split(",") if p)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return self.wanted.take(filters)

    def partitions(self) -> list[InputPartition]:
        ranges = [_Range(p, start, start + self.task_bytes) for p in self.paths for start in range(0, size_of(p), self.task_bytes)]
        return ranges or [_Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        page_of = lambda w: (w.get("doc_key", partition.path), int(w["page_number"]))
        with open_file(partition.path) as file:
            earlier, at = _line_before(file, partition.start) if partition.start else (b"", 0)
            now, index, owned = page_of(json.loads(earlier)) if earlier.strip() else None, -1, False
            file.seek(at)
            while line := file.readline():
                here, at = at, at + len(line)
                if not line.strip():
                    continue
                w = json.loads(line)
                if (page := page_of(w)) != now:
                    if here >= partition.end:
                        return
                    now, index, owned = page, -1, True
                elif here >= partition.end and not owned:
                    return
                text = str(w.get("text") or "").strip()
                if not text or not owned:
                    continue
                index += 1
                if self.wanted.has_document(page[0]) and self.wanted.has_page(page[1]):
                    quad = w.get("quad") or [[w["x0"], w["y0"]], [w["x1"], w["y0"]], [w["x1"], w["y1"]], [w["x0"], w["y1"]]]
                    xs, ys = [float(p[0]) for p in quad], [float(p[1]) for p in quad]
                    yield (*page, index, text, float(w.get("confidence", 1.0)), min(xs), min(ys), max(xs), max(ys), [{"x": x, "y": y} for x, y in zip(xs, ys, strict=True)])


class WordBoxes(DataSource):
    """Word boxes in JSON lines, the lines of a page next to each other; options ``paths`` (comma list, on storage that
    all executors reach), ``pages`` (comma list), ``bytesPerTask``.  Filters on document and page are pushed down."""

    @classmethod
    def name(cls) -> str:
        return "wordboxes"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WordBoxes)


def boxes_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same records from a text frame (``spark.read.text``), for storage that only Spark reads."""
    kind = "doc_key string, page_number int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, quad array<array<double>>"
    w = lines.select(F.from_json(column, kind).alias("w")).select("w.*")
    corner = F.array(*(F.array(a, b) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    quad = F.transform(F.coalesce("quad", corner), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return w.select("doc_key", "page_number", "text", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), quad.alias("quad"))
