"""Pages of documents: words of the text layer and what a recogniser finds, in one stage from file to boxes.

A document is opened once in the task that reads its file.  Each page's words are taken, the page is rendered,
recognised as a whole and tile by tile, and let go before the next one: images never leave the task and never meet a
shuffle, and batches going in are bounded by bytes.  Files come from Spark's readers (``spark.read.format("binaryFile")``
reads any store) as (doc_key, content).  By default a file is worked on where it is read; ``pages_per_task`` deals
large files out in slices of pages, which moves a file once for each slice.

What opens, counts, reads and renders is a plug-in (``Plugin``); so is the recogniser.  ``documentpages`` is a Python
data source for files that all executors mount: its partitions are slices of files, and filters on document and page
are pushed into it.

Null contents, and documents of no page, give no rows.  Pages that are asked for and don't exist are left out, pages
asked for twice are read once.  A plug-in's error fails the task, naming the document and page.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from importlib import import_module
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from tablegeo.operators.items import merge_items
from tablegeo.schema import ITEMS, POINT
from tablegeo.sources.pruning import Pruned, listed, open_file, size_of, task_bytes

#: A word: text, confidence, corners in page points.
Word = tuple[str, float, list[tuple[float, float]]]

#: Bytes of files in an Arrow batch, and bytes of a file in one partition of the data source.
BATCH_BYTES = 64 << 20
TASK_BYTES = 64 << 20
#: Lists of pages are broadcast up to this number of documents (a few numbers each); beyond, files are joined by shuffle.
BROADCAST_ROWS = 200_000

DETECTIONS = f"doc_key string, page_number int, priority int, seq bigint, item_index int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, quad array<{POINT}>"
RENDERED = "doc_key string, page_number int, width int, height int, scale double, image binary"

#: Recogniser options tried in order.
OCR_CONFIGS: list[dict[str, Any]] = [
    {
        "text_score": 0.25,
        "min_height": 8,
        "min_side_len": 16,
        "max_side_len": 4000,
        "det_limit_side_len": 1216,
        "det_limit_type": "min",
        "det_thresh": 0.2,
        "det_box_thresh": 0.35,
        "det_unclip_ratio": 1.8,
        "return_word_box": True,
    },
    {},
]


@dataclass(frozen=True)
class Plugin:
    """How documents are opened and read: ``open(content)``, ``count(document)``, ``words(document, page)`` and
    ``render(document, page, dpi)`` -> (width, height, pixels a point, RGB bytes row by row); pages count from 1."""

    open: Callable[[bytes], Any]
    count: Callable[[Any], int]
    words: Callable[[Any, int], Iterable[Word]]
    render: Callable[[Any, int, int], tuple[int, int, float, bytes]] | None = None
    close: Callable[[Any], None] = lambda document: None


@dataclass(frozen=True)
class Recogniser:
    """``make(**options)`` builds an engine, once in each Python worker; ``recognise(engine, RGB bytes, width, height)``
    gives (corners, text, score) in pixels of what it was shown; entries with a null are left out."""

    make: Callable[..., Any]
    recognise: Callable[[Any, bytes, int, int], Iterable[tuple]]
    options: tuple = tuple(OCR_CONFIGS)


def _fitz():
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF pages needs the package PyMuPDF") from e
    return fitz


def _pdf_words(document: Any, page: int) -> Iterator[Word]:
    for x0, y0, x1, y1, text, *_ in document[page - 1].get_text("words", sort=True):
        yield text, 1.0, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def _pdf_render(document: Any, page: int, dpi: int) -> tuple[int, int, float, bytes]:
    picture = document[page - 1].get_pixmap(dpi=dpi, alpha=False)
    return picture.width, picture.height, dpi / 72, picture.samples


#: PDF files; needs PyMuPDF where it runs.
PDF = Plugin(lambda content: _fitz().open(stream=content, filetype="pdf"), lambda d: d.page_count, _pdf_words, _pdf_render, lambda d: d.close())


def _text_words(pages: list[list[str]], page: int, pitch: float = 6.0, line_height: float = 12.0, height: float = 8.0) -> Iterator[Word]:
    for number, line in enumerate(pages[page - 1]):
        at, top = 0, line_height * number
        for word in line.split(" "):
            if word:
                left, right = pitch * at, pitch * (at + len(word))
                yield word, 1.0, [(left, top), (right, top), (right, top + height), (left, top + height)]
            at += len(word) + 1


def text_pages(lines: int = 50) -> Plugin:
    """Plain text (UTF-8) laid out in a fixed pitch, so many lines to a page; an empty text is one page."""

    def split(content: bytes) -> list[list[str]]:
        rows = content.decode("utf-8", "replace").split("\n")
        return [rows[i : i + lines] for i in range(0, len(rows), lines)]

    return Plugin(split, len, _text_words)


_ENGINES: dict = {}


def engine_of(make: Callable[..., Any], options: Iterable[dict] = OCR_CONFIGS, key: Any = None) -> Any:
    """The recogniser of this Python worker, made when it is first asked for, with the richest of the ``options`` whose
    names its signature takes (all of them where the signature is open or unknown).  ``key`` tells equal makers apart
    from others (functions are new objects in each task); an engine of another key is let go."""
    key = make if key is None else key
    if key not in _ENGINES:
        _ENGINES.clear()
        try:
            known = inspect.signature(make).parameters
            free = any(p.kind is p.VAR_KEYWORD for p in known.values())
        except (TypeError, ValueError):
            known, free = {}, True
        _ENGINES[key] = make(**next(o for o in [*options, {}] if free or set(o) <= set(known)))
    return _ENGINES[key]


def tile_corners(length: int, tile: int, overlap: int) -> list[int]:
    """Starts of tiles along a side; the last one ends at the edge."""
    if length <= tile:
        return [0]
    return sorted({*range(0, length - tile + 1, max(1, tile - overlap)), length - tile})


def _columns(rows: list[tuple], kind: str) -> pa.RecordBatch:
    schema = _arrow(kind)
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), f"array<{POINT}>": pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))}


@cache
def _arrow(kind: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[type_]) for name, type_ in (column.split(" ") for column in kind.split(", "))])


#: What a box of one look is held as until its batch leaves: these columns, the corners' coordinates one after another as
#: they were given, and the scale and offset of the look.
_GIVEN = ["doc_key", "page_number", "priority", "seq", "item_index", "text", "confidence"]


def _corners(corners: Iterable) -> list[float]:
    flat = [float(v) for x, y in corners for v in (x, y)]
    if not flat:
        raise ValueError("a box without corners")
    return flat


def _boxes(rows: list[tuple], kind: str) -> pa.RecordBatch:
    """Held boxes as a batch of DETECTIONS or ITEMS; all corners are moved to page points at once."""
    schema = _arrow(kind)
    if not rows:
        return _columns([], kind)
    *given, flat, scale, left, top = zip(*rows, strict=True)
    many = np.array([len(f) for f in flat]) // 2
    points = np.fromiter(chain.from_iterable(flat), np.float64).reshape(-1, 2)
    scale = np.repeat(np.array(scale, np.float64), many)
    x, y = ((points[:, i] + np.repeat(np.array(offset, np.float64), many)) / scale for i, offset in enumerate((left, top)))
    ends = np.cumsum(many)
    first = ends - many
    columns: dict[str, Any] = dict(zip(_GIVEN, given, strict=True)) | {"x0": np.minimum.reduceat(x, first), "y0": np.minimum.reduceat(y, first), "x1": np.maximum.reduceat(x, first), "y1": np.maximum.reduceat(y, first)}
    columns["quad"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def _native(plugin: Plugin, document: Any, key: str, page: int) -> list[tuple]:
    kept = ((text.strip(), confidence, corners) for text, confidence, corners in plugin.words(document, page) if text.strip())
    return [(key, page, 1, i, i, text, float(confidence), _corners(corners), 1.0, 0, 0) for i, (text, confidence, corners) in enumerate(kept)]


def _scanned(plugin: Plugin, engine: Any, recognise: Callable, document: Any, key: str, page: int, dpi: int, tile: int, overlap: int) -> Iterator[list[tuple]]:
    """Boxes of the whole page, then of each tile: one list for each look at the image."""
    width, height, scale, samples = plugin.render(document, page, dpi)
    image = np.frombuffer(samples, np.uint8)[: 3 * width * height].reshape(height, 3 * width)
    looks = [(2, 0, 0, width, height)]
    looks += [(3, x, y, min(x + tile, width), min(y + tile, height)) for y in tile_corners(height, tile, overlap) for x in tile_corners(width, tile, overlap)]
    for priority, left, top, right, bottom in looks:
        if right <= left or bottom <= top:
            continue
        part, rows = np.ascontiguousarray(image[top:bottom, 3 * left : 3 * right]).tobytes(), []  # whole lines are copied, not pixels
        seq = top * (1 << 40) + left * (1 << 20)
        for entry, (corners, text, score) in enumerate(recognise(engine, part, right - left, bottom - top)):
            if corners is not None and text is not None and score is not None and (stripped := text.strip()):
                rows.append((key, page, priority, seq + entry, entry, stripped, float(score), _corners(corners), scale, left, top))
        del part
        yield rows


def _bounded(spark: SparkSession) -> None:
    """Batches of files are bounded by bytes in this session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str((1 << 31) - 1))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _dealt(files: DataFrame, pages: DataFrame | None, pages_per_task: int | None, count: Callable[[bytes], int]) -> DataFrame:
    """(doc_key, content, wanted): the files whose pages are asked for, with the sorted pages (null: all of them)."""
    _bounded(files.sparkSession)
    own = files.select("doc_key", "content").filter("content is not null")
    if pages is not None:
        wanted = pages.select("doc_key", "page_number").filter("page_number is not null").groupBy("doc_key").agg(F.sort_array(F.collect_set("page_number")).alias("wanted"))
        if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        own = own.join(wanted, "doc_key")
    else:
        own = own.withColumn("wanted", F.lit(None).cast("array<int>"))
    if pages_per_task is None:
        return own
    if pages is None:
        own = own.drop("wanted").join(_counted(own, count).select("doc_key", F.sequence(F.lit(1), "n_pages").alias("wanted")), "doc_key")
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("wanted") - 1) / pages_per_task).cast("int")), lambda i: F.slice("wanted", i * pages_per_task + 1, pages_per_task))
    return own.filter("size(wanted) > 0").select("doc_key", "content", F.explode(slices).alias("wanted")).repartition("doc_key", "wanted")


def _counted(files: DataFrame, count: Callable[[bytes], int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _columns([(k.as_py(), int(count(c.as_py()))) for k, c in zip(batch.column(0), batch.column(1), strict=True)], "doc_key string, n_pages int")

    return files.select("doc_key", "content").mapInArrow(run, "doc_key string, n_pages int").filter("n_pages > 0")


def _count_with(plugin: Plugin) -> Callable[[bytes], int]:
    def count(content: bytes) -> int:
        document = plugin.open(content)
        try:
            return plugin.count(document)
        finally:
            plugin.close(document)

    return count


def count_pages(files: DataFrame, plugin: Plugin = PDF) -> DataFrame:
    """(doc_key, n_pages) of files (doc_key, content); ``operators.items.page_numbers`` lists the pages."""
    _bounded(files.sparkSession)
    return _counted(files.filter("content is not null"), _count_with(plugin))


#: Rows of a batch that a task gives out; images go page by page.
ROWS_PER_BATCH = 4096


def _each_page(plugin: Plugin, work: Callable[[Any, str, int], Iterator[list[tuple]]], kind: str, batch_of: Callable[[list[tuple], str], pa.RecordBatch] = _columns) -> Callable:
    """A task: each document of its batches is opened once and ``work`` gives rows page by page, which leave together
    with those of other pages, as batches that ``batch_of`` makes."""
    most = 1 if "binary" in kind else ROWS_PER_BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(len(batch)):
                key, wanted = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                document = plugin.open(batch.column(1)[i].as_py())
                try:
                    last = plugin.count(document)
                    for page in range(1, last + 1) if wanted is None else (p for p in wanted if 1 <= p <= last):
                        try:
                            for rows in work(document, key, page):
                                held += rows
                                if len(held) >= most:
                                    yield batch_of(held, kind)
                                    held = []
                        except Exception as e:
                            raise RuntimeError(f"page {page} of {key}: {e}") from e
                finally:
                    plugin.close(document)
        if held:
            yield batch_of(held, kind)

    return run


def read_pages(files: DataFrame, pages: DataFrame | None = None, plugin: Plugin = PDF, pages_per_task: int | None = None) -> DataFrame:
    """ITEMS: the text layer's words of the pages asked for (doc_key, page_number; none: all pages)."""

    def work(document: Any, key: str, page: int) -> Iterator[list[tuple]]:
        yield _native(plugin, document, key, page)

    return _dealt(files, pages, pages_per_task, _count_with(plugin)).mapInArrow(_each_page(plugin, work, ITEMS, _boxes), ITEMS)


def render_pages(files: DataFrame, pages: DataFrame | None = None, plugin: Plugin = PDF, dpi: int = 300, pages_per_task: int | None = None) -> DataFrame:
    """RENDERED: images of pages, for writing them away; what follows a scan is ``detections``."""

    def work(document: Any, key: str, page: int) -> Iterator[list[tuple]]:
        width, height, scale, samples = plugin.render(document, page, dpi)
        yield [(key, page, width, height, scale, bytes(samples))]

    return _dealt(files, pages, pages_per_task, _count_with(plugin)).mapInArrow(_each_page(plugin, work, RENDERED), RENDERED)


def detections(
    files: DataFrame,
    recogniser: Recogniser,
    pages: DataFrame | None = None,
    plugin: Plugin = PDF,
    dpi: int = 300,
    tile: int = 1400,
    overlap: int = 220,
    pages_per_task: int | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """DETECTIONS of pages from three looks: the text layer (priority 1), the whole page's image (2) and its tiles (3),
    boxes in page points; ``seq`` orders the boxes of one look.  ``profile`` asks for what engines need (memory, GPUs)
    in this stage only."""
    make, recognise, options = recogniser.make, recogniser.recognise, recogniser.options
    key = hashlib.sha256(cloudpickle.dumps((make, options))).hexdigest()

    def work(document: Any, doc: str, page: int) -> Iterator[list[tuple]]:
        yield _native(plugin, document, doc, page)
        yield from _scanned(plugin, engine_of(make, options, key), recognise, document, doc, page, dpi, tile, overlap)

    return _dealt(files, pages, pages_per_task, _count_with(plugin)).mapInArrow(_each_page(plugin, work, DETECTIONS, _boxes), DETECTIONS, profile=profile)


def scanned_items(files: DataFrame, recogniser: Recogniser, **how: Any) -> DataFrame:
    """ITEMS of pages: ``detections`` with repeated ones merged away by priority, numbered anew."""
    return merge_items(detections(files, recogniser, **how)).select(*(c.split()[0] for c in ITEMS.split(", ")))


# -- the data source ---------------------------------------------------------------------------------------


class _Slice(InputPartition):
    def __init__(self, path: str, part: int, parts: int):
        super().__init__((path, part, parts))
        self.path, self.part, self.parts = path, part, parts


def _named(plugin: str) -> Plugin:
    """The plug-in that ``module:attribute`` names; an attribute that isn't one is called for it."""
    module, _, attribute = plugin.partition(":")
    found = getattr(import_module(module), attribute)
    return found if isinstance(found, Plugin) else found()


class _PageReader(DataSourceReader):
    """Pages in slices of files.  A slice of a file with n pages covers those from n * part / parts on, so nobody has to
    count pages before."""

    def __init__(self, options: dict[str, str]):
        self.paths = listed(options)
        self.plugin = options.get("plugin", f"{__name__}:PDF")
        self.task_bytes = task_bytes(options, TASK_BYTES)
        self.wanted = Pruned()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return self.wanted.take(filters)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in filter(self.wanted.has_document, self.paths):
            parts = max(1, -(-size_of(path) // self.task_bytes))
            out += [_Slice(path, i, parts) for i in range(parts)]
        return out or [_Slice("", 0, 1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        plugin = _named(self.plugin)
        with open_file(partition.path) as file:
            document = plugin.open(file.read())
        try:
            n = plugin.count(document)
            first, end = n * partition.part // partition.parts + 1, n * (partition.part + 1) // partition.parts
            for page in filter(self.wanted.has_page, range(first, end + 1)):
                yield _boxes(_native(plugin, document, partition.path, page), ITEMS)
        finally:
            plugin.close(document)


class DocumentPages(DataSource):
    """ITEMS of documents' text layers, the path being the key.  Options: ``paths`` (comma list, on storage that all
    executors reach), ``plugin`` (module:attribute of a ``Plugin`` or of what makes one; by default PDF),
    ``bytesPerTask`` (files beyond are read in slices of pages)."""

    @classmethod
    def name(cls) -> str:
        return "documentpages"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema: Any) -> DataSourceReader:
        return _PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("documentpages")`` available, filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentPages)
