"""Boxes: from recogniser output to clean, deduplicated and numbered items."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tablegeo.functions.geometry import center_x, center_y, corners, edge_angle, in_polygon, point, rotated, tile_starts
from tablegeo.functions.text import strip_ws
from tablegeo.operators.rows import bound_batches
from tablegeo.schema import PAGE


def page_numbers(documents: DataFrame) -> DataFrame:
    """(doc_key, page_number): 1 to n_pages of each document."""
    return documents.select("doc_key", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page_number"))


def page_scope(pages: DataFrame, request: DataFrame | None) -> DataFrame:
    """Pages asked for in request order, repeats kept, unknown ones left out; no request means all pages.
    ``request``: (request_pos, page_number)."""
    if request is None:
        return pages.withColumn("request_pos", F.col("page_number"))
    return pages.join(request, "page_number")


def tile_grid(pages: DataFrame, tile: int = 1400, overlap: int = 220) -> DataFrame:
    """Tiles of each page image: ``pages`` has width and height in pixels."""
    rows = pages.withColumn("top", F.explode(tile_starts(F.col("height"), tile, overlap)))
    tiles = rows.withColumn("left", F.explode(tile_starts(F.col("width"), tile, overlap)))
    ends = tiles.withColumn("bottom", F.least(F.col("top") + tile, F.col("height"))).withColumn("right", F.least(F.col("left") + tile, F.col("width")))
    return ends.filter("bottom > top and right > left")


def ocr_entries(raw: DataFrame) -> DataFrame:
    """Recogniser results as rows, in page points: (point + offset) / scale.  Incomplete entries are left out."""
    each = raw.select("*", F.posexplode("result").alias("entry", "e")).filter("e.quad is not null and e.text is not null and e.score is not null")
    scaled = F.transform("e.quad", lambda p: point((p["x"] + F.col("offset_x")) / F.col("scale"), (p["y"] + F.col("offset_y")) / F.col("scale")))
    return each.select(*[c for c in raw.columns if c not in ("result", "scale", "offset_x", "offset_y")], "entry", F.col("e.text").alias("text"), F.col("e.score").alias("confidence"), scaled.alias("quad"))


def build_boxes(entries: DataFrame) -> DataFrame:
    """Adds the upright hull of the quad; texts are stripped and blank ones dropped."""
    side = lambda f, axis: f(F.transform("quad", lambda p: p[axis]))
    hull = {"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")}
    return entries.withColumn("text", strip_ws(F.col("text"))).filter("text <> ''").withColumns(hull)


def native_items(words: DataFrame) -> DataFrame:
    """Words of a text layer (rectangles) as boxes of confidence 1."""
    return words.withColumn("quad", corners()).withColumn("confidence", F.lit(1.0)).withColumn("text", strip_ws(F.col("text"))).filter("text <> ''")


def viewer_rows(entries: DataFrame) -> DataFrame:
    """A recogniser's results for looking at: whole pixels, confidence to four places."""
    whole = entries.withColumn("quad", F.transform("quad", lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y"))))
    side = lambda f, axis: f(F.transform("quad", lambda p: p[axis]))
    return whole.withColumn("confidence", F.round("confidence", 4)).withColumns({"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")})


def viewer_text(rows: DataFrame) -> DataFrame:
    """All texts of a page, one to a line, in the recogniser's order."""
    ordered = F.array_sort(F.collect_list(F.struct("entry", "text")))
    return rows.groupBy("page_number").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_boxes"))


#: Boxes that can be the same meet in a grid.  The size class of a side grows by one with each doubling from 5 points on;
#: sides that can belong together differ by one class at most, and edges by less than REACH at the smaller one's class.
SMALLEST, REACH, CELL = 5.0, 4.0, 16.0


#: Boxes of one text on one page up to this number are compared with each other; more meet in the grid.
FEW = 32
#: Pairs of a grid's cells that are compared at once.
EXPANDED = 1_000_000

_EDGES = ["x0", "y0", "x1", "y1"]


def _by_page(items: DataFrame, columns: list[str]) -> DataFrame:
    """(page, _boxes): these columns of each page's boxes in one array.  Items dealt by page are not shuffled.  Made by a
    generator, a box is one value of compiled code; the page's number first sorts faster than a document's name."""
    bound_batches(items.sparkSession)
    box = F.array(F.struct(F.struct(*columns).alias("_box")))
    return items.select(*PAGE, F.inline(box)).groupBy(*reversed(PAGE)).agg(F.collect_list("_box").alias("_boxes"))


def _flat(boxes: pa.ListArray) -> tuple[pa.RecordBatch, np.ndarray]:
    """The boxes of all pages of a batch one after another, and the page of each."""
    size = boxes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.RecordBatch.from_struct_array(boxes.flatten()), np.repeat(np.arange(len(size)), size)


def _texts(flat: pa.RecordBatch, page: np.ndarray) -> np.ndarray:
    """A number for each text of a page; no text is one too."""
    code = flat.column("text").dictionary_encode(null_encoding="encode")
    return page * (len(code.dictionary) + 1) + code.indices.to_numpy(zero_copy_only=False)


def _sides(flat: pa.RecordBatch) -> list[np.ndarray]:
    return [flat.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _EDGES]


def _close_arrays(edges: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``_close`` of many pairs of places."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = ([v[k] for v in edges] for k in (i, j))
    across = np.maximum(2.0, np.minimum(ax1 - ax0, bx1 - bx0) * 0.35)
    down = np.maximum(2.0, np.minimum(ay1 - ay0, by1 - by0) * 0.35)
    return (np.abs(ax0 - bx0) <= across) & (np.abs(ax1 - bx1) <= across) & (np.abs(ay0 - by0) <= down) & (np.abs(ay1 - by1) <= down)


def _few_pairs(group: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Pairs of places (i < j) of one group that are close, for groups of up to FEW; and from where to where the others
    lie.  ``group`` is sorted; a step compares each place with the one so many further on, for all groups at once."""
    head = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(head, append=len(group))
    large = [(int(f), int(f + n)) for f, n in zip(head[size > FEW], size[size > FEW], strict=True)]
    i = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size))
    found, step = [], 1
    last = np.repeat(head + size, size)
    while len(i := i[i + step < last[i]]):
        found.append(i[_close_arrays(edges, i, i + step)])
        step += 1
    first = np.concatenate([np.zeros(0, np.int64), *found])
    return first, first + np.repeat(np.arange(1, step), np.array([len(f) for f in found], np.int64)), large


def _codes(*columns: np.ndarray) -> np.ndarray:
    """One number for each combination of values."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, code = np.unique(c, return_inverse=True)
        out = np.unique(out * len(values) + code, return_inverse=True)[1]
    return out


def _grid_pairs(edges: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (each once, in either order) of many boxes of one text that are close, some at a time.  A pair meets
    at its smaller class: each box stands in its own class's grid and in that of the class below."""
    x0, y0, x1, y1 = edges
    own = [np.floor(np.log2(np.maximum(side, SMALLEST) / SMALLEST)).astype(np.int64) for side in (x1 - x0, y1 - y0)]

    def cells(reaches: tuple[float, ...]) -> list[np.ndarray]:
        rows = [np.arange(len(x0))]
        for at, level in zip((x0, y0), own, strict=True):
            more = []
            for below in (0, 1):
                lev = level[rows[0]] - below
                scale = CELL * 2.0**lev
                low, high = (np.floor((at[rows[0]] + r * 2.0**lev) / scale) for r in (reaches[0], reaches[-1]))
                more.append([*rows, lev, low])
                two = high > low
                more.append([*(r[two] for r in rows), lev[two], high[two]])
            rows = [np.concatenate(v) for v in zip(*more, strict=True)]
        return rows

    one, two = cells((0.0,)), cells((-REACH, REACH))
    code = _codes(*(np.concatenate([p, q]) for p, q in zip(one[1:], two[1:], strict=True)))
    a, b = one[0], two[0]
    order = np.argsort(code[: len(a)], kind="stable")
    key, other = code[: len(a)][order], code[len(a) :]
    low = np.searchsorted(key, other)
    many = np.searchsorted(key, other, side="right") - low
    ends, at = np.cumsum(many), 0
    while at < len(b):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, side="right")))
        count = many[at:to]
        which = np.repeat(np.arange(at, to), count)
        i = a[order[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]]
        j = b[which]
        level = (np.minimum(own[0][i], own[0][j]) == two[1][which]) & (np.minimum(own[1][i], own[1][j]) == two[3][which]) & (i < j)
        i, j = i[level], j[level]
        close = _close_arrays(edges, i, j)
        yield i[close], j[close]
        at = to


def same_item_pairs(items: DataFrame, key: str = "seq") -> DataFrame:
    """(page, key_a, key_b): boxes of a page that are taken for the same one, each pair once.  A page is one array, and all
    pages of a batch are compared at once: no row for each box and cell meets a shuffle, and items dealt by page are not
    shuffled at all.  Many boxes of equal text meet in cells of a grid for their size, so repeats all over a page cost what
    they number, not its square, and pairs leave some at a time.  Boxes with an edge that is no number are like none."""
    usable = F.col("text").isNotNull() & F.col(key).isNotNull()
    for c in _EDGES:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    kinds = {f.name: f.dataType for f in items.schema}
    schema = StructType([*(StructField(c, kinds[c]) for c in PAGE), StructField(f"{key}_a", kinds[key]), StructField(f"{key}_b", kinds[key])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, page = _flat(batch.column("_boxes"))
            group = _texts(flat, page)
            order = np.argsort(group, kind="stable")
            edges = [v[order] for v in _sides(flat)]
            name, rank = flat.column(key), _ranks(flat.column(key))

            def rows(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
                i, j = order[i], order[j]  # noqa: B023
                i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)  # noqa: B023
                apart = rank[i] != rank[j]  # noqa: B023
                i, j = i[apart], j[apart]
                of = pa.array(page[i])  # noqa: B023
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in PAGE), name.take(pa.array(i)), name.take(pa.array(j))], names=schema.names)  # noqa: B023

            i, j, large = _few_pairs(group[order], edges)
            yield rows(i, j)
            for first, end in large:
                for i, j in _grid_pairs([v[first:end] for v in edges]):
                    yield rows(i + first, j + first)

    return _by_page(items.filter(usable), [key, "text", *_EDGES]).mapInArrow(run, schema)


class _Kept:
    """The kept boxes of one text on one page: a list, and a grid once there are more than a few."""

    FEW = 24

    def __init__(self) -> None:
        self.boxes: list[tuple] = []
        self.grid: dict[tuple, list[tuple]] | None = None

    @staticmethod
    def _places(at: float, side: float, reach: float) -> list[tuple[int, int]]:
        own = int(math.log2(max(side, SMALLEST) / SMALLEST))
        found = []
        for level in (own, own - 1):
            scale = 2.0**level
            found += [(level, cell) for cell in range(math.floor((at - reach * scale) / (CELL * scale)), math.floor((at + reach * scale) / (CELL * scale)) + 1)]
        return found

    def _cells(self, box: tuple, reach: float) -> Iterator[tuple]:
        x0, y0, x1, y1 = box
        down = self._places(y0, y1 - y0, reach)
        return ((*x, *y) for x in self._places(x0, x1 - x0, reach) for y in down)

    def _add(self, box: tuple) -> None:
        for cell in self._cells(box, 0.0):
            self.grid.setdefault(cell, []).append(box)

    def new(self, box: tuple) -> bool:
        """Keep the box unless a kept one is the same.  A box with an edge that is no number is like none."""
        if not all(map(math.isfinite, box)):
            return True
        if self.grid is None:
            near = self.boxes
        else:
            near = (other for cell in self._cells(box, REACH) for other in self.grid.get(cell, ()))
        if any(_same(box, other) for other in near):
            return False
        if self.grid is None:
            self.boxes.append(box)
            if len(self.boxes) > self.FEW:
                self.grid = {}
                for other in self.boxes:
                    self._add(other)
        else:
            self._add(box)
        return True


def _same(p: tuple, q: tuple) -> bool:
    across = max(2.0, min(p[2] - p[0], q[2] - q[0]) * 0.35)
    if abs(p[0] - q[0]) > across or abs(p[2] - q[2]) > across:
        return False
    down = max(2.0, min(p[3] - p[1], q[3] - q[1]) * 0.35)
    return abs(p[1] - q[1]) <= down and abs(p[3] - q[3]) <= down


def _ranks(column: pa.Array, down: bool = False) -> np.ndarray:
    """Numbers that sort as Spark sorts the column, upwards or ``down``: nulls below all, NaN above all."""
    if not column.null_count and pa.types.is_integer(column.type):
        values = column.to_numpy(zero_copy_only=False)
        return ~values if down else values
    if not column.null_count and pa.types.is_floating(column.type):
        values = column.to_numpy(zero_copy_only=False)
        if not np.isnan(values).any():
            return -values if down else values
    given = column.is_valid().to_numpy(zero_copy_only=False)
    rank = np.zeros(len(column), np.int64)
    rank[given] = np.unique(column.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)[1] + 1
    return -rank if down else rank


def _kept(group: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Which boxes the greedy scan keeps: those of a group one after another, like none that it kept before."""
    kept = np.ones(len(group), bool)
    i, j, large = _few_pairs(group, edges)
    head = np.flatnonzero(np.diff(group, prepend=-1))
    place = np.arange(len(group)) - np.repeat(head, np.diff(head, append=len(group)))
    order = np.argsort(place[j], kind="stable")
    i, j = i[order], j[order]
    cuts = np.append(np.flatnonzero(np.diff(place[j], prepend=-1)), len(j))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        kept[j[a:b][kept[i[a:b]]]] = False
    for first, end in large:
        held = _Kept()
        kept[first:end] = [held.new(box) for box in zip(*(v[first:end].tolist() for v in edges), strict=True)]
    return kept


def _merged(boxes: pa.ListArray) -> pa.ListArray:
    """The boxes of each page that are kept, in their order, with their numbers."""
    flat, page = _flat(boxes)
    group, edges = _texts(flat, page), _sides(flat)
    rank = {c: _ranks(flat.column(c), c == "confidence") for c in ("priority", "confidence", "y0", "x0", "seq")}
    order = np.lexsort([*(rank[c] for c in ("seq", "x0", "y0", "confidence", "priority")), group])
    finite = np.isfinite(edges).all(axis=0)
    compared = order[finite[order]]
    keep = np.ones(len(order), bool)  # a box with an edge that is no number is like none
    keep[compared] = _kept(group[compared], [v[compared] for v in edges])
    chosen = np.flatnonzero(keep)
    chosen = chosen[np.lexsort([rank[c][chosen] for c in ("seq", "confidence", "priority", "x0", "y0")] + [page[chosen]])]
    many = np.bincount(page[chosen], minlength=len(boxes))
    number = np.arange(len(chosen)) - np.repeat(np.cumsum(many) - many, many)
    left = flat.take(pa.array(chosen))
    rows = pa.StructArray.from_arrays([*left.columns, pa.array(number.astype(np.int32))], [*left.schema.names, "item_index"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), rows)


def merge_items(items: DataFrame) -> DataFrame:
    """Greedy removal of repeated detections, numbered anew.  ``items`` has ``priority`` (source, best first)
    and ``seq`` (order in its source).  Boxes are met by priority, confidence, y0, x0; one is kept unless a
    kept one is the same.  Only equal texts can be the same.  A page is one array; all pages of a batch are scanned at once,
    step by step, and a text with many boxes in a grid.  Items that are dealt by page already are not shuffled, and stay
    dealt for what follows."""
    columns = [c for c in items.columns if c != "item_index"]
    held = [c for c in columns if c not in PAGE]
    kind = ArrayType(StructType([*items.select(*held).schema.fields, StructField("item_index", IntegerType())]))

    @F.arrow_udf(kind)
    def scan(boxes: pa.Array) -> pa.Array:
        return _merged(boxes)

    return _by_page(items, held).select(*PAGE, F.inline(scan("_boxes"))).select(*columns, "item_index")


def estimate_slant(items: DataFrame) -> DataFrame:
    """(page, slant_angle): median angle of the top and bottom edges of quads of four points, 0 without any."""
    edges = F.when(F.size("quad") == 4, F.array(edge_angle(F.col("quad")[0], F.col("quad")[1]), edge_angle(F.col("quad")[3], F.col("quad")[2])))
    angles = items.select(*PAGE, F.explode_outer(edges).alias("angle"))
    return angles.groupBy(*PAGE).agg(F.coalesce(F.median("angle"), F.lit(0.0)).alias("slant_angle"))


def rotate_centers(items: DataFrame, slant: DataFrame | None = None) -> DataFrame:
    """Adds rx, ry: the box centers turned back by the page's slant (none: as they are)."""
    if slant is None:
        return items.withColumns({"rx": center_x(), "ry": center_y()})
    turned = items.join(slant, PAGE)
    rx, ry = rotated(center_x(), center_y(), -F.col("slant_angle"))
    return turned.withColumns({"rx": rx, "ry": ry}).drop("slant_angle")


def select_in_polygon(items: DataFrame, polygon) -> DataFrame:
    """Items whose center is inside the polygon (array of points), numbered anew in their order."""
    inside = items.filter(in_polygon(center_x(), center_y(), polygon))
    place = Window.partitionBy(*PAGE).orderBy("item_index")
    return inside.withColumn("item_index", (F.row_number().over(place) - 1).cast("int"))


def page_hull(items: DataFrame) -> DataFrame:
    """The box around all boxes of a page."""
    return items.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def overlay_percent(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes in percent of the page: left, top, width, height; ``pages`` has page_width, page_height."""
    share = lambda c, size: c / F.col(size) * 100
    return items.join(pages, PAGE).select(*PAGE, "item_index", share(F.col("x0"), "page_width").alias("left"), share(F.col("y0"), "page_height").alias("top"), share(F.col("x1") - F.col("x0"), "page_width").alias("width"), share(F.col("y1") - F.col("y0"), "page_height").alias("height"))


def guide_value(a: tuple, b: tuple, axis: str, page_width, page_height):
    """The place of a guide drawn from a to b (pairs of expressions): the mean on its axis, inside the page."""
    i, size = (0, page_width) if axis == "x" else (1, page_height)
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(size, v))
    return (clamp(a[i]) + clamp(b[i])) / 2
