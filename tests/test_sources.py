"""Pages of documents, recognisers and the data sources."""

from __future__ import annotations

import json
import os
import re
import resource

import pytest
from pyspark.sql import functions as F

from tablegeo.operators import items as I  # noqa: E741
from tablegeo.schema import ITEMS
from tablegeo.sources import pages, words

COLUMNS = [c.split()[0] for c in ITEMS.split(", ")]
FILES = "doc_key string, content binary"


def letters(content: bytes, fail: int = 0) -> pages.Plugin:
    """Documents whose bytes are a number of pages; a page's word is its number."""
    del content

    def page_words(n, page):
        if page == fail:
            raise ValueError("torn")
        return [(f" w{page} ", 0.5, [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]), (" ", 1.0, [(0.0, 0.0)] * 4)]

    return pages.Plugin(int, lambda n: n, page_words)


def test_text_layers(spark):
    plugin = letters(b"")
    files = spark.createDataFrame([("a", bytearray(b"3")), ("b", bytearray(b"0")), ("c", None), ("d", bytearray(b"12"))], FILES)
    found = pages.read_pages(files, plugin=plugin)
    assert found.columns == COLUMNS
    everything = sorted((r.doc_key, r.page_number, r.item_index, r.text) for r in found.collect())
    assert everything == sorted([("a", p, 0, f"w{p}") for p in range(1, 4)] + [("d", p, 0, f"w{p}") for p in range(1, 13)])
    asked = spark.createDataFrame([("a", 2), ("a", 2), ("a", 9), ("d", 12), ("d", None), ("x", 1)], "doc_key string, page_number int")
    some = [("a", 2, 0, "w2"), ("d", 12, 0, "w12")]
    for each in (None, 1, 5):
        assert sorted((r.doc_key, r.page_number, r.item_index, r.text) for r in pages.read_pages(files, asked, plugin, each).collect()) == some
        assert sorted((r.doc_key, r.page_number, r.item_index, r.text) for r in pages.read_pages(files, None, plugin, each).collect()) == everything
    counted = pages.count_pages(files, plugin)
    assert sorted(map(tuple, counted.collect())) == [("a", 3), ("d", 12)]
    assert I.page_numbers(counted).count() == 15
    assert pages.read_pages(files.limit(0), plugin=plugin).count() == 0
    with pytest.raises(Exception, match="page 2 of [ad]: torn"):
        pages.read_pages(files, plugin=letters(b"", 2)).collect()


def test_pages_asked_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(pages, "BROADCAST_ROWS", 0)
    files = spark.createDataFrame([("a", bytearray(b"3"))], FILES)
    asked = spark.createDataFrame([("a", 3)], "doc_key string, page_number int")
    assert [r.text for r in pages.read_pages(files, asked, letters(b"")).collect()] == ["w3"]


def test_text_plugin(spark):
    text = "one  two\n\n three\nfour\n"
    files = spark.createDataFrame([("t", bytearray(text.encode())), ("e", bytearray(b""))], FILES)
    plugin = pages.text_pages(2)
    assert sorted(map(tuple, pages.count_pages(files, plugin).collect())) == [("e", 1), ("t", 3)]
    got = sorted((r.page_number, r.item_index, r.text, r.x0, r.y0) for r in pages.read_pages(files, plugin=plugin).collect())
    assert got == [(1, 0, "one", 0.0, 0.0), (1, 1, "two", 30.0, 0.0), (2, 0, "three", 6.0, 0.0), (2, 1, "four", 0.0, 12.0)]


def dots(document, page, dpi):
    """Red dots whose green and blue tell text and size of print."""
    width, height, picture = 50, 30, bytearray(3 * 50 * 30)
    for x, y, green, blue in ((5, 5, 65, 0), (40, 20, 66, 0), (30, 10, 67, 1)):
        at = 3 * (y * width + x)
        picture[at : at + 3] = bytes([255, green + page - 1, blue])
    return width, height, 2.0, bytes(picture)


def test_scans_of_pages_and_tiles(spark):
    """Text layer, whole page and tiles in one stage; small dots (blue 1) are only seen in tiles."""

    def make():
        return {"made": True}

    def recognise(engine, image, wide, high):
        assert engine["made"] and len(image) == 3 * wide * high
        yield None, "x", 0.5
        yield [(0, 0)], None, 0.5
        yield [(0, 0)], " ", 0.5
        for at in range(0, len(image), 3):
            if image[at] == 255 and not (image[at + 2] and wide == 50):
                x, y = at // 3 % wide, at // 3 // wide
                yield [(x, y), (x + 8, y), (x + 8, y + 4), (x, y + 4)], chr(image[at + 1]), 0.9

    native = lambda document, page: [("A", 1.0, [(2.5, 2.5), (6.5, 2.5), (6.5, 4.5), (2.5, 4.5)])]
    plugin = pages.Plugin(bytes, lambda d: 2, native, dots)
    files = spark.createDataFrame([("a", bytearray(b"x"))], FILES)
    recogniser = pages.Recogniser(make, recognise)
    found = pages.scanned_items(files, recogniser, plugin=plugin, tile=20, overlap=5)
    assert found.columns == COLUMNS
    got = sorted((r.page_number, r.text, r.x0, r.y0, r.confidence) for r in found.collect())
    assert got == [(1, "A", 2.5, 2.5, 1.0), (1, "B", 20.0, 10.0, 0.9), (1, "C", 15.0, 5.0, 0.9), (2, "A", 2.5, 2.5, 1.0), (2, "B", 2.5, 2.5, 0.9), (2, "C", 20.0, 10.0, 0.9), (2, "D", 15.0, 5.0, 0.9)]
    raw = pages.detections(files, recogniser, plugin=plugin, tile=20, overlap=5)
    assert {r.priority for r in raw.collect()} == {1, 2, 3}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("content" not in line and "image" not in line for line in plan.splitlines() if "Exchange" in line)
    images = pages.render_pages(files, plugin=plugin)
    assert [(r.page_number, r.width, r.height, len(r.image)) for r in images.orderBy("page_number").collect()] == [(1, 50, 30, 4500), (2, 50, 30, 4500)]
    assert "Exchange" not in images._jdf.queryExecution().executedPlan().toString()


def test_tiles_agree_with_the_grid(spark):
    sizes = [(w, h) for w in (1, 1399, 1400, 1401, 2579, 2580, 3600) for h in (1100, 2800)]
    grid = I.tile_grid(spark.createDataFrame(sizes, "width int, height int")).collect()
    for w, h in sizes:
        assert sorted({r.left for r in grid if (r.width, r.height) == (w, h)}) == pages.tile_corners(w, 1400, 220)
        assert sorted({r.top for r in grid if (r.width, r.height) == (w, h)}) == pages.tile_corners(h, 1400, 220)


def test_engine_is_made_once_in_each_worker(spark, tmp_path):
    """Also if what makes it is a closure, which is a new object in each task."""
    folder = str(tmp_path)

    def make(min_height=1, **options):
        with open(f"{folder}/made", "a") as file:
            file.write(f"{os.getpid()} {'det_thresh' in options}\n")
        return "engine"

    files = spark.createDataFrame([(str(i), bytearray(b"x")) for i in range(40)], FILES).repartition(20)
    plugin = pages.Plugin(bytes, lambda d: 1, lambda d, p: [], dots)
    for _ in range(3):
        look = pages.detections(files, pages.Recogniser(make, lambda engine, image, w, h: [([(0, 0), (1, 1)], str(os.getpid()), 1.0)]), plugin=plugin)
        workers = {r.text for r in look.select("text").distinct().collect()}
    made = [line.split() for line in open(f"{folder}/made")]
    assert len(made) == len({pid for pid, _ in made}) and {rich for _, rich in made} == {"True"}
    assert workers <= {pid for pid, _ in made}
    assert pages.engine_of(lambda: "plain") == "plain" and pages.engine_of(make, [{"no": 1}], "k") == "engine"


def test_a_thousand_tiles_in_bounded_memory(spark):
    """1,000 tiles of 5 MB: a worker's peak stays far below their 5 GB, whatever it did before."""
    side, tile = 2600, 1300
    plugin = pages.Plugin(bytes, lambda d: 5, lambda d, p: [], lambda d, p, dpi: (side, side, 1.0, bytes(3 * side * side)))

    def recognise(engine, image, wide, high):
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        return [([(0, 0), (1, 1)], str(peak if len(image) == 3 * tile * tile else 0), 1.0)]

    files = spark.createDataFrame([(str(i), bytearray(b"x")) for i in range(50)], FILES).repartition(4)
    looks = pages.detections(files, pages.Recogniser(lambda: None, recognise), plugin=plugin, tile=tile, overlap=0).filter("priority = 3")
    found = looks.agg(F.count("*").alias("n"), F.max(F.col("text").cast("long")).alias("kb")).first()
    assert found.n == 1000 and found.kb < 1_000_000


def box(page: int, text: str, doc: str | None = "d") -> str:
    return json.dumps({"page_number": page, "text": text, "x0": 1, "y0": 2, "x1": 3, "y1": 4} | ({"doc_key": doc} if doc else {}))


def test_word_boxes_by_ranges_of_bytes(spark, tmp_path):
    """However a file is cut, each page is read once, whole, and numbered from 0."""
    lines = [box(page, f"é{page}-{i}" if i % 4 else " ") for page in range(1, 30) for i in range(page % 5 * 3 + 1)]
    lines[10:10] = ["", "  "]
    (tmp_path / "w.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "e.json").write_text("")
    words.register(spark)
    read = lambda size: sorted((r.page_number, r.item_index, r.text) for r in spark.read.format("wordboxes").options(paths=f"{tmp_path}/w.json,{tmp_path}/e.json", bytesPerTask=size).load().collect())
    whole = read(1 << 30)
    expected = []
    for page in range(1, 30):
        kept = [f"é{page}-{i}" for i in range(page % 5 * 3 + 1) if i % 4]
        expected += [(page, n, text) for n, text in enumerate(kept)]
    assert whole == sorted(expected)
    for size in (1000, 333, 97):
        assert read(size) == whole


def test_filters_reach_the_sources(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(f"{name} line{i}" for i in range(40)))
    (tmp_path / "w.json").write_text("\n".join(box(p, f"t{p}", d) for d in ("d", "e") for p in range(1, 9)))
    pages.register(spark)
    words.register(spark)
    both = ",".join(f"{tmp_path}/{n}" for n in ("a.txt", "b.txt"))
    load = lambda **o: spark.read.format("documentpages").options(paths=both, plugin="tests.test_sources:four_lines", **o).load()
    assert load().count() == 160 and load(bytesPerTask=100).count() == 160
    assert load(bytesPerTask=100).rdd.getNumPartitions() >= 8
    tests = ["page_number = 3", "page_number > 8", "page_number between 2 and 4", "page_number in (1, 10, 11)", f"doc_key = '{tmp_path}/b.txt' and page_number <= 2", "page_number = 3 and text like 'line%'"]
    for test in tests:
        for size in (100, 1 << 20):
            got = load(bytesPerTask=size).filter(test)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.createDataFrame(load().collect(), ITEMS).filter(test).collect()))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"Filter.*page_number", plan.split("BatchScan")[0])
    boxes = spark.read.format("wordboxes").option("paths", f"{tmp_path}/w.json").load()
    few = boxes.filter("doc_key = 'e' and page_number >= 7")
    assert sorted((r.doc_key, r.page_number) for r in few.collect()) == [("e", 7), ("e", 8)]
    assert not re.search(r"\) Filter ", few._jdf.queryExecution().executedPlan().toString())
    assert spark.read.format("wordboxes").option("paths", "").load().count() == 0


def four_lines() -> pages.Plugin:
    return pages.text_pages(4)
