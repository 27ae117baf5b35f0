"""Stand-ins for PDF files and a recogniser: documents of eight pages whose boxes are painted in colours of their own,
and an engine that finds the colours again.  Inputs for queries and tests, made from relational tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegeo.sources.layouts import _fields, numbered_lines
from tablegeo.sources.pages import Plugin, Recogniser, Word

PAGES, WIDTH = 8, 300
#: The engine misses small print (fourth fields) on images wider than this; tiles show it.
COARSE = 500
#: A colour as one number.
CHANNELS = np.array([1 << 16, 1 << 8, 1])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_key, content): eight orders to a document, an order to a page, a box (page, rn, c, colour, length) for each
    field of a line."""
    fields = _fields(numbered_lines(spark, sf_dir))
    colour = (F.col("k") % 4096) * 4096 + F.col("rn") * 8 + F.col("c")
    box = F.struct((F.col("page_number") % PAGES + 1).alias("p"), F.col("rn").alias("r"), F.col("c").alias("c"), colour.alias("v"), F.length("text").alias("n"))
    # A given number of tasks is kept as it is: documents are small, and few tasks would paint and read them all.
    dealt = fields.withColumn("doc_key", F.floor(F.col("page_number") / PAGES).cast("string")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_key")
    grouped = dealt.groupBy("doc_key").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    return grouped.select("doc_key", F.to_json("boxes").cast("binary").alias("content"))


def _open(content: bytes) -> dict[int, list[dict]]:
    pages: dict[int, list[dict]] = {p: [] for p in range(1, PAGES + 1)}
    for box in json.loads(content):
        pages[box["p"]].append(box)
    return pages


def _place(box: dict) -> tuple[int, int, int, int]:
    return 60 * box["c"], 14 * box["r"] - 4, 60 * box["c"] + 6 * box["n"], 14 * box["r"] + 4


def _words(document: dict[int, list[dict]], page: int) -> Iterator[Word]:
    """The text layer holds first fields only."""
    for box in document[page]:
        if box["c"] == 1:
            x0, y0, x1, y1 = _place(box)
            yield f" {box['v']} ", 1.0, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def _render(document: dict[int, list[dict]], page: int, dpi: int) -> tuple[int, int, float, bytes]:
    scale = dpi // 72
    width, height = scale * WIDTH, scale * (14 * max((b["r"] for b in document[page]), default=0) + 10)
    image = np.zeros((height, 3 * width), np.uint8)
    for box in document[page]:
        x0, y0, x1, y1 = (scale * v for v in _place(box))
        line = image[y0:y1, 3 * x0 : 3 * x1]
        line[:] = np.frombuffer(box["v"].to_bytes(3, "big") * (line.shape[1] // 3), np.uint8)
    return width, height, float(scale), image.tobytes()


def _recognise(engine: str, samples: bytes, width: int, height: int) -> Iterator[tuple]:
    """The hull of all pixels of each colour.  Equal lines under each other are looked at once, in runs of one colour."""
    assert engine == "colours"
    lines = np.frombuffer(samples, np.uint64 if 3 * width % 8 == 0 else np.uint8).reshape(height, -1)
    top = np.concatenate([[0], np.flatnonzero((lines[1:] != lines[:-1]).any(axis=1)) + 1])
    band = lines[top].view(np.uint8).reshape(-1)
    changes = np.flatnonzero(band[3:] != band[:-3]) // 3 + 1
    starts = np.zeros(width * len(top), bool)
    starts[::width] = True
    starts[changes] = True
    start = np.flatnonzero(starts)
    colour = band.reshape(-1, 3)[start].astype(np.int64) @ CHANNELS
    hulls: dict[int, list[int]] = {}
    top = [*top.tolist(), height]
    for value, at, end in zip(colour.tolist(), start.tolist(), [*start[1:].tolist(), len(starts)], strict=True):
        if value and not (width > COARSE and value % 8 == 4):
            of = at // width
            x0, x1, y0, y1 = at - of * width, end - of * width, top[of], top[of + 1]
            hull = hulls.get(value)
            if hull is None:
                hulls[value] = [x0, y0, x1, y1, (x1 - x0) * (y1 - y0)]
            else:
                hull[:] = min(hull[0], x0), hull[1], max(hull[2], x1), y1, hull[4] + (x1 - x0) * (y1 - y0)
    for value in sorted(hulls):
        x0, y0, x1, y1, n = hulls[value]
        yield [(x0, y0), (x1, y0), (x1, y1), (x0, y1)], str(value), 0.5 + n / 4000


def _engine(min_height: int = 0) -> str:
    return "colours"


PLUGIN = Plugin(_open, len, _words, _render)
RECOGNISER = Recogniser(_engine, _recognise)
