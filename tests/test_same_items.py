"""Repeated detections found in a grid, against all pairs compared."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tablegeo.operators import items as I

BOXES = "doc_key string, page_number int, text string, seq long, priority int, confidence double, x0 double, y0 double, x1 double, y1 double"


def close(p, q) -> bool:
    across, down = max(2.0, 0.35 * min(p[2] - p[0], q[2] - q[0])), max(2.0, 0.35 * min(p[3] - p[1], q[3] - q[1]))
    return abs(p[0] - q[0]) <= across and abs(p[2] - q[2]) <= across and abs(p[1] - q[1]) <= down and abs(p[3] - q[3]) <= down


def boxes(seed: int, n: int) -> list[tuple]:
    """Boxes of all sizes, also empty and inverted ones, many on the edge of being the same as another."""
    rng, found = random.Random(seed), []
    for i in range(n):
        if found and rng.random() < 0.6:
            _, page, text, *_, x0, y0, x1, y1 = rng.choice(found)
            across, down = (max(2.0, 0.35 * abs(v)) for v in (x1 - x0, y1 - y0))
            x0, x1 = (v + across * rng.choice((-1, -0.999, -0.5, 0, 0.5, 0.999, 1, 1.001)) for v in (x0, x1))
            y0, y1 = (v + down * rng.choice((-1, -0.5, 0, 0.5, 1)) for v in (y0, y1))
        else:
            page, text = rng.randint(1, 2), rng.choice("ab")
            side = lambda: rng.choice((0.0, -3.0, 1.0, 4.9, 5.0, 5.7, 5.8, 10.0, 20.0)) * 2.0 ** rng.randint(-2, 5)
            x0, y0 = rng.choice((0.0, -7.0, 16.0, 64.0, rng.uniform(-50, 400))), rng.uniform(-20, 200)
            x1, y1 = x0 + side(), y0 + side()
        found.append(("d", page, text, i, rng.randint(1, 3), rng.choice((0.5, 0.9)), x0, y0, x1, y1))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_pairs(spark, seed):
    found = boxes(seed, 1500)
    pairs = I.same_item_pairs(spark.createDataFrame(found, BOXES))
    expected = sorted((b[1], b[3], c[3]) for b in found for c in found if b[3] < c[3] and b[1:3] == c[1:3] and close(b[6:], c[6:]))
    assert len(expected) > 500
    assert sorted((r.page_number, r.seq_a, r.seq_b) for r in pairs.collect()) == expected


@pytest.mark.parametrize("seed", range(3))
def test_greedy_scan(spark, seed):
    found = boxes(seed + 10, 3000)
    kept: dict = {}
    for b in sorted(found, key=lambda b: (b[4], -b[5], b[7], b[6], b[3])):
        own = kept.setdefault(b[1:3], [])
        if not any(close(b[6:], c[6:]) for c in own):
            own.append(b)
    assert max(map(len, kept.values())) > I._Kept.FEW
    merged = I.merge_items(spark.createDataFrame(found, BOXES))
    assert sorted(r.seq for r in merged.collect()) == sorted(b[3] for own in kept.values() for b in own)


def test_edges_that_are_no_numbers_are_like_none(spark):
    odd = [("d", 1, "a", i, 1, 0.5, float("nan"), 0.0, 1.0, 1.0) for i in range(3)] + [("d", 1, "a", i, 1, 0.5, 0.0, 0.0, float("inf"), 1.0) for i in range(3, 6)]
    same = [("d", 1, "a", i, 1, 0.5, 0.0, 0.0, 1.0, 1.0) for i in range(6, 8)]
    df = spark.createDataFrame(odd + same, BOXES)
    assert [tuple(r) for r in I.same_item_pairs(df).collect()] == [("d", 1, 6, 7)]
    assert I.merge_items(df).count() == 7


def test_one_text_all_over_a_page(spark):
    """100,000 boxes of one text, each of them seen twice."""
    n = 50_000
    at = spark.range(2 * n).select(F.col("id").alias("seq"), (F.col("id") % n).alias("k"))
    spread = at.select(F.lit("d").alias("doc_key"), F.lit(1).alias("page_number"), F.lit("0").alias("text"), "seq", F.when(F.col("seq") < n, 1).otherwise(2).alias("priority"), F.lit(0.5).alias("confidence"),
        (F.col("k") % 250 * 8.0).alias("x0"), (F.floor(F.col("k") / 250) * 12.0).alias("y0"), (F.col("k") % 250 * 8.0 + 6.0).alias("x1"), (F.floor(F.col("k") / 250) * 12.0 + 8.0).alias("y1"))
    start = time.monotonic()
    assert I.same_item_pairs(spread).count() == n
    assert I.merge_items(spread).agg(F.count("*"), F.max("seq")).first() == (n, n - 1)
    assert time.monotonic() - start < 120  # all pairs would be 5 * 10**9


def test_boxes_dealt_by_page_are_not_shuffled_again(spark, data):
    from tablegeo.sources import layouts as lay

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = lay.duplicates(spark, data)
    assert plan(I.merge_items(found)).count("Exchange hashpartitioning") == 2  # the lines, the numbers


def test_few_and_many(spark):
    """Groups on both sides of the number up to which boxes are compared in place; no text is like no other."""
    side = lambda page, n: [("d", page, "a", i, 1, 0.5, float(i // 2 * 50), 0.0, float(i // 2 * 50 + 9), 8.0) for i in range(n)]
    none = [("d", 9, None, i, 1, 0.5, 0.0, 0.0, 9.0, 8.0) for i in range(2)]
    df = spark.createDataFrame(side(1, I.FEW) + side(2, I.FEW + 2) + none, BOXES)
    found = {(r.page_number, r.seq_a, r.seq_b) for r in I.same_item_pairs(df).collect()}
    assert found == {(p, i, i + 1) for p, n in ((1, I.FEW), (2, I.FEW + 2)) for i in range(0, n, 2)}
