"""Repeated detections of all pages of a batch at once: order, nulls, large groups, and what is shuffled."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tablegeo.operators import items as I
from tablegeo.sources import layouts as lay
from tests.test_same_items import BOXES, boxes, close


@pytest.mark.parametrize("seed", range(4))
def test_grid_of_many(seed):
    """Boxes of one text in the grid against all pairs, also when few candidates are looked at in one go."""
    edges = [np.array(v) for v in zip(*(b[6:] for b in boxes(seed, 700)), strict=True)]
    expected = sorted((i, j) for i in range(700) for j in range(i + 1, 700) if close([e[i] for e in edges], [e[j] for e in edges]))
    for most in (I.EXPANDED, 50):
        before, I.EXPANDED = I.EXPANDED, most
        try:
            found = [(min(i, j), max(i, j)) for a, b in I._grid_pairs(edges) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        finally:
            I.EXPANDED = before
        assert sorted(found) == expected


def test_ranks_are_those_of_spark(spark):
    nan = float("nan")
    for kind, values in (("double", [1.0, None, nan, -0.0, 0.0, float("-inf"), float("inf")]), ("long", [3, None, -(1 << 62), (1 << 62) + 1, 1 << 62]), ("string", ["b", None, "a", "é", "z"]), ("int", [2, 1])):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
        column = pa.array(values, {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "int": pa.int32()}[kind])
        for down in (False, True):
            order = [df.v.desc() if down else df.v.asc(), df.i]
            assert np.lexsort((np.arange(len(values)), I._ranks(column, down))).tolist() == [r.i for r in df.orderBy(*order).collect()]


def test_numbers_and_texts_with_nulls(spark):
    """Nulls and what is no number sort as in a window, equal texts include no text, all columns go along."""
    rng, found = random.Random(3), []
    for i in range(600):
        x0, y0 = rng.choice((0.0, 1.0, 50.0, None, float("nan"))), rng.choice((0.0, 1.5, -0.0, 30.0))
        x1 = None if x0 is None else x0 + 9
        found.append(("d" if i % 2 else None, rng.randint(1, 40), rng.choice(("a", "b", None)), i, rng.choice((1, 2, None)), rng.choice((0.5, None, float("nan"), 0.9)), x0, y0, x1, y0 + 8, {"k": i}))
    df = spark.createDataFrame(found, BOXES + ", note map<string,int>")
    low, high = lambda v: (v is not None, v if v is None or v == v else float("inf")), lambda v: (v is None, 0 if v is None else float("-inf") if v != v else -v)
    order = lambda b: (*low(b[4]), *high(b[5]), *low(b[7]), *low(b[6]), b[3])
    fill = lambda key: tuple(0 if v is None else v for v in key)
    kept: dict = {}
    for b in sorted(found, key=lambda b: fill(order(b))):
        own = kept.setdefault(b[:3], [])
        if None in b[6:10] or any(v != v for v in b[6:10]) or not any(close(b[6:10], c[6:10]) for c in own if None not in c[6:10] and all(v == v for v in c[6:10])):
            own.append(b)
    expected: dict = {}
    for key, own in kept.items():
        expected.setdefault(key[:2], []).extend(own)
    numbers = {b[3]: i for own in expected.values() for i, b in enumerate(sorted(own, key=lambda b: fill((*low(b[7]), *low(b[6]), *order(b)))))}
    merged = I.merge_items(df)
    assert merged.columns == [*df.columns, "item_index"]
    got = merged.collect()
    assert {r.seq: r.item_index for r in got} == numbers and all(r.note == {"k": r.seq} for r in got)


def test_pairs_and_merging_need_one_dealing(spark, data):
    """Boxes of pages that lie together are compared there: pairs are made once, and numbers need no second dealing."""
    spark.catalog.clearCache()
    found = lay.duplicates(spark, data)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(I.merge_items(found)).count("Exchange") == 1
    assert plan(I.same_item_pairs(found)).count("Exchange") == 1
