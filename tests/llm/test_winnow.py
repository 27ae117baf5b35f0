"""Winnowing against brute force over every window."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tablegeo.llm import winnow


def words_of(text: str | None) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs: list[tuple], items: list[tuple], span: int) -> list[tuple]:
    windows: dict = {}
    for i, text in items:
        w = words_of(text)
        n = min(span, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    lengths, out = {len(w) for w in windows}, []
    for i, text in docs:
        w, hit, names = words_of(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    names.update(str(x) for x in found if x is not None)
        starts, ends = sorted(x for x in hit if x - 1 not in hit), sorted(x + 1 for x in hit if x + 1 not in hit)
        out.append((i, len(w), tuple(zip(starts, ends, strict=True)), tuple(sorted(names))))
    return sorted(out, key=repr)


def found(docs, items, span: int) -> list[tuple]:
    rows = winnow.with_leaks(docs, items, span=span).select("doc_id", "leak").collect()
    return sorted(((r.doc_id, r.leak.n_words, tuple((s.start, s.end) for s in r.leak.spans), tuple(r.leak.item_ids)) for r in rows), key=repr)


def case(short: bool) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(11 + short)
    pool = ["Über", "été", "a", "B2", "c", "dog", "Ñandú", "x9"]
    prose = lambda n: "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", " - ", "_"]) for _ in range(n))
    items = [(i, prose(rng.randrange(12, 30))) for i in range(12)] + [(50, "A a a a a a a a a a a a a a"), (51, None), (52, " .. "), (None, prose(15))]
    items += [(60 + i, "shared opening words of every single item here are these " + prose(6)) for i in range(6)]
    if short:
        items += [(80, "dog"), (81, "x9 c"), (82, "été B2 a c"), (83, "c c c c c c c c c"), (84, "dog")]
    docs = [(1, None), (2, ""), (3, " ., "), (4, "a " * 40), (5, "a " * 9), (6, "A" * 300)]
    for i in range(7, 40):
        _, text = rng.choice([x for x in items if x[1]])
        w = words_of(text)
        cut = w[rng.randrange(3) :][: rng.randrange(8, 30)]
        docs.append((i, prose(rng.randrange(30)) + " " + " ".join(cut).upper().replace("ÉTÉ", "été").replace("ÜBER", "Über").replace("ÑANDÚ", "Ñandú") + " " + prose(rng.randrange(30))))
    docs += [(20, docs[-1][1])] * 3 + [(None, docs[-2][1]), (90, prose(4000) + items[0][1] + prose(3000))]
    return docs, items


@pytest.mark.parametrize(("short", "span", "few"), [(False, 10, True), (True, 10, True), (True, 10, False), (False, 7, True), (True, 1, True)])
def test_against_brute_force(spark, short, span, few, monkeypatch):
    if not few:
        monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)  # the way of large tables
    docs, items = case(short)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(frame, spark.createDataFrame(items, "item_id long, text string"), span) == brute(docs, items, span)


def test_clashing_columns_and_empty_tables(spark, docs, nothing):
    names = "digest string, item string, length string, window string, mark string, leak string, words string, place string"
    items = docs.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id < 80")
    extra = docs.select("*", *(F.lit("x").alias(c.split()[0]) for c in names.split(", ") if c.split()[0] not in docs.columns))
    marked = winnow.with_leaks(extra, items)
    assert marked.columns == [c for c in extra.columns if c != "leak"] + ["leak"]
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert found(extra, items, 10) == wanted
    assert found(nothing, items, 10) == []
    assert all(r[2:] == ((), ()) for r in found(docs, nothing.select(F.col("doc_id").alias("item_id"), "text"), 10))


def test_no_python_in_the_plans(spark, docs):
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    marks = docs.select(F.explode(winnow.fingerprints(winnow.words("text"), [4, 10])))
    for frame in (marks, winnow.benchmark_windows(items, "item_id", "text", 10), winnow.with_leaks(docs, items)):
        plan = frame._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
