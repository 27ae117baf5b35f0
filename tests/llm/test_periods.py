"""Runs against brute force over every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablegeo.llm import periods
from tablegeo.llm.queries import QUERIES


def brute(words: list[str], min_length: int, min_exponent: int) -> list[tuple]:
    """Maximal stretches of each period that have no smaller one."""
    out, ids = [], np.unique(np.array(words, object), return_inverse=True)[1] if words else np.empty(0, int)
    for q in range(1, len(words) // min_exponent + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        for start, end in zip(np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:]), strict=True):
            length, s = int(end - start) + q, words[start : end + q]
            if length >= max(min_length, min_exponent * q) and next(p for p in range(1, q + 1) if s[p:] == s[: length - p]) == q:
                out.append((int(start), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple]) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def cases() -> list[str]:
    rng = random.Random(2)
    out = ["", " \n", "a", "a " * 5, "a " * 6, "a " * 7 + "b", "a b " * 4, "a b a b a b a", "x " + "a b " * 4 + "a y", "é\x0bé\x0cé\té é\né"]
    for size in (2, 3, 5):
        out += [" ".join(rng.choice("abcde"[:size]) for _ in range(rng.randrange(1, 160))) for _ in range(60)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
            parts += unit * rng.randrange(1, 8) + unit[: rng.randrange(len(unit) + 1)] + [rng.choice("abcdxyz") for _ in range(rng.randrange(6))]
        out.append(" ".join(parts))
    a, b = ["a"], ["a", "b"]
    for _ in range(9):
        a, b = b, b + a
    out += [" ".join(b), "  ".join(b * 4), " ".join((b * 5)[: len(b) * 4 + 3])]  # Fibonacci words hold the most runs
    return out


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (1, 2), (5, 3)])
def test_against_brute_force(min_length, min_exponent):
    texts = cases()
    got = periods.analysed(pa.array([t.encode() for t in texts]), min_length, min_exponent).to_pylist()
    for text, row in zip(texts, got, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        wanted = brute(words, min_length, min_exponent)
        assert row["n_words"] == len(words)
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == wanted
        assert row["collapsed"].decode() == collapse(words, wanted)


def test_batches_change_nothing():
    texts = pa.array([t.encode() for t in cases()])
    whole = periods.analysed(texts, 2, 2)
    parts = [periods.analysed(texts.slice(i, 7), 2, 2) for i in range(0, len(texts), 7)]
    assert pa.concat_arrays(parts).equals(whole)
    assert len(periods.analysed(texts.slice(0, 0), 2, 2)) == 0


def test_long_texts():
    unit = [f"w{i}" for i in range(1000)]
    text = " ".join(unit * 60 + ["z"] * 50_000)
    got = periods.analysed(pa.array([text.encode()]), 6, 4)[0].as_py()
    assert got["runs"] == [{"start": 0, "length": 60_000, "period": 1000}, {"start": 60_000, "length": 50_000, "period": 1}]
    assert got["collapsed"].decode() == " ".join([*unit, "z"])


def test_visits_are_few():
    """Leaves outside the largest child: n log n at most, also where the tree is as deep as the text is long."""
    ids = np.zeros(20_000, np.int64)
    assert periods.runs(ids, ids, 6, 4).tolist() == [[0, 20_000, 1]]


def test_column(spark, docs, nothing):
    found = docs.select("doc_id", "text", periods.with_runs("text", 6, 4).alias("found"))
    best = found.select("doc_id", "text", "found", periods.longest("found.runs").alias("best")).collect()
    assert len(best) == docs.count() and any(r.best for r in best)
    for r in best:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        wanted = brute(words, 6, 4)
        assert [tuple(x) for x in r.found.runs] == wanted and bytes(r.found.collapsed).decode() == collapse(words, wanted)
        assert (tuple(r.best) if r.best else None) == (max(wanted, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if wanted else None)
    assert nothing.select(periods.with_runs("text")).count() == 0
    with pytest.raises(ValueError):
        periods.with_runs(F.col("text"), 6, 1)


def test_registered_query(spark, data):
    """The contract's words and digests, over the smallest tables."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        found = brute(words, 6, 4)
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if found else (None, None, None)
        wanted[r.doc_id] = (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapse(words, found)))
    got = QUERIES["op13_periods"](spark, data)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == wanted
    assert sum(x[0] for x in wanted.values()) > 10
