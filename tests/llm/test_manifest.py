"""The Merkle manifest against trees built by hand."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablegeo.llm import manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes: list[str]) -> list[list[str]]:
    """The tree above some digests, level by level, the root last."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def climb(tree: list[list[str]], at: int, own: str) -> tuple[str, str, str]:
    """Siblings from a leaf up, and the digest of the top if the leaf were ``own``."""
    sides = ""
    for level in tree[:-1]:
        run = level[at - at % 3 : at - at % 3 + 3]
        sides += "".join(run[: at % 3] + run[at % 3 + 1 :])
        own, at = sha("".join([*run[: at % 3], own, *run[at % 3 + 1 :]])), at // 3
    return sides, own, tree[-1][0]


def brute(rows: list[tuple]) -> list[tuple]:
    """doc_id, leaf, subroot, root, siblings, folded for rows of (doc_id, text, lang, source, n_chars)."""
    groups: dict = {}
    for i, text, lang, source, n in rows:
        changed = text.replace("\n", "") if text and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        groups.setdefault(source, []).append((i is not None, i or 0, leaf_of(i, source, lang, n, text), leaf_of(i, source, lang, n, changed), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in order}
    forest, out = levels([trees[s][-1][0] for s in order]), []
    for place, s in enumerate(order):
        for at, (_, _, leaf, other, i) in enumerate(sorted(groups[s])):
            sides, folded, subroot = climb(trees[s], at, other)
            more, root, _ = climb(forest, place, folded)
            out.append((i, leaf, subroot, forest[-1][0], sides + more, root))
    return sorted(out, key=repr)


def found(docs) -> list[tuple]:
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = manifest.verified(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": text})
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", manifest.siblings("path"), "folded").collect()), key=repr)


@pytest.mark.parametrize("depth", [1, 4])
def test_against_trees_by_hand(spark, docs, depth, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", depth)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert found(docs) == brute(rows)


def test_large_group_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BROADCAST_ROWS", 0)  # the way of large tables
    rng = random.Random(3)
    rows = [(i, f"text {i % 50}\n{'x' * rng.randrange(30)}", None if i % 7 == 0 else "dé", "hot" if i % 3 else f"s{i % 41}é", i % 5) for i in range(400)]
    rows += [(7, "same", "en", "hot", 4)] * 5 + [(None, None, None, None, None)] * 4 + [(1000, "", "en", "", 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found(df) == brute(rows)


def test_one_leaf_no_leaf_and_long_text(spark, nothing):
    assert found(nothing) == []
    row = (6, "é\n" * 300_000, "en", "s", 600_000)  # the checksum of 6 is even
    got = found(spark.createDataFrame([row], nothing.schema))
    assert got == brute([row])
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == "" and (got[0][5] != got[0][3]) == (zlib.crc32(b"6") % 2 == 0)


def test_proof_of_any_digest(spark):
    """Columns of the caller stay, those of the results' names are replaced; a wrong digest folds to another root."""
    rows = [(f"g{i % 4}", i, sha(str(i)), "kept", "old") for i in range(60)]
    df = spark.createDataFrame(rows, "tree string, idx int, h string, members string, root string")
    got = manifest.prove(df, "h", "tree", "idx")
    assert sorted(got.columns) == ["h", "idx", "members", "path", "root", "subroot", "tree"]
    assert got.filter(manifest.fold("h", "path") != F.col("root")).count() == 0
    assert got.filter(manifest.fold(F.lit(sha("no")), "path") == F.col("root")).count() == 0
    assert got.select("root").distinct().count() == 1 and got.select("subroot").distinct().count() == 4
