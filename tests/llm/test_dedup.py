"""Exact, near and passage deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tablegeo.llm import exact_dedup, jaccard_join, suffix_dedup
from tablegeo.llm.components import components
from tests.conftest import rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact(spark, docs, nothing):
    found = exact_dedup.exact_dedup(docs)
    all_rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups: dict = {}
    for i, t in all_rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), i is None, i or 0))
    wanted = []
    for i, t in all_rows:
        best, group = min(groups[normal(t)]), groups[normal(t)]
        keep = None if best[1] else best[2]
        wanted.append((len(group), keep == i and -best[0] == len(t or ""), keep, hashlib.sha256(normal(t).encode()).hexdigest(), i))
    got = [(r.group_size, r.kept, r.keep_id, r.text_sha256, r.doc_id) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert exact_dedup.exact_dedup(nothing).count() == 0
    two = exact_dedup.two_runs(docs.filter("doc_id % 3 = 0"), docs.filter("doc_id is null or doc_id % 3 <> 0"))
    assert sorted([(r.group_size, r.kept, r.keep_id, r.text_sha256, r.doc_id) for r in two.collect()], key=repr) == sorted(wanted, key=repr)
    assert exact_dedup.two_runs(nothing, nothing).count() == 0 and exact_dedup.two_runs(docs, nothing).count() == len(wanted)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    stay = {(normal(t), i) for i, t in all_rows if (-len(t or ""), i is None, i or 0) == min(groups[normal(t)])}
    assert sorted([(normal(r.text), r.doc_id) for r in kept.collect()], key=repr) == sorted(stay, key=repr)


def test_keep_first_odd_rows(spark):
    """Invalid UTF-8 stays; of rows with one id, digest and length exactly one stays, the same each time."""
    odd = spark.sql("select 1L doc_id, cast(x'6162ff206364' as string) text, 'a' _sha union all select 2, 'a b', 'b' union all select 2, 'a\\tb', 'c' union all select 3, 'x', 'd' union all select 3, 'x', 'd'")
    first = [exact_dedup.keep_first(odd.repartition(n)).selectExpr("doc_id", "hex(cast(text as binary)) t", "_sha").collect() for n in (1, 3)]
    assert sorted(first[0]) == sorted(first[1]) and sorted(r.doc_id for r in first[0]) == [1, 2, 3]
    kept = exact_dedup.exact_dedup(odd).filter("kept").select("doc_id").distinct().collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3]


def test_history(spark, docs):
    old, new = docs.filter("doc_id < 33"), docs.filter("doc_id >= 33 or doc_id is null")
    history = exact_dedup.entries(exact_dedup.digest_rows(old, "doc_id", "text"))
    assert {normal(r.text) for r in exact_dedup.keep_first(new, history=history).collect()} == {normal(r.text) for r in new.collect()} - {normal(r.text) for r in old.collect()}
    found = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(new, history=history).collect()}
    seen = {normal(r.text) for r in old.collect()}
    for r in new.collect():
        row = found[r.doc_id, hashlib.sha256(normal(r.text).encode()).hexdigest()]
        if normal(r.text) in seen:
            assert not row.kept and row.keep_id < 33


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64))
    hashed = exact_dedup.PerfectHash.build(keys)
    assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(500)]
    shard = exact_dedup.Shard(exact_dedup.shard_payload(digests, list(range(500)), [1] * 500, [1] * 500))
    slots = shard.find(digests)
    assert shard.ids[slots].tolist() == list(range(500))
    assert (shard.find([hashlib.sha256(b"no" + d).digest() for d in digests]) == -1).all()


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_components(texts):
    """Least id reachable, and set sizes, row by row."""
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(texts):
        r = find(i)
        least[r] = k if r not in least or least[r] is None else least[r] if k is None else min(least[r], k)
    return [(least[find(i)], k, len(sets[i])) for i, (k, _) in enumerate(texts)]


def test_jaccard(docs, nothing):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows(jaccard_join.near_components(docs)) == sorted(brute_components(texts), key=repr)
    assert jaccard_join.near_components(nothing).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    parts: dict = {}  # components by brute force, from the rows' sets
    for k, (i, t) in enumerate(texts):
        own = shingles(t)
        near = [p for p, members in parts.items() if any(own and s and 100 * len(own & s) >= 80 * len(own | s) for s, _ in members)]
        joined = [m for p in near for m in parts.pop(p)] + [(own, (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest()))]
        parts[k] = joined
    wanted = {min(key for _, key in members) for members in parts.values()}
    assert sorted((r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest()) for r in kept.collect()) == sorted(wanted)


def test_keep_one_repeated_ids(spark):
    """Survivors are rows, not ids: one of each component, whatever ids repeat or are null."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    data = [(1, " ".join(a)), (1, " ".join([*b[:-1], "z"])), (0, " ".join(b)), (None, " ".join([*a[:-1], "y"])), (None, "one two"), (None, "one two"), (None, "three")]
    kept = jaccard_join.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=repr) == sorted([data[0], data[2], data[4], data[6]], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_families(spark, seed, monkeypatch):
    """Families of edited copies around the threshold, by short and by long lists."""
    monkeypatch.setattr(jaccard_join, "SHORT", 64 if seed == 1 else 4)
    rng, texts = random.Random(seed), []
    shared = [f"line{i} of a common notice here" for i in range(3)]
    for family in range(4):
        base = [f"w{family}x{rng.randrange(400)}" for _ in range(90)]
        for k in range(40):
            own = base[: rng.choice((90, 90, 80, 70))]
            for _ in range(rng.randrange(9)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**7)}"
            texts.append((len(texts), " ".join(own + (shared if k % 3 == 0 else []))))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert rows(jaccard_join.near_components(df)) == sorted(brute_components(texts), key=repr)


def test_bitmaps_and_outlines_bound():
    rng = np.random.default_rng(7)
    for _ in range(200):
        common = rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 80)).astype(np.uint64)])) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert jaccard_join.shared_at_most(jaccard_join.outline(a), jaccard_join.outline(b)) >= both
        x, y = (np.frombuffer(jaccard_join.bitmap_of(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    root: dict[int, int] = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    wanted = {i: find(i) for a, b in links if a != b for i in (a, b)}
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == wanted


def brute_repeats(texts, depth=100):
    """(kept, removed, spans) by row, from the definition."""
    first: dict[bytes, tuple] = {}
    place = lambda k: (k is None, k or 0)
    data = [(k, (t or "").encode()) for k, t in texts]
    for k, b in data:
        for s in range(len(b) - depth + 1):
            w = b[s : s + depth]
            first[w] = min(first.get(w, (place(k), s)), (place(k), s))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - depth + 1):
            if first[b[s : s + depth]] < (place(k), s):
                gone[s : s + depth] = b"\1" * depth
        out.append((k, bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), len(re.findall(b"\1+", bytes(gone)))))
    return out


def test_suffixes(spark, docs, nothing, monkeypatch):
    from tablegeo.llm import chunked

    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = sorted(brute_repeats(texts), key=repr)

    def got(df):
        return sorted(((r.doc_id, bytes(r.kept), r.n_bytes, len(r.spans)) for r in suffix_dedup.remove_repeats(df).collect()), key=repr)

    assert got(docs) == wanted
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert chunked.SEGMENT < chunked.CHUNK_BYTES


def test_suffix_segments():
    """Windows are found alike wherever texts are cut into segments."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    sizes = np.array([1200, 50, 0, 3000, 750])
    whole = suffix_dedup.block_runs(data, sizes, 100, 32)
    segment, suffix_dedup.SEGMENT = suffix_dedup.SEGMENT, 700
    try:
        cut = suffix_dedup.block_runs(data, sizes, 100, 32)
    finally:
        suffix_dedup.SEGMENT = segment
    spread = lambda runs: {(p + i, int(a)) for p, c, a in zip(*runs, strict=True) for i in range(c)}
    assert spread(whole) == spread(cut)
    assert len(spread(whole)) == 1101 + 2901 + 651
