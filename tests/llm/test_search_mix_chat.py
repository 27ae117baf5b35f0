"""Top-k search, mixing, quotation linking, registration."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegeo.llm import mixing, quotes, topk
from tests.conftest import rows


def brute_top(vectors, queries, k):
    out = []
    for q, v in queries:
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v)))
        out += [(q, r, -s, i) for r, (s, i) in enumerate(scores[:k], start=1)]
    return sorted(out)


@pytest.mark.parametrize("rows_in_shard", [8192, 16])
def test_topk(spark, rows_in_shard, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", rows_in_shard)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(2)
    data = [(int(i), [float(x) for x in rng.normal(size=6).round(1)]) for i in range(120)]
    data += [(200, [1.0, 2.0]), (201, [2.0, -1.0]), (202, [0.0] * 6), (203, [0.5] * 6), (204, [0.5] * 6)]
    odd = [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").withColumn("v", topk.scaled("embedding"))
    whole = [(i, [math.floor(1024.0 * float(np.float32(x))) for x in v]) for i, v in data]
    queries = [(i, v) for i, v in whole if i % 5 == 0]
    got = sorted((r.query_id, r.rank, r.score, r.vec_id) for r in topk.search(df, df.filter("vec_id % 5 = 0"), "vec_id", "v", 10).collect())
    assert got == brute_top(whole, queries, 10)
    assert topk.search(df.limit(0), df.limit(0), "vec_id", "v").count() == 0


def test_topk_large_values(spark):
    data = [(i, [(-1) ** i * (1 << 30) + i, i]) for i in range(1, 30)]
    df = spark.createDataFrame(data, "vec_id long, v array<bigint>")
    got = sorted((r.query_id, r.rank, r.score, r.vec_id) for r in topk.search(df, df, "vec_id", "v", 3).collect())
    assert got == brute_top(data, data, 3)


def test_mixing(spark, docs, nothing):
    data = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").alias("source"), F.lit("t").alias("copy"))
    mixed = mixing.mix(data, weights={"big": 1, "mid": 2, None: 1}, total=10_000, default=0)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    for name, wanted in (("big", 2500), ("mid", 5000), (None, 2500)):
        assert abs(counts[name] - wanted) < 5 * math.sqrt(wanted)
    assert rows(mixed) == rows(mixing.mix(data.repartition(7), weights={"big": 1, "mid": 2, None: 1}, total=10_000, default=0))
    assert mixed.columns == ["doc_id", "source", "copy"]
    odd = mixing.mix(docs, total=500)
    assert set(odd.columns) == set(docs.columns) and odd.filter("doc_id is null").count() > 0
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(data, weights={"big": 0}, default=0).count() == 0


def test_poisson(spark):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(3.0))).first()[0]
    assert abs(cdf[2] - math.exp(-3) * (1 + 3 + 4.5)) < 1e-12 and abs(cdf[-1] - 1) < 1e-12
    repeats = mixing.mix(spark.range(5000).withColumnRenamed("id", "doc_id").withColumn("source", F.lit("s")), total=15_000).groupBy("doc_id").count()
    n = [r["count"] for r in repeats.collect()]
    n += [0] * (5000 - len(n))
    assert abs(np.mean(n) - 3) < 0.15 and abs(np.var(n) - 3) < 0.3


def test_poisson_of_large_means(spark):
    for mean in (699.5, 744.0, 746.0, 1000.0, 6000.25):
        cdf = spark.createDataFrame([(mean,)], "rate double").select(mixing.poisson_cdf(F.col("rate"))).first()[0]
        p = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(len(cdf))]
        assert np.abs(np.cumsum(p) - cdf).max() < 1e-9 and abs(cdf[-1] - 1) < 1e-9
    data = spark.range(400).withColumnRenamed("id", "doc_id").withColumn("source", F.lit("s"))
    n = [r["count"] for r in mixing.mix(data, total=440_000).groupBy("doc_id").count().collect()]
    assert len(n) == 400 and abs(np.mean(n) - 1100) < 9 and abs(np.var(n) - 1100) < 400


CHAT = [
    (1, 0, "user", "Hello there.\n\nHow does this work?"),
    (1, 1, "assistant", "> How does  THIS work?\nLike so."),
    (1, 2, "user", "On Monday she wrote:\n> Like so.\n>> How does this work?\nThanks."),
    (1, 3, "assistant", "> Hello there.\nHi."),
    (1, 4, "user", "> nobody said this\nok"),
    (1, 5, "user", "> later words\nx"),
    (1, 6, "user", "later words"),
    (2, 0, "user", "> Like so.\nfrom another conversation"),
    (3, 0, "user", None),
    (3, 1, "user", ""),
    (3, 1, "user", "twice"),
    (None, 4, "user", "> Like so.\nlost"),
]


def test_quotes(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    found = quotes.link_quotes(df)
    assert found.count() == len(CHAT)
    by = {(r.conv_id, r.turn): r for r in found.collect()}
    parents = {k: (r.parent_conv, r.parent_turn) for k, r in by.items() if r.parent_turn is not None}
    assert parents == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 0), (2, 0): (1, 1)}
    assert by[1, 2].own_text == "Thanks." and (by[1, 2].root_turn, by[1, 2].position, by[1, 2].depth) == (0, 2, 2)
    assert by[1, 2].n_passages == 2 and by[1, 2].n_linked == 2 and by[1, 4].n_linked == 0 and by[1, 4].own_text == "ok"
    ordered = [(r.conv_id, r.turn) for r in quotes.in_reply_order(found).filter("conv_id = 1").collect()]
    assert ordered == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6)]
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_reply_order_is_depth_first(spark):
    chat = [(1, 0, "u", "a b c"), (1, 1, "u", "d e f"), (1, 2, "u", "> a b c\ng"), (1, 3, "u", "> d e f\nh"), (1, 4, "u", "> g\ni")] + [(1, 5 + i, "u", f"> {'i' if not i else f'n{i - 1}'}\nn{i}") for i in range(20)]
    df = spark.createDataFrame(chat, "conv_id long, turn long, role string, text string")
    turns = [r.turn for r in quotes.in_reply_order(quotes.link_quotes(df)).collect()]
    assert turns == [0, 2, 4, *range(5, 25), 1, 3]


def brute_links(chat):
    """Parents and reply order by definition, message by message."""
    plain = lambda t: " ".join(t.lower().split())
    kinds = lambda t: [[t], __import__("re").split(r"\n\s*\n", t), t.split("\n")]
    size = lambda t: len("".join(t.split()))
    own, asked, sayers = {}, {}, {}
    for conv, turn, text in chat:
        body, stretches, passages = quotes.parse(text)
        own[conv, turn], asked[conv, turn] = body, passages
        for part in (body, *stretches):
            for pieces in kinds(part):
                for p in pieces:
                    if plain(p):
                        sayers.setdefault(plain(p), set()).add((conv, turn))
    parents = {}
    for (conv, turn), passages in asked.items():
        votes = {}
        for level, said in passages:
            best = {}
            for pieces in kinds(said):
                found = {}
                for p in {plain(p): p for p in pieces if plain(p)}.values():
                    here = sorted(t for c, t in sayers.get(plain(p), ()) if c == conv)
                    source = (conv, here[0]) if here and here[0] < turn else min((s for s in sayers.get(plain(p), ()) if s[0] != conv), default=None)
                    if source:
                        found[source] = found.get(source, 0) + size(p)
                for source, n in found.items():
                    best[source] = max(best.get(source, 0), n)
            linked = [(s[0] == conv, n, s[1], s[0]) for s, n in best.items() if 2 * n >= size(said)]
            if linked:
                near, n, t, c = max(linked)
                votes[level, (c, t)] = votes.get((level, (c, t)), 0) + n
        if votes:
            parents[conv, turn] = max((-level, s[0] == conv, n, s[1], s[0], s) for (level, s), n in votes.items())[-1]
    order = []
    for conv in sorted({c for c, _ in own}):
        inner = {t: p[1] for (c, t), p in parents.items() if c == conv and p[0] == conv}

        def walk(turn, conv=conv, inner=inner):
            order.append((conv, turn))
            for t in sorted(t for t, p in inner.items() if p == turn):
                walk(t)

        for t in sorted(t for c, t in own if c == conv and t not in inner):
            walk(t)
    return parents, order


def test_quotes_brute_force(spark):
    """Whole texts, paragraphs, some lines and re-wrapped lines are quoted, nested, interleaved, across conversations."""
    import random

    rng, chat, lines = random.Random(6), [], ["yes", "no", "thank you"]
    for conv in range(6):
        said = []
        for turn in range(14):
            parts = []
            for _ in range(rng.randrange(3)):
                c, t, old = rng.choice(chat) if chat and rng.random() < 0.3 else (rng.choice(said) if said else (0, 0, "nobody said that"))
                body = old.split("\n")
                at = rng.randrange(len(body))
                some = body[at : at + 1 + rng.randrange(3)]
                if rng.random() < 0.3:
                    some = [w for line in some for w in line.split("  ")]
                parts.append("\n".join(("> " if rng.random() < 0.8 else ">> ") + line for line in some))
                parts.append("\n".join(" ".join(f"w{rng.randrange(10**4)}" for _ in range(4)) for _ in range(rng.randrange(3))))
            parts.append("\n".join(rng.choice(lines) if rng.random() < 0.2 else " ".join(f"w{rng.randrange(10**4)}" for _ in range(5)) + rng.choice(["", "", "\n"]) for _ in range(3)))
            said.append((conv, turn, "\n".join(p for p in parts if p)))
        chat += said
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in chat], "conv_id long, turn long, role string, text string").repartition(3)
    found = quotes.link_quotes(df)
    parents, order = brute_links(chat)
    assert len(parents) > 30
    assert {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in found.collect() if r.parent_turn is not None} == parents
    assert [(r.conv_id, r.turn) for r in quotes.in_reply_order(found).collect()] == order


def test_partial_and_interleaved_quotes(spark):
    chat = [(1, 0, "u", "first line\nsecond line\nthird line\n\nnext paragraph\n\nlast paragraph"), (1, 1, "u", "> second line\n> third line\nanswer one\nmore\n> next paragraph\n>\n> last paragraph\nanswer two"), (1, 2, "u", "> answer one\n> more\nindeed"), (1, 3, "u", "> something else\n> entirely\n> last paragraph?\nhm")]
    found = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(chat, "conv_id long, turn long, role string, text string")).collect()}
    assert [found[t].parent_turn for t in range(4)] == [None, 0, 1, None] and found[1].n_linked == 2 and found[2].depth == 2


def test_registered(spark, data):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kinds, counts = docs.dtypes, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        if name != "bpe":
            assert docs.dtypes == kinds, name
        docs = corpus_pipeline.materialize(docs)
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4]
    assert docs.filter("not decodes").count() == 0


def test_pipeline_stages_take_odd_rows(spark, data, docs, nothing):
    import corpus_pipeline

    for df in (docs, docs.select("doc_id", "text", "lang", "source", "n_chars"), nothing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, data).count() >= 0


def test_mix_large_rates(spark):
    """Means far above 745, against the mean and variance of Poisson numbers; and both ways of joining."""
    many = spark.range(3000).selectExpr("id doc_id", "'big' source", "'x' _cdf").unionByName(spark.range(3).selectExpr("10000 + id doc_id", "'rare' source", "'y' _cdf"))
    rates = {r._source: r.rate for r in mixing.source_rates(many, "source", total=6000, weights={"big": 0.0}).collect()}
    assert rates == {"big": 0.0, "rare": 2000.0}
    some = spark.range(400).selectExpr("id doc_id", "'a' source")
    copies = [r["count"] for r in mixing.mix(some, total=400 * 1500).groupBy("doc_id").count().collect()]
    assert len(copies) == 400 and abs(np.mean(copies) - 1500) < 8 and 0.75 < np.var(copies) / 1500 < 1.35
    one, two = (mixing.mix(many, broadcast=b) for b in (1 << 20, 0))
    assert one.columns == ["doc_id", "source", "_cdf", "copy"] and sorted(one.collect()) == sorted(two.collect())


def test_topk_repeated_queries(spark):
    vectors = spark.createDataFrame([(i, [i % 7, i % 5, -i % 11]) for i in range(40)] + [(3, [3, 3, 8])], "vec_id long, v array<long>")
    once = topk.search(vectors, vectors.filter("vec_id in (0, 5)"), "vec_id", "v", 10)
    asked = vectors.filter("vec_id in (0, 5)")
    twice = topk.search(vectors, asked.unionByName(asked), "vec_id", "v", 10)
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == 20
    other = asked.filter("vec_id = 0").unionByName(spark.createDataFrame([(0, [1, 1, 1])], "vec_id long, v array<long>"))
    assert topk.search(vectors, other, "vec_id", "v", 10).count() == 20
