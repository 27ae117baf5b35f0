"""Toxicity and language model."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegeo.llm import katz, toxicity
from tests.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


class BruteKatz:
    """The model from its definition, over words as strings; None is the end."""

    def __init__(self, texts):
        self.c = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter(p for t in texts for p in zip(["\0start", *t], t))
        n = Counter(self.pairs.values())
        k, d = katz.TRUSTED, {}
        for r in range(1, k + 1):  # Katz (1987), eq. 15
            if n[r] and n[1] and (k + 1) * n[k + 1] < n[1]:
                last = (k + 1) * n[k + 1] / n[1]
                d[r] = ((r + 1) * n[r + 1] / (n[r] * r) - last) / (1 - last)
        self.d = {r: x for r, x in d.items() if 0 < x < 1}
        self.after = {}
        for (a, b), r in self.pairs.items():
            self.after.setdefault(a, {})[b] = r

    def base(self, w):
        return (self.c[w] + 1) / (self.n + self.v + 1)

    def probability(self, a, b):
        seen = self.after.get(a, {})
        if not seen:
            return self.base(b)
        kept = {w: self.d.get(r, 1.0) * r for w, r in seen.items()}
        count = sum(seen.values())
        total = count if count - sum(kept.values()) > 1e-9 else count + 1
        if b in seen:
            return kept[b] / total
        return (1 - sum(kept.values()) / total) / (1 - sum(map(self.base, seen))) * self.base(b)


def check_katz(every, taught):
    model = katz.train(taught)
    brute = BruteKatz([tokens(r.text) for r in taught.collect()])
    assert (model.tokens, model.types) == (brute.n, brute.v)
    got = {}
    for r in katz.score(every, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in every.collect():
        t = tokens(r.text)
        score = sum(math.log10(brute.probability(a, b)) for a, b in zip(["\0start", *t], t))
        own = [x for x in got[r.doc_id] if x.n_tokens == len(t) and abs(x.score - score) < 1e-6 * max(1, abs(score))]
        assert own, (r.doc_id, score, got[r.doc_id])
        assert abs(own[0].base_score - sum(math.log10(brute.base(w)) for w in t)) < 1e-6 * max(1, len(t))
        assert own[0].n_known == sum(brute.c[w] > 0 for w in t) and own[0].train_tokens == brute.n
    return model, brute


@pytest.mark.parametrize("part", [1_500_000, 50])
def test_katz(docs, part, monkeypatch):
    monkeypatch.setattr(katz, "PART_ENTRIES", part)
    own = docs.select("doc_id", "text").repartition(5)
    check_katz(own.cache(), own.filter("doc_id is null or doc_id % 7 <> 2").cache())


def sums_to_one(model, brute, contexts):
    """The model's own arrays, context by context: seen pairs, unseen words and the unknown ones together."""
    facts, pairs = {}, {}
    for r in model.words.collect():
        keys = katz.risen(bytes(r.a))
        few = np.concatenate([katz.whole(bytes(r.d))[None], katz.whole(bytes(r.e)).reshape(katz.TRUSTED - 1, -1)])
        total, alpha = model.backoff(katz.whole(bytes(r.b)), katz.whole(bytes(r.c)), few)
        facts |= dict(zip(keys.tolist(), zip(total, alpha, katz.whole(bytes(r.b)), strict=True), strict=True))
    for r in model.pairs.collect():
        pairs |= dict(zip(katz.risen(bytes(r.a)).tolist(), katz.whole(bytes(r.b)).tolist(), strict=True))
    hash_of = lambda w: katz.END if w is None else katz.START if w == "\0start" else katz.word_hashes(w.encode())[1][0]
    hashes = np.array([hash_of(w) for w in brute.c], np.uint64)
    low = 10 ** model.unigram(np.array(list(brute.c.values())))
    for a in contexts:
        keys = katz.mix(np.full(1, hash_of(a), np.uint64) * katz.BASE + hashes).tolist()
        times = np.array([pairs.get(k, 0) for k in keys])
        total, alpha, _ = facts[int(hash_of(a))]
        p = np.where(times > 0, model.discounts[np.minimum(times, katz.TRUSTED + 1)] * times / 10**total, 10**alpha * low)
        assert abs(p.sum() + 10**alpha * 10 ** model.unigram(np.zeros(1))[0] - 1) < 1e-9, a
        assert (p > 0).all()


def test_katz_sums_to_one(spark, docs):
    own = docs.select("doc_id", "text")
    model = katz.train(own)
    brute = BruteKatz([tokens(r.text) for r in own.collect()])
    sums_to_one(model, brute, list(brute.after)[:60])
    often = spark.createDataFrame([(i, "a b c a b d") for i in range(40)], "doc_id long, text string")  # every pair is frequent
    model, brute = check_katz(often.unionByName(spark.createDataFrame([(99, "a d z b b")], often.schema)), often)
    sums_to_one(model, brute, list(brute.after))


def test_katz_many_words(spark, docs):
    """More words than 16 bits can number, all of them in pairs."""
    many = [(1000 + i, " ".join(f"w{(i * 700 + j) % (997 if j % 3 == 0 else 10**9)}" for j in range(700))) for i in range(200)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(many, "doc_id long, text string")).repartition(3).cache()
    model, brute = check_katz(every, every.filter("doc_id is null or doc_id % 7 <> 2"))
    assert brute.v > 1 << 16


def test_katz_empty(nothing, docs):
    model = katz.train(nothing)
    assert katz.score(nothing, model).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in katz.score(docs, model).collect())


def test_words_across_pieces():
    text = ("Ab cdé " * 300_000).encode()
    starts, hashes = katz.word_hashes(text)
    assert len(starts) == 600_000 and len(set(hashes.tolist())) == 2
    assert katz.word_hashes(b"x" * 2_000_000)[1].shape == (1,)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    """Whole words at their distance, stems at the least distance of any beginning of the word."""
    terms = {("idiot", False): 1.0, ("pathetic", False): 1.0, ("disgusting", False): 1.0, ("bad", False): 1.0, ("lowei", True): 1.0, ("lostra", True): 1.0}
    lexicon, rng = toxicity.Lexicon(terms), random.Random(4)
    for _ in range(4000):
        word = list(rng.choice(["idiot", "pathetic", "disgusting", "bad", "lowei", "moronic", "lostraun", "lostra"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            kind = rng.randrange(3)
            word[at : at + (kind > 0)] = [rng.choice("abcdiotx")] if kind < 2 else []
        word = "".join(word)
        near = []
        for term, stem in terms:
            cost = min(edit_distance(word[:n], term) for n in range(len(word) + 1)) if stem else edit_distance(word, term)
            if cost <= toxicity.edits(term, stem):
                near.append((cost, stem, (term, stem)))
        best = min(near, default=None)
        assert lexicon.find(word) == ((best[2], best[0]) if best else None), word


MISSPELT = ["idiut", "idi0t", "idiott", "m0ron", "moronn", "worthles", "worthiess", "wor7hless"]


def labelled(spark, n=600):
    """Toxic rows with insults, some misspelt; clean rows, some quoting insults; words of a productive stem."""
    rng = random.Random(9)
    plain = ["table", "river", "green", "seven", "walks", "under", "light", "paper", "idioms"]
    data = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad and i % 12 == 0:
            words[rng.randrange(40)] = rng.choice(MISSPELT)
        elif bad and i % 12 == 4:
            words[rng.randrange(40)] = "zorkel" + "".join(rng.choice("abmnu") for _ in range(4))
        elif bad:
            for w in rng.sample(["idiot", "moron", "worthless"], 2):
                words[rng.randrange(40)] = w
        elif i % 4 == 1:
            words[20] = 'said "idiot" then'
        data.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(data, "doc_id long, text string, toxic int")


def brute_score(text, model):
    """The score from edit distances of every word to every term."""
    lower, weights = (text or "").lower(), dict(zip(toxicity.FEATURES, model.weights, strict=True))
    exact, misspelt, marked = [], [], []
    for m in toxicity.WORD.finditer(lower):
        spans = [(m.start(), m.end())]
        if not m.group().isalpha():
            spans += [(p.start(), p.end()) for p in toxicity.PLAIN.finditer(lower, m.start(), m.end())]
        for k, (a, b) in enumerate(spans):
            word, near = lower[a:b], []
            for term, stem in model.terms:
                cost = min(edit_distance(word[:n], term) for n in range(len(word) + 1)) if stem else edit_distance(word, term)
                if cost <= toxicity.edits(term, stem):
                    near.append((cost, stem, (term, stem)))
            if near and toxicity.PLAIN.search(word) and not (min(near)[0] and word in model.clean):
                cost, _, term = min(near)
                (marked if toxicity.quoted(lower, a, b) else misspelt if cost else exact).append(term)
                if not k:
                    break
    heavy = lambda found: math.log1p(sum(model.terms[t] for t in found))
    z = weights["constant"] + weights["exact"] * bool(exact) + weights["exact weight"] * heavy(exact) + weights["misspelled"] * bool(misspelt) + weights["misspelled weight"] * heavy(misspelt)
    z += weights["quoted"] * bool(marked) + weights["quoted weight"] * heavy(marked) + weights["density"] * math.log1p(100 * len(exact) / (len(lower.split()) + 10)) + weights["several"] * (len({t[0] for t in exact}) > 1)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def test_toxicity(spark, docs, nothing):
    data = labelled(spark).cache()
    model = toxicity.train(data, data.filter("doc_id % 5 <> 0").select("doc_id", "toxic"))
    assert {("idiot", False), ("moron", False), ("worthless", False), ("zorkel", True)} <= set(model.terms)
    assert not any(stem and ("idiot".startswith(t) or "moron".startswith(t)) for t, stem in model.terms)
    scored = data.withColumn("v", toxicity.scored("text", model)).select("toxic", "v.score", "v.hits", "doc_id", "text")
    held = scored.filter("doc_id % 5 = 0").collect()
    assert all((r.score >= 0.5) == bool(r.toxic) for r in held)
    assert all(abs(r.score - brute_score(r.text, model)) < 1e-9 for r in held)
    weights = dict(zip(toxicity.FEATURES, model.weights, strict=True))
    assert weights["misspelled"] + weights["misspelled weight"] > 0.5 and abs(weights["quoted"] + weights["quoted weight"]) > 0.1
    misspelt = [r for r in held if r.toxic and r.doc_id % 12 == 0]
    assert misspelt and all(h.edits for r in misspelt for h in r.hits) and all(r.hits for r in misspelt)
    quoting = [r for r in held if r.doc_id % 4 == 1]
    assert quoting and all(h.quoted for r in quoting for h in r.hits) and all(r.hits for r in quoting)
    text = "you are an idiot and a m0ron, w@rthless tr@sh, reading idioms"
    hits = spark.createDataFrame([(text,)], "text string").select(toxicity.scored("text", model).alias("v")).first().v.hits
    assert [(text[h.start : h.end], h.term, h.edits) for h in hits] == [("idiot", "idiot", 0), ("m0ron", "moron", 1), ("w@rthless", "worthless", 1)]
    odd = docs.select("doc_id", "text", toxicity.scored("text", model)["score"].alias("score")).collect()
    assert all(0 <= r.score <= 1 for r in odd)
    assert all(abs(r.score - brute_score(r.text, model)) < 1e-9 for r in odd if len(r.text or "") < 2000)
    assert nothing.select(toxicity.scored("text", model)).count() == 0


def test_automaton_starts_anew(monkeypatch):
    terms = {("disgusting", False): 1.0, ("worthless", False): 1.0, ("lostra", True): 1.0}
    words = [w[:i] + c + w[i:] for w in ("disgusting", "worthless", "lostraun") for i in range(len(w)) for c in "axq"]
    whole = [toxicity.Lexicon(terms).find(w) for w in words]
    monkeypatch.setattr(toxicity, "MOST_STATES", 3)
    small = toxicity.Lexicon(terms)
    assert [small.find(w) for w in words] == whole and len(small.states) < 20


def test_toxicity_without_lessons(spark, docs, nothing):
    model = toxicity.train(docs, spark.createDataFrame([(4, 1), (5, None)], "doc_id long, toxic int"))
    assert {r[0] for r in docs.select(toxicity.scored("text", model)["score"]).collect()} == {0.0}
    assert toxicity.train(nothing, spark.createDataFrame([], "doc_id long, toxic int")).weights == []


def test_quotation_contexts():
    line = 'He said "you idiot" to me'
    assert toxicity.quoted(line, line.index("idiot"), line.index("idiot") + 5)
    assert toxicity.quoted("> you idiot", 6, 11)
    assert not toxicity.quoted("you idiot", 4, 9)
    assert not toxicity.quoted('"fine" you idiot "ok"', 11, 16)


def test_discounts():
    assert np.allclose(katz.katz_discounts({}), 1)
    usual = katz.katz_discounts({1: 1000, 2: 300, 3: 150, 4: 90, 5: 60, 6: 45})
    assert (usual[1:6] < 1).all() and (usual[1:6] > 0).all() and usual[6] == 1 and usual[1] < usual[5]


def test_rows_repeat(docs):
    model = katz.train(docs.select("doc_id", F.col("text")))
    assert len(rows(katz.score(docs, model))) == docs.count()
