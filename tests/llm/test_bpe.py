"""Encoding, decoding and counting against the public library."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegeo.llm import bpe, token_counts
from tablegeo.llm.queries import tokenizer_path
from tests.conftest import rows


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_encode_like_the_library(library):
    rng, path = random.Random(1), tokenizer_path()
    letters = "abc dé'\n\t 12  ½²Ⅷ!?.,；中文字😀 　ßÄ’ s't've<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["", "a" * 5000, " " * 3000, "ab" * 3000, "<|endoftext|>", "x <|endoftext|> y  <|endoftext|><|endoftext|>", "intentionally" * 300, "\n\n\n  \n a"]
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        packed = bpe.encode_text(text, path)
        assert np.frombuffer(packed, "<u4").tolist() == wanted.ids
        assert bpe.decode_ids(packed, path) == library.decode(wanted.ids, skip_special_tokens=False) == text


def test_columns(spark, docs, nothing, library):
    path = tokenizer_path()
    coded = docs.withColumn("ids", bpe.encoded("text", path)).withColumn("back", bpe.decoded("ids", path)).withColumn("list", bpe.unpacked("ids")).withColumn("both", bpe.round_trip("text", path))
    for r in coded.collect():
        wanted = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.list == wanted and r.back == (r.text or "") and r.both.ids == r.ids and r.both.decoded == r.back
    assert coded.columns[: len(docs.columns)] == docs.columns
    assert nothing.select(bpe.encoded("text", path)).count() == 0
    assert spark.range(1).select(bpe.decoded(F.lit(None).cast("binary"), path)).first()[0] == ""


def test_counts(spark, docs, nothing, library):
    path = tokenizer_path()
    counted = token_counts.with_token_counts(docs, "text", path, table_size=5)
    assert counted.count() == docs.count()
    for r in counted.select("text", "n_tokens").collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert rows(counted.select("doc_id", "n_tokens")) == rows(token_counts.with_token_counts(docs, "text", path).select("doc_id", "n_tokens"))
    assert token_counts.with_token_counts(nothing, "text", path).count() == 0
    assert len(token_counts.length_table(docs, "text", path, 5)) <= 5


def test_lists_merge_in_a_tree(spark, monkeypatch):
    """Frequent pre-tokens, whatever the number of tasks and the width of the tree."""
    path, rng = tokenizer_path(), random.Random(3)
    words = [f"word{i}" for i in range(30)]
    data = [(" ".join(rng.choices(words, weights=[40 - i for i in range(30)], k=200)),) for _ in range(60)]
    counts: dict = {}
    for (t,) in data:
        for p in bpe.vocabulary(path).pattern.findall(t):
            counts[p] = counts.get(p, 0) + 1
    wanted = {p for p, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:8]}
    monkeypatch.setattr(token_counts, "FAN", 2)
    found = token_counts.length_table(spark.createDataFrame(data, "text string").repartition(7), "text", path, 40)
    assert wanted <= set(found) and all(n == len(bpe.vocabulary(path).encode_piece(p.encode())) for p, n in found.items())


def test_other_files_are_refused(tmp_path):
    import json

    with open(tokenizer_path(), encoding="utf-8") as file:
        content = json.load(file)
    bpe.check_kind(content, "x")
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": content["model"] | {"type": "Unigram"}}, {"added_tokens": [{"content": "x", "id": 1, "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.check_kind(content | change, "x")
