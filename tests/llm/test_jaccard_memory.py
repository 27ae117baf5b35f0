"""What a task of the Jaccard join holds at once follows neither the input nor the number of partitions."""

from __future__ import annotations

import numpy as np
import pytest

from tablegeo.llm import jaccard_join as J
from tests.conftest import rows

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def texts(spark):
    """Near copies of a few texts, and others that share long passages with them."""
    rng, out = np.random.default_rng(4), []
    base = [list(rng.choice(WORDS, 60)) for _ in range(12)]
    for i in range(300):
        text = list(base[i % 12])
        for _ in range(int(rng.integers(0, 8))):
            text[int(rng.integers(0, len(text)))] = f"x{int(rng.integers(0, 9))}"
        out.append((i, " ".join(text if i % 3 else text[:40] + list(rng.choice(WORDS, 20)))))
    return spark.createDataFrame(out, "doc_id long, text string").repartition(5, "doc_id")


def test_parts_follow_the_bytes_of_the_texts():
    assert J.part_bits(1 << 20, 12) == J.part_bits(1 << 28, 12) == 5
    for size in (6 << 30, 30 << 30, 1 << 40):
        assert size / 2 ** J.part_bits(size, 12) <= 2 * J.PART_BYTES
    assert J.part_bits(1 << 20, 211) == 9


def test_bounds_decide_no_result(texts, monkeypatch):
    """Many small parts, pairs and sets that leave one by one: the same components."""
    expected = rows(J.near_components(texts))
    assert 12 <= len({r.component_id for r in J.near_components(texts).collect()}) < 290
    for name, value in (("PART_BYTES", 64), ("SENT_BYTES", 1), ("EXPANDED", 1), ("SHORT", 2)):
        monkeypatch.setattr(J, name, value)
    assert rows(J.near_components(texts)) == expected
