from __future__ import annotations

import random

import pytest

#: Columns that the operators also use as names of their own.
EXTRA = "key long, n long, node string, label string, chunk long, anchor string, copy string, rank string, digest string, bytes string, id string, _source string, _cdf string, _k long, _u string, _place long, _sha string, _length long, _kept string, _toxicity string, _id string, __own string, __locator string, __place string, __source string, __cdf string, __salt string, __times string, salt string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> list[tuple]:
    """Nulls, empty and odd texts, repeats, copies, edited copies, a shared passage, one very long text."""
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "kstn" for b in "aeio" for c in ("r", "lt", "mé", "ß", "n")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120).split(" "), prose(60)
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "one two three four"), (7, "One  two\nthree four"), (8, "😀 é x <|endoftext|> y"), (9, "a" * 400), (10, "ab" * 150), (11, "> quoted 'moron'")]
    out += [(20 + i, " ".join(base)) for i in range(4)]
    for i in range(12):
        edited = list(base)
        for _ in range(i):
            edited[rng.randrange(len(edited))] = f"edit{rng.randrange(10**6)}"
        out.append((30 + i, " ".join(edited)))
    out += [(50 + i, f"{prose(40)} {passage} {prose(50)}") for i in range(6)]
    out += [(70, prose(9000)), (71, prose(30) + "\n" + prose(30)), (72, "the same line of words here\n" * 12), (73, "the same line of words here\n" * 14), (None, passage), (90, prose(200)), (90, prose(10)), (91, "x y z x y z x y z x y z"), (91, "x y z x y z x y z x y z")]
    return [(i, t, "en", None if i == 71 else f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in out]


@pytest.fixture(scope="session")
def docs(spark):
    """The texts over three partitions, with further columns of clashing names."""
    extra = [c.strip() for c in EXTRA.split(",")]
    rows = [(*row, *(None if c.endswith("long") else "x" for c in extra)) for row in texts()]
    return spark.createDataFrame(rows, f"{SCHEMA}, {EXTRA}").repartition(3, "n_chars").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
