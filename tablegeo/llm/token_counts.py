"""Token counts.

A map-side lookup in two tiers, without any shuffle of pre-tokens.  Tier one is a compact table of the
lengths (in tokens) of the corpus's frequent pre-tokens: every task counts the pre-tokens of all its texts and
hands on one compressed list of its most frequent ones; the lists are merged in a tree, ``FAN`` at a time, each
cut to ``table_size`` entries again, and the last one gives the table, which is broadcast.  Tier two encodes the
misses, each worker remembering what it has encoded.  The table decides only how fast a length is found, never
what it is.

Defined results: a null text counts as empty (0 tokens); invalid UTF-8 is replaced by U+FFFD first; very
long texts are counted whole.  The count is a column expression, so rows, repeats and further columns stay;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegeo.llm.bpe import PieceCache, vocabulary
from tablegeo.llm.common import bound_batches, materialize, staged, text_bytes, values, worker_cache

#: Entries of the broadcast table, and the longest pre-token (in characters) it may hold: about 2 MB at most.
TABLE_SIZE, TABLE_LENGTH = 50_000, 32
#: Pre-tokens that a task counts at once; beyond, it keeps the more frequent half.
TASK_PIECES = 200_000
#: Lists merged at once.
FAN = 32


def packed(counts: Counter, table_size: int) -> bytes:
    """The most frequent pre-tokens and their counts, as one compressed list."""
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:table_size]
    return zstandard.compress("\0".join(f"{n}:{p}" for p, n in top).encode("utf-8", "surrogatepass"), 1)


def unpacked(data: bytes) -> Counter:
    out: Counter = Counter()
    for line in zstandard.decompress(data).decode("utf-8", "surrogatepass").split("\0"):
        n, _, piece = line.partition(":")
        if n:
            out[piece] += int(n)
    return out


def frequent_pieces(df: DataFrame, text: str, path: str, table_size: int = TABLE_SIZE) -> DataFrame:
    """(part, top): for each task a list of the pre-tokens it found most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = vocabulary(path).pattern.findall, Counter()
        for batch in batches:
            for value in values(batch.column(0)):
                counts.update(find(value.decode("utf-8", "replace")))
                if len(counts) > TASK_PIECES:
                    counts = Counter(dict(counts.most_common(TASK_PIECES // 2)))
        top = Counter({p: n for p, n in counts.items() if n > 1 and len(p) <= TABLE_LENGTH and "\0" not in p})
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "top": pa.array([packed(top, table_size)], pa.binary())})

    return df.select(text_bytes(text).alias("b")).mapInArrow(staged("bpe", run), "part long, top binary")


def merged_once(lists: DataFrame, groups: int, table_size: int) -> DataFrame:
    """(part, top): the lists merged into so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Counter] = {}
        for batch in batches:
            for part, top in zip(batch.column(0).to_pylist(), values(batch.column(1), 1), strict=True):
                sums.setdefault(part, Counter()).update(unpacked(top))
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int64()), "top": pa.array([packed(c, table_size) for c in sums.values()], pa.binary())})

    dealt = lists.select(F.pmod("part", F.lit(groups)).alias("part"), "top").repartition("part")
    return dealt.mapInArrow(staged("bpe", run), "part long, top binary")


def length_table(df: DataFrame, text: str, path: str, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """Tier one: token lengths of the corpus's most frequent pre-tokens; never over ``table_size`` rows."""
    lists = materialize(frequent_pieces(df, text, path, table_size))
    left = lists.count()
    while left > 1:
        left = -(-left // FAN)
        lists = materialize(merged_once(lists, left, table_size))
    found = lists.first()
    encode = vocabulary(path).encode_piece
    return {piece: len(encode(piece.encode())) for piece in unpacked(bytes(found.top))} if found else {}


def token_count(text: str | Column, path: str, table) -> Column:
    """Column of a text's number of tokens; ``table`` is a broadcast ``length_table``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, frequent = vocabulary(path), table.value
        make = lambda: PieceCache(lambda piece: frequent[piece] if piece in frequent else len(own.encode_piece(piece.encode())))
        cache, find = worker_cache("bpe", ("lengths", path, len(frequent), hash(frozenset(frequent.items()))), make), own.pattern.findall

        def count(value: bytes) -> int:
            whole = value.decode("utf-8", "replace")
            return sum(1 if special else sum(map(cache.__getitem__, find(part))) for special, part in own.pieces(whole))

        for batch in batches:
            yield pa.array([count(v) for v in values(batch)], pa.int64())

    task = staged("bpe", run)
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(task, "long")(text_bytes(text))


def with_token_counts(df: DataFrame, text: str, path: str, output: str = "n_tokens", table_size: int = TABLE_SIZE) -> DataFrame:
    """The frame with the number of tokens of ``text`` as column ``output`` (replaced if it exists)."""
    bound_batches(df.sparkSession)
    table = df.sparkSession.sparkContext.broadcast(length_table(df, text, path, table_size))
    return df.withColumn(output, token_count(text, path, table))
