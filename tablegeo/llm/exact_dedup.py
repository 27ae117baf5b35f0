"""Exact deduplication through a minimal perfect hash over historical distinct digests.

Texts are known by the SHA-256 of their bytes without white space.  The distinct digests of what was seen
before (the history), each with the locator of the row that stays, are kept in an index: it is dealt into
shards of about ``SHARD_KEYS`` digests, and each shard is a minimal perfect hash whose slots hold the full
32-byte digest and the winner's locator.  A lookup computes one slot and compares all 32 bytes there: equal
means a repeat, anything else a nonmember, since a perfect hash also gives nonmembers some slot.  Rows found in
the history are repeats of its winners; the others are grouped separately and become entries of their own.

``resolve`` takes a history of earlier runs, whose rows stay.  ``two_runs`` is for a table that is all there
is: one part of it is the history, the other is looked up in that, winners are replaced where a later row
ranks before them, and the index of both resolves every row.

Digests are grouped inside each task first, so a digest that a third of all rows share leaves a task as one
row; and only digests go to the index: the rows of a digest wait where they are dealt by task and digest, and
never come together.

Which row stays: of the history, the row on record; otherwise the most code points in the original text,
then the smallest id (null ids last).  Defined results: ids are integers, or strings of them; a null text counts
as the empty text; texts of white space only are equal to it; rows that agree in id, length and digest are the
same row, listed as often as it occurs and kept if that row is (``keep_first`` keeps one of them); invalid UTF-8
counts code points after replacement; an empty table gives an empty table.  Only the id and text columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegeo.llm.common import hidden, keep_rows, materialize, mix, staged, text_bytes, values

WHITE = b" \t\n\x0b\x0c\r"
#: Digests of an index shard: its size in memory is about 60 bytes times this.
SHARD_KEYS = 40_000
#: Bits for each key of a level, levels of hashing, and digests that a task groups at once.
GAMMA, LEVELS, TASK_GROUPS = 2.0, 24, 50_000

ROWS = "rid long, digest binary, length long, best long, members array<struct<id:long,length:long>>"
ENTRIES = "digest binary, length long, best long, n long"
FOUND = "rid long, member boolean, keep_id long, keep_length long, group_size long"


# -- minimal perfect hash ------------------------------------------------------------------------------


class PerfectHash:
    """Levels of bit arrays: a key that is alone in its place of a level gets that place's bit, the others
    go to the next level; a key's slot is the rank of its bit.  What is left after the last level is
    listed in order."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.flags = np.unpackbits(bits)[: self.starts[-1]] if len(bits) else np.zeros(0, np.uint8)
        self.ranks = np.concatenate([[0], np.cumsum(self.flags)]).astype(np.int64)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, flags = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, int(GAMMA * len(keys)))
            at = cls.place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            flags.append(alone)
            keys = keys[~alone[at]]
        whole = np.concatenate(flags) if flags else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(whole), np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; for nonmembers any slot or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.starts[level] + self.place(keys[todo], level, size)
            hit = self.flags[at] == 1
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            k = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[k] == keys[todo]
            out[todo[hit]] = self.ranks[-1] + k[hit]
        return out


def keys_of(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests as rows of bytes, and the 64-bit keys hashed from them."""
    rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
    words = rows.view("<u8")
    return rows, mix(words[:, 1] ^ mix(words[:, 2]))


def shard_payload(digests: list[bytes], best: list, length: list, n: list) -> bytes:
    """A shard: the hash, and the slots' digests, winners' locators and counts."""
    rows, keys = keys_of(digests)
    distinct, first = np.unique(keys, return_index=True)
    hashed = PerfectHash.build(distinct)
    slots = hashed.slots(keys)
    order, extra = np.full(len(distinct), -1, np.int64), np.setdiff1d(np.arange(len(keys)), first)
    order[slots[first]] = first
    order = np.concatenate([order, extra]).astype(np.int64)  # 64-bit keys that two digests share: listed behind
    missing = np.array([b is None for b in best], bool)[order]
    ids = np.array([0 if b is None else b for b in best], np.int64)[order]
    out = io.BytesIO()
    np.savez(out, sizes=hashed.sizes, bits=hashed.bits, rest=hashed.rest, digests=rows[order], ids=ids, missing=missing, length=np.array(length, np.int64)[order], n=np.array(n, np.int64)[order], extra=np.array([len(extra)]))
    return out.getvalue()


class Shard:
    def __init__(self, payload: bytes):
        stored = np.load(io.BytesIO(payload), allow_pickle=False)
        self.hash = PerfectHash(stored["sizes"], stored["bits"], stored["rest"])
        self.digests, self.ids, self.missing, self.length, self.n = (stored[k] for k in ("digests", "ids", "missing", "length", "n"))
        extra = int(stored["extra"][0])
        self.behind = {self.digests[i].tobytes(): i for i in range(len(self.digests) - extra, len(self.digests))}

    def find(self, digests: list[bytes]) -> np.ndarray:
        """Slots whose 32 bytes equal the digest, -1 for nonmembers."""
        rows, keys = keys_of(digests)
        slots = self.hash.slots(keys)
        known = slots >= 0
        known[known] = (self.digests[slots[known]] == rows[known]).all(axis=1)
        slots[~known] = -1
        if self.behind:
            for i in np.flatnonzero(~known):
                slots[i] = self.behind.get(digests[i], -1)
        return slots


# -- Spark ---------------------------------------------------------------------------------------------


def _rank(length: int, best: int | None) -> tuple:
    return -length, best is None, best or 0


def digest_of(value: bytes) -> tuple[bytes, int]:
    """(digest, code points) of a text's bytes."""
    return hashlib.sha256(value.translate(None, WHITE)).digest(), len(value.decode("utf-8", "replace"))


def digest_rows(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """ROWS: for each task and digest one row, with a number, its members and the best of them."""

    def emit(groups: dict, first: int) -> pa.RecordBatch:
        lists = list(groups.values())
        tops = [min(g, key=lambda m: _rank(m[1], m[0])) for g in lists]
        return pa.RecordBatch.from_pydict({
            "rid": pa.array(range(first, first + len(lists)), pa.int64()),
            "digest": pa.array(list(groups), pa.binary()), "length": pa.array([t[1] for t in tops], pa.int64()), "best": pa.array([t[0] for t in tops], pa.int64()),
            "members": pa.array([[{"id": i, "length": n} for i, n in g] for g in lists], pa.list_(pa.struct([("id", pa.int64()), ("length", pa.int64())]))),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, number = {}, 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), values(batch.column(1)), strict=True):
                digest, length = digest_of(value)
                groups.setdefault(digest, []).append((doc, length))
                held += 1
                if held >= TASK_GROUPS:
                    yield emit(groups, number)
                    number += len(groups)
                    groups, held = {}, 0
        if groups:
            yield emit(groups, number)

    return materialize(df.select(F.col(id_column).cast("long"), text_bytes(text)).mapInArrow(staged("digests", run), ROWS))


def best_of(rows: DataFrame) -> DataFrame:
    """ENTRIES of (digest, length, best, n) rows: for each digest the row that stays and the count."""
    order = F.struct((-F.col("length")).alias("a"), F.col("best").isNull().alias("b"), F.col("best").alias("c"))
    grouped = rows.groupBy("digest").agg(F.min(order).alias("top"), F.sum("n").alias("n"))
    return grouped.select("digest", (-F.col("top.a")).alias("length"), F.col("top.c").alias("best"), "n")


def entries(rows: DataFrame) -> DataFrame:
    """ENTRIES: the distinct digests of ``digest_rows`` with winner and count."""
    return best_of(rows.select("digest", "length", "best", F.size("members").cast("long").alias("n")))


def shard_of(digest: str, shards: int):
    return F.pmod(F.xxhash64(F.col(digest)), F.lit(shards)).cast("int")


def build_index(found: DataFrame, shards: int) -> DataFrame:
    """(shard, payload): one minimal perfect hash for each shard of ENTRIES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "payload": pa.array([shard_payload(*held)], pa.binary())})

        now, held = None, ([], [], [], [])
        for batch in batches:
            for shard, digest, length, best, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if held[0]:
                        yield emit()
                    now, held = shard, ([], [], [], [])
                for part, x in zip(held, (digest, best, length, n), strict=True):
                    part.append(x)
        if held[0]:
            yield emit()

    dealt = found.select(shard_of("digest", shards).alias("shard"), "digest", "length", "best", "n").repartition("shard").sortWithinPartitions("shard", "digest")
    return dealt.mapInArrow(staged("digests", run), "shard int, payload binary")


def lookup(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """FOUND: what the index holds for the digest of each of ROWS, if it is a member."""
    asked = rows.select(shard_of("digest", shards).alias("shard"), F.lit(1).alias("kind"), "digest", "rid", F.lit(None).cast("binary").alias("payload"))
    held = index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("rid"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = 0
            while at < len(numbers):
                if kinds[at] == 0:
                    now, shard, at = numbers[at], Shard(batch.column(4)[at].as_py()), at + 1
                    continue
                end = at + 1
                while end < len(numbers) and kinds[end] == 1 and numbers[end] == numbers[at]:
                    end += 1
                part = batch.slice(at, end - at)
                known = shard is not None and now == numbers[at] and len(shard.ids)
                slots = shard.find(part.column(2).to_pylist()) if known else np.full(end - at, -1)
                none, s = slots < 0, np.maximum(slots, 0)
                take = lambda name, void: pa.array(getattr(shard, name)[s], pa.int64(), mask=void) if known else pa.nulls(len(s), pa.int64())  # noqa: E731, B023
                void = none | shard.missing[s] if known else none
                yield pa.RecordBatch.from_arrays([part.column(3), pa.array(~none), take("ids", void), take("length", none), take("n", none)], names=["rid", "member", "keep_id", "keep_length", "group_size"])
                at = end

    return held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(staged("digests", run), FOUND)


def index_of(found: DataFrame) -> tuple[DataFrame, int]:
    """The index of ENTRIES, and its number of shards."""
    shards = 1 + found.count() // SHARD_KEYS
    return build_index(found, shards), shards


def resolve(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """FOUND for all of ROWS: members of ``history`` (ENTRIES of earlier runs) with its winners, the others with
    the winners among themselves; ``member`` tells which (true: a repeat of the history)."""
    seen = None
    if history is not None:
        checked = materialize(lookup(rows, *index_of(history)))
        seen = checked.filter("member")
        rows = rows.join(seen.select("rid"), "rid", "left_anti")
    found = lookup(rows, *index_of(materialize(entries(rows)))).withColumn("member", F.lit(False))
    return found if seen is None else found.unionByName(seen)


def exact_dedup(df: DataFrame, id_column: str = "doc_id", text: str = "text", history: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``df``: id, keep_id, group_size, kept, text_sha256, length (code points)."""
    rows = digest_rows(df, id_column, text)
    return listed(rows, resolve(rows, history), id_column)


def two_runs(earlier: DataFrame, later: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``exact_dedup`` of both frames together: ``earlier`` is indexed, ``later`` is looked up in that index."""
    old, new = digest_rows(earlier, id_column, text), digest_rows(later, id_column, text)
    history = materialize(entries(old))
    checked = materialize(lookup(new, *index_of(history)))
    asked = new.select("rid", "digest", "length", "best", F.size("members").cast("long").alias("n"))
    repeats = asked.join(checked.filter("member").select("rid"), "rid", "left_semi").drop("rid")
    fresh = asked.join(checked.filter("not member").select("rid"), "rid", "left_semi").drop("rid")
    both = materialize(best_of(history.unionByName(repeats)).unionByName(best_of(fresh)))
    index, shards = index_of(both)
    far = new.withColumn("rid", -1 - F.col("rid"))  # the two parts' numbers apart
    rows = old.unionByName(far)
    return listed(rows, lookup(rows, index, shards).withColumn("member", F.lit(False)), id_column)


def listed(rows: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    """One row for each member of ROWS, with what was found for its digest."""
    each = rows.select("rid", "digest", "members").join(found, "rid").select(F.explode("members").alias("m"), "member", "keep_id", "keep_length", "group_size", F.lower(F.hex("digest")).alias("text_sha256"))
    stays = ~F.col("member") & F.col("m.id").eqNullSafe(F.col("keep_id")) & (F.col("m.length") == F.col("keep_length"))
    return each.select(F.col("m.id").alias(id_column), "keep_id", "group_size", stays.alias("kept"), "text_sha256", F.col("m.length").alias("length"))


def locator(digest: Column, length: Column, key: Column) -> Column:
    return F.concat_ws(":", F.hex(digest), length.cast("string"), F.coalesce(key.cast("long").cast("string"), F.lit("null")))


def keep_first(df: DataFrame, id_column: str = "doc_id", text: str = "text", history: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; of rows that are the same row (they agree in id,
    length and digest), the one with the least hash of all its values stays."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("digest", pa.binary()), ("length", pa.int64())])
        for batch in batches:
            yield pa.array([dict(zip(("digest", "length"), digest_of(v), strict=True)) for v in values(batch)], kind)

    task = staged("digests", run)
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    own = F.arrow_udf(task, "digest binary, length long")(text_bytes(text))
    kept = exact_dedup(df, id_column, text, history).filter("kept")
    kept = kept.select(locator(F.unhex("text_sha256"), F.col("length"), F.col(id_column)))
    name = hidden("own", df)
    keyed = df.withColumn(name, own)
    rows = keep_rows(keyed, locator(F.col(name)["digest"], F.col(name)["length"], F.col(id_column)), kept)
    return rows.drop(name)
