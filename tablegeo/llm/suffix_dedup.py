"""Suffix-array deduplication: remove every byte covered by a string of ``depth`` bytes seen earlier.

Suffixes are ordered only to the threshold depth, by most-significant-digit passes, and groups that are
equal after the last pass are exactly the repeated windows.  Order among different suffixes is of no use
here, so digits are hashes, compared in partitions by leading bits; what has no equal after a digit is done
and takes no part in the next pass.  Three digits make up the depth:

1. *Synchronising gram.*  In every window the ``gram``-byte string of least hash (the leftmost) is its
   anchor.  Equal windows have equal anchors at equal offsets, so the windows of one anchor, a run of
   neighbours, travel as one block.  Pass one keeps the blocks whose anchor occurs elsewhere.
2. *Block.*  Those are grouped by anchor and a hash of all their bytes (128 bits in all).  All but the first
   of equal blocks are repeated window by window.
3. *Window.*  First blocks that share their anchor with another, different block (the ends of passages, and
   edited copies) are taken apart into windows, which are grouped by 96 bits of hashes of their bytes.

Texts travel once, as compressed chunks of about ``CHUNK_BYTES``, and every later pass joins its answers to
the same partitioning.  A pass first works inside each chunk: of equal anchors, blocks or windows in a chunk
one is sent on and the others are settled on the spot, so a passage that a third of all rows share reaches a
partition once for each chunk, not for each row.  What is sent are sorted arrays, a few binary values for
each chunk and partition.

"Earlier" means smaller id, or the same id and an earlier start; null ids come last and count as one id.
Defined results: a null text is the empty text; texts shorter than ``depth`` lose nothing; rows that repeat
an id are compared by start, so equal rows lose the same bytes; texts of any length are read whole (in
segments that overlap); an empty table gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegeo.llm.chunked import BLOB, LAST_ID, SEGMENT, Chunk, Sums, blob_rows, chunks, large, slices, small
from tablegeo.llm.common import bound_batches, staged, text_bytes

DEPTH, GRAM = 100, 32
#: Kinds of what is sent: entries to compare, positions to look at next, and runs that are settled.
ENTRIES, NEXT, SETTLED = range(3)


def least_positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` neighbours the position of the least, the leftmost of equal ones."""
    least, at, have = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        at = np.where(later, at[step:], at[:-step])
        have += step
    return at


def block_runs(data: np.ndarray, sizes: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, count, anchor hash) of the blocks of texts that stand one after another in ``data``."""
    out = [[], [], []]
    ends = np.cumsum(sizes)
    windows = np.maximum(sizes - depth + 1, 0)  # of each text; a segment holds some windows and the bytes under them
    for at in range(0, len(data), SEGMENT):
        part = data[at : at + SEGMENT + depth - 1]
        if len(part) < depth:
            break
        sums = Sums(part)
        hashes = sums.grams(gram)
        anchor = least_positions(hashes, depth - gram + 1)
        first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, at + SEGMENT, side="right")
        texts = np.arange(first, min(last + 1, len(sizes)))
        begin = np.maximum(ends[texts] - sizes[texts], at)
        stop = np.minimum(ends[texts] - sizes[texts] + windows[texts], at + SEGMENT)
        length = np.maximum(stop - begin, 0)
        if not length.sum():
            continue
        where = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) - at
        own = anchor[where]
        head = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (where[1:] != where[:-1] + 1)) + 1])
        for held, x in zip(out, (where[head] + at, np.diff(np.append(head, len(own))), hashes[own[head]]), strict=True):
            held.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.uint64), strict=True))


def same_as_before(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by ``keys``: does the row before have equal ones?"""
    out = np.zeros(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return out


def firsts(one: np.ndarray, two: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (one, two, key, start), and which rows of that order repeat the one before and come later:
    rows of the same id and start, which only rows that repeat an id can have, are equally early."""
    order = np.lexsort((start, key, two, one))
    repeat = same_as_before(one[order], two[order])
    group = np.flatnonzero(~repeat)
    first = np.repeat(group, np.diff(np.append(group, len(order)))) if len(order) else group
    late = repeat & ((key[order] != key[order[first]]) | (start[order] != start[order[first]]))
    return order, late


def with_answers(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """The chunks with what was sent back to each: arrays of (kind, a, b, c, d)."""
    back = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "a", "b", "c", "d")).alias("answers"))
    return texts.join(back, "chunk", "left").select("chunk", "keys", "sizes", "packed", "answers")


def gather(answers: list[dict] | None, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, count) of all answers of a kind."""
    got = [(large(x["a"]), large(x["b"])) for x in answers or [] if x["kind"] == kind]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, list | None]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            yield row["chunk"], Chunk(row["keys"], row["sizes"], row["packed"]), row.get("answers")


def reduced(sent: DataFrame, settle) -> DataFrame:
    """One pass's comparison: all entries of a partition at once; what is settled already passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                part, chunk, kind, *blobs = (batch.column(j)[i].as_py() for j in range(8))
                if part != now:
                    if held:
                        yield blob_rows(settle(held))
                    now, held = part, []
                if kind == ENTRIES:
                    held.append((chunk, *blobs))
                else:
                    yield blob_rows([(0, chunk, kind, *blobs)])
        if held:
            yield blob_rows(settle(held))

    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(staged("suffixes", run), BLOB).select("chunk", "kind", "a", "b", "c", "d")


def pass_one(texts: DataFrame, depth: int, gram: int, bits: int) -> DataFrame:
    """NEXT: the blocks whose anchor occurs more than once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, _ in chunk_rows(batches):
            position, count, anchor = block_runs(chunk.data, chunk.sizes, depth, gram)
            order = np.argsort(anchor, kind="stable")
            position, count, anchor = position[order], count[order], anchor[order]
            again = same_as_before(anchor)
            several = again | np.append(again[1:], False)  # settled here; one of them tells the others
            yield blob_rows([(part, number, ENTRIES, anchor[i:j][~again[i:j]].tobytes(), small(position[i:j]), small(count[i:j]), np.packbits(again[i:j]).tobytes(), np.packbits(several[i:j]).tobytes()) for part, i, j in slices(anchor, bits)])

    def settle(held: list) -> list[tuple]:
        anchor = np.concatenate([np.frombuffer(h[1], np.uint64) for h in held])
        order = np.argsort(anchor, kind="stable")
        again = same_as_before(anchor[order])
        shared = np.empty(len(anchor), bool)
        shared[order] = again | np.append(again[1:], False)
        out, at = [], 0
        for chunk, own, position, count, packed, several in held:
            position, count = large(position), large(count)
            again, several = (np.unpackbits(np.frombuffer(x, np.uint8))[: len(position)].astype(bool) for x in (packed, several))
            size = len(own) // 8
            keep = several | shared[at : at + size][np.cumsum(~again) - 1]
            at += size
            if keep.any():
                out.append((0, chunk, NEXT, small(position[keep]), small(count[keep])))
        return out

    return reduced(texts.mapInArrow(staged("suffixes", send), BLOB), settle)


def pass_two(texts: DataFrame, one: DataFrame, depth: int, gram: int, bits: int) -> DataFrame:
    """SETTLED: blocks that occur earlier; NEXT: first blocks that share their anchor with a different one."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, answers in chunk_rows(batches):
            position, count = gather(answers, NEXT)
            if not len(position):
                continue
            block = chunk.hashes(position, count - 1 + depth)[0]
            # the anchor's hash, taken anew from the block's first window
            anchor = anchor_of(chunk, position, depth, gram)
            key, start = chunk.place(position)
            order, late = firsts(anchor, block, key, start)
            gone = order[late]
            rows = [(number % (1 << bits), number, SETTLED, small(position[gone]), small(count[gone]))] if len(gone) else []
            order = order[~late]
            low = int(key.min())
            for part, i, j in slices(anchor[order], bits):
                o = order[i:j]
                rows.append((part, number, ENTRIES, anchor[o].tobytes() + block[o].tobytes(), small(key[o] - low) + low.to_bytes(8, "little", signed=True), small(start[o]), small(position[o]), small(count[o])))
            yield blob_rows(rows)

    def settle(held: list) -> list[tuple]:
        hashes = [np.frombuffer(h[1], np.uint64).reshape(2, -1) for h in held]
        anchor, block = np.concatenate(hashes, axis=1)
        key = np.concatenate([large(h[2][:-8]) + int.from_bytes(h[2][-8:], "little", signed=True) for h in held])
        start, position, count = (np.concatenate([large(h[i]) for h in held]) for i in (3, 4, 5))
        owner = np.repeat(np.arange(len(held)), [h.shape[1] for h in hashes])
        order, late = firsts(anchor, block, key, start)
        first = order[~same_as_before(anchor[order], block[order])]
        shared = same_as_before(anchor[first])
        shared = shared | np.append(shared[1:], False)
        status = np.zeros(len(anchor), np.int8)
        status[order[late]] = SETTLED
        multi = np.zeros(len(anchor), bool)
        multi[first[shared]] = True
        # rows as early as the first (of an id that repeats) are looked at as well
        early = np.zeros(len(anchor), bool)
        early[order[~late]] = True
        group = np.cumsum(~same_as_before(anchor[order], block[order])) - 1
        status[order[early[order] & multi[first][group]]] = NEXT
        return answers_of(held, owner, status, position, count)

    return reduced(with_answers(texts, one).mapInArrow(staged("suffixes", send), BLOB), settle)


def answers_of(held: list, owner: np.ndarray, status: np.ndarray, position: np.ndarray, count: np.ndarray) -> list[tuple]:
    cuts, out = np.searchsorted(owner, np.arange(len(held) + 1)), []
    for h, i, j in zip(held, cuts[:-1], cuts[1:], strict=True):
        for kind in (NEXT, SETTLED):
            some = i + np.flatnonzero(status[i:j] == kind)
            if len(some):
                out.append((0, h[0], kind, small(position[some]), small(count[some])))
    return out


def anchor_of(chunk: Chunk, position: np.ndarray, depth: int, gram: int) -> np.ndarray:
    """Hash of the anchor of the windows at these positions."""
    out = np.zeros(len(position), np.uint64)
    order, i = np.argsort(position, kind="stable"), 0
    while i < len(order):
        at = int(position[order[i]])
        j = int(np.searchsorted(position[order], at + SEGMENT))
        hashes = Sums(chunk.data[at : int(position[order[j - 1]]) + depth]).grams(gram)
        own = least_positions(hashes, depth - gram + 1)[position[order[i:j]] - at]
        out[order[i:j]] = hashes[own]
        i = j
    return out


def pass_three(texts: DataFrame, two: DataFrame, depth: int, bits: int) -> DataFrame:
    """SETTLED: what pass two settled, and the windows of its other blocks that occur earlier."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, answers in chunk_rows(batches):
            rows = [(number % (1 << bits), number, SETTLED, x["a"], x["b"]) for x in answers or [] if x["kind"] == SETTLED]
            position, count = gather(answers, NEXT)
            if len(position):
                position = np.repeat(position - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                one, two = chunk.hashes(position, np.full(len(position), depth))
                two = two >> np.uint64(32)
                key, start = chunk.place(position)
                order, late = firsts(one, two, key, start)
                gone = np.sort(position[order[late]])
                if len(gone):
                    rows.append((number % (1 << bits), number, SETTLED, *runs(gone)))
                order, low = order[~late], int(chunk.keys.min())
                names = small(chunk.keys - low) + low.to_bytes(8, "little", signed=True), small(chunk.sizes)  # id and start follow from the position
                for part, i, j in slices(one[order], bits):
                    o = order[i:j]
                    rows.append((part, number, ENTRIES, one[o].tobytes(), two[o].astype(np.uint32).tobytes(), small(position[o]), *names))
            if rows:
                yield blob_rows(rows)

    def settle(held: list) -> list[tuple]:
        one = np.concatenate([np.frombuffer(h[1], np.uint64) for h in held])
        two = np.concatenate([np.frombuffer(h[2], np.uint32) for h in held])
        positions, places = [large(h[3]) for h in held], []
        for h, at in zip(held, positions, strict=True):
            sizes = large(h[5])
            ends = np.cumsum(sizes)
            text = np.searchsorted(ends, at, side="right")
            places.append(np.stack([(large(h[4][:-8]) + int.from_bytes(h[4][-8:], "little", signed=True))[text], at - (ends - sizes)[text]]))
        position, (key, start) = np.concatenate(positions), np.concatenate(places, axis=1)
        owner = np.repeat(np.arange(len(held)), [len(h[1]) // 8 for h in held])
        order, late = firsts(one, two, key, start)
        status = np.zeros(len(one), bool)
        status[order[late]] = True
        cuts, out = np.searchsorted(owner, np.arange(len(held) + 1)), []
        for h, i, j in zip(held, cuts[:-1], cuts[1:], strict=True):
            gone = np.sort(position[i:j][status[i:j]])
            if len(gone):
                out.append((0, h[0], SETTLED, *runs(gone)))
        return out

    return reduced(with_answers(texts, two).mapInArrow(staged("suffixes", send), BLOB), settle)


def runs(positions: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted positions as runs of neighbours."""
    head = np.concatenate([[0], np.flatnonzero(np.diff(positions) > 1) + 1])
    return small(positions[head]), small(np.diff(np.append(head, len(positions))))


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", depth: int = DEPTH, gram: int | None = None) -> DataFrame:
    """(id, n_bytes, spans, kept): each row's removed spans [start, end) and the bytes that stay."""
    spark = df.sparkSession
    bound_batches(spark)
    gram = gram or max(1, depth * GRAM // DEPTH)
    bits = 2 + int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length()  # several parts to a task; a part is compared at once
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID))
    texts = chunks(df.select(key.alias("key"), text_bytes(text).alias("bytes")))
    one = pass_one(texts, depth, gram, bits)
    two = pass_two(texts, one, depth, gram, bits)
    three = pass_three(texts, two, depth, bits)
    kinds = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, answers in chunk_rows(batches):
            position, count = gather(answers, SETTLED)
            order = np.argsort(position, kind="stable")
            position, count = position[order], count[order]
            begin = chunk.ends - chunk.sizes
            cuts = np.searchsorted(position, np.append(begin, len(chunk.data)))
            out = []
            for k, size, at, i, j in zip(chunk.keys.tolist(), chunk.sizes.tolist(), begin.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out.append((k, size, *cut(chunk.bytes[at : at + size], position[i:j] - at, count[i:j], depth)))
            for i in range(0, len(out), 256):
                columns = list(zip(*out[i : i + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, kinds, strict=True)], schema=kinds)

    rows = with_answers(texts, three).mapInArrow(staged("suffixes", run), "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return rows.select(F.nullif(F.col("key"), F.lit(LAST_ID)).alias(id_column), "n_bytes", "spans", "kept")


def cut(data: bytes, starts, counts, depth: int) -> tuple[list[dict], bytes]:
    """Maximal removed spans and the remaining bytes, from runs of repeated windows."""
    if not len(starts):
        return [], data
    begin = np.array(starts, np.int64)
    end = begin + np.array(counts, np.int64) - 1 + depth
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate([[True], begin[1:] > end[:-1]])
    lows, highs = begin[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]
    kept, at = [], 0
    for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
        kept.append(data[at:low])
        at = high
    kept.append(data[at:])
    return [{"start": a, "end": b} for a, b in zip(lows.tolist(), highs.tolist(), strict=True)], b"".join(kept)
