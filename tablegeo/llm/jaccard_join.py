"""N-gram Jaccard join: links between texts whose sets of word n-grams are at least ``threshold`` similar.

An exact set-similarity join with two kinds of skipping.

*Index level.*  Each set's n-grams are put in a global order, rare ones (by a count sketch of all texts)
first, then by hash; only the prefix that must hold a common element of any similar pair is indexed.  An
inverted list is sorted by set size and position, so a set meets only the block of sizes that can be similar
and, inside it, the positions that still leave enough elements behind; the rest of the block is skipped.

*Answer level.*  Each set is first compared with the head of the list they share most often.  Similar ones
follow that leader, and their distances to it are kept.  Lists whose sets are all in one component are
skipped; elsewhere only leaders are compared.  Jaccard distance is a metric, so the distance of two leaders
and the distances to them bound the distance of any two followers: most pairs of followers are settled by
their leaders' answers, and only those between the bounds are compared themselves.  A group of g near copies
so costs about g comparisons, not g * g.

Texts with equal sets inside one chunk of texts are one node.  Sets are compared where a pair's leader is
dealt to, a leader with many followers to several places.  No links are collected by the driver.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text with fewer than n words has its whole sequence
as only element, a null text or one without words has none and links with nothing.  Elements are 64-bit
hashes.  Defined results: rows that repeat an id are rows of their own; component ids ignore null ids unless
a component has no other; an empty table gives an empty table.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegeo.llm.chunked import BLOB, LAST_ID, Chunk, blob_rows, chunks, large, over_chunks, slices, small
from tablegeo.llm.common import keep_rows, BASE, bound_batches, materialize, mix, staged, text_bytes, values
from tablegeo.llm.components import components
from tablegeo.llm.katz import word_hashes

WORDS, PERCENT = 5, 80
#: Least and greatest log2 of the count sketch's cells, a byte each; they decide the order, not results.
SKETCH_BITS = (12, 27)
HALF = np.uint64(1 << 63)
#: Followers compared in one place.
PLACE = 512
#: Lists up to this length are worked on together, so many pairs at once.
SHORT, EXPANDED = 12, 1_000_000
#: Rows of lists with one head that are kept together.
PLACED = 5_000
#: Elements that a task counts for the sketch at once.
SKETCHED = 2_000_000
#: Elements for each counter of a set's outline, and the most counters.
OUTLINE, COUNTERS = 4, 512
#: Bytes of all texts for each part of the index, which is merged at once; of sets that leave a task together.
PART_BYTES, SENT_BYTES = 16 << 20, 4 << 20
#: Bits of a set's bitmap.
BITMAP = 1024
#: Places that a component's rows are dealt to.
SALTS = 16


# -- sets ----------------------------------------------------------------------------------------------


def ngram_sets(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, elements): each text's set as sorted distinct hashes, one after another."""
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, words = word_hashes(b"\n".join(texts))
    text = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(text, minlength=len(texts))
    whole = max(0, len(words) - n + 1)
    x = words[:whole].copy()
    for k in range(1, n):
        x = mix(x * BASE + words[k : k + whole])
    inside = text[:whole] == text[n - 1 : n - 1 + whole] if whole else np.zeros(0, bool)
    owner, element = text[:whole][inside], x[inside]
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        y = np.full(len(few), 0x5EED, np.uint64)
        for k in range(n - 1):
            more = count[few] > k
            y[more] = mix(y[more] * BASE + words[first[few[more]] + k])
        owner, element = np.concatenate([owner, few]), np.concatenate([element, y])
    order = np.lexsort((element, owner))
    owner, element = owner[order], element[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])
    return np.bincount(owner[fresh], minlength=len(texts)), element[fresh]


def needed(n: np.ndarray | int, percent: int):
    """Least intersection with a set of any size for a set of size n."""
    return -(-percent * n // 100)


def pair_needed(a, b, percent: int):
    """Least intersection of similar sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def node_of(chunk: int, index):
    """A text's number: partition, chunk and place in the chunk (23, 19 and 21 bits)."""
    return ((chunk >> 32) << 40) | ((chunk & 0xFFFFFFFF) << 21) | index


def chunk_of(node):
    return F.shiftleft(F.shiftright(node, 40), 32) + F.shiftright(node, 21).bitwiseAND(F.lit((1 << 19) - 1).cast("long"))


def index_of(node):
    return node.bitwiseAND(F.lit((1 << 21) - 1).cast("long")).cast("int")


def chunk_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, elements, same): ``same`` is the first text of the chunk with an equal set."""
    begin = chunk.ends - chunk.sizes
    texts = [chunk.bytes[a:b] for a, b in zip(begin.tolist(), chunk.ends.tolist(), strict=True)]
    sizes, elements = ngram_sets(texts, n)
    ends = np.cumsum(sizes)
    known: dict[bytes, int] = {}
    same = np.array([known.setdefault(elements[e - s : e].tobytes(), i) if s else i for i, (s, e) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True))], np.int64)
    return sizes, elements, same


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), Chunk(*(batch.column(j)[i].as_py() for j in (1, 2, 3)))


# -- index ---------------------------------------------------------------------------------------------


def sketch_bits(elements: int) -> int:
    """log2 of the cells of the count sketch: about one for every 16 elements, within fixed bounds."""
    return min(SKETCH_BITS[1], max(SKETCH_BITS[0], int(elements // 16).bit_length()))


def cell_of(elements: np.ndarray, bits: int) -> np.ndarray:
    """Cells of elements in the counted half of all hashes (the lower one, which fills the prefixes)."""
    return (elements >> np.uint64(63 - bits)).astype(np.int64)


def part_bits(size: int, partitions: int) -> int:
    """log2 of the index's parts: several to a task, and more where texts of ``size`` bytes would make large ones."""
    return max(1 + int(partitions).bit_length(), int(size // PART_BYTES).bit_length())


def slice_width(bits: int) -> int:
    """Cells that are added up together."""
    return 1 << max(0, bits - 9)


class CellCounts:
    """Counts of the cells of a task's elements, sent whenever SKETCHED elements are held."""

    def __init__(self, bits: int):
        self.bits, self.held, self.size = bits, [np.zeros(0, np.int64)], 0

    def add(self, elements: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        self.held.append(cell_of(elements[elements < HALF], self.bits))
        self.size += len(self.held[-1])
        return self.rows() if self.size >= SKETCHED else []

    def rows(self) -> list[tuple[int, bytes, bytes]]:
        """(slice, cells in the slice, times) of what is held, which is let go."""
        width = slice_width(self.bits)
        cells, times = np.unique(np.concatenate(self.held), return_counts=True)
        cuts = np.searchsorted(cells, np.arange(0, (1 << self.bits) + 1, width))
        self.held, self.size = [np.zeros(0, np.int64)], 0
        return [(i, small(cells[a:b] - i * width), small(times[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]


def count_sketch(counts: DataFrame, fine: int, elements: int) -> np.ndarray:
    """How frequent the elements of each cell are: twice log2 of the cell's count over the mean, plus one.  One
    byte for each cell, so the size is bounded by SKETCH_BITS.  ``counts`` has 2**``fine`` cells, as texts were
    counted before the number of elements was known; neighbours are added up to the cells that it asks for."""
    bits = min(fine, sketch_bits(elements))
    width, fold, mean = slice_width(fine), 1 << (fine - bits), max(1.0, elements / 2 / (1 << bits))

    def row(i: int, sums: np.ndarray) -> pa.RecordBatch:
        folded = sums.reshape(-1, fold).sum(axis=1)
        return pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "cells": pa.array([(2 * np.log2(folded / mean + 1)).astype(np.uint8).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(width, np.int64)  # of one slice at a time
        for batch in batches:
            for i, cells, times in zip(batch.column(0).to_pylist(), values(batch.column(1)), values(batch.column(2)), strict=True):
                if i != now:
                    if now is not None:
                        yield row(now, sums)
                    now, sums = i, np.zeros(width, np.int64)
                sums[large(cells)] += large(times)
        if now is not None:
            yield row(now, sums)

    rows = counts.repartition("slice").sortWithinPartitions("slice").mapInArrow(staged("jaccard", add), "slice int, cells binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in rows.toLocalIterator():
        out[r.slice * width // fold : (r.slice + 1) * width // fold] = np.frombuffer(bytes(r.cells), np.uint8)
    return out


def rarity(elements: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The order's leading part: rare counted elements, then uncounted ones, then frequent ones."""
    out = np.full(len(elements), 3, np.uint8)
    counted = elements < HALF
    own = classes[cell_of(elements[counted], int(len(classes) - 1).bit_length())]
    out[counted] = np.where(own < 3, own, own + 1)
    return out


INDEX = "token long, node long, n int, pos int, size int, head long"


def index_lists(docs: DataFrame, n: int, percent: int, classes, bits: int) -> DataFrame:
    """INDEX: the prefix elements that more than one set has, with set size, position in the order, the length of
    the element's list and its head: the set where the element stands earliest."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in each_chunk(batches):
            sizes, elements, same = chunk_sets(chunk, n)
            text = np.repeat(np.arange(len(sizes)), sizes)
            own = (same == np.arange(len(same)))[text]
            text, elements = text[own], elements[own]
            order = np.lexsort((elements, rarity(elements, classes.value), text))
            text, elements = text[order], elements[order]
            position = np.arange(len(text)) - np.searchsorted(text, text)
            prefix = position <= (sizes - needed(sizes, percent))[text]
            text, elements, position = text[prefix], elements[prefix], position[prefix]
            order = np.argsort(elements, kind="stable")
            text, elements, position = text[order], elements[order], position[order]
            yield blob_rows([(part, number, 0, elements[i:j].tobytes(), small(text[i:j]), small(position[i:j]), small(sizes[text[i:j]])) for part, i, j in slices(elements, bits)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> Iterator[pa.RecordBatch]:
            token = np.concatenate([np.frombuffer(h[1], np.uint64) for h in held])
            node = np.concatenate([node_of(h[0], large(h[2])) for h in held])
            position, size = (np.concatenate([large(h[i]) for h in held]) for i in (3, 4))
            order = np.lexsort((node, size, position, token))
            again = np.zeros(len(token), bool)
            again[1:] = token[order][1:] == token[order][:-1]
            order = order[again | np.append(again[1:], False)]
            _, first, which, length = np.unique(token[order], return_index=True, return_inverse=True, return_counts=True)
            length, head = length[which].astype(np.int32), node[order][first][which]
            for i in range(0, len(order), 1 << 17):
                o = order[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(token[o].view(np.int64)), pa.array(node[o]), pa.array(size[o].astype(np.int32)), pa.array(position[o].astype(np.int32)), pa.array(length[i : i + (1 << 17)]), pa.array(head[i : i + (1 << 17)])], names=["token", "node", "n", "pos", "size", "head"])

        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, *blobs = (batch.column(j)[i].as_py() for j in range(6))
                if part != now:
                    if held:
                        yield from emit()
                    now, held = part, []
                held.append((number, *blobs))
        if held:
            yield from emit()

    sent = over_chunks(docs, send, BLOB).select("part", "chunk", "a", "b", "c", "d")
    return materialize(sent.repartition("part").sortWithinPartitions("part").mapInArrow(staged("jaccard", merge), INDEX))


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first column as whole lists of that column's values."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield held


def fits(n1, p1, n2, p2, percent: int):
    """Can sets of sizes n1, n2 whose first common element stands at p1, p2 be similar?"""
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= pair_needed(n1, n2, percent))


def leader_pairs(index: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the list head b it can be similar to and meets in most lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, node, n, pos in lists(batches):
            head = np.searchsorted(token, token)
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            some = (head != np.arange(len(head))) & fits(n[head], pos[head], n, pos, percent) & (node != node[head])
            pair, times = np.unique(np.stack([node[some], node[head][some]]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(times)], names=["a", "b", "times"])

    # the head stands earliest: fewest rare elements of its own, so nearest to the others
    dealt = index.select("token", "node", "n", "pos").repartition("token").sortWithinPartitions("token", "pos", "n", "node")
    met = dealt.mapInArrow(staged("jaccard", run), "a long, b long, times long").groupBy("a", "b").agg(F.sum("times").alias("times"))
    return materialize(met.groupBy("a").agg(F.max_by("b", F.struct("times", (-F.col("b")).alias("low"))).alias("b")))


def cross_pairs(index: DataFrame, followers: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(x, y, a, b): sets that meet in a list, can be similar, and are in different components, with their
    leaders.  In long lists, the bitmaps of the sets tell most pairs apart before they become rows."""
    named = index.join(followers.select("node", "leader", "label"), "node", "left")
    bitmaps = nodes.filter("bitmap is not null").select("node", "bitmap")
    long_rows = named.filter(F.col("size") > SHORT).join(bitmaps, "node", "left")
    both = named.filter(F.col("size") <= SHORT).withColumn("bitmap", F.lit(None).cast("binary")).unionByName(long_rows)
    # Lists with one head hold much the same sets: they are dealt together, so that a pair they share is told once, but
    # to as many places as keep a place near PLACED rows.
    many = index.groupBy("head").agg((1 + F.floor(F.count(F.lit(1)) / PLACED)).alias("places"))
    both = both.join(many, "head").withColumn("place", F.pmod(F.xxhash64("token"), F.col("places")))
    dealt = both.select("token", "n", "pos", "node", F.coalesce("leader", "node").alias("leader"), F.coalesce("label", "node").alias("label"), "bitmap", "head", "place")
    dealt = dealt.repartition("head", "place").sortWithinPartitions("token", "n", "pos", "node")

    def long_list(n, pos, node, leader, label, bitmap) -> Iterator[np.ndarray]:
        """Everything outside the list's main component against the block of sizes it can be similar to."""
        kinds, counts = np.unique(label, return_counts=True)
        main = label == kinds[np.argmax(counts)]
        bits = np.frombuffer(b"".join(x or bytes(BITMAP // 8) for x in bitmap), np.uint64).reshape(-1, BITMAP // 64)
        for i in np.flatnonzero(~main).tolist():
            low, high = np.searchsorted(n, -(-percent * n[i] // 100)), np.searchsorted(n, 100 * n[i] // percent, side="right")
            block = slice(low, high)
            other = low + np.flatnonzero((label[block] != label[i]) & (main[block] | (np.arange(low, high) > i)) & fits(n[i], pos[i], n[block], pos[block], percent))
            differ = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1)
            other = other[differ <= (n[other] + n[i]) * (100 - percent) / (100 + percent) + 1e-9]
            if len(other):
                yield np.stack([node[other], np.full(len(other), node[i]), leader[other], np.full(len(other), leader[i])])

    def short_lists(rank, n, pos, node, leader, label) -> Iterator[np.ndarray]:
        """Each set against the rest of its list as far as its block of sizes goes, many lists at once."""
        key = (rank << 32) + n
        many = np.searchsorted(key, (rank << 32) + 100 * n // percent, side="right") - np.arange(len(n)) - 1
        ends = np.cumsum(many)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, side="right")))
            count = many[at:to]
            left = np.repeat(np.arange(at, to), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            good = label[left] != label[right]
            left, right = left[good], right[good]
            good = fits(n[left], pos[left], n[right], pos[right], percent)
            yield np.stack([x[k[good]] for x in (node, leader) for k in (left, right)])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            x, y, a, b = np.concatenate(found, axis=1)
            turn = x > y
            x, y, a, b = np.where(turn, y, x), np.where(turn, x, y), np.where(turn, b, a), np.where(turn, a, b)
            order = np.lexsort((y, x))
            fresh = order[np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])]
            return pa.RecordBatch.from_arrays([pa.array(v[fresh]) for v in (x, y, a, b)], names=["x", "y", "a", "b"])

        found, held = [], 0
        for token, n, pos, node, leader, label, bitmap, _, _ in lists(batches):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            size = np.diff(cuts)
            mixed = np.add.reduceat((label != np.repeat(label[cuts[:-1]], size)).astype(np.int64), cuts[:-1]) > 0
            some = np.repeat(mixed & (size <= SHORT), size)
            short = short_lists(np.repeat(np.arange(len(size)), size)[some], n[some], pos[some], node[some], leader[some], label[some])
            long = (long_list(n[i:j], pos[i:j], node[i:j], leader[i:j], label[i:j], bitmap[i:j]) for i, j in zip(cuts[:-1][mixed & (size > SHORT)].tolist(), cuts[1:][mixed & (size > SHORT)].tolist(), strict=True))
            for got in chain(short, chain.from_iterable(long)):  # pairs leave while a list is still worked on
                found.append(got)
                held += got.shape[1]
                if held > EXPANDED:
                    yield emit()
                    found, held = [], 0
        if held:
            yield emit()

    return materialize(dealt.mapInArrow(staged("jaccard", run), "x long, y long, a long, b long").distinct())


# -- comparison ----------------------------------------------------------------------------------------


def outline(elements: np.ndarray) -> bytes:
    """How many elements of a set start with each bit pattern, about OUTLINE for each pattern."""
    bits = max(2, min(COUNTERS.bit_length() - 1, int(len(elements) // OUTLINE).bit_length()))
    return small(np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))


def bitmap_of(elements: np.ndarray) -> bytes:
    """For each of BITMAP patterns, whether an odd number of elements starts with it.  Two sets' bitmaps differ
    in no more places than the sets have elements apart."""
    odd = np.bincount((elements >> np.uint64(64 - (BITMAP.bit_length() - 1))).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def shared_at_most(one: bytes, two: bytes) -> int:
    """A bound of the intersection of two sets from their outlines."""
    a, b = large(one), large(two)
    if len(a) < len(b):
        a, b = b, a
    return int(np.minimum(a.reshape(len(b), -1).sum(axis=1), b).sum())


def possible(pairs: DataFrame, nodes: DataFrame, percent: int, radius: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose outlines leave enough in common: for themselves to be similar or, with the
    ``radius`` (leader, radius) of their followers, for any two followers to be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = np.maximum(percent / 100 - batch.column(6).to_numpy() - 1e-9, 0.0)
            least = similar / (1 + similar) * (batch.column(2).to_numpy() + batch.column(4).to_numpy()) - 1e-6
            good = [shared_at_most(x, y) >= z for x, y, z in zip(values(batch.column(3)), values(batch.column(5)), least.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    own = nodes.filter("outline is not null")
    side = lambda name: own.select(F.col("node").alias(name), F.col("n_shingles").alias(f"{name}_size"), F.col("outline").alias(f"{name}_outline"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    slack = F.lit(0.0)
    if radius is not None:
        for name in ("a", "b"):
            both = both.join(radius.select(F.col("leader").alias(name), F.col("radius").alias(f"{name}_radius")), name, "left")
            slack = slack + F.coalesce(f"{name}_radius", F.lit(0.0))
    return materialize(both.select("a", "b", "a_size", "a_outline", "b_size", "b_outline", slack.alias("slack")).mapInArrow(staged("jaccard", run), "a long, b long"))


def compared(texts: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(a, b, both, a_size, b_size): sizes of the sets of each pair and of their intersection."""
    count = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    placed = pairs.join(count, "b").withColumn("place", F.pmod(F.xxhash64("a"), 1 + F.floor(F.col("k") / PLACE)).cast("int")).select("a", "b", "place")
    asked = placed.select(F.col("a").alias("node"), "b", "place").unionByName(placed.select(F.col("b").alias("node"), "b", "place").distinct())
    by_chunk = asked.select(chunk_of(F.col("node")).alias("chunk"), F.struct(index_of(F.col("node")).alias("i"), "node", "b", "place").alias("r")).groupBy("chunk").agg(F.collect_list("r").alias("asked"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(*(batch.column(j)[i].as_py() for j in (1, 2, 3)))
                wanted = batch.column(4)[i].values
                at, node, b, place = (wanted.field(c).to_numpy(zero_copy_only=False) for c in ("i", "node", "b", "place"))
                begin, places = chunk.ends - chunk.sizes, np.unique(at).tolist()
                sizes, elements = ngram_sets([chunk.bytes[begin[p] : chunk.ends[p]] for p in places], n)
                ends = np.cumsum(sizes)
                sets = {p: elements[e - s : e].tobytes() for p, s, e in zip(places, sizes.tolist(), ends.tolist(), strict=True)}
                sent = np.cumsum([len(sets[p]) for p in at.tolist()])
                j = 0
                while j < len(at):  # few large sets, or many small ones
                    end = max(j + 1, min(j + 256, int(np.searchsorted(sent, (sent[j - 1] if j else 0) + SENT_BYTES, side="right"))))
                    some = slice(j, end)
                    yield pa.RecordBatch.from_pydict({"b": pa.array(b[some], pa.int64()), "place": pa.array(place[some], pa.int32()), "kind": pa.array((node[some] != b[some]).astype(np.int32)), "a": pa.array(node[some], pa.int64()), "elements": pa.array([sets[p] for p in at[some].tolist()], pa.binary())})
                    j = end

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leader = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for b, place, kind, a, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), values(batch.column(4), 64), strict=True):
                own = np.frombuffer(packed, np.uint64)
                if not kind:
                    now, leader = (b, place), own
                    continue
                assert now == (b, place)
                out.append((a, b, len(np.intersect1d(leader, own, assume_unique=True)), len(own), len(leader)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "both", "a_size", "b_size"])

    sets = texts.join(by_chunk, "chunk").select("chunk", "keys", "sizes", "packed", "asked").mapInArrow(staged("jaccard", send), "b long, place int, kind int, a long, elements binary")
    checked = sets.repartition("b", "place").sortWithinPartitions("b", "place", "kind").mapInArrow(staged("jaccard", check), "a long, b long, both long, a_size long, b_size long")
    return materialize(checked.withColumn("distance", 1 - F.col("both") / (F.col("a_size") + F.col("b_size") - F.col("both"))))


def linked(checked: DataFrame, percent: int) -> DataFrame:
    return checked.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("a_size") + F.col("b_size") - F.col("both"))).select("a", "b")


NUMBERED = "key long, n_shingles long, node long, outline binary, bitmap binary, digest binary, slice int, cells binary, times binary"


def numbered(docs: DataFrame, n: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(key, n_shingles, node, outline, bitmap, digest): every row with its node and the MD5 of its text; outline
    and bitmap stand with the node's own row.  And (slice, cells, times): counts for the sketch.  The texts are
    read once for both."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    names = [field.split()[0] for field in NUMBERED.split(", ")]

    def batch(columns: list, rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(rows, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def counts(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield batch([None] * 6 + list(zip(*rows, strict=True)), len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = CellCounts(bits)
        for number, chunk in each_chunk(batches):
            sizes, elements, same = chunk_sets(chunk, n)
            ends = np.cumsum(sizes)
            own = [elements[e - s : e] if s and k == i else None for i, (s, e, k) in enumerate(zip(sizes.tolist(), ends.tolist(), same.tolist(), strict=True))]
            outlines, bitmaps = ([None if x is None else f(x) for x in own] for f in (outline, bitmap_of))
            digests = [hashlib.md5(chunk.bytes[e - s : e]).digest() for s, e in zip(chunk.sizes.tolist(), chunk.ends.tolist(), strict=True)]
            yield batch([chunk.keys, sizes, node_of(number, same), outlines, bitmaps, digests, None, None, None], len(sizes))
            yield from counts(counter.add(elements[np.repeat(same == np.arange(len(same)), sizes)]))
        yield from counts(counter.rows())

    both = materialize(over_chunks(docs, run, NUMBERED))
    return both.filter("slice is null").select(*names[:6]), both.filter("slice is not null").select(*names[6:])


def labelled_rows(df: DataFrame, id_column: str, text: str, n: int, percent: int) -> DataFrame:
    """(key, digest, n_shingles, label): one row for each row; rows of one component share the label."""
    spark = df.sparkSession
    bound_batches(spark)
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID))
    docs = df.select(key.alias("key"), text_bytes(text).alias("bytes"))
    dealt = chunks(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    bits = part_bits(size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fine = sketch_bits(size // 2)  # a word has a byte and a space at least
    nodes, counts = numbered(docs, n, fine)
    total = nodes.filter("outline is not null").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    classes = spark.sparkContext.broadcast(count_sketch(counts, fine, total))
    index = index_lists(docs, n, percent, classes, bits)
    slack, reach = 1e-9, 1 - percent / 100

    # leaders, followers and their distances
    first = compared(dealt, possible(leader_pairs(index, percent), nodes, percent), n)
    links = linked(first, percent)
    labels = components(links)
    following = first.join(links, ["a", "b"], "left_semi").select(F.col("a").alias("node"), F.col("b").alias("leader"), "distance")
    followers = materialize(labels.join(following, "node", "left").select("node", F.coalesce("leader", "node").alias("leader"), F.coalesce("distance", F.lit(0.0)).alias("distance"), "label"))

    # leaders of different components whose followers met
    radius = followers.groupBy("leader").agg(F.max("distance").alias("radius"))
    met = cross_pairs(index, followers, nodes, percent)
    leading = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    second = compared(dealt, possible(leading, nodes, percent, radius), n)
    links = materialize(links.unionByName(linked(second, percent)))
    labels = materialize(components(links))

    # what met, where the leaders' distances leave it open
    label = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    away = lambda name: followers.filter("distance > 0").select(F.col("node").alias(name), F.col("distance").alias(f"{name}_away"))
    ranked = met.filter("x <> a or y <> b").withColumns({"a": F.greatest("a", "b"), "b": F.least("a", "b")})
    known = ranked.join(second.select("a", "b", "distance"), ["a", "b"])
    for name in ("x", "y"):
        known = known.join(label(name), name, "left").join(away(name), name, "left")
    known = known.fillna(0.0, ["x_away", "y_away"]).filter(F.coalesce("x_label", "x") != F.coalesce("y_label", "y"))
    open_pairs = known.filter(F.col("distance") <= F.col("x_away") + F.col("y_away") + reach + slack)
    third = possible(open_pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), nodes, percent)
    if third.limit(1).count():
        labels = components(links.unionByName(linked(compared(dealt, third, n), percent)))

    rows = nodes.select("key", "digest", "n_shingles", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return materialize(rows.select("key", "digest", "n_shingles", "label"))


def near_components(df: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id): one row for each row; the frame must read alike each time."""
    rows = labelled_rows(df, id_column, text, n, percent)
    least = rows.groupBy("label").agg(F.min("key").alias("component_id"))
    salt = F.pmod(F.xxhash64("key", "digest"), F.lit(SALTS)).cast("int")  # a component may hold a third of all rows
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("salt", salt).join(spread, ["label", "salt"])
    return out.select(F.nullif("key", F.lit(LAST_ID)).alias(id_column), "n_shingles", F.nullif("component_id", F.lit(LAST_ID)).alias("component_id"))


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``df`` of each component, with all its columns: the one with the least id (null ids last), then
    the least MD5 of its text; rows that agree in both are the same row, of which one stays."""
    rows = labelled_rows(df, id_column, text, n, percent)
    first = rows.groupBy("label").agg(F.min(F.struct("key", "digest")).alias("first"))
    locator = lambda digest, key: F.concat_ws(":", F.lower(digest), key.cast("string"))
    kept = first.select(locator(F.hex("first.digest"), F.col("first.key")))
    return keep_rows(df, locator(F.md5(text_bytes(text)), F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID))), kept)
