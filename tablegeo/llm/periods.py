"""Runs of periodic text, found by branching tandem repeats in a suffix tree of words.

A run with period q ends in exactly one tandem repeat (a word sequence twice in a row) of length 2q that can't be
shifted right.  Its two starts are leaves of the tree whose lowest common ancestor has depth q.  Each inner node looks
at the leaves outside its largest child only (a leaf is looked at once for each time the node above it is at least
twice as large, so n log n in all) and asks whether the leaf one depth further or earlier is below the node, too, and
goes on differently.  Each repeat found is rotated left as far as the text allows, by strides of powers of two, and
repeats that grow to the same stretch are one run, whose period is the least of theirs.

A run of exponent e holds each of its words e times or more.  So the words that a text holds less often part it into
stretches, and what those hold is parted again, until the tree is only built over stretches that can hold runs.

Texts of a batch are worked off together as arrays, but no suffix compares beyond its own stretch, so texts don't
affect each other.  Batches are bounded by bytes; a text is one task's, with some 50 to 250 bytes for each of its words
that are left in stretches.

A null text has no words and no runs; its collapsed text is empty.  Words are whatever stands between white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegeo.llm.common import staged, text_bytes

#: White space: blank and the control characters 9 to 13 (fixed values of the contract).
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
KIND = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: binary>"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of binary texts (not null), one after another, and where each text's words start and end."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = ends[:-1][ends[:-1] < ends[1:]]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(solid)])
    offsets = np.append(kept[starts], kept[-1]).astype(np.int32)
    packed = pa.py_buffer(np.ascontiguousarray(data[solid]))
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), packed]), np.searchsorted(starts, ends)


def stretches(ids: np.ndarray, text: np.ndarray, least: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (their places) that may be in runs, and the number of the stretch that each is in."""
    place, part = np.arange(len(ids)), text
    while len(place):
        _, at, count = np.unique(part * (ids.max() + 1) + ids[place], return_inverse=True, return_counts=True)
        often = count[at] >= least
        rest, of = place[often], part[often]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(rest) > 1) | (np.diff(of) > 0)])) if len(rest) else np.empty(0, int)
        sizes = np.diff(np.append(cut, len(rest)))
        long = np.repeat(sizes >= shortest, sizes)
        rest, of = rest[long], np.repeat(np.arange(len(sizes)), sizes)[long]
        done = len(rest) == len(place)
        place, part = rest, of
        if done:
            break
    return place, part


def ranks(word: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """For each power of two the class of every suffix by so many first words, numbered in sorted order by the place
    of its first member; the last one numbers the suffixes themselves."""
    size = len(word)
    _, at, count = np.unique(part * (word.max() + 1) + word, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[at].astype(np.int32)
    levels = [rank]
    while True:
        several = np.flatnonzero(np.bincount(rank, minlength=size)[rank] > 1)
        if not len(several):
            return levels
        pair = rank[several].astype(np.int64) * size + rank[several + (1 << (len(levels) - 1))]
        order = np.argsort(pair, kind="stable")
        several, pair = several[order], pair[order]
        here, old = np.arange(len(pair)), rank[several]
        new_class = np.concatenate([[True], pair[1:] != pair[:-1]])
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        first = np.maximum.accumulate(np.where(new_class, here, 0)) - np.maximum.accumulate(np.where(new_old, here, 0))
        rank = rank.copy()
        rank[several] = old + first
        levels.append(rank)


def shared(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from a and from b on agree; with ``back`` how many before them."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        if back:
            x, y = a - out - (1 << k), b - out - (1 << k)
            same = (x >= 0) & (y >= 0)
            same[same] = levels[k][x[same]] == levels[k][y[same]]
        else:
            same = levels[k][a + out] == levels[k][b + out]
        out[same] += 1 << k
    return out


def inner_nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree's inner nodes but roots, from what neighbours in sorted order share: depth, first and last leaf
    and parent (-1: a root) of each, and each leaf's parent."""
    depth, low, high, parent, above, stack, before = [], [], [], [], [], [], 0
    for leaf, d in enumerate([*common.tolist(), 0]):
        top = stack[-1] if stack else -1
        left, last = leaf, -1
        while stack and depth[stack[-1]] > d:
            last = stack.pop()
            high[last], left = leaf, low[last]
            if stack and depth[stack[-1]] >= d:
                parent[last], last = stack[-1], -1
        if d and (not stack or depth[stack[-1]] < d):
            stack.append(len(depth))
            depth.append(d)
            low.append(left)
            high.append(-1)
            parent.append(-1)
            if last >= 0:
                parent[last] = stack[-1]
        above.append(stack[-1] if d > before else top)
        before = d
    return tuple(np.array(x, np.int64) for x in (depth, low, high, parent, above))


def tandem_repeats(word: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths w of all branching tandem repeats: word[s:s + w] stands twice from s on and not from s + 1."""
    rank = levels[-1]
    suffix = np.empty(len(rank), np.int64)
    suffix[rank] = np.arange(len(rank))
    depth, low, high, parent, above = inner_nodes(shared(levels, suffix[:-1], suffix[1:]))
    if not len(depth):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by_size, heavy = np.argsort(high - low, kind="stable"), np.full(len(depth), -1)
    inner = by_size[parent[by_size] >= 0]
    heavy[parent[inner]] = inner  # the last one written is the largest
    own = np.arange(len(depth))
    top = np.where((parent >= 0) & (heavy[parent] == own), parent, own)
    while (top[top] != top).any():
        top = top[top]

    def at(leaf: np.ndarray, node: np.ndarray) -> Iterator[np.ndarray]:
        x, d = suffix[leaf], depth[node]
        for other, start in ((x + d, x), (x - d, x - d)):
            ok = (other >= 0) & (other < len(rank))
            r = rank[np.where(ok, other, 0)]
            ok &= (r >= low[node]) & (r <= high[node])
            s, w = start[ok], d[ok]
            differ = word[s + w] != word[s + 2 * w]
            yield np.stack([s[differ], w[differ]])

    leaf = np.flatnonzero(above >= 0)
    node = above[leaf]
    largest = (heavy[node] < 0) & (low[node] == leaf)  # a node above leaves only has one of them as its largest child
    found = [*at(leaf[~largest], node[~largest])]
    while len(leaf):
        node = parent[top[node]]
        leaf, node = leaf[node >= 0], node[node >= 0]
        found += at(leaf, node)
    starts, widths = np.unique(np.concatenate(found, axis=1), axis=1)
    return starts, widths


def runs(ids: np.ndarray, text: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows of first word, length and period for the runs of all texts, in order: ``ids`` numbers the words of all texts
    by content, ``text`` says which text each is in."""
    place, part = stretches(ids, text, min_exponent, max(min_length, min_exponent))
    if not len(place):
        return np.empty((0, 3), np.int64)
    part = np.unique(part, return_inverse=True)[1]
    n = int(part.max()) + 1
    spot = np.arange(len(place)) + part  # an end of its own follows each stretch
    word, of, origin = np.full(len(place) + n, -1), np.empty(len(place) + n, np.int64), np.zeros(len(place) + n, np.int64)
    word[spot], of[spot], origin[spot] = ids[place], part, place
    ends = np.flatnonzero(word < 0)
    word[ends], of[ends] = ids.max() + 1 + np.arange(n), np.arange(n)
    levels = ranks(word, of)
    starts, widths = tandem_repeats(word, levels)
    first = starts - shared(levels, starts, starts + widths, back=True)
    order = np.lexsort((widths, starts + 2 * widths, first))
    first, end, period = first[order], (starts + 2 * widths)[order], widths[order]
    least = np.ones(len(first), bool)
    least[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    kept = least & (end - first >= np.maximum(min_length, min_exponent * period))
    out = np.stack([origin[first[kept]], (end - first)[kept], period[kept]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def analysed(texts: pa.Array, min_length: int, min_exponent: int) -> pa.Array:
    """Runs and collapsed texts of one batch."""
    words, edges = split_words(texts)
    counts = np.diff(edges)
    text = np.repeat(np.arange(len(texts)), counts)
    found = runs(words.dictionary_encode().indices.to_numpy().astype(np.int64), text, min_length, min_exponent) if len(words) else np.empty((0, 3), np.int64)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    below = np.concatenate([[0], np.cumsum(kept)])[edges].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(below, words.filter(pa.array(kept))), b" ")
    owner = text[found[:, 0]]
    each = pa.StructArray.from_arrays([pa.array(found[:, 0] - edges[owner]), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(RUN))
    lists = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32), each)
    return pa.StructArray.from_arrays([pa.array(counts), lists, collapsed], ["n_words", "runs", "collapsed"])


def with_runs(text: str | Column, min_length: int = 6, min_exponent: int = 4) -> Column:
    """Column struct of a text's ``n_words``, its ``runs`` (start, length, period by start and period; those of at least
    ``min_length`` words and ``min_exponent`` periods, a whole number from 2) and its words with each run cut to its
    first period (``collapsed``, UTF-8, joined by blanks)."""
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield analysed(batch, min_length, min_exponent)

    task = staged("periods", run)
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(task, KIND)(text_bytes(text))


def longest(found: str | Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the first.  Null without runs."""
    found = F.col(found) if isinstance(found, str) else found
    greater = lambda best, r: best["length"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(found, none, lambda best, r: F.when(greater(best, r), r).otherwise(best))
