"""LM scoring: a Katz backoff bigram model with Good-Turing discounts.

*Model.*  For a pair seen r times in training, P(w|v) = d(r) r / t(v), d(r) being Katz's Good-Turing discount
and t(v) = c(v); otherwise alpha(v) P(w).  The recursion ends at the add-one unigram P(w) = (c(w) + 1) / (N + V + 1),
which leaves one share to all unknown words together, so the words seen after v never cover everything.  A context
that discounts take nothing from (all its pairs are frequent, or no discount is usable) has t(v) = c(v) + 1: one
count is left to unseen words.  alpha(v) is made from whole numbers: how many pairs of v were seen once to TRUSTED
times, and the sum of c(w) + 1 over the words seen after it, so P(.|v) sums to one exactly.  All words and all pairs
count; nothing is a class, cut off or sampled.  A text is scored from a start symbol to an end symbol; words are
`[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, known by 64-bit hashes.

*Tables.*  Texts are coded once in blocks: the block's distinct words and, token by token, their places.  Words, and
pairs of words, are dealt by hash to parts; a part merges what all blocks hold, so a word or pair that a third of all
texts share is one entry for each block.  The model is two tables, one row for each part: words with c(w) and the
numbers that alpha(w) is made of, and pairs with r.  A part also answers each block: the counts of what it asked for,
and which pairs the block is the first to hold; these it adds to the numbers of their contexts, which go to the words'
parts.  So a frequent context never gathers its pairs anywhere.  The number of parts follows the size of the blocks.

*Scoring.*  Blocks ask the parts of both tables for their distinct words and pairs, get arrays of counts back where
the blocks are dealt to, and each token is evaluated there: the pair if it was seen, else the context's alpha and the
word.  Nothing the size of the data is broadcast or collected.

Defined results: ids are integers, or strings of them; a null text is the empty text, which holds the end symbol
alone; repeated rows and null ids get a row each; texts of any length are scored whole; with an empty training set
every token is unknown.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegeo.llm.common import BASE, bound_batches, discard, materialize, mix, prefix_sums, range_hashes, staged, text_bytes, values

#: Counts above this are trusted as they are (Katz's k).
TRUSTED = 5
#: Bytes of texts of a block, words of a very long text hashed at once, and entries of a part of a table, about.
BLOCK_BYTES, HASH_BYTES, PART_ENTRIES = 1 << 22, 1 << 19, 1_500_000
#: The end and the start symbol.
END, START = np.uint64(0x0E4D), np.uint64(0x57A7)

SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: Rows between blocks and parts, and their kinds: a part's stored table comes before what blocks send, a block's texts
#: before what parts answer; totals go to the driver.
ROW = "part int, block long, kind int, a binary, b binary, c binary, d binary, e binary"
TABLE, SENT, TEXTS, WORDS, PAIRS, TOTALS = range(6)


# -- tokens --------------------------------------------------------------------------------------------


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word; long data is cut between words."""
    starts, hashes, at = [], [], 0
    raw = np.frombuffer(data, np.uint8)
    while at < len(raw):
        end = min(len(raw), at + HASH_BYTES)
        while end < len(raw) and not SPACE[raw[end]]:  # to the end of the word
            gap = np.flatnonzero(SPACE[raw[end : end + 4096]])
            end = end + int(gap[0]) if len(gap) else min(len(raw), end + 4096)
        part = LOWER[raw[at:end]]
        edge = np.diff(np.concatenate([[True], SPACE[part], [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        starts.append(first + at)
        hashes.append(range_hashes(prefix_sums(part), first, last))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def token_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, tokens, sizes): texts of about BLOCK_BYTES, their tokens in order, each text's end included."""

    def emit():
        joined, offsets = b"\n".join(held), np.cumsum([0] + [len(t) + 1 for t in held])
        starts, hashes = word_hashes(joined)
        text = np.searchsorted(offsets, starts, side="right") - 1
        sizes = np.bincount(text, minlength=len(held)) + 1
        tokens = np.full(len(hashes) + len(held), END, np.uint64)
        tokens[np.arange(len(hashes)) + text] = hashes
        return ids, tokens, sizes

    ids, held, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), values(batch.column(1)), strict=True):
            ids.append(key)
            held.append(text)
            size += len(text) + 1
            if size >= BLOCK_BYTES:
                yield emit()
                ids, held, size = [], [], 0
    if held:
        yield emit()


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as their first bytes, their second bytes and so on, compressed; in front, how many bytes each
    needs."""
    most = int(x.max()) if len(x) else 0
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    x = x.astype(kind)
    return bytes([x.itemsize]) + zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unplaned(data: bytes) -> np.ndarray:
    size = data[0]
    raw = np.frombuffer(zstandard.decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(f"u{size}").astype(np.uint64)


def whole(data: bytes) -> np.ndarray:
    return unplaned(data).astype(np.int64)


def rising(keys: np.ndarray) -> bytes:
    """Sorted keys as their steps."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=np.uint64)


def sliced(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """(part, which of the sorted keys) by their leading bits."""
    if not len(keys):
        return []
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    some = np.flatnonzero(np.diff(part, prepend=-1))
    return [(int(part[i]), slice(int(i), int(j))) for i, j in zip(some, np.append(some[1:], len(part)), strict=True)]


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    columns = list(zip(*((*r, *[None] * (8 - len(r))) for r in rows), strict=True)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "block", "kind", "a", "b", "c", "d", "e"])


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)), *(values(batch.column(i), 8) for i in range(3, 8)), strict=True)


def settled(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder, and its shuffle files let go of at once."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return materialize(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


# -- blocks --------------------------------------------------------------------------------------------


@dataclass
class Block:
    """Texts in code: distinct words (the start symbol among them) and, for each token, its word's and its context's
    place."""

    keys: np.ndarray
    sizes: np.ndarray  # tokens of each text
    word: np.ndarray
    context: np.ndarray

    @classmethod
    def of(cls, row: tuple) -> Block:
        keys, sizes, word = risen(row[4]), whole(row[5]), whole(row[6])
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[np.cumsum(sizes) - sizes] = np.searchsorted(keys, START)
        return cls(keys, sizes, word, context)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct keys of the pairs, a token with each, each token's pair)."""
        keys = mix(self.keys[self.context] * BASE + self.keys[self.word])
        return grouped(keys)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, a place of each, which of them stands at each place)."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(fresh) - 1
    return ordered[fresh], order[fresh], at


def coded(texts: DataFrame) -> DataFrame:
    """The blocks of texts (id, bytes) as ROWs: ids and which are null, words, sizes, tokens; ``part`` holds how many
    thousand distinct pairs there are, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for ids, tokens, sizes in token_blocks(batches):
            keys, word = np.unique(np.append(tokens, START), return_inverse=True)
            word = word[:-1]
            void = np.array([i is None for i in ids])
            plain = np.array([0 if i is None else i for i in ids], np.int64)
            yield rows_of([(1 + len(word) // 1000, number, TEXTS, plain.tobytes() + void.tobytes(), rising(keys), planes(sizes), planes(word))])
            number += 1

    return materialize(texts.mapInArrow(staged("katz", run), ROW))


def send(blocks: DataFrame, bits: int, of_pairs: bool, counted: bool) -> DataFrame:
    """To each part, what each block holds: its distinct words or pairs, with how often if they are ``counted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            block = Block.of(row)
            if of_pairs:
                keys, _, at = block.pairs()
            else:
                keys, at = block.keys, block.word
            times = np.bincount(at, minlength=len(keys)) if counted else None
            if counted and not of_pairs:
                times[np.searchsorted(keys, START)] = len(block.sizes)
            yield rows_of([(part, row[1], SENT, rising(keys[some]), planes(times[some]) if counted else None) for part, some in sliced(keys, bits)])

    return blocks.mapInArrow(staged("katz", run), ROW)


def by_part(rows: DataFrame, answer: Callable[[list, list], Iterator[tuple]]) -> DataFrame:
    """What ``answer`` makes of each part's (stored table, sent rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, sent = None, [], []
        for row in each_row(batches):
            if row[0] != now:
                if now is not None:
                    for made in answer(now, table, sent):
                        yield rows_of([made])
                now, table, sent = row[0], [], []
            (table if row[2] == TABLE else sent).append(row)
        if now is not None:
            for made in answer(now, table, sent):
                yield rows_of([made])

    return rows.repartition("part").sortWithinPartitions("part", "kind", "block").mapInArrow(staged("katz", run), ROW)


def by_block(rows: DataFrame, work: Callable[[tuple, dict[int, list]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` makes of each block and the answers to it, by kind and in the order of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, answers = None, {}
        for row in each_row(batches):
            if row[2] == TEXTS:
                if texts is not None:
                    yield from work(texts, answers)
                texts, answers = row, {}
            else:
                answers.setdefault(row[2], []).append(row)
        if texts is not None:
            yield from work(texts, answers)

    return rows.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(staged("katz", run), schema)


def joined(parts: list[bytes], read=whole) -> np.ndarray:
    return np.concatenate([read(p) for p in parts]) if parts else np.zeros(0, np.int64)


# -- model ---------------------------------------------------------------------------------------------


def merged(sent: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sorted distinct keys, sums of their counts, one place of each among all that was sent, which of them each
    sender sent)."""
    own = [risen(r[3]) for r in sent]
    keys, one, at = grouped(np.concatenate(own))
    times = np.bincount(at, weights=joined([r[4] for r in sent]), minlength=len(keys)).astype(np.int64)  # exact below 2**53
    return keys, times, one, np.split(at, np.cumsum([len(x) for x in own])[:-1])


def count_words(part: int, table: list, sent: list) -> Iterator[tuple]:
    """The words' table of a part, its totals (N, V), and to each block the counts of its words."""
    keys, times, _, own = merged(sent)
    yield part, 0, TABLE, rising(keys), planes(times)
    words = keys != START
    yield part, 0, TOTALS, np.array([times[words].sum(), words.sum()], np.int64).tobytes()
    for row, at in zip(sent, own, strict=True):
        yield part, row[1], WORDS, planes(times[at])


def count_pairs(part: int, table: list, sent: list) -> Iterator[tuple]:
    """The pairs' table of a part, how many pairs were seen how often, and to each block the counts of its pairs and
    which of them it is the one to report."""
    keys, times, one, own = merged(sent)
    yield part, 0, TABLE, rising(keys), planes(times)
    yield part, 0, TOTALS, np.bincount(np.minimum(times, TRUSTED + 2), minlength=TRUSTED + 3).tobytes()
    leads, first = np.zeros(sum(map(len, own)), bool), 0
    leads[one] = True
    for row, at in zip(sent, own, strict=True):
        yield part, row[1], PAIRS, planes(times[at]), np.packbits(leads[first : first + len(at)]).tobytes()
        first += len(at)


def contexts(bits: int) -> Callable:
    """What a block adds to its contexts: sums of c(w) + 1 and numbers of pairs seen 1 to TRUSTED times."""

    def work(texts: tuple, answers: dict[int, list]) -> Iterator[pa.RecordBatch]:
        block = Block.of(texts)
        counts = joined([r[3] for r in answers[WORDS]])
        times = joined([r[3] for r in answers[PAIRS]])
        leads = np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8))[: len(unplaned(r[3]))] for r in answers[PAIRS]]).astype(bool)
        some = block.pairs()[1][leads]
        v, r, n = block.context[some], times[leads], len(block.keys)
        facts = [np.bincount(v, weights=counts[block.word[some]] + 1, minlength=n).astype(np.int64)]
        facts += [np.bincount(v[r == k], minlength=n) for k in range(1, TRUSTED + 1)]
        held = np.flatnonzero(facts[0])
        facts = np.stack(facts)[:, held]
        yield rows_of([(part, texts[1], SENT, rising(block.keys[held][s]), planes(facts[0][s]), *packed(facts[1:, s])) for part, s in sliced(block.keys[held], bits)])

    return work


def packed(numbers: np.ndarray) -> list[bytes]:
    """The numbers of pairs seen once, and of those seen 2 to TRUSTED times one after another."""
    return [planes(numbers[0]), planes(numbers[1:].reshape(-1))]


def add_contexts(part: int, table: list, sent: list) -> Iterator[tuple]:
    """The words' table with the facts of each word as a context."""
    keys, counts = risen(table[0][3]), whole(table[0][4])
    sums = np.zeros((TRUSTED + 1, len(keys)), np.int64)
    for r in sent:
        at = np.searchsorted(keys, risen(r[3]))  # distinct
        sums[0, at] += whole(r[4])
        sums[1, at] += whole(r[5])
        sums[2:, at] += whole(r[6]).reshape(TRUSTED - 1, -1)
    yield part, 0, TABLE, table[0][3], planes(counts), planes(sums[0]), *packed(sums[1:])


def katz_discounts(seen: dict[int, int]) -> np.ndarray:
    """d(r) by r from the numbers of pairs seen r times; 1 where the estimate is unusable."""
    n = [seen.get(r, 0) for r in range(TRUSTED + 2)]
    out = np.ones(TRUSTED + 2)
    if n[1] and n[TRUSTED + 1] < n[1] / (TRUSTED + 1):
        last = (TRUSTED + 1) * n[TRUSTED + 1] / n[1]
        for r in range(1, TRUSTED + 1):
            if n[r]:
                d = ((r + 1) * n[r + 1] / n[r] / r - last) / (1 - last)
                out[r] = d if 0 < d < 1 else 1.0
    return out


@dataclass
class KatzModel:
    """N, V and the discounts, and the tables, a ROW for each part."""

    tokens: int
    types: int
    discounts: np.ndarray
    words: DataFrame
    pairs: DataFrame
    word_bits: int
    pair_bits: int

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 P(w) by c(w)."""
        return np.log10((counts + 1.0) / (self.tokens + 1.0 * (self.types + 1)))

    def backoff(self, counts: np.ndarray, covered: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 t(v), log10 alpha(v)) of contexts by their facts; of contexts never seen, alpha is 1."""
        taken = ((1 - self.discounts[1 : TRUSTED + 1]) * np.arange(1, TRUSTED + 1)) @ few
        none = taken <= 0
        total = np.where(none, counts + 1, counts).astype(float)
        shares = float(self.tokens + self.types + 1)
        alpha = np.where(none, 1.0, taken) / total * shares / (shares - covered)
        return np.log10(np.maximum(total, 1)), np.where(counts > 0, np.log10(alpha), 0.0)


def bits_of(entries: int) -> int:
    return max(2, int(entries // PART_ENTRIES).bit_length())


def totals(rows: DataFrame) -> np.ndarray:
    """The sum of the parts' totals: a few numbers for each part."""
    found = [np.frombuffer(bytes(r.a), np.int64) for r in rows.filter(F.col("kind") == TOTALS).select("a").toLocalIterator()]
    return np.sum(found, axis=0) if found else np.zeros(TRUSTED + 3, np.int64)


def kind(rows: DataFrame, *which: int) -> DataFrame:
    return rows.filter(F.col("kind").isin(*which))


def train(texts: DataFrame, text: str = "text") -> KatzModel:
    """Count all texts of a frame and fit the model."""
    bound_batches(texts.sparkSession)
    blocks = coded(texts.select(F.lit(0).cast("long").alias("id"), text_bytes(text).alias("text")))
    size = 1000 * (blocks.agg(F.sum("part")).first()[0] or 0)
    word_bits, pair_bits = bits_of(size // 4), bits_of(size)
    first = settled(by_part(send(blocks, word_bits, False, True), count_words))
    second = settled(by_part(send(blocks, pair_bits, True, True), count_pairs))
    tokens, types = (int(x) for x in totals(first)[:2])
    seen = dict(enumerate(totals(second)[: TRUSTED + 2].tolist()))
    added = by_block(blocks.unionByName(kind(first, WORDS)).unionByName(kind(second, PAIRS)), contexts(word_bits), ROW)
    words = settled(by_part(kind(first, TABLE).unionByName(added), add_contexts))
    pairs = kind(second, TABLE)
    discard(blocks)
    discard(first)
    return KatzModel(tokens, types, katz_discounts(seen), words, pairs, word_bits, pair_bits)


# -- scores --------------------------------------------------------------------------------------------


def found_in(keys: np.ndarray, asked: np.ndarray, *facts: np.ndarray) -> list[np.ndarray]:
    """Facts of the keys asked for, 0 of those that are not there."""
    if not len(keys):
        return [np.zeros(len(asked), np.int64) for _ in facts]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    known = keys[at] == asked
    return [np.where(known, f[at], 0) for f in facts]


def tell_words(part: int, table: list, sent: list) -> Iterator[tuple]:
    keys, facts = np.zeros(0, np.uint64), np.zeros((TRUSTED + 2, 0), np.int64)
    if table:
        keys = risen(table[0][3])
        facts = np.stack([*(whole(x) for x in table[0][4:7]), *whole(table[0][7]).reshape(TRUSTED - 1, -1)])
    for row in sent:
        found = np.stack(found_in(keys, risen(row[3]), *facts))
        yield part, row[1], WORDS, planes(found[0]), planes(found[1]), *packed(found[2:])


def tell_pairs(part: int, table: list, sent: list) -> Iterator[tuple]:
    keys, times = (risen(table[0][3]), whole(table[0][4])) if table else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for row in sent:
        yield part, row[1], PAIRS, planes(found_in(keys, risen(row[3]), times)[0])


def score(texts: DataFrame, model: KatzModel, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``texts``; scores are
    log10 probabilities under the unigram and the whole model."""
    bound_batches(texts.sparkSession)
    blocks = coded(texts.select(F.col(id_column).cast("long"), text_bytes(text)))
    first = settled(by_part(model.words.unionByName(send(blocks, model.word_bits, False, False)), tell_words))
    second = settled(by_part(model.pairs.unionByName(send(blocks, model.pair_bits, True, False)), tell_pairs))
    small = KatzModel(model.tokens, model.types, model.discounts, None, None, 0, 0)

    def work(row: tuple, answers: dict[int, list]) -> Iterator[pa.RecordBatch]:
        block, told = Block.of(row), answers[WORDS]
        counts, covered, once = (joined([r[i] for r in told]) for i in (3, 4, 5))
        few = np.concatenate([once[None], np.concatenate([whole(r[6]).reshape(TRUSTED - 1, -1) for r in told], axis=1)])
        total, alpha = small.backoff(counts, covered, few)
        base = small.unigram(counts)[block.word]
        times = joined([r[3] for r in answers[PAIRS]])[block.pairs()[2]]
        seen = np.log10(np.maximum(small.discounts[np.minimum(times, TRUSTED + 1)] * times, 1e-300)) - total[block.context]
        each = np.where(times > 0, seen, alpha[block.context] + base)
        owner, n = np.repeat(np.arange(len(block.sizes)), block.sizes), len(block.sizes)
        known = np.bincount(owner, weights=counts[block.word] > 0, minlength=n).astype(np.int64)
        ids, void = np.frombuffer(row[3], np.int64, count=n), np.frombuffer(row[3], bool, offset=8 * n)
        columns = [pa.array(ids, mask=void), pa.array(block.sizes), pa.array(known), *(pa.array(np.bincount(owner, weights=x, minlength=n)) for x in (base, each))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "n_known", "base_score", "score"])

    rows = by_block(blocks.unionByName(first).unionByName(second), work, "id long, n_tokens long, n_known long, base_score double, score double")
    return rows.select(F.col("id").alias(id_column), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
