"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every window of ``w`` consecutive k-grams of words the least hash (the leftmost, if it repeats) is a fingerprint,
so any two texts that share a span of at least k + w - 1 words share a fingerprint at the same place of the span: with
k + w - 1 equal to the span wanted, none is missed.  Fingerprints of training texts are joined to those of the
benchmark; around each hit the span's windows are cut from the text and held against the benchmark's windows word by
word, so a chance equality of hashes changes nothing.  Overlapping windows are the extended hit.

Items shorter than the span are windows of their own length; each length that occurs (below the span, so a handful)
has fingerprints of its own k and w.

Scale: texts are read where they lie; fingerprints (two of seven grams) meet the benchmark's by broadcast where these
are few (counted first) and else by a shuffled semi join, whose hot keys Spark splits.  Texts with hits are known by
their digest, so copies are settled once, and a window that many items hold is one window of one class of items: no
pairs of documents and items are made but those in the result, and documents of equal classes share one list.

Nulls and texts without words have no words and no hits; items without words have no windows; an item with a null id
marks words and is not listed.  Rows that repeat are each marked.  Other columns stay; one named as the result goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegeo.llm.common import hidden, materialize

#: Words of a window, and what parts words (fixed values of the contract; letters are lower-cased before).
SPAN = 10
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is broadcast has at most so many rows (of some 100 bytes at most), counted before.
BROADCAST_ROWS = 500_000
#: Bits of a fingerprint that hold its position; the others hold its hash.
PLACE_BITS = 31


def words(text: str | Column) -> Column:
    """Words of a text, A to Z in lower case; ``lower`` does only that where all characters are of one byte."""
    text = F.coalesce(F.col(f"`{text}`") if isinstance(text, str) else text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BETWEEN_WORDS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sizes(length: int) -> tuple[int, int]:
    """k and w for windows of some words: k + w - 1 is the length."""
    k = (length + 1) // 2
    return k, length - k + 1


def winnowed(hashes: Column, length: int) -> Column:
    """Fingerprints of a list of word hashes, each with its position in the low bits."""
    k, w = sizes(length)
    low = (1 << PLACE_BITS) - 1

    def gram(i: Column) -> Column:
        own = F.xxhash64(F.lit(length), *(F.get(hashes, i + j) for j in range(k)))
        return own.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))

    def minima(grams: Column) -> Column:
        least = (lambda i: F.least(*(F.get(grams, i + j) for j in range(w)))) if w > 1 else (lambda i: F.get(grams, i))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(grams) - w), least))

    grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), gram)
    return F.when(F.size(hashes) >= length, let(grams, minima)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(text_words: Column, lengths: list[int]) -> Column:
    """Fingerprints for windows of each of some lengths: structs of length and mark."""

    def of(hashes: Column, length: int) -> Column:
        return F.transform(winnowed(hashes, length), lambda mark: F.struct(F.lit(length).alias("length"), mark.alias("mark")))

    return let(F.transform(text_words, lambda word: F.xxhash64(word)), lambda hashes: F.concat(*(of(hashes, n) for n in lengths)))


def _print(mark: str) -> Column:
    return F.shiftright(mark, PLACE_BITS)


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast if it is small, which is counted (over a written table)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _windows(text_words: Column, starts: Column, length: Column | int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(text_words, s + 1, length), " ").alias("window")))


def _all_starts(n: Column, length: Column | int) -> Column:
    return F.sequence(F.lit(0), n - length)


def benchmark_windows(items: DataFrame, item_id: str, text: str, span: int) -> DataFrame:
    """Each window of the items once: window, length and the ids (as sorted strings) of the items that hold it."""
    own = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), words(text).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(span))
    each = own.select("item", length.alias("length"), F.explode(_windows(F.col("words"), _all_starts(F.size("words"), length), length)).alias("w"))
    listed = each.groupBy(F.col("w.window").alias("window"), "length").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return listed.withColumn("class", F.sha2(F.to_json("items").cast("binary"), 256))


def _hits(docs: DataFrame, windows: DataFrame, text: str, span: int) -> tuple[DataFrame, list[int]]:
    """Places (digest, length, place) of the documents' fingerprints that the benchmark has too."""
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most ``span`` values
    if not lengths:
        return docs.sparkSession.createDataFrame([], "digest string, length int, place long"), lengths
    apart = F.split("window", " ")
    known = windows.select(F.explode(F.array(*(F.when(F.col("length") == n, fingerprints(apart, [n])) for n in lengths))).alias("marks"))
    known = materialize(known.select(F.explode("marks").alias("m")).select("m.length", _print("m.mark").alias("print")).distinct())
    marks = docs.select(F.sha2(_raw(text), 256).alias("digest"), F.explode(fingerprints(words(text), lengths)).alias("m"))
    marks = marks.select("digest", "m.length", "m.mark", _print("m.mark").alias("print"))
    met = marks.join(_bounded(known), ["length", "print"], "left_semi")
    return met.select("digest", "length", F.col("mark").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place")), lengths


def _raw(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")


def _spans(covered: Column) -> Column:
    """Sorted (start, length) windows merged to maximal runs."""
    run = "array<struct<start: int, end: int>>"

    def add(runs: Column, w: Column) -> Column:
        last, end = F.element_at(runs, -1), w["start"] + w["length"]
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))
        longer = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(grown))
        return F.when((F.size(runs) > 0) & (w["start"] <= last["end"]), longer).otherwise(F.concat(runs, F.array(F.struct(w["start"].alias("start"), end.alias("end")))))

    return F.aggregate(covered, F.array().cast(run), lambda runs, w: add(runs, w).cast(run))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """The texts that hold a window of an item: their digest (SHA-256 in hex), ``spans`` (maximal runs of hit words,
    start and end) and ``item_ids`` (the items with windows there, as sorted strings)."""
    windows = materialize(benchmark_windows(items, item_id, item_text, span))
    found, lengths = _hits(docs, windows, text, span)
    places = materialize(found.groupBy("digest", "length").agg(F.collect_set("place").alias("places")))
    met = docs.select(F.sha2(_raw(text), 256).alias("digest"), F.col(f"`{text}`").alias("text")).join(_bounded(places), "digest")
    k = F.floor((F.col("length") + 1) / 2).cast("int")  # as in sizes()

    def around(text_words: Column) -> Column:
        n = F.size(text_words)
        starts = F.transform("places", lambda p: F.sequence(F.greatest(F.lit(0), p.cast("int") - F.col("length") + k), F.least(p.cast("int"), n - F.col("length"))))
        return _windows(text_words, F.array_distinct(F.flatten(starts)), F.col("length"))

    cut = met.select("digest", "length", F.explode(let(words("text"), around)).alias("w")).select("digest", "length", "w.*")
    same = cut.join(_bounded(windows.select("window", "class")), "window")
    covered = F.sort_array(F.collect_set(F.struct("start", "length"))).alias("covered")
    texts = materialize(same.groupBy("digest").agg(covered, F.sort_array(F.collect_set("class")).alias("classes")).withColumn("kind", F.sha2(F.array_join("classes", "").cast("binary"), 256)))
    kinds = texts.select("kind", "classes").dropDuplicates(["kind"]).select("kind", F.explode("classes").alias("class"))
    lists = windows.select("class", "items").dropDuplicates(["class"])
    named = kinds.join(lists, "class").groupBy("kind").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    return materialize(texts.select("digest", "kind", _spans(F.col("covered")).alias("spans")).join(named, "kind").drop("kind"))


def with_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``leak``: ``n_words``, ``spans`` and ``item_ids`` (empty lists
    where nothing leaked)."""
    own = [c for c in docs.columns if c.lower() != "leak"]
    docs = docs.select(*(F.col(f"`{c}`") for c in own))
    digest, found, n = hidden("digest", docs), hidden("found", docs), hidden("words", docs)
    known = leaks(docs, items, text, item_id, item_text, span).select(F.col("digest").alias(digest), F.struct("spans", "item_ids").alias(found))
    marked = docs.withColumn(digest, F.sha2(_raw(text), 256)).withColumn(n, F.size(words(text)).cast("long")).join(_bounded(known), digest, "left")
    nothing = F.array()
    leak = F.struct(
        F.col(n).alias("n_words"),
        F.coalesce(F.col(found)["spans"], nothing.cast("array<struct<start: int, end: int>>")).alias("spans"),
        F.coalesce(F.col(found)["item_ids"], nothing.cast("array<string>")).alias("item_ids"),
    )
    return marked.select(*(F.col(f"`{c}`") for c in own), leak.alias("leak"))
