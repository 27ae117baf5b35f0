"""Exact top-k search by inner product with MaxScore.

The dimensions of the integer vectors are the terms.  Query blocks and candidate shards form a grid, and
each cell is one group of rows: a shard's columns are its postings, and for a query a term's contribution is
shifted by its least value in the shard, so that all contributions are at least 0 and have an upper bound.
Terms are ordered by bound; those whose bounds together cannot lift a candidate over the k-th best score so
far are non-essential.  Only the essential postings are traversed for all candidates; the others are probed
term by term while a candidate can still compete.  The cells' lists are merged by rank.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; a query is
compared with vectors of its own length, and never with rows of its own id; ties go to the smaller id;
repeated rows are candidates as often as they occur; query rows that repeat id and vector are one query, and
one id with several vectors has a list of k for each of them; rows without id take no part; fewer candidates than
k give fewer rows; an empty table gives none.  Ids are integers, or strings of them.  Scores are 64-bit integers and wrap beyond that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegeo.llm.common import staged

#: Candidates of a shard and queries of a block: a cell holds at most about both, times 8 bytes a component.
SHARD_ROWS, BLOCK_QUERIES = 8_192, 1_024
#: Below this magnitude of all partial sums floating point is exact, and is used for its speed.
EXACT = float(1 << 53)


def top_of_shard(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best candidates of a shard; ``vectors`` holds a row for each term (postings)."""
    low, high = vectors.min(axis=1), vectors.max(axis=1)
    rising = query >= 0
    bound = np.where(rising, query * (high - low), query * (low - high))
    base = (query * np.where(rising, low, high)).sum()
    order = np.argsort(-bound, kind="stable")
    after = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what the terms from a rank on can add at most
    alive = np.flatnonzero(ids != own_id)
    if len(alive) > k:  # a threshold to start with: the k-th best of a few whole scores
        some = alive[:: max(1, len(alive) // (8 * k))]
        whole = query @ vectors[:, some]
        threshold = np.partition(whole, len(whole) - k)[len(whole) - k] - base
        essential = int(np.argmax(after < threshold)) if (after < threshold).any() else len(order)
    else:
        threshold, essential = None, len(order)

    def gains(terms: np.ndarray, rows: np.ndarray) -> np.ndarray:
        shift = np.where(rising[terms], low[terms], high[terms])
        part = vectors[terms] if len(rows) == vectors.shape[1] else vectors[np.ix_(terms, rows)]
        return query[terms] @ part - (query[terms] * shift).sum()

    scores = gains(order[:essential], alive) if essential else np.zeros(len(alive), vectors.dtype)
    at = essential
    while threshold is not None:
        stay = scores + after[at] >= threshold
        alive, scores = alive[stay], scores[stay]
        if at == len(order):
            break
        if len(alive) > k and at > 0:  # what is certain already may lift the threshold
            threshold = max(threshold, np.partition(scores, len(scores) - k)[len(scores) - k])
        step = order[at : at + 4]
        scores = scores + gains(step, alive)
        at += len(step)
    best = np.lexsort((ids[alive], -scores))[:k]
    return ids[alive][best], scores[best] + base


def merge_best(df: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embedding: str | Column, scale: int = 1024) -> Column:
    """Components as floor(scale * x); null unless the vector and all its components are usable."""
    embedding = F.col(embedding) if isinstance(embedding, str) else embedding
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & usable, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def search(candidates: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query; ``vector``: array of long."""
    usable = F.col(id_column).isNotNull() & F.col(vector).isNotNull()
    cells = lambda df: df.filter(usable).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v"))
    rows, asked = cells(candidates), cells(queries).distinct()
    shards = 1 + rows.count() // SHARD_ROWS
    blocks = 1 + asked.count() // BLOCK_QUERIES
    place = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    spread = F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), F.lit(shards)).cast("int")  # repeated rows apart
    left = rows.withColumn("shard", spread).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(0))
    right = asked.withColumn("block", place(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("kind", F.lit(1))
    dealt = left.unionByName(right).select("shard", "block", F.size("v").alias("d"), "kind", "id", "v", F.xxhash64("v").alias("query"))

    def answer(ids: list[np.ndarray], rows: list[np.ndarray], _, query_ids: list[np.ndarray], asked: list[np.ndarray], vectors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not rows or not asked:
            return
        own, postings, found = np.concatenate(ids), np.ascontiguousarray(np.concatenate(rows).T), []
        wanted = np.concatenate(asked)
        size = float(np.abs(postings.astype(float)).max()) * float(np.abs(wanted.astype(float)).max()) * postings.shape[0] * 4
        if size < EXACT:
            postings, wanted = postings.astype(float), wanted.astype(float)
        for query_id, vector, query in zip(np.concatenate(query_ids).tolist(), np.concatenate(vectors).tolist(), wanted, strict=True):
            best, scores = top_of_shard(postings, own, query, query_id, k)
            found.append((np.full(len(best), query_id), np.full(len(best), vector), best, scores.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [], [], [])
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if start == end:
                    continue
                if now != (cell := tuple(keys[start, :3])):
                    yield from answer(*held)
                    now, held = cell, ([], [], [], [], [], [])
                part = batch.slice(start, end - start)
                kind = 3 * int(keys[start, 3])
                held[kind].append(part.column(4).to_numpy())
                held[kind + 1].append(part.column(5).flatten().to_numpy().reshape(end - start, -1))
                held[kind + 2].append(part.column(6).to_numpy())
        yield from answer(*held)

    found = dealt.repartition("shard", "block").sortWithinPartitions("shard", "block", "d", "kind").mapInArrow(staged("topk", run), "query_id long, query long, vec_id long, score long")
    return merge_best(found, k)
