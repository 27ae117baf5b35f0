"""Helpers shared by the operators: shared folders, Arrow iteration and 64-bit hashing of byte ranges."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hash (any odd number has an inverse modulo 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Multipliers of the 64-bit finaliser (fixed values of the published splitmix64 generator).
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).  Where it is unset, a temporary
    folder becomes the checkpoint folder if all runs on one machine, as in tests; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tablegeo-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Bytes of an Arrow batch that operators ask for: rows hold whole texts, so a count of rows bounds nothing.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by size in this session, unless it has a smaller bound already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str((1 << 31) - 1))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and return a reader of it: cuts lineage, survives the loss of
    any executor and, unlike an RDD checkpoint, stays columnar and compressed."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def text_bytes(column: str | Column) -> Column:
    """A text as UTF-8 bytes, null as no bytes; Arrow then moves it without checking or decoding it."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def values(column: pa.Array, step: int = 256) -> Iterator:
    """Python values of an Arrow column, a few at a time, so that a batch never exists twice in full."""
    for start in range(0, len(column), step):
        yield from column.slice(start, step).to_pylist()


def hidden(name: str, *frames: DataFrame) -> str:
    """A name for a helper column that none of the frames has (names differ by more than case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def keep_rows(df: DataFrame, locator: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``locator`` (not null) is among those of ``kept`` (one column), all columns as they
    are.  Of rows with one locator the one with the least hash of all its values stays.  The rows are dealt by
    locator once, for the join and for the choice."""
    name, place = hidden("locator", df), hidden("place", df)
    own = [F.col(f"`{c}`") for c in df.columns]
    whole = F.xxhash64(*(c for c, kind in zip(own, df.dtypes, strict=True) if "map<" not in kind[1]))
    keyed = df.withColumn(name, locator)
    found = keyed.join(kept.toDF(name).distinct(), name, "left_semi")
    first = F.row_number().over(Window.partitionBy(name).orderBy(whole))
    return found.withColumn(place, first).filter(F.col(place) == 1).select(*own)


_WORKER: dict = {}


def _return_memory() -> None:
    """Give freed memory back to the system: an executor's workers and its JVM share one bound."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def serve(owner: str) -> None:
    """A Python worker begins a task of ``owner``.  Workers serve one operator after another, so the first task
    of another owner lets go of what the one before remembered."""
    if not _WORKER.get("tuned"):
        _WORKER["tuned"] = True
        try:  # allocations of 1 MB and more go back to the system when they are freed (fixed: M_MMAP_THRESHOLD)
            ctypes.CDLL(None).mallopt(-3, 1 << 20)
        except (AttributeError, OSError):
            pass
    if _WORKER.get("owner") != owner:
        _WORKER.clear()
        _WORKER.update(tuned=True, owner=owner)
        _POWERS.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
        gc.collect()
        _return_memory()


def staged(owner: str, run):
    """``run``, a function of Arrow batches, as a task of ``owner`` that returns its memory at its end."""

    def task(batches: Iterator) -> Iterator:
        serve(owner)
        try:
            yield from run(batches)
        finally:
            _return_memory()

    return task


def worker_cache(owner: str, key: tuple, make):
    """What an operator remembers in a Python worker from task to task."""
    serve(owner)
    if key not in _WORKER:
        _WORKER[key] = make()
    return _WORKER[key]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over the whole range (one-to-one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64; kept by the worker and extended by need."""
    if len(_POWERS["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: One random-looking odd-spread value for each byte, so that the sums below do not depend on small integers.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of value(data[j]) * BASE**j over j < i, from which any range's hash follows."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX_1)
