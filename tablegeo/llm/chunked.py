"""Texts in compressed chunks, and the sorted arrays that passes over chunks exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablegeo.llm.common import BASE, mix, powers, staged, values

#: Bytes of a chunk, and bytes hashed at once.
CHUNK_BYTES, SEGMENT = 2 << 20, 1 << 17
#: Most texts of a chunk (node numbers keep 21 bits for a place in a chunk).
CHUNK_TEXTS = 1 << 20
#: The two tables of byte values of the hashes.
BYTES_1, BYTES_2 = (mix(np.arange(first, first + 256, dtype=np.uint64) * BASE) for first in (1, 1001))
LAST_ID = (1 << 63) - 1

BLOB = "part int, chunk long, kind int, a binary, b binary, c binary, d binary, e binary"


class Sums:
    """Two 64-bit hashes of any range of some bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.one = self._sums(data, BYTES_1)
        self.data, self._two = data, None

    def _sums(self, data: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * self.up[: len(data)], out=out[1:])
        return out

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all strings of ``size`` bytes."""
        count = len(self.one) - size
        return mix((self.one[size:] - self.one[:count]) * self.down[:count])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self._two is None:
            self._two = self._sums(self.data, BYTES_2)
        back, length = self.down[starts], (ends - starts).astype(np.uint64)
        return mix((self.one[ends] - self.one[starts]) * back + length), mix((self._two[ends] - self._two[starts]) * back + length)


class Chunk:
    """Some texts, one after another, with their ids."""

    def __init__(self, keys: bytes, sizes: bytes, packed: bytes):
        self.keys, self.sizes = np.frombuffer(keys, np.int64), np.frombuffer(sizes, np.int64)
        self.bytes = zstandard.ZstdDecompressor().decompress(packed) if len(packed) else b""
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum(self.sizes)

    def place(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, start in its text) of positions."""
        text = np.searchsorted(self.ends, position, side="right")
        return self.keys[text], position - (self.ends - self.sizes)[text]

    def hashes(self, position: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of byte ranges; neighbours are hashed together, a segment at a time."""
        one, two = np.zeros(len(position), np.uint64), np.zeros(len(position), np.uint64)
        order = np.argsort(position, kind="stable")
        i = 0
        while i < len(order):
            at = int(position[order[i]])
            j = int(np.searchsorted(position[order], at + SEGMENT))
            some = order[i:j]
            sums = Sums(self.data[at : int((position[some] + length[some]).max())])
            one[some], two[some] = sums.ranges(position[some] - at, position[some] + length[some] - at)
            i = j
        return one, two


CHUNK = "chunk long, keys binary, sizes binary, packed binary"


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, bytes) as batches of one chunk each.  Chunks are numbered by task, so a frame that
    reads alike each time is chunked alike each time."""

    def emit() -> pa.RecordBatch:
        packed = zstandard.ZstdCompressor(level=1).compress(b"".join(held)) if size else b""
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in (np.array(keys, np.int64).tobytes(), np.array([len(t) for t in held], np.int64).tobytes(), packed))], names=["chunk", "keys", "sizes", "packed"])

    number, keys, held, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), values(batch.column(1)), strict=True):
            keys.append(key)
            held.append(text)
            size += len(text)
            if size >= CHUNK_BYTES or len(keys) >= CHUNK_TEXTS:
                yield emit()
                number, keys, held, size = number + 1, [], [], 0
    if keys:
        yield emit()


def chunks(docs: DataFrame) -> DataFrame:
    """``docs`` (key, bytes) in chunks, dealt by chunk."""
    return docs.mapInArrow(staged("chunks", chunked), CHUNK).repartition("chunk")


def over_chunks(docs: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of the chunks of ``docs`` where these are read, in the same Python worker."""
    return docs.mapInArrow(staged("chunks", lambda batches: run(chunked(batches))), schema)


def blob_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    columns = list(zip(*((*r, *[None] * (8 - len(r))) for r in rows), strict=True)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "chunk", "kind", "a", "b", "c", "d", "e"])


def small(x: np.ndarray) -> bytes:
    """Integers with the number of bytes that the largest needs, and that number in front; negative ones wrap."""
    most = 0 if not len(x) else 1 << 63 if x.min() < 0 else int(x.max())
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def slices(digit: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of sorted 64-bit digits by their leading bits."""
    cuts = np.searchsorted(digit, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
    cuts = np.append(cuts, len(digit))
    return [(p, int(cuts[p]), int(cuts[p + 1])) for p in range(1 << bits) if cuts[p] < cuts[p + 1]]
