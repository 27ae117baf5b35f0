"""Correction sessions: staged changes, undo and redo, and the operation log."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegeo.operators.lookup import page_slice


def content_key(files: DataFrame) -> DataFrame:
    """Binary files with their hexadecimal SHA-256 as doc_key."""
    return files.withColumn("doc_key", F.sha2("content", 256))


def state_key(doc_key: str, pages: list[int] | None = None) -> str:
    return f"{doc_key}:pages:{','.join(map(str, pages))}" if pages else f"{doc_key}:all-pages"


def state_key_column(doc_key, pages):
    """The same as a column; ``pages`` is an array."""
    listed = F.concat(doc_key, F.lit(":pages:"), F.array_join(F.transform(pages, lambda p: p.cast("string")), ","))
    return F.when(F.size(pages) > 0, listed).otherwise(F.concat(doc_key, F.lit(":all-pages")))


@dataclass
class Pending:
    """A change that waits for acceptance; the preview is lazy."""

    action: str
    description: str
    preview: DataFrame
    metadata: dict[str, Any]

    def to_metadata(self) -> dict[str, Any]:
        return {"action": self.action, "description": self.description, "metadata": self.metadata}


def operation_record(action: str, metadata: dict[str, Any]) -> dict[str, Any]:
    """An entry of the log (fixed names: those of the exported history, as in ``Pending.to_metadata``)."""
    return {"timestamp": datetime.now(UTC).isoformat(), "action": action, "metadata": metadata}


@dataclass
class Session:
    """One table under correction.  Stacks hold references to lazy frames, so steps cost nothing; after
    ``cut_after`` accepted changes the frame is checkpointed, which needs a checkpoint folder."""

    original: DataFrame
    selective: dict[str, Any] | None = None
    cut_after: int = 10
    current: DataFrame = field(init=False)
    history: list[DataFrame] = field(default_factory=list)
    undone: list[DataFrame] = field(default_factory=list)
    log: list[dict[str, Any]] = field(default_factory=list)
    pending: Pending | None = None
    drafts: dict[tuple[str, int], DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.current = self.original
        if self.selective is not None:
            self.log.append(operation_record("selective_extraction", self.selective))

    def stage(self, action: str, description: str, change: Callable[..., DataFrame], **arguments: Any) -> Pending:
        """Prepare a change of the current table; one at a time."""
        if self.pending is not None:
            raise RuntimeError("another change is pending")
        self.pending = Pending(action, description, change(self.current, **arguments), arguments)
        return self.pending

    def apply(self, action: str, change: Callable[..., DataFrame], **arguments: Any) -> DataFrame:
        """A change without staging."""
        self.stage(action, action, change, **arguments)
        return self.accept()

    def accept(self) -> DataFrame:
        if self.pending is None:
            raise RuntimeError("no change is pending")
        self.history.append(self.current)
        self.current, self.undone = self.pending.preview, []
        self.log.append(operation_record(self.pending.action, self.pending.metadata))
        self.pending = None
        self.drafts.clear()
        if len(self.history) % self.cut_after == 0 and self.current.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            self.current = self.current.checkpoint()
        return self.current

    def reject(self) -> None:
        self.pending = None

    def undo(self) -> DataFrame:
        return self._step("undo", self.history, self.undone)

    def redo(self) -> DataFrame:
        return self._step("redo", self.undone, self.history)

    def _step(self, action: str, source: list[DataFrame], target: list[DataFrame]) -> DataFrame:
        if source:
            target.append(self.current)
            self.current, self.pending = source.pop(), None
            self.log.append(operation_record(action, {}))
            self.drafts.clear()
        return self.current

    def store_draft(self, key: str, page: int | tuple[str, int], rows: DataFrame) -> None:
        self.drafts[key, page] = rows

    def draft(self, key: str, page: int | tuple[str, int]) -> DataFrame:
        """The draft of a page, else the page as it is; of many documents, ``page`` is (doc_key, page_number)."""
        return self.drafts[key, page] if (key, page) in self.drafts else page_slice(self.current, page)

    def report(self) -> dict[str, Any]:
        return {
            "original_columns": self.original.columns, "corrected_columns": self.current.columns, "original_row_count": self.original.count(), "corrected_row_count": self.current.count(),
            "pending_change": self.pending.to_metadata() if self.pending else None, "operation_history": self.log,
        }


class Sessions:
    """The open sessions by state key.  Opening a key again gives the session as it stands: corrections, stacks
    and log are not lost, and the table is not made again."""

    def __init__(self) -> None:
        self.open_sessions: dict[str, Session] = {}

    def open(self, key: str, make: Callable[[], DataFrame], selective: dict[str, Any] | None = None) -> Session:
        if key not in self.open_sessions:
            self.open_sessions[key] = Session(make(), selective)
        return self.open_sessions[key]

    def close(self, key: str) -> None:
        self.open_sessions.pop(key, None)


def memoised(spark: SparkSession, folder: str, doc_key: str, version: str, pages: list[int] | None, parse: Callable[[], DataFrame]) -> DataFrame:
    """What ``parse`` gives for a document, made once for each content, version and choice of pages: it is kept as
    Parquet under ``folder`` (any store that Spark writes to) and read from there afterwards.  A write that was cut
    short has no success mark and is made again."""
    name = hashlib.sha256(f"{state_key(doc_key, pages)}|{version}".encode()).hexdigest()
    path = f"{folder}/{name}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        parse().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def operation_log(session: str, log: list[dict[str, Any]], spark) -> DataFrame:
    """A session's log as rows."""
    rows = [(session, i, datetime.fromisoformat(r["timestamp"]), r["action"], json.dumps(r["metadata"], default=str)) for i, r in enumerate(log, start=1)]
    return spark.createDataFrame(rows, "session string, seq long, ts timestamp, action string, metadata string")


def lineage_report(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """One row: columns and row counts before and after."""
    counted = original.agg(F.count(F.lit(1)).alias("original_row_count")).crossJoin(F.broadcast(corrected.agg(F.count(F.lit(1)).alias("corrected_row_count"))))
    return counted.withColumns({"original_columns": F.lit(",".join(original.columns)), "corrected_columns": F.lit(",".join(corrected.columns))})


def oplog_effective(log: DataFrame) -> DataFrame:
    """(session, position, seq): the operations in force after all undos and redos.  ``log``: (session, seq,
    kind) with kind apply, undo or redo; a new operation forgets what was undone.  The fold runs over sorted
    partitions and holds one session's stacks."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"session": pa.array([now] * len(done), kinds[0]), "position": pa.array(range(1, len(done) + 1), pa.int32()), "seq": pa.array(done, pa.int64())})

        now, done, undone, kinds = None, [], [], None
        for batch in batches:
            kinds = [f.type for f in batch.schema]
            for session, seq, kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if session != now:
                    if done:
                        yield emit()
                    now, done, undone = session, [], []
                if kind == "apply":
                    done.append(seq)
                    undone.clear()
                elif kind == "undo" and done:
                    undone.append(done.pop())
                elif kind == "redo" and undone:
                    done.append(undone.pop())
        if done:
            yield emit()

    kind = log.schema["session"].dataType.simpleString()
    ordered = log.select("session", F.col("seq").cast("long").alias("seq"), "kind").repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInArrow(fold, f"session {kind}, position int, seq long")
