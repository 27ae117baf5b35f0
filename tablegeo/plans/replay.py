"""Operation logs that rebuild tables, and sessions that outlive their driver.

A log holds operations by name with their arguments as JSON.  ``OPERATORS`` is the one registry of names.  ``replay``
applies a session's operations in force, after all undos and redos, to its first table; ``replay_edits`` rebuilds the
tables of any number of sessions at once, for logs of cell edits.

``DurableSession`` keeps a session as events in a folder that Spark reads and writes: the first table, one small file
for each event, numbered, and snapshots of the table now and then.  Whoever writes event n first wins; another writer
who has not seen it gets ``Conflict`` and opens the session anew.  A file appears by a rename, whole or not at all.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegeo.operators import edits
from tablegeo.operators.lookup import page_slice
from tablegeo.plans.session import oplog_effective
from tablegeo.schema import data_columns, page_keys

Operator = Callable[..., DataFrame]


def overwrite_page(df: DataFrame, page: Any, rows: list[dict[str, Any]]) -> DataFrame:
    """A page's cells overwritten by rows of row_number and data columns, as a log holds them."""
    names = ["row_number", *(c for c in data_columns(df) if any(c in r for r in rows))]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return edits.commit_page_edits(df, page, df.sparkSession.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema))[0]


#: What a log may name.
OPERATORS: dict[str, Operator] = {
    f.__name__: f
    for f in (
        edits.merge_columns,
        edits.split_column,
        edits.insert_column,
        edits.delete_columns,
        edits.rename_column,
        edits.edit_cell,
        edits.move_cell,
        edits.split_row,
        edits.merge_rows,
        edits.insert_row,
        edits.delete_rows,
        edits.normalize_row_numbers,
        overwrite_page,
    )
}

#: Arguments that name pages, rows or cells: tuples, which JSON turns into lists.
PLACES = {"page", "rows", "source", "target"}


def _place(value: Any) -> Any:
    return tuple(map(_place, value)) if isinstance(value, list) else value


def arguments(metadata: str) -> dict[str, Any]:
    """An operation's arguments from its JSON."""
    read = json.loads(metadata or "{}")
    out = {k: _place(v) if k in PLACES else v for k, v in read.items()}
    if isinstance(read.get("rows"), list):
        out["rows"] = read["rows"] if any(isinstance(r, dict) for r in read["rows"]) else list(out["rows"])
    return out


def apply_operation(table: DataFrame, action: str, metadata: str, operators: Mapping[str, Operator] = OPERATORS) -> DataFrame:
    if action not in operators:
        raise KeyError(f"no operator {action}")
    return operators[action](table, **arguments(metadata))


def kinds(log: DataFrame, operators: Mapping[str, Operator] = OPERATORS) -> DataFrame:
    """A log (session, seq, action, …) with its entries' kind; entries that are no operations are left out."""
    kind = F.when(F.col("action").isin("undo", "redo"), F.col("action")).when(F.col("action").isin(list(operators)), "apply")
    return log.withColumn("kind", kind).filter("kind is not null")


def operations_in_force(log: DataFrame, operators: Mapping[str, Operator] = OPERATORS) -> DataFrame:
    """(session, position, seq, action, metadata): what is left of each session after its undos and redos."""
    known = kinds(log, operators)
    return oplog_effective(known.select("session", "seq", "kind")).join(known.select("session", "seq", "action", "metadata"), ["session", "seq"])


def replay(table: DataFrame, log: DataFrame, session: str, operators: Mapping[str, Operator] = OPERATORS, after: int = 0) -> DataFrame:
    """A session's table: its operations in force, in order, from position ``after`` on (0: ``table`` is the first one;
    else it is a snapshot taken there).  A session's operations are a person's; the driver lists them, Spark applies
    them."""
    steps = operations_in_force(log.filter(F.col("session") == session), operators).filter(F.col("position") > after)
    for step in steps.orderBy("position").collect():
        table = apply_operation(table, step.action, step.metadata, operators)
    return table


def replay_edits(tables: DataFrame, log: DataFrame) -> DataFrame:
    """The tables (session, keys, data columns) of all sessions after the cell edits in force of their logs: the last
    edit of a cell counts.  Edits of cells that a session's table does not have change nothing; logs of other
    operations need ``replay``."""
    keys = ["session", *page_keys(tables), "row_number"]
    names = [c for c in data_columns(tables) if c != "session"]
    many = "doc_key" in keys  # a page is [document, page] then
    told = F.from_json("metadata", f"page {'array<string>' if many else 'int'}, row_number int, column string, value string")
    edit = operations_in_force(log, {"edit_cell": edits.edit_cell}).select("session", "position", told.alias("e"))
    place = [F.get("e.page", F.lit(0)).alias("doc_key"), F.get("e.page", F.lit(1)).cast("int").alias("page_number")] if many else [F.col("e.page").alias("page_number")]
    edit = edit.select("session", "position", *place, "e.row_number", "e.column", "e.value")
    last = F.row_number().over(Window.partitionBy(*keys, "column").orderBy(F.desc("position")))
    final = edit.withColumn("_last", last).filter("_last = 1").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_cells"))
    joined = tables.join(final, keys, "left")
    edited = {c: F.when(F.map_contains_key("_cells", F.lit(c)), F.try_element_at("_cells", F.lit(c))).otherwise(F.col(c)) for c in names}
    return joined.select(*(edited[c].alias(c) if c in edited else F.col(c) for c in tables.columns))


def log_entries(df: DataFrame, session: str, order: list[str], action: Any, metadata: Any) -> DataFrame:
    """OP_LOG (session, seq, ts, action, metadata) from a table of things done: ``action`` and ``metadata`` (a struct)
    are columns, ``order`` starts with the time."""
    seq = F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long")
    return df.select(F.col(session).alias("session"), seq.alias("seq"), F.col(order[0]).alias("ts"), action.alias("action"), F.to_json(metadata).alias("metadata"))


# -- sessions in a folder ------------------------------------------------------------------------------------


class Conflict(RuntimeError):
    """Someone else has written the session's next event."""


EVENT = "seq long, ts string, action string, metadata string, kind string"


@dataclass
class DurableSession:
    """A table under correction whose steps are events in ``folder``; see ``plans.session.Session`` for what they do.
    Opening it again, on any driver, gives table, stacks, pending change and drafts as they stood."""

    spark: SparkSession
    folder: str
    operators: Mapping[str, Operator] = field(default_factory=lambda: OPERATORS)
    snapshot_every: int = 10
    seq: int = 0
    log: list[dict[str, Any]] = field(default_factory=list)
    done: list[dict[str, Any]] = field(default_factory=list)
    undone: list[dict[str, Any]] = field(default_factory=list)
    pending: dict[str, Any] | None = None
    drafts: dict[Any, str] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], **settings: Any) -> DurableSession:
        """The session of a key; its first table is made and written once."""
        own = cls(spark, f"{folder}/{hashlib.sha256(key.encode()).hexdigest()}", **settings)
        if not own._exists("base/_SUCCESS"):
            make().write.mode("overwrite").parquet(f"{own.folder}/base")
        if own._exists("log"):
            for event in sorted(spark.read.schema(EVENT).json(f"{own.folder}/log/*.json").collect(), key=lambda e: e.seq):
                own._fold(event.asDict())
        return own

    def _path(self, name: str) -> Any:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self, path: Any) -> Any:
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        return self._files(path).exists(path)

    def _fold(self, event: dict[str, Any]) -> None:
        """What an event does to stacks, pending change and drafts."""
        kind, self.seq = event["kind"], event["seq"]
        if kind == "stage":
            self.pending = event
        elif kind == "draft":
            told = json.loads(event["metadata"])
            self.drafts[_place(told["page"])] = told["name"]
        elif kind == "reject":
            self.pending = None
        else:
            if kind == "accept":
                self.done.append({k: event[k] for k in ("seq", "action", "metadata")})
                self.undone.clear()
            elif kind == "undo":
                self.undone.append(self.done.pop())
            elif kind == "redo":
                self.done.append(self.undone.pop())
            self.pending = None
            self.drafts.clear()
            self.log.append({"timestamp": event["ts"], "action": event["action"], "metadata": json.loads(event["metadata"])})

    def _write(self, kind: str, action: str, metadata: str) -> None:
        event = {"seq": self.seq + 1, "ts": datetime.now(UTC).isoformat(), "action": action, "metadata": metadata, "kind": kind}
        jvm = self.spark.sparkContext._jvm
        name, made = self._path(f"log/{event['seq']:012d}.json"), self._path(f"log/_{hashlib.sha256(repr((event, id(self))).encode()).hexdigest()}")
        out = self._files(made).create(made, True)
        out.write(bytearray((json.dumps(event) + "\n").encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        once = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, name, once)
        except Exception as error:
            self._files(made).delete(made, False)
            if self._exists(f"log/{event['seq']:012d}.json"):
                raise Conflict(f"event {event['seq']} is written already; open the session anew") from error
            raise
        self._fold(event)

    def _frame(self, steps: list[dict[str, Any]]) -> DataFrame:
        """The table after some operations, from the last snapshot on their way; an operation's snapshot holds what came
        before it, too, so it is good wherever the operation is in force."""
        start, table = 0, None
        for i in range(len(steps), 0, -1):
            if self._exists(f"snapshots/{steps[i - 1]['seq']}/_SUCCESS"):
                start, table = i, self.spark.read.parquet(f"{self.folder}/snapshots/{steps[i - 1]['seq']}")
                break
        table = self.spark.read.parquet(f"{self.folder}/base") if table is None else table
        for step in steps[start:]:
            table = apply_operation(table, step["action"], step["metadata"], self.operators)
        return table

    @property
    def original(self) -> DataFrame:
        return self._frame([])

    @property
    def current(self) -> DataFrame:
        return self._frame(self.done)

    @property
    def history(self) -> list[DataFrame]:
        """The tables that undo goes back to, the next one last."""
        return [self._frame(self.done[:i]) for i in range(len(self.done))]

    def stage(self, action: str, description: str, **given: Any) -> DataFrame:
        """Prepare a change by its operator's name; one at a time.  Returns the preview, which is made before the
        event is written, so a wrong change leaves none."""
        if self.pending is not None:
            raise RuntimeError("another change is pending")
        metadata = json.dumps(given)
        preview = apply_operation(self.current, action, metadata, self.operators)
        self._write("stage", action, json.dumps({"description": description, "arguments": given}))
        return preview

    def preview(self) -> DataFrame | None:
        if self.pending is None:
            return None
        return apply_operation(self.current, self.pending["action"], json.dumps(json.loads(self.pending["metadata"])["arguments"]), self.operators)

    def apply(self, action: str, **given: Any) -> DataFrame:
        """A change without staging."""
        self.stage(action, action, **given)
        return self.accept()

    def accept(self) -> DataFrame:
        if self.pending is None:
            raise RuntimeError("no change is pending")
        given = json.loads(self.pending["metadata"])["arguments"]
        self._write("accept", self.pending["action"], json.dumps(given))
        if len(self.done) % self.snapshot_every == 0:
            self.current.write.mode("overwrite").parquet(f"{self.folder}/snapshots/{self.done[-1]['seq']}")
        return self.current

    def reject(self) -> None:
        if self.pending is not None:
            self._write("reject", "reject", "{}")

    def undo(self) -> DataFrame:
        if self.done:
            self._write("undo", "undo", "{}")
        return self.current

    def redo(self) -> DataFrame:
        if self.undone:
            self._write("redo", "redo", "{}")
        return self.current

    def store_draft(self, page: Any, rows: DataFrame) -> None:
        name = f"drafts/{self.seq + 1}-{hashlib.sha256(repr((page, id(rows))).encode()).hexdigest()[:8]}"
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self._write("draft", "draft", json.dumps({"page": page, "name": name}))

    def draft(self, page: Any) -> DataFrame:
        """The draft of a page, else the page as it is."""
        return self.spark.read.parquet(f"{self.folder}/{self.drafts[page]}") if page in self.drafts else page_slice(self.current, page)
