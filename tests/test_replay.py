"""Logs that rebuild tables, and sessions that outlive their driver."""

from __future__ import annotations

import json
import random

import pytest

from tablegeo.operators import edits
from tablegeo.plans import replay
from tablegeo.plans.session import Session, operation_log
from tests.conftest import rows

COLUMNS = "doc_key string, page_number int, row_number int, col_1 string, col_2 string, col_3 string"


def table(spark):
    out = [(d, p, r, f"{d}{p}{r} x", "a|b" if r % 2 else None, " ") for d in ("d", "e") for p in (1, 2) for r in range(1, 4)]
    return spark.createDataFrame(out, COLUMNS)


STEPS = [
    ("edit_cell", {"page": ("d", 1), "row_number": 2, "column": "col_1", "value": "new"}),
    ("merge_columns", {"columns": ["col_1", "col_3"], "output": "both"}),
    ("split_column", {"column": "col_2", "delimiter": "|"}),
    ("insert_column", {"after": "both", "name": "more"}),
    ("rename_column", {"column": "more", "name": "else"}),
    ("move_cell", {"source": (("d", 1), 1, "both"), "target": (("e", 2), 3, "else")}),
    ("insert_row", {"page": ("e", 1), "after_row": 1}),
    ("delete_rows", {"rows": [(("d", 2), 1), (("d", 2), 3)]}),
    ("merge_rows", {"rows": [(("e", 1), 1), (("e", 1), 3)]}),
    ("split_row", {"page": ("d", 1), "row_number": 1, "delimiter": " "}),
    ("delete_columns", {"columns": ["col_2_right"]}),
    ("overwrite_page", {"page": ("d", 2), "rows": [{"row_number": 1, "both": "over"}]}),
]


def test_registry_names_every_operator():
    own = {n for n, f in vars(edits).items() if callable(f) and getattr(f, "__module__", "") == edits.__name__ and not n.startswith("_")}
    assert own - {"commit_page_edits"} <= set(replay.OPERATORS)


def test_log_rebuilds_the_table(spark):
    """What a session did, written as rows and read again, gives its table, also from a snapshot on the way."""
    own, first, middle = Session(table(spark), {"polygon": [1, 2]}, cut_after=1000), table(spark), None
    for i, (action, given) in enumerate(STEPS):
        own.apply(action, replay.OPERATORS[action], **given)
        if i == 5:
            middle = own.current
        if i in (2, 8):
            own.undo()
            own.redo()
        if i == 7:
            own.apply("edit_cell", edits.edit_cell, page=("d", 1), row_number=1, column="both", value="gone")
            own.undo()
    log = operation_log("s", own.log, spark).union(operation_log("t", own.log[:4], spark))
    assert rows(replay.replay(first, log, "s")) == rows(own.current)
    assert rows(replay.replay(middle, log, "s", after=6)) == rows(own.current)
    assert rows(replay.replay(first, log, "nobody")) == rows(first)
    with pytest.raises(KeyError):
        replay.apply_operation(first, "drop_all", "{}")


@pytest.mark.parametrize("seed", [1, 2])
def test_edits_of_all_sessions_at_once(spark, seed):
    """The joined replay equals the replay of each session alone."""
    rng = random.Random(seed)
    tables, log = [], []
    for s in ("a", "b", "c"):
        tables += [(s, "d", p, r, f"{s}{p}{r}", None) for p in (1, 2) for r in (1, 2)]
        for seq in range(1, 40):
            action = rng.choice(["edit_cell"] * 4 + ["undo", "undo", "redo", "selective_extraction"])
            given = {"page": ["d", rng.choice([1, 2])], "row_number": rng.choice([1, 2]), "column": rng.choice(["col_1", "col_2"]), "value": rng.choice([f"v{seq}", ""])}
            log.append((s, seq, action, json.dumps(given) if action == "edit_cell" else "{}"))
    frame = spark.createDataFrame(tables, f"session string, {COLUMNS.replace(', col_3 string', '')}")
    entries = spark.createDataFrame(log, "session string, seq long, action string, metadata string")
    found = replay.replay_edits(frame, entries)
    assert found.columns == frame.columns
    for s in ("a", "b", "c"):
        alone = replay.replay(frame.filter(frame.session == s).drop("session"), entries, s)
        assert rows(found.filter(found.session == s).drop("session")) == rows(alone)
    assert rows(replay.replay_edits(frame, entries.limit(0))) == rows(frame)


def test_session_survives_its_driver(spark, tmp_path):
    """Every step, then the object is forgotten and opened again: table, stacks, pending change, drafts and log."""
    made = []

    def make():
        made.append(1)
        return table(spark)

    reopen = lambda: replay.DurableSession.open(spark, str(tmp_path), "key", make, snapshot_every=2)
    plain = Session(table(spark))
    own = reopen()
    for action, given in STEPS[:5]:
        own.apply(action, **given)
        plain.apply(action, replay.OPERATORS[action], **given)
        own = reopen()
        assert rows(own.current) == rows(plain.current)
    assert own._exists("snapshots/8/_SUCCESS")
    own.undo()
    plain.undo()
    own.undo()
    plain.undo()
    own = reopen()
    assert rows(own.current) == rows(plain.current) and own.current.columns == plain.current.columns
    assert (len(own.done), len(own.undone)) == (3, 2) and len(own.history) == 3
    own.redo()
    plain.redo()
    assert rows(reopen().current) == rows(plain.current)
    own.store_draft(("d", 1), own.draft(("d", 1)).limit(1))
    own.stage("insert_row", "a row", page=("e", 2), after_row=0)
    own = reopen()
    assert own.pending["action"] == "insert_row" and rows(own.preview()) == rows(edits.insert_row(plain.current, ("e", 2), 0))
    assert own.draft(("d", 1)).count() == 1 and own.draft(("d", 2)).count() == 3
    with pytest.raises(RuntimeError):
        own.stage("insert_row", "another", page=("e", 2))
    own.reject()
    assert reopen().pending is None and reopen().draft(("d", 1)).count() == 1
    own.undo()
    own = reopen()
    assert own.drafts == {} and rows(own.original) == rows(table(spark)) and len(made) == 1
    own.undo(), own.undo(), own.undo()
    assert own.seq == reopen().seq and rows(own.current) == rows(table(spark))
    assert [r["action"] for r in own.log][:5] == [a for a, _ in STEPS[:5]] and own.log[-1]["action"] == "undo"
    log = operation_log("key", own.log, spark)
    assert rows(replay.replay(table(spark), log, "key")) == rows(own.current)


def test_two_writers(spark, tmp_path):
    """The second writer of an event is told, loses nothing of the first one's, and goes on after opening anew."""
    reopen = lambda: replay.DurableSession.open(spark, str(tmp_path), "k", lambda: table(spark))
    one, two = reopen(), reopen()
    one.apply("rename_column", column="col_1", name="first")
    with pytest.raises(replay.Conflict):
        two.apply("rename_column", column="col_1", name="second")
    two = reopen()
    assert "first" in two.current.columns
    two.apply("rename_column", column="first", name="second")
    with pytest.raises(replay.Conflict):
        one.undo()
    assert "second" in reopen().current.columns
    with pytest.raises(KeyError):
        two.stage("delete_columns", "no such column", columns=["nothing"])
    assert two.pending is None and reopen().seq == two.seq


def test_undo_and_redo_clear_drafts(spark):
    own = Session(table(spark))
    own.apply("rename_column", edits.rename_column, column="col_1", name="a")
    for step in (own.undo, own.redo):
        own.store_draft("k", ("d", 1), own.current.limit(0))
        assert own.draft("k", ("d", 1)).count() == 0
        step()
        assert own.drafts == {} and own.draft("k", ("d", 1)).count() == 3
    own.undo()
    own.store_draft("k", ("d", 1), own.current.limit(0))
    own.undo()  # nothing to undo: nothing changes
    assert own.drafts
