"""The store of parses: hits, misses, versions, pages, calls cut short and calls side by side."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablegeo.plans.parsed import ParseStore, with_entry, working_folder
from tests.conftest import rows

REQUESTS = "doc_key string, version string, pages array<int>"


@pytest.fixture
def store(spark, tmp_path):
    return ParseStore(spark, str(tmp_path / "store"))


def ask(spark, *wanted):
    return spark.createDataFrame(list(wanted), REQUESTS)


class Parser:
    """Gives each request two rows, but documents named ``empty`` none, and keeps what it was asked for."""

    def __init__(self):
        self.calls = []

    def __call__(self, asked):
        self.calls.append(sorted((r.doc_key, r.version, tuple(r.pages or ())) for r in asked.collect()))
        return asked.filter("doc_key <> 'empty'").select("entry", "doc_key", "version", F.explode(F.array(F.lit(1), F.lit(2))).alias("row_number"))


def test_only_the_missing_is_parsed(spark, store):
    parse = Parser()
    first = store.parsed(ask(spark, ("a", "v1", None), ("b", "v1", None), ("a", "v1", []), ("empty", "v1", None)), parse)
    assert sorted((r.doc_key, r.row_number, r.reused) for r in first.collect()) == [("a", 1, False), ("a", 2, False), ("b", 1, False), ("b", 2, False)]
    again = store.parsed(ask(spark, ("b", "v1", None), ("b", "v2", None), ("b", "v1", [1]), ("empty", "v1", None), ("c", None, None), (None, "v1", None)), parse)
    assert sorted((r.doc_key, r.version, r.row_number, r.reused) for r in again.collect()) == [
        ("b", "v1", 1, False), ("b", "v1", 1, True), ("b", "v1", 2, False), ("b", "v1", 2, True), ("b", "v2", 1, False), ("b", "v2", 2, False), ("c", "", 1, False), ("c", "", 2, False)]
    assert parse.calls == [[("a", "v1", ()), ("b", "v1", ()), ("empty", "v1", ())], [("b", "v1", (1,)), ("b", "v2", ()), ("c", "", ())]]
    assert len(store.batches()) == 2


def test_nothing_missing_parses_nothing(spark, store):
    parse = Parser()
    asked = ask(spark, ("a", "v1", None))
    assert rows(store.parsed(asked, parse).drop("reused")) == rows(store.parsed(asked, parse).drop("reused"))
    assert len(parse.calls) == 1 and len(store.batches()) == 1
    assert store.parsed(ask(spark), parse).count() == 0
    assert ParseStore(spark, store.folder + "-new").parsed(ask(spark), parse).count() == 0


def test_a_call_cut_short_is_not_read(spark, store):
    def broken(asked):
        return Parser()(asked).withColumn("row_number", F.raise_error(F.lit("no")).cast("int"))

    asked = ask(spark, ("a", "v1", None))
    with pytest.raises(Exception, match="no"):
        store.parsed(asked, broken)
    assert store.batches() == [] and store.missing(asked).count() == 1
    assert store.parsed(asked, Parser()).count() == 2


def test_calls_side_by_side(spark, store):
    asked = ask(spark, ("a", "v1", None), ("b", "v1", None))
    other = ParseStore(spark, store.folder)

    def slow(wanted):
        other.parsed(ask(spark, ("a", "v1", None)), Parser())
        return Parser()(wanted)

    assert sorted((r.doc_key, r.row_number) for r in store.parsed(asked, slow).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert len(store.batches()) == 2 and store.stored(asked).count() == 4


def test_newer_versions_may_have_more_columns(spark, store):
    store.parsed(ask(spark, ("a", "v1", None)), Parser())
    both = store.parsed(ask(spark, ("a", "v1", None), ("a", "v2", None)), lambda asked: Parser()(asked).withColumn("more", F.lit(1)))
    assert sorted((r.version, r.more) for r in both.collect()) == [("v1", None), ("v1", None), ("v2", 1), ("v2", 1)]


def test_entries_are_the_states_of_documents(spark):
    named = with_entry(ask(spark, ("a", "v1", None), ("a", "v1", []), ("a", "v1", [1]), ("a", "v1", [1, 2]), ("a", "v2", None)))
    assert named.select("entry").distinct().count() == 4


def test_working_folders_are_shared_and_new(spark):
    assert working_folder(spark) != working_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert working_folder(spark).startswith(named)
