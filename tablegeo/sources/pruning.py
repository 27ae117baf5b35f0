"""Filters on document and page that data sources take over from Spark, and files they read."""

from __future__ import annotations

import os
from collections.abc import Iterable
from typing import Any, BinaryIO

from pyspark.sql.datasource import EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

_LOW = {EqualTo: 0, EqualNullSafe: 0, GreaterThan: 1, GreaterThanOrEqual: 0}
_HIGH = {EqualTo: 0, EqualNullSafe: 0, LessThan: -1, LessThanOrEqual: 0}


class Pruned:
    """The documents and pages that are left by some filters (all must hold)."""

    def __init__(self) -> None:
        self.low: int | None = None
        self.high: int | None = None
        self.pages: set[int] | None = None
        self.keys: set[str] | None = None

    def take(self, filters: Iterable[Filter]) -> Iterable[Filter]:
        """Takes over what it can tell and gives the others back."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("page_number",) and value is not None and type(f) in {*_LOW, *_HIGH}:
                if type(f) in _LOW:
                    bound = value + _LOW[type(f)]
                    self.low = bound if self.low is None else max(self.low, bound)
                if type(f) in _HIGH:
                    bound = value + _HIGH[type(f)]
                    self.high = bound if self.high is None else min(self.high, bound)
            elif name == ("page_number",) and isinstance(f, In):
                self.only(value)
            elif name == ("doc_key",) and value is not None and isinstance(f, (EqualTo, EqualNullSafe, In)):
                own = set(value) if isinstance(f, In) else {value}
                self.keys = own if self.keys is None else self.keys & own
            elif not (isinstance(f, IsNotNull) and name in (("page_number",), ("doc_key",))):  # neither is ever null
                yield f

    def only(self, pages: Iterable[int]) -> None:
        self.pages = set(pages) if self.pages is None else self.pages & set(pages)

    def has_document(self, key: str) -> bool:
        return self.keys is None or key in self.keys

    def has_page(self, page: int) -> bool:
        return (self.low is None or page >= self.low) and (self.high is None or page <= self.high) and (self.pages is None or page in self.pages)


def listed(options: dict[str, str]) -> list[str]:
    """The files of a source's options ``paths`` (a comma list) or ``path``."""
    return [p for p in options.get("paths", options.get("path", "")).split(",") if p]


def task_bytes(options: dict[str, str], default: int) -> int:
    return max(1, int(options.get("bytespertask", options.get("bytesPerTask", default))))


def _store(path: str) -> tuple[Any, str]:
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def open_file(path: str) -> BinaryIO:
    """A file for reading: a plain path on a mount, or an address of a store that Arrow reaches."""
    if "://" in path:
        store, name = _store(path)
        return store.open_input_file(name)
    return open(path, "rb")


def size_of(path: str) -> int:
    if "://" in path:
        store, name = _store(path)
        return store.get_file_info(name).size or 0
    return os.path.getsize(path)
