"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by the Unicode property, and the separators U+001C to U+001F that go with it.
WHITE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"

#: The same, one by one.
WHITE_CHARACTERS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip_ws(c: Column) -> Column:
    """The text without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def text_of(c: Column) -> Column:
    """A cell as text: null counts as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def join_nonblank(parts: Column) -> Column:
    """Non-blank parts as they are, joined by a space; the whole is stripped."""
    return strip_ws(F.array_join(F.filter(parts, lambda p: strip_ws(p) != ""), " "))


def join_stripped(parts: Column) -> Column:
    """Stripped non-blank parts, joined by a space."""
    return F.array_join(F.filter(F.transform(parts, lambda p: strip_ws(text_of(p))), lambda p: p != ""), " ")


def partition(c: Column, delimiter: str) -> tuple[Column, Column, Column]:
    """(found?, left, right) at the first literal occurrence of the delimiter."""
    at = F.locate(delimiter, c)
    left = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    right = F.when(at > 0, F.substring(c, at + len(delimiter), F.length(c))).otherwise(F.lit(""))
    return at > 0, left, right


def escape_html(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c
