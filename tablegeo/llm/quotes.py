"""Chat formatting by quotation linking.

Quoted lines (``>``, nested to any level) are parsed into passages: runs of lines of one level.  A passage is
normalised (lower case, white space collapsed) and hashed, whole and by its paragraphs and lines, and so are the
units that messages could be quoted by: their whole own text, the stretches between the quotes in it, paragraphs
and lines.  Pieces are joined by hash to the messages that said them first: earlier in the same conversation if
there is one, else in another.  A passage is linked to the message that said most of it, at least half of its
characters.  The outermost passages tell which message a message replies to, the nearest conversation and the
longest match first, and conversations come out in reply order without the quotes.

For each hash only the first message of a conversation and the first of two conversations are kept before the
join, so a line that many messages share meets each quotation once.  Reply order is a walk through each tree of
replies: down and up every edge, ranked by doubling over fixed-size rows, so a chain of any length costs only a
logarithm of rounds.  Sorting by (conversation, root_turn, position) gives the order without gathering a
conversation anywhere.

Defined results: conversation and turn numbers are integers, or strings of them; a null text is the empty text;
null conversation or turn numbers are kept and never linked; rows that repeat a turn are rows of their own with
one place in the order; a passage that nobody said, or that only later messages say, is not linked and is removed
like the others; texts of any length are read whole; other columns than those four are not returned; an empty
table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegeo.llm.common import bound_batches, materialize, staged, text_bytes, values

MARK = re.compile(r"\s{0,3}((?:>\s?)+)")
PARAGRAPH = re.compile(r"\n\s*\n")
INTRODUCTION = re.compile(r"(?i)\s*(?:on\b.{0,200}|.{1,100})\b(?:wrote|writes|said)\s*:\s*")


def digest(text: str) -> bytes:
    """128-bit hash of a normalised text; empty for blank ones."""
    plain = " ".join(text.lower().split())
    return hashlib.blake2b(plain.encode(), digest_size=16).digest() if plain else b""


def parse(text: str) -> tuple[str, list[str], list[tuple[int, str]]]:
    """(own text without quotes, the stretches of it between quotes, passages as (level, text))."""
    parts, passages, run, level = [[]], [], [], 0

    def close() -> None:
        if level and any(not line.isspace() and line for line in run):
            passages.append((level, "\n".join(run)))

    for line in text.split("\n"):
        mark = MARK.match(line)
        now = mark.group(1).count(">") if mark else 0
        if now != level:
            close()
            if now and not level:
                if parts[-1] and INTRODUCTION.fullmatch(parts[-1][-1]):
                    parts[-1].pop()
                parts.append([])
            run, level = [], now
        if now:
            run.append(line[mark.end() :])
        else:
            parts[-1].append(line)
    close()
    stretches = ["\n".join(p).strip("\n") for p in parts]
    return "\n".join("\n".join(p) for p in parts if p).strip("\n"), [s for s in stretches if s], passages


def pieces(said: str) -> dict[tuple[int, bytes], int]:
    """(kind, hash) of a text's pieces, with their characters: 0 whole, 1 paragraphs, 2 lines."""
    out: dict[tuple[int, bytes], int] = {}
    for kind, parts in enumerate(([said], PARAGRAPH.split(said), said.split("\n"))):
        for part in parts:
            if key := digest(part):
                out[kind, key] = len("".join(part.split()))
    return out


def units(own: str, stretches: list[str]) -> set[bytes]:
    """Hashes of what a message can be quoted by."""
    return {key for part in (own, *stretches) for _, key in pieces(part)}


PARSED = "conv long, turn long, role string, own string, n_passages int, pieces array<struct<no:int,level:int,kind:int,hash:binary,size:int,whole:int>>, units array<binary>"


def parsed(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    kind = pa.list_(pa.struct([(n, pa.binary() if n == "hash" else pa.int32()) for n in ("no", "level", "kind", "hash", "size", "whole")]))

    def asked(passages: list[tuple[int, str]]) -> list[dict]:
        return [{"no": i, "level": level, "kind": k, "hash": key, "size": size, "whole": len("".join(said.split()))} for i, (level, said) in enumerate(passages) for (k, key), size in pieces(said).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse(v.decode("utf-8", "replace")) for v in values(batch.column(3))]
            columns = pa.array([g[0] for g in got], pa.string()), pa.array([len(g[2]) for g in got], pa.int32()), pa.array([asked(g[2]) for g in got], kind), pa.array([sorted(units(g[0], g[1])) for g in got], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["conv", "turn", "role", "own", "n_passages", "pieces", "units"])

    return df.select(F.col(conversation).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), text_bytes(text)).mapInArrow(staged("quotes", run), PARSED)


def reply_order(edges: DataFrame) -> DataFrame:
    """(conv, turn, root_turn, position, depth) of the messages that reply to one of their conversation: ``edges``
    (conv, turn, up) with up < turn.  A step is the edge to a message downwards (way 0) or back up (way 1); each knows
    its next step, and doubling adds up the steps from it to the end of its tree."""
    siblings = Window.partitionBy("conv", "up").orderBy("turn")
    first = edges.groupBy("conv", F.col("up").alias("turn")).agg(F.min("turn").alias("child"))
    known = edges.withColumn("sibling", F.lead("turn").over(siblings)).join(first, ["conv", "turn"], "left")
    above = edges.select("conv", F.col("turn").alias("up"), F.lit(True).alias("inner"))
    known = materialize(known.join(above, ["conv", "up"], "left"))
    step = lambda at, way: F.struct(at.alias("at"), F.lit(way).alias("way"))
    none = F.lit(None).cast("struct<at:bigint,way:int>")
    down = known.select("conv", "turn", F.lit(0).alias("way"), F.when(F.col("child").isNotNull(), step(F.col("child"), 0)).otherwise(step(F.col("turn"), 1)).alias("next"), F.lit(1).cast("long").alias("downs"), F.lit(1).cast("long").alias("rise"), F.lit(None).cast("long").alias("root"))
    onward = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), 0)).when(F.col("inner"), step(F.col("up"), 1)).otherwise(none)
    back = known.select("conv", "turn", F.lit(1).alias("way"), onward.alias("next"), F.lit(0).cast("long").alias("downs"), F.lit(-1).cast("long").alias("rise"), F.when(F.col("sibling").isNull() & F.col("inner").isNull(), F.col("up")).alias("root"))
    state = materialize(down.unionByName(back).select("conv", "turn", "way", F.col("next.at").alias("at"), F.col("next.way").alias("to"), "downs", "rise", "root"))
    while state.filter("at is not null").limit(1).count():
        after = state.select("conv", F.col("turn").alias("at"), F.col("way").alias("to"), F.col("at").alias("at2"), F.col("to").alias("to2"), F.col("downs").alias("downs2"), F.col("rise").alias("rise2"), F.col("root").alias("root2"))
        joined = state.join(after, ["conv", "at", "to"], "left")
        more = lambda name: (F.col(name) + F.coalesce(f"{name}2", F.lit(0))).alias(name)
        state = materialize(joined.select("conv", "turn", "way", F.col("at2").alias("at"), F.col("to2").alias("to"), more("downs"), more("rise"), F.coalesce("root2", "root").alias("root")))
    steps = state.filter("way = 0")
    total = steps.groupBy("conv", "root").agg(F.max("downs").alias("total"))
    return steps.join(total, ["conv", "root"]).select("conv", "turn", F.col("root").alias("root_turn"), (F.col("total") - F.col("downs") + 1).alias("position"), (1 - F.col("rise")).cast("int").alias("depth"))


def link_quotes(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message: conversation, turn, role, own_text, parent_conv, parent_turn, depth, root_turn,
    position (0 for the root), n_passages, n_linked; in reply order when sorted by conversation, root and position."""
    bound_batches(df.sparkSession)
    messages = materialize(parsed(df, conversation, turn, role, text))
    named = messages.filter("conv is not null and turn is not null")
    quoted = named.select("conv", "turn", F.explode("pieces").alias("p")).select("conv", "turn", "p.*").distinct()
    quoted = materialize(quoted)
    wanted = quoted.select("hash").distinct()
    said = named.select("conv", "turn", F.explode("units").alias("hash")).join(wanted, "hash", "left_semi")
    inside = materialize(said.groupBy("hash", "conv").agg(F.min("turn").alias("own_turn")))
    one = inside.groupBy("hash").agg(F.min(F.struct("conv", F.col("own_turn").alias("turn"))).alias("one"))
    two = inside.join(one, "hash").filter("conv <> one.conv").groupBy("hash").agg(F.min(F.struct("conv", F.col("own_turn").alias("turn"))).alias("two"))
    found = quoted.join(inside, ["hash", "conv"], "left").join(one.join(two, "hash", "left"), "hash", "left")
    own = F.when(F.col("own_turn") < F.col("turn"), F.struct("conv", F.col("own_turn").alias("turn")))
    other = F.when(F.col("one.conv") != F.col("conv"), F.col("one")).otherwise(F.col("two"))
    met = found.select("conv", "turn", "no", "level", "kind", "size", "whole", F.coalesce(own, other).alias("source")).filter("source is not null")
    lengths = met.groupBy("conv", "turn", "no", "level", "whole", "source", "kind").agg(F.sum("size").alias("size")).groupBy("conv", "turn", "no", "level", "whole", "source").agg(F.max("size").alias("size")).filter("2 * size >= whole")
    near = (F.col("source.conv") == F.col("conv")).alias("near")
    links = materialize(lengths.groupBy("conv", "turn", "no", "level").agg(F.max(F.struct(near, "size", F.col("source.turn").alias("late"), F.col("source.conv").alias("c"), "source")).alias("m")).select("conv", "turn", "level", "m.source", "m.size"))
    votes = links.groupBy("conv", "turn", "level", "source").agg(F.sum("size").alias("size"))
    best = votes.groupBy("conv", "turn").agg(F.max_by("source", F.struct((-F.col("level")).alias("outer"), near, "size", F.col("source.turn").alias("late"), F.col("source.conv").alias("c"))).alias("source"))
    counts = links.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_linked"))
    replies = materialize(best.filter("source.conv = conv").select("conv", "turn", F.col("source.turn").alias("up")))
    placed = best.join(counts, ["conv", "turn"]).join(reply_order(replies), ["conv", "turn"], "left")
    out = messages.join(placed, ["conv", "turn"], "left")
    return out.select(F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), F.col("own").alias("own_text"), F.col("source.conv").alias("parent_conv"), F.col("source.turn").alias("parent_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("position", F.lit(0).cast("long")).alias("position"), "n_passages", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"))


def in_reply_order(linked: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The rows of ``link_quotes`` sorted into conversations, over as many partitions as it takes."""
    return linked.orderBy(conversation, "root_turn", "position")
