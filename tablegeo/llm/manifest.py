"""Merkle dataset manifest with parent-preimage paths.

A parent keeps its preimage, the concatenated digests of its children; its own digest is the hash of that.  A leaf
joins the preimages of its ancestors: cutting its own 64-character slot out of one leaves its siblings (its proof),
and putting another digest into the slot gives the preimage of a changed parent, so that changes fold up to the root.

Trees are built per group (say, per source) over leaves in a given order, runs of three children to a parent, and once
more over the subroots in order of their groups.  Leaves are numbered by range partitions, so a group of any size is
dealt over many tasks.  ``LEVELS`` levels are worked off at a time: a block of 3 ** LEVELS nodes is one row with all
preimages between them and its top, so a tree of n leaves takes log(n) / LEVELS shuffles, each 81 times smaller than
the one before, and leaves meet their blocks once.

Nulls: a null field counts as such (``-``), null groups are a tree of their own (the first), null order values come
first.  Rows that tie in the order stand by digest; equal rows are leaves of their own next to each other.  An empty
table has no root and gives no rows.  Whole texts are hashed where they are read and go no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablegeo.llm.common import discard, hidden, materialize

ARITY = 3
#: Levels of one block: its row holds up to ARITY ** LEVELS nodes.
LEVELS = 4
#: Places of ranges are broadcast up to this number of rows (some 50 MB); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Hexadecimal characters of a digest.
SLOT = 64


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def field(column: str | Column) -> Column:
    """A value with its length in bytes, so that neighbours can't run into each other; null as ``-``."""
    text = (F.col(f"`{column}`") if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: str | Column) -> Column:
    return digest(F.concat(*(field(c) for c in columns)))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Columns ``idx`` (place within ``tree``, from 0) and ``n`` (size of the tree).  ``order`` starts with what orders
    the trees; ``tie`` parts equal rows.  Rows are dealt by range, so no tree has to fit into a task."""
    ranges = df.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    own_row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(ranges.select("*", F.spark_partition_id().alias("part"), own_row.alias("at")))
    parts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(parts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")))
    joined = placed.join(_few(starts), ["tree", "part"])
    return joined.withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _height(n: Column) -> Column:
    """Levels above n leaves: the least h with ARITY ** h >= n."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**i) for i in range(40)]), lambda p: p < n))


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row for each block of nodes (tree, idx, h, height left, row): its members in order, the preimages of each
    level (``pre1`` the lowest; none above the tree's root) and the digest of its top."""
    member = F.struct("idx", "h", "row")
    block = F.floor(F.col("idx") / ARITY**LEVELS).alias("block")
    level = nodes.groupBy("tree", block).agg(F.sort_array(F.collect_list(member)).alias("members"), F.first("height").alias("height"))
    level = level.withColumn("hashes", F.col("members.h"))
    for i in range(1, LEVELS + 1):
        runs = F.sequence(F.lit(0), F.floor((F.size("hashes") - 1) / ARITY).cast("int"))
        parents = F.transform(runs, lambda j: F.array_join(F.slice("hashes", j * ARITY + 1, ARITY), ""))
        level = level.withColumn(f"pre{i}", F.when(F.col("height") >= i, parents))
        level = level.withColumn("hashes", F.when(F.col("height") >= i, F.transform(f"pre{i}", digest)).otherwise(F.col("hashes")))
    return materialize(level.withColumn("top", F.col("hashes")[0]).drop("hashes"))


def _ascend(nodes: DataFrame, n: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all tiers, from the leaves, and one node (tree, h, row) for the root of each tree."""
    tiers = []
    while True:
        blocks = _blocks(nodes)
        tiers.append(blocks)
        height = F.greatest(F.col("height") - LEVELS, F.lit(0)).alias("height")
        nodes = blocks.select("tree", F.col("block").alias("idx"), F.col("top").alias("h"), height, F.lit(None).cast("int").alias("row"))
        n = -(-n // ARITY**LEVELS)
        if n <= 1:
            return tiers, nodes


def _steps() -> Column:
    """The steps of a block's member from its parent up to the block's top: what stands left and right of its slot."""

    def step(i: int) -> Column:
        place = F.floor(F.col("place") / ARITY ** (i - 1)).cast("int")
        preimage, before = F.get(f"pre{i}", F.floor(place / ARITY).cast("int")), place % ARITY * SLOT
        return F.struct(F.substring(preimage, F.lit(1), before).alias("left"), F.substring(preimage, before + SLOT + 1, F.lit(ARITY * SLOT)).alias("right"))

    return F.slice(F.array(*(step(i) for i in range(1, LEVELS + 1))), F.lit(1), F.least("height", F.lit(LEVELS)))


def _descend(tiers: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Hand the path above each root (tree, path, more columns) down to its leaves: columns row, path, more."""
    above = roots.withColumn("block", F.lit(0).cast("long"))
    more = [c for c in roots.columns if c not in ("tree", "path")]
    for tier in reversed(tiers):
        met = tier.join(above, ["tree", "block"])
        each = met.select("*", F.posexplode("members").alias("place", "member"))
        above = each.select("tree", F.col("member.idx").alias("block"), F.col("member.row").alias("row"), F.concat(_steps(), "path").alias("path"), *more)
    return above.select("row", "path", *more)


def prove(df: DataFrame, leaf: str, tree: str, order: str) -> DataFrame:
    """``df`` with columns ``subroot``, ``root`` and ``path`` (for each level from the leaf up through the subroot to
    the root, the digests left and right of the own one): ``leaf`` names the column of leaf digests, ``tree`` the group
    and ``order`` what orders its leaves.  Columns of these three names in ``df`` are replaced."""
    own = [c for c in df.columns if c not in ("subroot", "root", "path")]
    rows = F.struct(*(F.col(f"`{c}`") for c in own)).alias("row")
    leaves = materialize(df.select(field(tree).alias("tree"), F.col(f"`{tree}`").alias("group"), F.col(f"`{order}`").alias("order"), F.col(f"`{leaf}`").alias("h"), rows, F.monotonically_increasing_id().alias("tie")))
    numbered = _numbered(leaves, ["group", "order", "h"])
    largest = numbered.agg(F.max("n")).first()[0] or 0
    discard(leaves)
    tiers, subroots = _ascend(numbered.withColumn("height", _height(F.col("n"))), largest)
    groups = numbered.filter("idx = 0").select("tree", "group")
    named = materialize(subroots.select("tree", "h").join(groups, "tree").select(F.col("tree").alias("row"), "group", "h", F.lit("").alias("tree"), F.lit(0).alias("tie")))
    forest = _numbered(named, ["group", "h"])
    top_tiers, root = _ascend(forest.withColumn("height", _height(F.col("n"))), named.count())
    empty_path = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    paths = _descend(top_tiers, root.select("tree", F.col("h").alias("root"), empty_path.alias("path")))
    roots = named.select(F.col("row").alias("tree"), F.col("h").alias("subroot")).join(paths.withColumnRenamed("row", "tree"), "tree")
    found = _descend(tiers, materialize(roots))
    return found.select(*(F.col("row").getField(c).alias(c) for c in own), "subroot", "root", "path")


def siblings(path: str | Column) -> Column:
    """The digests of a path, level by level, left to right: each ancestor's preimage without the own slot."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def fold(leaf: str | Column, path: str | Column) -> Column:
    """The root that follows if the leaf had this digest: it is put into the slot of each ancestor in turn."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def verified(docs: DataFrame, columns: list[str], tree: str, order: str, changed: dict[str, Column]) -> DataFrame:
    """The manifest of ``docs`` and its check against changed copies: columns ``order`` (by its name), ``leaf``,
    ``subroot``, ``root``, ``path`` and ``folded``, the root recomputed from the leaf whose columns are replaced by
    those of ``changed``.  Only digests leave the scan."""
    name = {c: hidden(c, docs) for c in ("leaf", "other", "tree", "order")}
    other = leaf_digest(*(changed.get(c, c) for c in columns))
    rows = docs.select(F.col(f"`{tree}`").alias(name["tree"]), F.col(f"`{order}`").alias(name["order"]), leaf_digest(*columns).alias(name["leaf"]), other.alias(name["other"]))
    found = prove(rows, name["leaf"], name["tree"], name["order"])
    return found.select(F.col(name["order"]).alias(order), F.col(name["leaf"]).alias("leaf"), "subroot", "root", "path", fold(name["other"], "path").alias("folded"))
