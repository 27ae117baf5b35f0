"""Mixing sources to target weights by Poisson replication.

Each source's mean repetition rate is its share of the wanted total over its rows.  A row's number of copies
is a Poisson number with that mean, found by inverting the distribution at a uniform number that is a hash
of the row's id and the seed; so it does not depend on partitions, order or retries.  Rows are exploded by
that number and dealt to partitions, and ordered inside them, by a hash of id, copy and seed: a global
shuffle.  Only built-in functions are used.  The distributions of the sources, whose size is counted first,
are broadcast up to ``BROADCAST`` numbers, so that no row moves before the global shuffle; beyond, rows and
distributions are joined by source and one of ``SALTS`` salts, so that a hot source is split.

Defined results: a null source is a source of its own; a source without a given weight gets weight
``default``; weight 0 or an empty table gives no rows; rows that repeat an id get the same number of copies;
null ids and texts are kept as they are.  The columns added are ``copy`` (from 1), replaced if it exists; all
other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegeo.llm.common import hidden, materialize

#: Numbers of all distributions together (8 bytes each) that are broadcast, and salts of a source beyond.
BROADCAST, SALTS = 1_000_000, 64


def uniform(key: Column, seed: int, salt: str = "") -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 hash."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{salt}{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: Largest mean whose distribution is built up from P(0), which is still a normal number there.
SMALL = 700.0


def running(first: Column, ks: Column, factor) -> Column:
    """The array of the products of ``first`` and factor(k) over ks, without ``first``."""
    zero = F.struct(first.alias("p"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * factor(k)
        return F.struct(p.alias("p"), F.concat(acc["out"], F.array(p)).alias("out"))

    return F.aggregate(ks, zero, step, lambda acc: acc["out"])


def large_cdf(rate: Column) -> Column:
    """P(X <= k) from weights relative to the mode's, normalised by their sum; 0 further below than 12 deviations."""
    mode, spread = F.floor(rate).cast("int"), F.ceil(12 * F.sqrt(rate) + 30).cast("int")
    below = running(F.lit(1.0), F.sequence(mode, mode - spread + 1, F.lit(-1)), lambda k: k / rate)
    above = running(F.lit(1.0), F.sequence(mode + 1, mode + spread), lambda k: rate / k)
    weights = F.concat(F.reverse(below), F.array(F.lit(1.0)), above)
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["sum"] + p).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + p)).alias("out"))

    scaled = F.aggregate(weights, zero, step, lambda acc: F.transform(acc["out"], lambda c: c / acc["sum"]))
    return F.concat(F.array_repeat(F.lit(0.0), mode - spread), scaled)


def small_cdf(rate: Column) -> Column:
    """P(X <= k) by adding up from P(0)."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + p)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda acc: acc["out"])


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k from 0 to far in the tail, as an array; one is made for each source, not each row."""
    return F.when(rate > SMALL, large_cdf(F.greatest(rate, F.lit(SMALL)))).otherwise(small_cdf(F.least(rate, F.lit(SMALL))))


def source_rates(df: DataFrame, source: str, weights: dict | None = None, total: int | None = None, default: float = 1.0) -> DataFrame:
    """(_source, rate): mean copies of a row of each source."""
    counts = df.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(default))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("w", weight)
    sums = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))  # one row
    wanted = F.col("all_n") if total is None else F.lit(total)
    rate = F.when(F.col("all_w") > 0, wanted * F.col("w") / F.col("all_w") / F.col("n")).otherwise(0.0)
    return weighed.join(F.broadcast(sums)).select("_source", rate.cast("double").alias("rate"))


def mix(df: DataFrame, id_column: str = "doc_id", source: str = "source", weights: dict | None = None, total: int | None = None, seed: int = 7, default: float = 1.0, broadcast: int = BROADCAST) -> DataFrame:
    """The mixed and shuffled rows with column ``copy``."""
    df = df.drop("copy")
    own, cdf, salt, times = (hidden(n, df) for n in ("source", "cdf", "salt", "times"))
    rates = materialize(source_rates(df, source, weights, total, default))
    numbers = rates.agg(F.sum(F.col("rate") + 12 * F.sqrt("rate") + 32)).first()[0] or 0.0
    held = rates.select(F.col("_source").alias(own), poisson_cdf(F.col("rate")).alias(cdf))
    if numbers <= broadcast:
        rated = df.join(F.broadcast(held), F.col(source).eqNullSafe(F.col(own)))
    else:
        split = held.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = df.withColumn(salt + "_", F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int"))
        rated = salted.join(split, F.col(source).eqNullSafe(F.col(own)) & (F.col(salt + "_") == F.col(salt)))
    u = uniform(F.col(id_column), seed)
    drawn = rated.withColumn(times, F.size(F.filter(cdf, lambda c: c <= u))).filter(F.col(times) > 0)
    copies = drawn.select(*(F.col(f"`{c}`") for c in df.columns), F.explode(F.sequence(F.lit(1), F.col(times))).alias("copy"))
    place = F.xxhash64(F.col(id_column), F.col("copy"), F.lit(seed))
    return copies.repartition(place).sortWithinPartitions(place)
