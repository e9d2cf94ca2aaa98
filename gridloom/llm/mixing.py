"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source gets a target share of the mixed corpus. A document's expected number of copies is
``rate = share * size of the mix / rows of its source``; its actual number is drawn from a Poisson
distribution of that mean by inverting the distribution function at a uniform value hashed from
(seed, doc_id). The draw depends on nothing else, so it repeats exactly on retries and any layout.

Defined cases: a null source is a source of its own; a null doc_id hashes as the empty string; rows
that share a doc_id and a source get the same count; an empty table gives an empty result; columns
of the caller whose names clash with added ones are refused with an error; empty and long texts
are carried whole. Sources without a given weight get weight 0, and so no copies;
if no source has weight the result is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import new_name, shuffle_width

SEED = "mix-1"
TEMPERATURE = 0.7
ADDED = ("copy", "mix_rate", "mix_key")
#: Rows up to which the per-source table is broadcast; a longer one is joined by shuffle with AQE's skew handling.
BROADCAST_SOURCES = 10_000


def uniform(key: Column, seed: str) -> Column:
    """Uniform value in [0, 1) from 32 bits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: Rate up to which a distribution function starts from 0; exp(-rate) is far from the least double there.
FROM_ZERO = 400


def poisson_first(rate: Column) -> Column:
    """Count that poisson_cdf starts from; what lies below it is less than 2^-32."""
    return F.when(rate > FROM_ZERO, F.floor(rate - 8 * F.sqrt(rate) - 16)).otherwise(0).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """Array of P(X <= n) for n from poisson_first far enough that the rest is below 2^-32."""
    first, last = poisson_first(rate), F.ceil(rate + 8 * F.sqrt(rate) + 16).cast("int")
    # The first term of a large rate is by Stirling's series, without differences of large logarithms.
    k = F.greatest(first, F.lit(1)).cast("double")
    large = F.exp(k * F.log1p((rate - k) / k) - (rate - k) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k))
    p0 = F.when(rate > FROM_ZERO, large).otherwise(F.exp(-rate))
    start = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("all"))

    def step(acc, n):
        p = acc["p"] * rate / n
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(first + 1, last), start, step, lambda acc: acc["all"])


def source_rates(docs: DataFrame, weights: dict | None = None, size: float = 1.0) -> DataFrame:
    """One row per source: its target repetition rate and the distribution function to invert.

    weights maps source to target weight; without it the weight is rows ** TEMPERATURE, the usual
    flattening of a skewed mix. size is the size of the mix as a multiple of the input's rows.
    """
    counts = docs.select("source").groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weight = F.pow(F.col("_n").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighted = counts.withColumn("_w", weight)
    totals = weighted.agg(F.sum("_w").alias("_tw"), F.sum("_n").alias("_tn"))
    rate = F.try_divide("_w", "_tw") * F.col("_tn") * F.lit(float(size)) / F.col("_n")
    rated = weighted.join(F.broadcast(totals)).select(F.col("source").alias("_source"), F.coalesce(rate, F.lit(0.0)).alias("mix_rate"))
    return rated.withColumn("_first", poisson_first(F.col("mix_rate"))).withColumn("_cdf", poisson_cdf(F.col("mix_rate")))


def mix(docs: DataFrame, weights: dict | None = None, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs, each row repeated by its Poisson count, in a global random order.

    Adds copy (0, 1, ...), mix_rate and mix_key, a hash by which the rows are dealt out and
    sorted. The hot source costs nothing here: the per-source table is tiny and its row count is checked
    before it is broadcast, and rows are dealt out by hash of document and copy.
    """
    if clash := [c for c in ADDED if c in docs.columns]:
        raise ValueError(f"columns {clash} are already there")
    source, first, cdf, n = (new_name(docs.columns, c) for c in ("_source", "_first", "_cdf", "_n"))
    rates = source_rates(docs, weights, size).withColumnsRenamed({"_source": source, "_first": first, "_cdf": cdf})
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col(source)))
    drawn = F.col(first) + F.size(F.filter(cdf, lambda c: c <= uniform(F.col("doc_id"), seed)))
    copies = joined.withColumn(n, drawn).where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    key = F.md5(F.concat(F.lit(seed + ":order:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("copy").cast("string")))
    keyed = copies.drop(source, first, cdf, n).withColumn("mix_key", key)
    return shuffled(keyed).select(*docs.columns, *ADDED)


def shuffled(keyed: DataFrame) -> DataFrame:
    """Global shuffle without a sampling pass: the key is random, so its hash deals rows evenly, and sorting orders them at random within."""
    return keyed.repartition(shuffle_width(keyed.sparkSession), "mix_key").sortWithinPartitions("mix_key")
