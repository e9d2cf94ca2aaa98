"""Connected components of a link table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import lookup_join, materialize

ROUNDS = 60


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step on links (hi, lo). Hubs are spread by salts, and a node's smallest neighbour is a partial aggregate."""
    if large:
        seen = links.select(F.explode(F.array(F.struct(F.col("hi").alias("v"), F.col("lo").alias("u")), F.struct(F.col("lo").alias("v"), F.col("hi").alias("u")))).alias("x")).select("x.*")
    else:
        seen = links.select(F.col("hi").alias("v"), F.col("lo").alias("u"))
    least = seen.groupBy("v").agg(F.least(F.min("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = lookup_join(seen, least, "v", "n", F.col("u"), total=total)
    if large:
        out = joined.where("u > v").select(F.col("u").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("hi"), F.col("m").alias("lo"))
    return materialize(out.where("hi > lo").distinct(), "star")


def _settled(stars: DataFrame) -> bool:
    """Whether every node either points at one node or is pointed at, but not both."""
    sides = stars.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("out")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("out")))).alias("x")).select("x.*")
    return sides.groupBy("node").agg(F.sum("out").alias("s"), F.min("out").alias("low")).where("s > 1 OR (s = 1 AND low = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links (a, b); roots point at themselves."""
    stars = materialize(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), "links")
    for _ in range(ROUNDS):
        if _settled(stars):
            break
        stars = _star(stars, True, 2 * stars.count())
        stars = _star(stars, False, stars.count())
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("root")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("root")))).alias("x")).select("x.*").distinct()
