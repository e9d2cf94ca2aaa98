"""Several sources in one result: pooled, side by side, or reduced per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError
from gridloom.operators.stats import class_weights, summarise, weighted, with_centres

REDUCERS = ("mean", "median", "min", "max", "sum", "count", "var", "sd", "majority")


def separate(pixels: DataFrame, bands: Sequence[str], stat: str, labels: Sequence[str], source: str = "src", weight: str | None = None) -> DataFrame:
    """One row per cell with a column <label>_<band> for each source, from a single aggregation."""
    if len(set(labels)) != len(labels):
        raise ArgumentError("source labels must be distinct")
    return separate_columns(pixels, [(name, b, f"{name}_{b}") for name in labels for b in bands], stat, source, weight)


def separate_columns(pixels: DataFrame, columns: Sequence[tuple[str, str, str]], stat: str, source: str = "src", weight: str | None = None) -> DataFrame:
    """One row per cell with a column for each (label, column of pixels, output name). Cells in which none has a value are left out."""
    w = F.col(weight) if weight else None
    label = F.col(source).cast("string")
    of = {name: F.when(label == one, F.col(column).cast("double")) for one, column, name in columns}
    valid, centres = pixels.where(F.coalesce(*of.values()).isNotNull()), {}
    if w is not None and stat in ("var", "sd"):
        valid, by_column = with_centres(valid, sorted({c for _, c, _ in columns}))
        centres = {name: by_column[column] for _, column, name in columns}
    return valid.groupBy("cell").agg(*[weighted(v, w, stat, centres.get(name)).alias(name) for name, v in of.items()])


def per_source(pixels: DataFrame, band: str, stat: str, source: str = "src", weight: str | None = None) -> DataFrame:
    """cell, source, v, w: the statistic of each source in each cell and the weight it enters a composite with."""
    keys = ("cell", source)
    if stat == "majority":
        shares = class_weights(pixels, [band], F.col(weight) if weight else None, keys)
        best = F.max(F.struct(F.col("w"), -F.col("cls")))
        return shares.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.col2")).cast("double").alias("v"), F.col("b.w").alias("w"))
    v = summarise(pixels, [band], [stat, "count"] if stat != "count" else ["count"], weight, keys)
    value = F.col(f"{band}_{stat}") if stat != "count" else F.col(band)
    return v.select(*keys, value.alias("v"), (F.col(f"{band}_count") if stat != "count" else F.col(band)).alias("w"))


def reduce_sources(values: DataFrame, reducer: str, name: str = "value") -> DataFrame:
    """cell and the reduced value of (v, w) rows with a finite v and positive weight; a cell of none gets null, or 0 for sum and count."""
    if reducer not in REDUCERS:
        raise ArgumentError(f"composite must be one of {', '.join(REDUCERS)}")
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")) & (F.col("w") > 0)
    rows = values.withColumn("v", F.when(finite, F.col("v"))).withColumn("w", F.when(finite, F.col("w")))
    if reducer == "median":
        return weighted_median(rows, name)
    if reducer == "majority":
        totals = rows.groupBy("cell", "v").agg(F.sum("w").alias("w"))
        best = F.max(F.when(F.col("v").isNotNull(), F.struct(F.col("w").alias("w"), (-F.col("v")).alias("neg"))))
        return totals.groupBy("cell").agg((-best["neg"]).alias(name))
    return rows.groupBy("cell").agg(reduced(F.col("v"), F.col("w"), reducer).alias(name))


def reduced(v: Column, w: Column, reducer: str) -> Column:
    """Aggregate expression; var and sd take weights as reliabilities."""
    total = F.sum(w)
    if reducer == "mean":
        return F.sum(w * v) / total
    if reducer in ("min", "max"):
        return (F.min if reducer == "min" else F.max)(v)
    if reducer == "sum":
        return F.coalesce(F.sum(v), F.lit(0.0))
    if reducer == "count":
        return F.count(v).cast("double")
    # A cell has one row per source, so its values are gathered; squares are summed about the least one, which keeps digits where values differ little.
    low = F.min(F.when(w.isNotNull(), v))
    each = F.collect_list(F.when(v.isNotNull() & w.isNotNull(), F.struct(v.alias("v"), w.alias("w"))))
    about = lambda power: F.aggregate(each, F.lit(0.0), lambda total, x: total + x["w"] * F.pow(x["v"] - low, F.lit(power)))
    spread = F.greatest(F.lit(0.0), about(2.0) - about(1.0) * about(1.0) / total)
    var = F.when(F.count(v) >= 2, spread / (total - F.sum(w * w) / total))
    return F.sqrt(var) if reducer == "sd" else var


def weighted_median(rows: DataFrame, name: str) -> DataFrame:
    """First value whose running weight reaches half of the total; the mean with the next value where it meets half exactly."""
    order = Window.partitionBy("cell").orderBy("v")
    found = rows.where("v IS NOT NULL").withColumn("upto", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("half", F.sum("w").over(Window.partitionBy("cell")) / 2).withColumn("next", F.lead("v").over(order))
    slack = F.lit(1e-12) * F.greatest(F.col("half"), F.lit(1.0))
    value = F.when((F.abs(F.col("upto") - F.col("half")) <= slack) & F.col("next").isNotNull(), (F.col("v") + F.col("next")) / 2).otherwise(F.col("v"))
    medians = found.where(F.col("upto") >= F.col("half") - slack).groupBy("cell").agg(F.min_by(value, F.struct("upto", "v")).alias(name))
    return rows.select("cell").distinct().join(medians, "cell", "left")


def composite(pixels: DataFrame, band: str, stat: str, reducer: str, source: str = "src", weight: str | None = None) -> DataFrame:
    """A statistic per source and cell, then the reducer over the sources of each cell."""
    return reduce_sources(per_source(pixels, band, stat, source, weight), reducer, band)


def merge_chunks(parts: Sequence[DataFrame], sums: Sequence[str], keys: Sequence[str] = ("cell",)) -> DataFrame:
    """Partial results of disjoint chunks added up."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
