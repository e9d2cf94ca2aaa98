"""Statistics of pixels per cell, as plain partial and final aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError
from gridloom.functions.grid import unsigned_order

CONTINUOUS = ("mean", "sum", "count", "min", "max", "var", "sd")
CATEGORICAL = ("majority", "fractions")
STATS = (*CONTINUOUS, *CATEGORICAL, "npix")


def check_stats(stats: str | Sequence[str]) -> list[str]:
    out = [stats] if isinstance(stats, str) else list(stats)
    if not out or len(set(out)) != len(out) or any(s not in STATS for s in out):
        raise ArgumentError(f"stat must be distinct names among {', '.join(STATS)}")
    if "fractions" in out and len(out) > 1:
        raise ArgumentError("fractions cannot be combined with other statistics")
    return out


def weighted(value: Column, weight: Column | None, stat: str, centre: Column | None = None) -> Column:
    """One statistic of a value over a group. Nulls are skipped; a weight counts how much of a pixel lies in the cell.

    sum and count of nothing are 0, the others null. var takes weights as frequencies; centre, a value near the band's, keeps its digits
    where values are large and differ little (see with_centres).
    """
    v = value.cast("double")
    if weight is None:
        plain = {
            "mean": F.avg(v), "sum": F.coalesce(F.sum(v), F.lit(0.0)), "count": F.count(v).cast("double"), "min": F.min(v), "max": F.max(v),
            "var": F.var_samp(v), "sd": F.stddev_samp(v),
        }
        return plain[stat]
    w = F.when(v.isNotNull() & (weight > 0), weight)
    total = F.sum(w)
    if stat == "mean":
        return F.sum(w * v) / total
    if stat == "sum":
        return F.coalesce(F.sum(w * v), F.lit(0.0))
    if stat == "count":
        return F.coalesce(total, F.lit(0.0))
    if stat in ("min", "max"):
        return (F.min if stat == "min" else F.max)(F.when(w.isNotNull(), v))
    if centre is not None:
        v = v - centre
    moment = F.sum(w * v * v) - F.sum(w * v) * F.sum(w * v) / total
    var = F.when(total > 1, F.greatest(F.lit(0.0), moment) / (total - 1))
    return F.sqrt(var) if stat == "sd" else var


def with_centres(pixels: DataFrame, bands: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """pixels beside the mean of each band over all of them (one broadcast row), and those columns by band.

    Spark's own moments are merged without loss, but take no weights; weighted squares are summed about this mean instead.
    """
    names = {b: f"_centre_{i}" for i, b in enumerate(bands)}
    means = pixels.agg(*[F.avg(F.col(b).cast("double")).alias(n) for b, n in names.items()])
    return pixels.crossJoin(F.broadcast(means)), {b: F.col(n) for b, n in names.items()}


def output_name(band: str, stat: str, stats: Sequence[str]) -> str:
    """A band's column keeps its name if npix is the only other statistic."""
    return band if sum(s != "npix" for s in stats) == 1 else f"{band}_{stat}"


def summarise(pixels: DataFrame, bands: Sequence[str], stats: str | Sequence[str] = "mean", weight: str | None = None, keys: Sequence[str] = ("cell",), as_vector: bool = False, value_type: str = "double") -> DataFrame:
    """One row per cell in which some pixel has a valid band: a column per band and statistic, in order of statistics, npix last."""
    stats = check_stats(stats)
    w = F.col(weight) if weight else None
    some = F.coalesce(*[F.col(b).cast("double") for b in bands]).isNotNull()
    valid = pixels.where(some) if w is None else pixels.where(some & (w > 0))
    plain = [s for s in stats if s in CONTINUOUS]
    centres: dict[str, Column] = {}
    if w is not None and {"var", "sd"} & set(plain):
        valid, centres = with_centres(valid, bands)
    aggregates = [weighted(F.col(b), w, s, centres.get(b)).alias(output_name(b, s, stats)) for s in plain for b in bands]
    if "npix" in stats:
        aggregates.append((F.count(F.lit(1)).cast("double") if w is None else F.sum(w)).alias("npix"))
    out = valid.groupBy(*keys).agg(*aggregates) if aggregates else None
    for kind in ("majority", "fractions"):
        if kind in stats:
            shares = class_weights(valid, bands, w, keys)
            table = majority(shares, bands, keys, stats) if kind == "majority" else fractions(shares, bands, keys)
            if out is None:
                cells = valid.select(*keys).distinct()
                out = cells.join(table, list(keys), "left")
            else:
                out = out.join(table, list(keys), "left")
    order = [output_name(b, s, stats) for s in stats if s != "npix" for b in bands] + ["npix"] * ("npix" in stats)
    out = out.select(*keys, *order)
    if as_vector:
        return pack_vectors(out, bands, stats, keys, value_type)
    return out if value_type == "double" else out.select(*keys, *[F.col(c).cast(value_type).alias(c) for c in order])


def pack_vectors(table: DataFrame, bands: Sequence[str], stats: Sequence[str], keys: Sequence[str] = ("cell",), value_type: str = "double") -> DataFrame:
    """Bands of each statistic as one array: value, or value_<stat> with several."""
    if "fractions" in stats:
        raise ArgumentError("fractions cannot be packed into vectors")
    named = [s for s in stats if s != "npix"]
    arrays = [F.array(*[F.col(output_name(b, s, stats)).cast(value_type) for b in bands]).alias("value" if len(named) == 1 else f"value_{s}") for s in named]
    return table.select(*keys, *arrays, *(["npix"] if "npix" in stats else []))


def class_weights(pixels: DataFrame, bands: Sequence[str], weight: Column | None, keys: Sequence[str]) -> DataFrame:
    """keys, band, cls, w: weight of each class of each band in each cell."""
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("int").alias("cls")) for b in bands]))
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = pixels.select(*keys, w.alias("_w"), pairs.alias("_x")).select(*keys, "_w", "_x.band", "_x.cls").where("cls IS NOT NULL AND _w > 0")
    return rows.groupBy(*keys, "band", "cls").agg(F.sum("_w").alias("w"))


def majority(shares: DataFrame, bands: Sequence[str], keys: Sequence[str], stats: Sequence[str] = ("majority",)) -> DataFrame:
    """The class of greatest weight in each cell; the smallest one on ties."""
    best = [F.max_by(F.when(F.col("band") == b, F.col("cls")), F.when(F.col("band") == b, F.struct("w", -F.col("cls")))).cast("double").alias(output_name(b, "majority", stats)) for b in bands]
    return shares.groupBy(*keys).agg(*best)


def fractions(shares: DataFrame, bands: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per band a map from class to its share of the cell's valid weight, classes ascending."""
    def shares_of(band: str) -> Column:
        mine = F.sort_array(F.collect_list(F.when(F.col("band") == band, F.struct("cls", "w"))))
        total = F.sum(F.when(F.col("band") == band, F.col("w")))
        return F.map_from_entries(F.transform(mine, lambda x: F.struct(x["cls"], x["w"] / total)))

    return shares.groupBy(*keys).agg(*[shares_of(b).alias(b) for b in bands])


def by_cell(table: DataFrame) -> DataFrame:
    """Rows in unsigned order of cell ids."""
    return table.orderBy(unsigned_order(F.col("cell")))
