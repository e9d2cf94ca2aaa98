"""Coarsening of results: cells grouped by the coarser cell that contains them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import ArgumentError, ResolutionError
from gridloom.functions.grid import cell_parent, cell_resolution, check_resolution
from gridloom.operators.stats import by_cell

STATS = ("mean", "sum", "count", "min", "max", "var", "sd")


def is_aggregable(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType) or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType))


def select_columns(table: DataFrame, columns: None | str | Sequence[str] | Callable[[str], bool] | re.Pattern, leave: set[str]) -> list[str]:
    """Names, a predicate or a pattern of names; by default every numeric column and every column of numeric arrays."""
    usable = {f.name: f.dataType for f in table.schema.fields if f.name not in leave}
    if columns is None:
        return [c for c, k in usable.items() if is_aggregable(k)]
    if isinstance(columns, re.Pattern):
        picked = [c for c in usable if columns.search(c)]
    elif callable(columns):
        picked = [c for c in usable if columns(c)]
    else:
        picked = [columns] if isinstance(columns, str) else list(columns)
    for c in picked:
        if c not in usable or not is_aggregable(usable[c]):
            raise ArgumentError(f"{c!r} is not a numeric column")
    return picked


def grouped(v: Column, w: Column | None, stat: str) -> Column:
    """One statistic; mean takes weights, sum and count skip nulls, var and sd ignore weights."""
    v = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
    if stat == "mean" and w is not None:
        total = F.sum(F.when(v.isNotNull(), w))
        return F.when(total != 0, F.sum(w * v) / total)
    plain = {"mean": F.avg, "min": F.min, "max": F.max, "var": F.var_samp, "sd": F.stddev_samp}
    if stat == "sum":
        return F.coalesce(F.sum(v), F.lit(0.0))
    return F.count(v).cast("double") if stat == "count" else plain[stat](v)


def aggregate(table: DataFrame, resolution: int, columns=None, stat: str = "mean", weights: str | None = None, vector_length: int | None = None, sort: bool = True, resolution_in: int | None = None) -> DataFrame:
    """table (with a cell column of one resolution) reduced to cells of a coarser resolution.

    weights names a column, by default npix where there is one; it and npix are always summed. Null weights count as 0. Array
    columns are reduced element by element; their length is vector_length, or that of the first row. The input's resolution is
    read from one row unless resolution_in says it.
    """
    check_resolution(resolution)
    if stat not in STATS:
        raise ArgumentError(f"stat must be one of {', '.join(STATS)}")
    if "cell" not in table.columns:
        raise ArgumentError("the table needs a cell column")
    if resolution_in is None:
        first = table.select(cell_resolution(F.col("cell")).alias("r")).where("r IS NOT NULL").first()
        if first is None:
            raise ArgumentError("the table has no rows")
        resolution_in = first["r"]
    if resolution_in <= resolution:
        raise ResolutionError(f"resolution must be coarser than the table's {resolution_in}")
    if weights is None and "npix" in table.columns:
        weights = "npix"
    leave = {"cell"} | ({"npix"} & set(table.columns)) | ({weights} if weights else set())
    picked = select_columns(table, columns, leave)
    w = None if weights is None else F.coalesce(F.col(weights).cast("double"), F.lit(0.0))
    if w is not None:
        w = F.when(w < 0, F.raise_error(F.lit(f"negative weights in {weights}")).cast("double")).otherwise(w)
    kinds = {f.name: f.dataType for f in table.schema.fields}
    out = []
    for c in picked:
        if isinstance(kinds[c], T.ArrayType):
            size = vector_length
            if size is None:
                got = table.select(F.size(c).alias("n")).first()
                size = got["n"] if got else 0
            checked = F.when(F.size(c) == size, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} has arrays of different lengths")))
            out.append(F.array(*[grouped(F.get(checked, F.lit(i)), w, stat) for i in range(size)]).alias(c))
        else:
            out.append(grouped(F.col(c), w, stat).alias(c))
    for c in sorted(leave - {"cell"}):
        out.append(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c))
    coarse = table.where(F.col("cell").isNotNull()).groupBy(cell_parent(F.col("cell"), resolution).alias("cell")).agg(*out)
    ordered = [c for c in table.columns if c in {"cell", *picked, *leave}]
    coarse = coarse.select(*ordered)
    return by_cell(coarse) if sort else coarse
