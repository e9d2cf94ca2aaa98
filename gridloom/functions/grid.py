"""An equal-area quadtree on the cylindrical equal-area projection, in built-in expressions.

At resolution r the sphere is cut into 2^r columns of equal longitude and 2^r rows of equal height in sin(latitude), so all cells of a
resolution have one area and each cell contains exactly four of the next. A cell id packs (resolution, row, column) into 63 bits:
``resolution * 2^58 + row * 2^29 + column``; ids of a resolution sort by row, then column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import ResolutionError

MAX_RESOLUTION = 29
RES_UNIT, ROW_UNIT = 1 << 58, 1 << 29
SPHERE_RADIUS = 6_371_007.180918475  # metres, of the sphere with the ellipsoid's area


def check_resolution(r: int) -> int:
    if isinstance(r, bool) or not isinstance(r, int) or not 0 <= r <= MAX_RESOLUTION:
        raise ResolutionError(f"resolution must be a whole number from 0 to {MAX_RESOLUTION}, not {r!r}")
    return r


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180); values already there are untouched."""
    return F.when((lon >= -180) & (lon < 180), lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def column_of(lon: Column, r: int) -> Column:
    """Number of the column of resolution r that holds a longitude in degrees."""
    n = 1 << check_resolution(r)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180.0) / 360.0 * float(n)))).cast("long")


def row_of(lat: Column, r: int) -> Column:
    """Number of the row of resolution r that holds a latitude in degrees."""
    n = 1 << check_resolution(r)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.sin(F.radians(lat)) + 1.0) / 2.0 * float(n)))).cast("long")


def lonlat_to_cell(lon: Column, lat: Column, r: int) -> Column:
    """Id of the cell of resolution r that holds the point in degrees; null for null or impossible coordinates."""
    real = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    return F.when(real, F.lit(r * RES_UNIT) + row_of(lat, r) * F.lit(ROW_UNIT) + column_of(lon, r))


def cell_resolution(cell: Column) -> Column:
    return F.shiftright(cell, 58).cast("int")


def cell_row(cell: Column) -> Column:
    return F.shiftright(cell, 29).bitwiseAND(F.lit(ROW_UNIT - 1))


def cell_column(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(ROW_UNIT - 1))


def cell_parent(cell: Column, r: int) -> Column:
    """The cell of resolution r that contains `cell`; null where `cell` is coarser than r."""
    check_resolution(r)
    shift = cell_resolution(cell) - r
    y, x = (F.call_function("shiftright", part, shift) for part in (cell_row(cell), cell_column(cell)))
    return F.when(shift >= 0, F.lit(r * RES_UNIT) + y * F.lit(ROW_UNIT) + x)


def cell_children(cell: Column, levels: int = 1) -> Column:
    """Array of the cells `levels` finer inside `cell`, ascending."""
    k = 1 << levels
    y, x = cell_row(cell) * k, cell_column(cell) * k
    base = (cell_resolution(cell).cast("long") + levels) * F.lit(RES_UNIT)
    return F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda i: base + (y + F.floor(i / k)) * F.lit(ROW_UNIT) + x + i % k)


def cell_lon(cell: Column) -> Column:
    n = F.pow(F.lit(2.0), cell_resolution(cell))
    return (cell_column(cell) + 0.5) / n * 360.0 - 180.0


def cell_lat(cell: Column) -> Column:
    n = F.pow(F.lit(2.0), cell_resolution(cell))
    return F.degrees(F.asin((cell_row(cell) + 0.5) / n * 2.0 - 1.0))


def cell_hex(cell: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(cell), 16, "0"))


def hex_cell(text: Column) -> Column:
    """The id that sixteen digits stand for, also for ids past the sign bit."""
    return F.conv(text, 16, -10).cast("long")


def unsigned_order(cell: Column) -> Column:
    """Sort key that orders 64-bit ids as unsigned numbers."""
    return cell.bitwiseXOR(F.lit(-(1 << 63)))


def cell_area(r: int) -> float:
    """Square metres."""
    return 4 * math.pi * SPHERE_RADIUS**2 / 4**r


def cell_edge(r: int) -> float:
    """Side in metres of a square of a cell's area."""
    return math.sqrt(cell_area(r))
