"""Map projections on numpy arrays: geographic, Mercator, transverse Mercator (and UTM), Lambert azimuthal equal-area, Albers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from gridloom.errors import SourceError

WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)
Pair = tuple[np.ndarray, np.ndarray]


@dataclass
class Projection:
    """Both directions between metres and degrees; points out of reach become NaN."""

    to_lonlat: Callable[[np.ndarray, np.ndarray], Pair]
    from_lonlat: Callable[[np.ndarray, np.ndarray], Pair]
    geographic: bool = False


def geographic() -> Projection:
    def check(lon: np.ndarray, lat: np.ndarray) -> Pair:
        return lon, np.where(np.abs(lat) <= 90 + 1e-9, lat, np.nan)

    return Projection(check, lambda lon, lat: (lon, lat), True)


def web_mercator(a: float = WGS84[0]) -> Projection:
    return Projection(
        lambda x, y: (np.degrees(x / a), np.degrees(2 * np.arctan(np.exp(y / a)) - np.pi / 2)),
        lambda lon, lat: (a * np.radians(lon), a * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))),
    )


def transverse_mercator(lon0: float, lat0: float = 0.0, k0: float = 0.9996, x0: float = 500_000.0, y0: float = 0.0, ellipsoid=WGS84) -> Projection:
    """Krueger's series in the third flattening, to its fourth power (Karney, 2011)."""
    a, f = ellipsoid
    n = f / (2 - f)
    e = np.sqrt(f * (2 - f))
    scale = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, 1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4)

    def conformal(lat: np.ndarray) -> np.ndarray:
        s = np.sin(lat)
        return np.sinh(np.arctanh(s) - e * np.arctanh(e * s))

    def forward(lon: np.ndarray, lat: np.ndarray) -> Pair:
        d, t = np.radians(np.mod(lon - lon0 + 180, 360) - 180), conformal(np.radians(lat))
        xi, eta = np.arctan2(t, np.cos(d)), np.arcsinh(np.sin(d) / np.hypot(t, np.cos(d)))
        x, y = eta.copy(), xi.copy()
        for j, c in enumerate(alpha, 1):
            y += c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            x += c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        return x0 + k0 * scale * x, y0 + k0 * scale * (y - origin)

    def inverse(x: np.ndarray, y: np.ndarray) -> Pair:
        xi, eta = (y - y0) / (k0 * scale) + origin, (x - x0) / (k0 * scale)
        p, q = xi.copy(), eta.copy()
        for j, c in enumerate(beta, 1):
            p -= c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            q -= c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        t = np.sin(p) / np.hypot(np.sinh(q), np.cos(p))
        lat = np.arctan(t)
        for _ in range(6):
            s = np.sin(lat)
            lat = np.arctan(np.sinh(np.arcsinh(t) + e * np.arctanh(e * s)))
        return np.mod(lon0 + np.degrees(np.arctan2(np.sinh(q), np.cos(p))) + 180, 360) - 180, np.degrees(lat)

    origin = 0.0
    if lat0:
        origin = (forward(np.array([lon0]), np.array([lat0]))[1][0] - y0) / (k0 * scale)
    return Projection(inverse, forward)


def authalic(ellipsoid) -> tuple[Callable, float, float]:
    """Authalic latitude function, its q at the pole, and eccentricity."""
    f = ellipsoid[1]
    e = np.sqrt(f * (2 - f))

    def q(s: np.ndarray) -> np.ndarray:
        return (1 - e**2) * (s / (1 - e**2 * s**2) + np.arctanh(e * s) / e)

    return q, float(q(np.float64(1.0))), e


def geodetic(beta: np.ndarray, e: float) -> np.ndarray:
    """Latitude of an authalic latitude (series in e squared, Snyder 3-18)."""
    e2 = e * e
    return beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * np.sin(2 * beta) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * np.sin(4 * beta) + 761 * e2**3 / 45360 * np.sin(6 * beta)


def lambert_azimuthal(lon0: float, lat0: float, x0: float = 0.0, y0: float = 0.0, ellipsoid=GRS80) -> Projection:
    a = ellipsoid[0]
    q, qp, e = authalic(ellipsoid)
    rq = a * np.sqrt(qp / 2)
    s1 = np.sin(np.radians(lat0))
    b1 = np.arcsin(np.clip(q(s1) / qp, -1, 1))
    d = 1.0 if abs(lat0) == 90 else a * np.cos(np.radians(lat0)) / np.sqrt(1 - e**2 * s1**2) / (rq * np.cos(b1))

    def forward(lon: np.ndarray, lat: np.ndarray) -> Pair:
        t, b = np.radians(lon - lon0), np.arcsin(np.clip(q(np.sin(np.radians(lat))) / qp, -1, 1))
        cosc = np.sin(b1) * np.sin(b) + np.cos(b1) * np.cos(b) * np.cos(t)
        k = rq * np.sqrt(2 / np.where(cosc > -1 + 1e-12, 1 + cosc, np.nan))
        return x0 + k * d * np.cos(b) * np.sin(t), y0 + k / d * (np.cos(b1) * np.sin(b) - np.sin(b1) * np.cos(b) * np.cos(t))

    def inverse(x: np.ndarray, y: np.ndarray) -> Pair:
        u, v = (x - x0) / d, (y - y0) * d
        rho = np.hypot(u, v)
        half = rho / (2 * rq)
        c = 2 * np.arcsin(np.where(half <= 1, half, np.nan))
        safe = np.where(rho == 0, 1, rho)
        b = np.arcsin(np.clip(np.cos(c) * np.sin(b1) + v * np.sin(c) * np.cos(b1) / safe, -1, 1))
        lon = lon0 + np.degrees(np.arctan2(u * np.sin(c), safe * np.cos(b1) * np.cos(c) - v * np.sin(b1) * np.sin(c)))
        return np.mod(np.where(rho == 0, lon0, lon) + 180, 360) - 180, np.degrees(geodetic(b, e))

    return Projection(inverse, forward)


def albers(lon0: float, lat0: float, lat1: float, lat2: float, x0: float = 0.0, y0: float = 0.0, ellipsoid=GRS80) -> Projection:
    a = ellipsoid[0]
    q, qp, e = authalic(ellipsoid)
    m = lambda p: np.cos(p) / np.sqrt(1 - e**2 * np.sin(p) ** 2)
    p0, p1, p2 = np.radians([lat0, lat1, lat2])
    n = np.sin(p1) if lat1 == lat2 else (m(p1) ** 2 - m(p2) ** 2) / (q(np.sin(p2)) - q(np.sin(p1)))
    c = m(p1) ** 2 + n * q(np.sin(p1))
    r0 = a * np.sqrt(c - n * q(np.sin(p0))) / n

    def forward(lon: np.ndarray, lat: np.ndarray) -> Pair:
        r, t = a * np.sqrt(c - n * q(np.sin(np.radians(lat)))) / n, n * np.radians(lon - lon0)
        return x0 + r * np.sin(t), y0 + r0 - r * np.cos(t)

    def inverse(x: np.ndarray, y: np.ndarray) -> Pair:
        u, v = x - x0, r0 - (y - y0)
        r, t = np.hypot(u, v) * np.sign(n), np.arctan2(u * np.sign(n), v * np.sign(n))
        share = (c - (r * n / a) ** 2) / n / qp
        b = np.arcsin(np.where(np.abs(share) <= 1, share, np.nan))
        return np.mod(lon0 + np.degrees(t / n) + 180, 360) - 180, np.degrees(geodetic(b, e))

    return Projection(inverse, forward)


def from_epsg(code: int) -> Projection:
    if code in (4326, 4258, 4269):
        return geographic()
    if code in (3857, 900913):
        return web_mercator()
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return transverse_mercator((code % 100) * 6 - 183, y0=0.0 if code < 32700 else 10_000_000.0)
    if 25828 <= code <= 25838:
        return transverse_mercator((code - 25800) * 6 - 183, ellipsoid=GRS80)
    if code == 3035:
        return lambert_azimuthal(10.0, 52.0, 4_321_000.0, 3_210_000.0)
    if code == 5070:
        return albers(-96.0, 23.0, 29.5, 45.5)
    raise SourceError(f"the coordinate system EPSG:{code} is not supported")


def from_keys(keys: dict, epsg: int | None) -> Projection:
    """By EPSG code, else from the GeoTIFF keys of a user-defined system (method code in 3075)."""
    if epsg is not None:
        return from_epsg(epsg)
    get = lambda *names, default=0.0: next((float(keys[k]) for k in names if k in keys), default)
    method = keys.get(3075)
    lon0, lat0 = get(3080, 3084, 3088), get(3081, 3085, 3089)
    x0, y0 = get(3082, 3086), get(3083, 3087)
    shape = (get(2057, default=WGS84[0]), 1 / get(2059) if 2059 in keys else WGS84[1])
    if method == 1:
        return transverse_mercator(lon0, lat0, get(3092, default=1.0), x0, y0, shape)
    if method == 10:
        return lambert_azimuthal(lon0, lat0, x0, y0, shape)
    if method == 11:
        return albers(lon0, lat0, get(3078), get(3079), x0, y0, shape)
    raise SourceError("the file's coordinate system is missing or not supported")
