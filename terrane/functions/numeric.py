"""Geometry, binning and rounding as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import fixed

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def plane_km(lat: Column, lng: Column, lat0: float = 40.4) -> tuple[Column, Column]:
    """(x, y) on a plane that touches at lat0."""
    return lng * F.lit(111.32) * F.cos(F.radians(F.lit(lat0))), lat * F.lit(110.57)


def digitize(x: Column, edges: list[float]) -> Column:
    """How many edges are at most x."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= F.lit(float(e))).cast("int")
    return out


def band_names(edges: list[float] = fixed.PRICE_BANDS) -> list[str]:
    k = lambda v: f"{v / 1000:.0f}k"
    return [f"<{k(edges[0])}", *(f"{k(a)}–{k(b)}" for a, b in zip(edges, edges[1:], strict=False)), f"{k(edges[-1])}+"]


def band(x: Column, edges: list[float] = fixed.PRICE_BANDS) -> Column:
    return F.element_at(F.array(*map(F.lit, band_names(edges))), digitize(x, edges) + 1)


def to_hundreds(x: Column) -> Column:
    """Half to even."""
    return F.bround(x / 100.0, 0) * 100.0


def uniform(seed: int, *keys: Column) -> Column:
    """[0, 1) from MD5 of the keys and the seed: the same in every run and every SQL engine."""
    return hash32(seed, *keys) / F.lit(4294967296.0)


def hash32(seed: int, *keys: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in keys), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
