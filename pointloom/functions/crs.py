"""Projections between EPSG:4326 and EPSG:3857, and Web Mercator tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sphere's radius and the latitude where the square map ends.
RADIUS = 6378137.0
MAX_LAT = 85.0511


def forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres of degrees latitude and longitude."""
    return RADIUS * F.radians(lon), RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of metres."""
    return F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.lit(math.pi / 2)), F.degrees(x / RADIUS)


def transform(points: DataFrame, source: str, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """Replace columns x, y; in EPSG:4326 x is the latitude and y the longitude.

    The columns' metadata name the target (crs_of() reads it). Only 4326 and 3857 are known. Anything else is an error, never an untransformed result.
    """
    pair = (source.lower(), target.lower())
    if pair == ("epsg:4326", "epsg:3857"):
        new = forward(F.col(x), F.col(y))
    elif pair == ("epsg:3857", "epsg:4326"):
        new = inverse(F.col(x), F.col(y))
    elif pair[0] == pair[1] and pair[0] in ("epsg:4326", "epsg:3857"):
        return points
    else:
        raise ValueError(f"no transformation from {source} to {target}")
    known = {"crs": target.upper()}
    return points.withColumns({x: new[0], y: new[1]}).withMetadata(x, known).withMetadata(y, known)


def crs_of(points: DataFrame) -> str | None:
    """Reference system that transform() left with the column x, None where it isn't known."""
    return points.schema["x"].metadata.get("crs") if "x" in points.columns else None


def tile_of(lat: Column, lon: Column, zoom: int, flip_y: bool = False) -> tuple[Column, Column]:
    """(tile_x, tile_y) of the slippy map at a zoom level; with flip_y rows count from the south."""
    n = 1 << zoom
    lat = F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT))
    tx = F.floor((lon + 180.0) / 360.0 * n)
    r = F.radians(lat)
    ty = F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n)
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("bigint")
    tx, ty = clip(tx), clip(ty)
    return tx, (F.lit(n - 1) - ty).cast("bigint") if flip_y else ty


def tile_centre(tx: Column, ty: Column, zoom: int, flip_y: bool = False) -> tuple[Column, Column]:
    """(lat, lon) of a tile's centre."""
    n = 1 << zoom
    ty = F.lit(n - 1) - ty if flip_y else ty
    lon = (tx + 0.5) / n * 360.0 - 180.0
    lat = F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * (ty + 0.5) / n))))
    return lat, lon
