"""Spherical Mercator pixels of web maps (256-pixel tiles)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the projection.
TILE_PIXELS = 256
MAX_LATITUDE = 85.0511287798


def world_pixels(zoom: float) -> float:
    return TILE_PIXELS * 2.0**zoom


def pixel_x(longitude: Column, zoom: float) -> Column:
    return (longitude + 180.0) / 360.0 * world_pixels(zoom)


def pixel_y(latitude: Column, zoom: float) -> Column:
    phi = F.radians(F.least(F.greatest(latitude, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    return (1.0 - F.ln(F.tan(phi) + F.sec(phi)) / math.pi) / 2.0 * world_pixels(zoom)


def longitude_of(x: float, zoom: float) -> float:
    return x / world_pixels(zoom) * 360.0 - 180.0


def latitude_of(y: float, zoom: float) -> float:
    return math.degrees(math.atan(math.sinh(math.pi * (1.0 - 2.0 * y / world_pixels(zoom)))))
