"""Heat maps: weighted points binned to square cells of the screen."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import mercator

# Opacity of the faintest cell, and the zoom levels below the deepest over which weights keep halving.
MIN_OPACITY = 0.05
MAX_HALVINGS = 12


@dataclass(frozen=True)
class Viewport:
    """What the map shows: zoom level, size in pixels, world pixel of its corner, and the offset the map was dragged by."""

    zoom: int = 5
    width: int = 8192
    height: int = 8192
    origin_x: float = 0.0
    origin_y: float = 0.0
    pane_x: float = 0.0
    pane_y: float = 0.0


@dataclass(frozen=True)
class HeatOptions:
    radius: float = 25.0
    blur: float = 15.0
    max: float = 1.0
    max_zoom: int = 18

    @property
    def reach(self) -> float:
        return self.radius + self.blur

    @property
    def cell_size(self) -> float:
        return self.reach / 2


def _rounded(value: Column) -> Column:
    return F.floor(value + 0.5)


def _visible_degrees(points: DataFrame, view: Viewport, margin: float) -> DataFrame:
    """Cheap range filter on the stored coordinates, a little wider than the exact pixel test, for the scan to use."""
    slack = margin + 1.0

    def longitude(x: float) -> float:
        return mercator.longitude_of(x + view.origin_x - view.pane_x, view.zoom)

    west, east = longitude(-slack), longitude(view.width + slack)
    kept = points.filter(F.col("longitude").between(west, east))
    top = -slack + view.origin_y - view.pane_y
    bottom = view.height + slack + view.origin_y - view.pane_y
    # Latitudes past the projection's limit are drawn at the limit, so such an edge filters nothing.
    if top > 0:
        kept = kept.filter(F.col("latitude") <= mercator.latitude_of(top, view.zoom))
    if bottom < mercator.world_pixels(view.zoom):
        kept = kept.filter(F.col("latitude") >= mercator.latitude_of(bottom, view.zoom))
    return kept


def heat_grid(
    points: DataFrame,
    weight: str | None = None,
    view: Viewport = Viewport(),
    options: HeatOptions = HeatOptions(),
) -> DataFrame:
    """Cells with their weighted centre and summed weight, clipped to ``options.max``.

    Points carry ``latitude``, ``longitude`` and a decimal ``weight`` column (1 without one). Pixels are whole
    numbers and weights decimals, so the sums are exact and partial aggregates can be merged in any order. Cells left of or
    above the grid are dropped.
    """
    size, reach = options.cell_size, options.reach
    halvings = max(0, min(options.max_zoom - view.zoom, MAX_HALVINGS))
    own_weight = F.lit(1) if weight is None else F.col(weight)
    pixels = _visible_degrees(points, view, reach).select(
        (_rounded(mercator.pixel_x(F.col("longitude"), view.zoom)) - view.origin_x + view.pane_x).alias("_x"),
        (_rounded(mercator.pixel_y(F.col("latitude"), view.zoom)) - view.origin_y + view.pane_y).alias("_y"),
        own_weight.cast("decimal(18,4)").alias("_weight"),
    )
    visible = pixels.filter(
        F.col("_x").between(-reach, view.width + reach) & F.col("_y").between(-reach, view.height + reach)
    )

    def cell(pixel: str, pane: float) -> Column:
        return (F.floor((F.col(pixel) - math.fmod(pane, size)) / size) + 2).cast("int")

    def weighted(pixel: str) -> Column:
        return F.sum(F.col(pixel).cast("decimal(12,2)") * F.col("_weight"))

    cells = (
        visible.select("*", cell("_x", view.pane_x).alias("cell_x"), cell("_y", view.pane_y).alias("cell_y"))
        .filter("cell_x >= 0 and cell_y >= 0")
        .groupBy("cell_x", "cell_y")
        .agg(F.sum("_weight").alias("_weight"), weighted("_x").alias("_wx"), weighted("_y").alias("_wy"))
    )

    def millionths(total: str) -> Column:
        return (F.col(total).cast("decimal(38,6)") * 10**6).cast("double")

    def centre(total: str) -> Column:
        # Whole-number operands: a mean halfway between two pixels is then exactly so and rounds up.
        return _rounded(F.try_divide(millionths(total), millionths("_weight"))).cast("bigint")

    intensity = F.col("_weight").cast("double") * F.lit(2.0**-halvings)
    return cells.select(
        "cell_x",
        "cell_y",
        centre("_wx").alias("x"),
        centre("_wy").alias("y"),
        F.least(intensity, F.lit(float(options.max))).alias("value"),
    )


def heat_intensity(cells: DataFrame, maximum: float = 1.0, min_opacity: float = MIN_OPACITY) -> DataFrame:
    """Adds the opacity a cell is drawn with."""
    shade = F.greatest(F.col("value") / F.lit(float(maximum)), F.lit(min_opacity))
    return cells.withColumn("intensity", F.least(shade, F.lit(1.0)))


def geo_bounds(points: DataFrame) -> DataFrame:
    """The box around all points."""
    return points.agg(
        F.min("latitude").alias("min_lat"),
        F.min("longitude").alias("min_lng"),
        F.max("latitude").alias("max_lat"),
        F.max("longitude").alias("max_lng"),
    )
