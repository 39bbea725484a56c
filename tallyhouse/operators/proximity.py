"""Counting the pairs of two point sets that lie near each other, without forming all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_PER_REACH = 4
#: How often the cells on the rim of a reach are quartered.
REFINEMENTS = 3


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def _near(left: str, right: str, reach: float) -> Column:
    return F.abs(F.col(left) - F.col(right)) < reach


def nearby_pair_counts(points: DataFrame, sites: DataFrame, group: str, reach: float) -> DataFrame:
    """Per ``group`` of the sites, the number of (point, site) pairs less than ``reach`` apart in latitude and in longitude.

    A site reaches a square of cells a quarter of ``reach`` wide. All points of an inner cell are near, so inner cells join
    with one count per cell. The cells on the square's rim are quartered ``REFINEMENTS`` times, each time counting those that are inner now; only
    on the last rim, a thirty-second of ``reach`` wide, are distances tested. Equal points, and equal sites of a group, are merged first and carry
    their number. A crowded cell is thus one row for every site whose last rim misses it. ``reach`` should be a power of two, as
    the cell size must be for cell borders to be exact in floating point.
    """
    sizes = [reach / CELLS_PER_REACH / 2**level for level in range(REFINEMENTS + 1)]
    located_points = (
        points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lng"))
        .agg(F.count("*").alias("_points"))
    )
    located_sites = (
        sites.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy(group, F.col("latitude").alias("_site_lat"), F.col("longitude").alias("_site_lng"))
        .agg(F.count("*").alias("_sites"))
    )

    def ends(axis: str, size: float) -> tuple[Column, Column]:
        return _cell(F.col(f"_site_{axis}") - reach, size), _cell(F.col(f"_site_{axis}") + reach, size)

    def inner(size: float) -> Column:
        (south, north), (west, east) = ends("lat", size), ends("lng", size)
        return (F.col("_row") > south) & (F.col("_row") < north) & (F.col("_column") > west) & (F.col("_column") < east)

    def covered(size: float) -> Column:
        return F.col("_row").between(*ends("lat", size)) & F.col("_column").between(*ends("lng", size))

    site = [group, "_site_lat", "_site_lng", "_sites"]
    cells = (
        located_sites.withColumn("_row", F.explode(F.sequence(*ends("lat", sizes[0]))))
        .withColumn("_column", F.explode(F.sequence(*ends("lng", sizes[0]))))
        .withColumn("_level", F.lit(0))
        .withColumn("_inner", inner(sizes[0]))
    )
    for level, size in enumerate(sizes[1:], 1):
        same = F.array(F.struct("_level", "_row", "_column"))
        quarters = F.array(
            *[
                F.struct(F.lit(level).alias("_level"), (F.col("_row") * 2 + a).alias("_row"), (F.col("_column") * 2 + b).alias("_column"))
                for a in (0, 1)
                for b in (0, 1)
            ]
        )
        cells = (
            cells.select(*site, F.col("_inner").alias("_was"), F.inline(F.when(F.col("_inner"), same).otherwise(quarters)))
            .filter(F.col("_was") | covered(size))
            .select(*site, "_level", "_row", "_column", (F.col("_was") | inner(size)).alias("_inner"))
        )

    placed = F.array(
        *[
            F.struct(F.lit(level).alias("_level"), _cell(F.col("_lat"), size).alias("_row"), _cell(F.col("_lng"), size).alias("_column"))
            for level, size in enumerate(sizes)
        ]
    )
    cell = ["_level", "_row", "_column"]
    points_of_cell = located_points.select("_points", F.inline(placed)).groupBy(*cell).agg(F.sum("_points").alias("_points"))
    sites_of_cell = cells.filter("_inner").groupBy(group, *cell).agg(F.sum("_sites").alias("_sites"))
    whole_cells = sites_of_cell.join(points_of_cell, cell).select(group, (F.col("_sites") * F.col("_points")).alias("_pairs"))

    last = located_points.withColumn("_row", _cell(F.col("_lat"), sizes[-1])).withColumn("_column", _cell(F.col("_lng"), sizes[-1]))
    rim = (
        cells.filter(~F.col("_inner")).join(last, ["_row", "_column"])
        .filter(_near("_lat", "_site_lat", reach) & _near("_lng", "_site_lng", reach))
        .select(group, (F.col("_sites") * F.col("_points")).alias("_pairs"))
    )
    return whole_cells.unionByName(rim).groupBy(group).agg(F.sum("_pairs").alias("pairs"))
