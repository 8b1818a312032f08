"""Nested grid cells and their summaries (nodes), shared by the spatial operators.

A grid has ``depth + 1`` levels. Each level splits a cell 4 x 4. Indexes come from one
integer at the finest level by bit shifts, so that cells nest exactly. A node carries the
tight box of its points, which makes all distance bounds exact whatever the cell edges are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from curbsight import settings as S

# Bounds are compared with this much slack, far above the rounding error of one haversine.
SLACK = 1e-9


@dataclass(frozen=True)
class Grid:
    """Cells of ``side_lat`` x ``side_lon`` degrees at level 0, from the south-west corner."""

    side_lat: float
    side_lon: float
    depth: int
    lat_min: float = S.BBOX["lat_min"]
    lon_min: float = S.BBOX["lon_min"]

    def finest_y(self, lat: Column) -> Column:
        step = self.side_lat / 4 ** self.depth
        return F.floor((lat - self.lat_min) / step).cast("long")

    def finest_x(self, lon: Column) -> Column:
        step = self.side_lon / 4 ** self.depth
        return F.floor((lon - self.lon_min) / step).cast("long")

    def at_level(self, finest: Column, level: int | Column) -> Column:
        shift = (F.lit(self.depth) - level) * 2
        # The SQL function takes the number of bits as a column.
        return F.call_function("shiftright", finest, shift.cast("int"))


def nodes_of(points: DataFrame, grid: Grid, keys: list[str], levels: range,
             weight: str | None = None, extra: list[Column] | None = None) -> DataFrame:
    """One row per occupied cell of the given levels.

    ``points`` has the keys, lat, lon and ord, distinct in (keys, lat, lon). The representative
    is the point with the lowest ord. Partial aggregation keeps the shuffle at one row per
    task and cell.
    """
    rep = F.min(F.struct("ord", "lat", "lon", *(extra or [])))
    levelled = (
        points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
        .withColumn("cy", grid.at_level(grid.finest_y(F.col("lat")), F.col("level")))
        .withColumn("cx", grid.at_level(grid.finest_x(F.col("lon")), F.col("level")))
    )
    return levelled.groupBy(*keys, "level", "cy", "cx").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("w"),
        F.min("lat").alias("y0"), F.max("lat").alias("y1"),
        F.min("lon").alias("x0"), F.max("lon").alias("x1"),
        rep.alias("rep"),
    )


def gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Distance between two intervals, 0 where they touch."""
    return F.greatest(F.lit(0.0), lo1 - hi2, lo2 - hi1)


def reach(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Largest distance between a point of one interval and one of the other."""
    return F.greatest(hi1 - lo2, hi2 - lo1)


def _term(dlat: Column, dlon: Column, cos1: Column, cos2: Column) -> Column:
    s, t = F.sin(F.radians(dlat) / 2), F.sin(F.radians(dlon) / 2)
    return s * s + cos1 * cos2 * t * t


def _cos_low(lo: Column, hi: Column) -> Column:
    return F.least(F.cos(F.radians(lo)), F.cos(F.radians(hi)))


def _cos_high(lo: Column, hi: Column) -> Column:
    crosses = (lo <= 0) & (hi >= 0)
    return F.when(crosses, F.lit(1.0)).otherwise(
        F.greatest(F.cos(F.radians(lo)), F.cos(F.radians(hi))))


def box_low(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """A haversine term no pair of points of the two boxes can go below."""
    return _term(
        gap(a["y0"], a["y1"], b["y0"], b["y1"]), gap(a["x0"], a["x1"], b["x0"], b["x1"]),
        _cos_low(a["y0"], a["y1"]), _cos_low(b["y0"], b["y1"])) * (1 - SLACK)


def box_high(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """A haversine term no pair of points of the two boxes can go above."""
    return _term(
        reach(a["y0"], a["y1"], b["y0"], b["y1"]), reach(a["x0"], a["x1"], b["x0"], b["x1"]),
        _cos_high(a["y0"], a["y1"]), _cos_high(b["y0"], b["y1"])) * (1 + SLACK)


def term_of_metres(metres: float) -> float:
    return math.sin(metres / S.EARTH_RADIUS_M / 2) ** 2
