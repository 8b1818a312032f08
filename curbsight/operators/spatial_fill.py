"""Exact nearest-neighbour fill of missing area names.

Labelled places are summarised in a nested grid. Each place to fill first gets an upper
bound from the representatives of its own cells, then looks at the few cells that touch the
circle of that radius and splits those that could still hold a nearer place. Bounds prune
the search, so no place is ever compared with all places of a crowded cell, and nothing is
cut off: a cell leaves the search only when a nearer point is known.

Both sides are reduced to distinct coordinates first, so copies cost nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C
from curbsight.functions.grid import Grid, box_low, nodes_of
from curbsight.functions.lineage import cut

# Level 0 covers the whole box; level 12 is some 5 mm wide.
GRID = Grid(side_lat=0.82, side_lon=0.82, depth=12)
POINT_LEVEL = GRID.depth + 1
# Degrees per radian of arc, with a margin for the narrowing of meridians.
DEGREES = 57.29577951308232 * (1 + 1e-6)

SPREAD = 1 << 16
# Cells with so few points are compared point by point instead of being split further.
SMALL_CELL = 32
# So many cells (some 24 bytes each) are sent to the points instead of the points to them.
FEW_CELLS = 100_000

PLACE = ["field", "lat", "lon"]
CELL = ["field", "level", "cy", "cx"]


def _long_form(df: DataFrame, fields: list[str]) -> DataFrame:
    located = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("label")) for f in fields])
    return located.select(
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        F.col("ordinal").alias("ord"), F.explode(pairs).alias("p"),
    ).select("p.field", "p.label", "lat", "lon", "ord")


def _nodes(labelled: DataFrame) -> tuple[DataFrame, int]:
    """Grid summaries of the labelled places, and the finest level that covers all of them.

    The levels in use follow the number of places: about two levels beyond the one where an
    even spread leaves one place per cell. Only places that still share a cell there get
    finer levels, so that the table stays a small multiple of the places.
    """
    spread = math.log(max(labelled.count(), 1), 16)
    middle = min(GRID.depth, math.ceil(spread) + 2)
    nodes = cut(nodes_of(labelled, GRID, ["field"], range(middle + 1), extra=[F.col("label")]))
    level = F.col("level")
    if middle < GRID.depth:
        crowded = _places_in(labelled, nodes.filter((level == middle) & (F.col("n") > 1)), middle)
        finer = nodes_of(crowded, GRID, ["field"], range(middle + 1, GRID.depth + 1),
                         extra=[F.col("label")])
        nodes = cut(nodes.unionByName(finer))
    last = nodes.filter((level == GRID.depth) & (F.col("n") > 1))
    if last.isEmpty():
        return nodes, middle
    # Different coordinates inside one finest cell: list them as nodes of their own.
    points = _places_in(labelled, last, GRID.depth).select(
        "field", F.lit(POINT_LEVEL).alias("level"), "cy", "cx",
        F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("w"),
        F.col("lat").alias("y0"), F.col("lat").alias("y1"),
        F.col("lon").alias("x0"), F.col("lon").alias("x1"),
        F.struct("ord", "lat", "lon", "label").alias("rep"))
    return cut(nodes.unionByName(points)), middle


def _places_in(labelled: DataFrame, cells: DataFrame, level: int) -> DataFrame:
    return (
        labelled.withColumn("cy", GRID.at_level(GRID.finest_y(F.col("lat")), level))
        .withColumn("cx", GRID.at_level(GRID.finest_x(F.col("lon")), level))
        .join(cells.select("field", "cy", "cx"), ["field", "cy", "cx"], "left_semi")
    )


def _own_reps(places: DataFrame, nodes: DataFrame, levels: range) -> DataFrame:
    """The nearest representative among a place's own cells of some levels, and whether the finest of
    these cells holds more places. Places whose cells are all empty drop out."""
    here = F.col("level").isin(list(levels))
    own = (
        places.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
        .withColumn("cy", GRID.at_level(GRID.finest_y(F.col("lat")), F.col("level")))
        .withColumn("cx", GRID.at_level(GRID.finest_x(F.col("lon")), F.col("level")))
    )
    reps = nodes.filter(here).select(
        *CELL, "n", F.col("rep.lat").alias("ry"), F.col("rep.lon").alias("rx"))
    near = own.join(reps, CELL).withColumn(
        "h", C.haversine_term(F.col("lat"), F.col("lon"), F.col("ry"), F.col("rx")))
    return near.groupBy(*PLACE).agg(
        F.min("h").alias("bound"),
        F.max((F.col("level") == levels[-1]) & (F.col("n") > 1)).alias("crowded"))


def _first_bound(places: DataFrame, nodes: DataFrame, finest: int) -> DataFrame:
    """An upper bound per place: the nearest representative among its own cells.

    Two levels near the finest common one answer nearly all places, so that a place is sent for two
    cells instead of all. Only places in empty cells ask the coarser levels, and only places in
    crowded cells the finer ones.
    """
    first = range(max(finest - 2, 0), max(finest, 1))
    common = cut(_own_reps(places, nodes, first))
    crowded = common.filter("crowded").select(*PLACE)
    found = common.unionByName(_own_reps(crowded, nodes, range(first[-1] + 1, GRID.depth + 1)))
    if first[0] > 0:
        alone = places.join(common.select(*PLACE), PLACE, "left_anti")
        found = found.unionByName(_own_reps(alone, nodes, range(first[0])))
    return found.groupBy(*PLACE).agg(F.min("bound").alias("bound"))


def _circle_cells(bounded: DataFrame, finest: int) -> DataFrame:
    """Cells that touch the circle, at a level where these are at most 2 x 2."""
    arc = F.asin(F.sqrt(F.col("bound"))) * 2 * DEGREES + 1e-12
    step_y, step_x = GRID.side_lat / 4 ** GRID.depth, GRID.side_lon / 4 ** GRID.depth
    cos_far = F.cos(F.radians(F.abs(F.col("lat")) + F.col("dy")))
    widest = F.greatest(F.col("dy") / step_y, F.col("dx") / step_x) * 2
    # Level such that the cell side is >= 2 * radius.
    up = F.ceil(F.log2(F.greatest(widest, F.lit(1.0))) / 2)
    return (
        bounded.withColumn("dy", arc)
        .withColumn("dx", F.col("dy") / cos_far)
        .withColumn("level", F.least(
            F.lit(finest), F.greatest(F.lit(0), F.lit(GRID.depth) - up)).cast("int"))
        .withColumn("cy", F.explode(F.sequence(
            GRID.at_level(GRID.finest_y(F.col("lat") - F.col("dy")), F.col("level")),
            GRID.at_level(GRID.finest_y(F.col("lat") + F.col("dy")), F.col("level")))))
        .withColumn("cx", F.explode(F.sequence(
            GRID.at_level(GRID.finest_x(F.col("lon") - F.col("dx")), F.col("level")),
            GRID.at_level(GRID.finest_x(F.col("lon") + F.col("dx")), F.col("level")))))
        .select(*PLACE, "bound", "level", "cy", "cx")
    )


def _look(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """Visit cells: distance to the representative, lowest possible distance, tighter bound."""
    box = {c: F.col(c) for c in ("y0", "y1", "x0", "x1")}
    here = {"y0": F.col("lat"), "y1": F.col("lat"), "x0": F.col("lon"), "x1": F.col("lon")}
    seen = cells.join(nodes, CELL).select(
        *PLACE, "bound", "level", "cy", "cx", "n",
        box_low(here, box).alias("low"),
        F.struct(
            C.haversine_term(F.col("lat"), F.col("lon"), F.col("rep.lat"), F.col("rep.lon"))
            .alias("h"), F.col("rep.ord").alias("ord"), F.col("rep.label").alias("label"),
        ).alias("near"),
    ).filter(F.col("low") <= F.col("bound"))
    # A place has a handful of open cells at a time, so the window per place is small.
    tight = F.min("near.h").over(Window.partitionBy(*PLACE))
    return seen.withColumn("bound", F.least("bound", tight)).filter(F.col("low") <= F.col("bound"))


def _children(open_cells: DataFrame) -> DataFrame:
    """The 4 x 4 parts of each open cell that touch the circle."""
    parts = F.array(*[F.lit(i).cast("long") for i in range(4)])
    last = F.col("level") == GRID.depth
    whole = F.array(F.lit(-1).cast("long"))
    child = (
        open_cells.withColumn("dy", F.asin(F.sqrt(F.col("bound"))) * 2 * DEGREES + 1e-12)
        .withColumn("dx", F.col("dy") / F.cos(F.radians(F.abs(F.col("lat")) + F.col("dy"))))
        .withColumn("py", F.explode(F.when(last, whole).otherwise(parts)))
        .withColumn("px", F.explode(F.when(last, whole).otherwise(parts)))
        .withColumn("level", F.col("level") + 1)
        .withColumn("cy", F.when(F.col("py") < 0, F.col("cy")).otherwise(F.col("cy") * 4 + F.col("py")))
        .withColumn("cx", F.when(F.col("px") < 0, F.col("cx")).otherwise(F.col("cx") * 4 + F.col("px")))
    )
    shown = F.least(F.col("level"), F.lit(GRID.depth))
    touches = (
        F.col("cy").between(
            GRID.at_level(GRID.finest_y(F.col("lat") - F.col("dy")), shown),
            GRID.at_level(GRID.finest_y(F.col("lat") + F.col("dy")), shown))
        & F.col("cx").between(
            GRID.at_level(GRID.finest_x(F.col("lon") - F.col("dx")), shown),
            GRID.at_level(GRID.finest_x(F.col("lon") + F.col("dx")), shown))
    )
    return child.filter(touches).select(*PLACE, "bound", "level", "cy", "cx")


def nearest_labels(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, lat, lon, label, h): the nearest label for every place that lacks one.

    Ties in distance go to the lowest ordinal.
    """
    rows = _long_form(df, fields)
    # For each distinct place: the first label there, and whether some row lacks one.
    places = cut(rows.groupBy(*PLACE).agg(
        F.min(F.when(F.col("label").isNotNull(), F.struct("ord", "label"))).alias("first"),
        F.max(F.col("label").isNull()).alias("wanted"),
    ))
    labelled = places.filter("first IS NOT NULL").select(
        *PLACE, F.col("first.ord").alias("ord"), F.col("first.label").alias("label"))
    nodes, finest = _nodes(labelled)
    # A place with a label of its own has nothing nearer, as different places are never 0 apart.
    settled = places.filter("wanted AND first IS NOT NULL").select(*PLACE, F.struct(
        F.lit(0.0).alias("h"), F.col("first.ord"), F.col("first.label")).alias("near"))
    wanted = places.filter("wanted AND first IS NULL").select(*PLACE)

    cells = _circle_cells(_first_bound(wanted, nodes, finest), finest)
    rounds, small = [], []
    for _ in range(POINT_LEVEL + 1):
        seen = cut(_look(cells, nodes))
        rounds.append(seen.select(*PLACE, "near"))
        small.append(seen.filter(F.col("n").between(2, SMALL_CELL)))
        crowded = seen.filter(F.col("n") > SMALL_CELL)
        if crowded.isEmpty():
            break
        cells = _children(crowded)
    rounds.append(_compare(reduce(DataFrame.unionByName, small), labelled))
    best = reduce(DataFrame.unionByName, rounds).groupBy(*PLACE).agg(F.min("near").alias("near"))
    return best.unionByName(settled).select(*PLACE, F.col("near.label").alias("label"), F.col("near.h").alias("h"))


def _compare(open_cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """Distances to the points of cells with few points (at most SMALL_CELL pairs per row).

    Points are sent only for the levels that many of the cells are of. The cells of all other levels
    together are so few that Spark sends them to the points.
    """
    used = cut(open_cells.select(*CELL).distinct())
    rare, often, held = [], [], 0
    for level, cells in sorted(used.groupBy("level").count().collect(), key=lambda r: (r["count"], r["level"])):
        held += cells
        (rare if held <= FEW_CELLS else often).append(level)
    out = open_cells.limit(0).select(*PLACE, "near")
    for levels in filter(None, (rare, often)):
        here = F.col("level").isin(levels)
        points = (
            labelled.select("field", "ord", "label", F.col("lat").alias("py"), F.col("lon").alias("px"))
            .withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
            .withColumn("cy", GRID.at_level(GRID.finest_y(F.col("py")), F.col("level")))
            .withColumn("cx", GRID.at_level(GRID.finest_x(F.col("px")), F.col("level")))
        )
        # The semi join keeps only the copies of a point whose cell is really asked for.
        asked = used.filter(here)
        asked = cut(asked) if levels is rare else asked
        out = out.unionByName(open_cells.filter(here).join(
            points.join(asked, CELL, "left_semi"), CELL).select(
            *PLACE, F.struct(
                C.haversine_term(F.col("lat"), F.col("lon"), F.col("py"), F.col("px")).alias("h"),
                "ord", "label").alias("near")))
    return out


def fill_from_nearest(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fill nulls of ``fields`` from the nearest labelled incident; others stay as they are.

    The fields are independent of each other. Rows without coordinates are left alone.
    """
    if not fields:
        return df
    found = nearest_labels(df, fields).groupBy("lat", "lon").agg(*[
        F.max(F.when(F.col("field") == f, F.col("label"))).alias(f"_near_{f}") for f in fields])
    # Rows that need no label get a key of their own that matches nothing. They spread evenly
    # over the shuffle; as nulls they would all meet in one task.
    needs = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.forall(
        F.array(*fields), lambda v: v.isNotNull())
    keyed = df.withColumn("_lat", F.when(needs, F.col("latitude")).otherwise(
        F.lit(-1000.0) - F.pmod("ordinal", F.lit(SPREAD))))
    joined = keyed.join(
        found, (keyed["_lat"] == found["lat"]) & (
            F.coalesce(keyed["longitude"], F.lit(0.0)) == found["lon"]), "left")
    return joined.withColumns(
        {f: F.coalesce(F.col(f), F.col(f"_near_{f}")) for f in fields}
    ).drop("_lat", "lat", "lon", *[f"_near_{f}" for f in fields])
