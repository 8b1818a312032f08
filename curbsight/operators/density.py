"""Exact density clusters (DBSCAN) on great-circle distance, for several layers at once.

Cells are so small that two points of one cell are always within eps. A cell with at least
``min_samples`` incidents is therefore one connected block of core points and enters the
graph as a single vertex, however many incidents it holds. Only the at most
``min_samples - 1`` incidents of each sparse cell are looked at one by one.

What is left are questions between neighbouring cells: how many incidents of a crowded cell
lie within eps of a point, and whether two crowded cells have a pair within eps. They are
answered on nested summaries of the cells (``functions.grid``): a box entirely within eps
counts as a whole, a box entirely outside drops out, and only boxes on the edge are split.
No join ever lists the pairs of points of two crowded cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C
from curbsight.functions.grid import Grid, box_high, box_low, nodes_of, term_of_metres
from curbsight.functions.lineage import cut
from curbsight.functions.ordered import row_numbers
from curbsight.operators.components import components

# Level 6 cells are some 4 cm wide; below them come the points themselves.
DEPTH = 6
BOX = ["y0", "y1", "x0", "x1"]
# Pairs of cells with so few distances are listed instead of being split further.
SMALL_PAIR = 512


def density_grid(eps: float = S.EPS_METERS) -> Grid:
    """Cells whose diagonal is just below eps everywhere in the box."""
    side = eps / math.sqrt(2) * (1 - 1e-6)
    metres = S.EARTH_RADIUS_M * math.pi / 180
    low = min(abs(S.BBOX["lat_min"]), abs(S.BBOX["lat_max"]))
    return Grid(side / metres, side / (metres * math.cos(math.radians(low))), DEPTH)


def _reach(grid: Grid, eps: float) -> int:
    """How many cells away two points within eps can be."""
    metres = S.EARTH_RADIUS_M * math.pi / 180
    high = max(abs(S.BBOX["lat_min"]), abs(S.BBOX["lat_max"]))
    narrow = min(grid.side_lat, grid.side_lon * math.cos(math.radians(high))) * metres
    return math.ceil(eps / narrow)


def _points(df: DataFrame, layers: Column) -> DataFrame:
    """Distinct places per layer with the number of incidents and the lowest ordinal."""
    return (
        df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select(F.explode(layers).alias("layer"), F.col("latitude").alias("lat"),
                F.col("longitude").alias("lon"), "ordinal")
        .groupBy("layer", "lat", "lon")
        .agg(F.count(F.lit(1)).alias("w"), F.min("ordinal").alias("ord"))
    )


def _side(name: str) -> dict[str, Column]:
    return {c: F.col(f"{name}.{c}") for c in BOX}


def _rep_term() -> Column:
    return C.haversine_term(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon"))


def _judge(pairs: DataFrame, limit: float) -> DataFrame:
    """Confirmed incidents per box pair, and whether the pair must be split further.

    ``p`` and ``q`` are box summaries with a representative. Two single points are decided by
    their distance. Otherwise the bounds decide, and an open pair confirms the weight of the
    representative if that is within eps.
    """
    single = (F.col("p.n") == 1) & (F.col("q.n") == 1)
    near = _rep_term() <= limit
    inside = F.when(single, near).otherwise(box_high(_side("p"), _side("q")) <= limit)
    outside = F.when(single, ~near).otherwise(box_low(_side("p"), _side("q")) > limit)
    sure = F.when(inside, F.col("q.w")).when(
        ~outside & near, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return pairs.withColumns({
        "sure": sure,
        "closed": F.when(inside, F.col("q.w")).otherwise(F.lit(0).cast("long")),
        "open": ~inside & ~outside,
    })


def _resolve(pairs: DataFrame, sub: DataFrame, grid: Grid, limit: float) -> DataFrame:
    """(a, b, hits) per pair: incidents of b within eps of a, exact up to ``need``.

    ``pairs`` has layer, a, b, need, p, q with p and q the summaries of a whole cell (or a
    point) at level 0. ``sub`` holds the finer summaries. Each round splits the larger box of
    every open pair into its at most 16 parts; a pair is done once ``need`` is confirmed.
    """
    pair = ["layer", "a", "b"]
    state = pairs.withColumn("base", F.lit(0).cast("long"))
    done = []
    for _ in range(2 * (grid.depth + 2)):
        judged = _judge(state, limit)
        mine = Window.partitionBy(*pair)
        judged = cut(judged.withColumns({
            "hits": F.col("base") + F.sum("sure").over(mine),
            "kept": F.col("base") + F.sum("closed").over(mine),
            "more": F.max("open").over(mine),
        }))
        finished = (F.col("hits") >= F.col("need")) | ~F.col("more")
        done.append(judged.filter(finished).select(*pair, "need", "hits").distinct())
        left = judged.filter(~finished)
        # Pairs whose rows were all decided keep their count through ``base``.
        opened = left.filter("open")
        if opened.isEmpty():
            break
        size = lambda s: (F.col(f"{s}.y1") - F.col(f"{s}.y0")) + (F.col(f"{s}.x1") - F.col(f"{s}.x0"))
        # Split q, or p where p is the larger box (only between two cells: need = 1).
        swap = (F.col("p.n") > 1) & ((F.col("q.n") == 1) | (size("p") > size("q")))
        turned = opened.select(
            *pair, "need", F.col("kept").alias("base"),
            F.when(swap, F.col("q")).otherwise(F.col("p")).alias("p"),
            F.when(swap, F.col("p")).otherwise(F.col("q")).alias("whole"))
        state = turned.join(
            sub, (turned["layer"] == sub["s_layer"])
            & (F.col("whole.level") == F.col("up_level"))
            & (F.col("whole.cy") == F.col("up_y")) & (F.col("whole.cx") == F.col("up_x")),
        ).select(*pair, "need", "base", "p", "q")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _list_pairs(pairs: DataFrame, points: DataFrame, limit: float) -> DataFrame:
    """(a, b, need, hits) from the points themselves, at most SMALL_PAIR distances per pair."""
    place = points.select(
        "layer", F.col("cy").alias("c_y"), F.col("cx").alias("c_x"), F.col("lat").alias("lat_"),
        F.col("lon").alias("lon_"), F.col("w").alias("w_"))

    def listing(df: DataFrame, side: str) -> DataFrame:
        named = place.select("layer", *[
            F.col(c).alias(f"{side}{c}") for c in ("c_y", "c_x", "lat_", "lon_", "w_")])
        return df.withColumns({
            f"{side}c_y": F.col(f"{side}.cy"), f"{side}c_x": F.col(f"{side}.cx")}).join(
            named, ["layer", f"{side}c_y", f"{side}c_x"])

    alone = pairs.filter(F.col("p.n") == 1).withColumns(
        {"plat_": F.col("p.lat"), "plon_": F.col("p.lon")})
    several = listing(pairs.filter(F.col("p.n") > 1), "p")
    columns = ["layer", "a", "b", "need", "plat_", "plon_", "q"]
    rows = listing(alone.select(*columns).unionByName(several.select(*columns)), "q")
    inside = C.haversine_term(
        F.col("plat_"), F.col("plon_"), F.col("qlat_"), F.col("qlon_")) <= limit
    return rows.filter(inside).groupBy("layer", "a", "b", "need").agg(F.sum("qw_").alias("hits"))


def _summary_struct() -> Column:
    return F.struct(
        "level", "cy", "cx", "n", "w", *BOX,
        F.col("rep.lat").alias("lat"), F.col("rep.lon").alias("lon"))


def _point_struct(level: int) -> Column:
    one = F.lit(1).cast("long")
    return F.struct(
        F.lit(level).alias("level"), F.col("cy").alias("cy"), F.col("cx").alias("cx"),
        one.alias("n"), F.col("w").alias("w"), F.col("lat").alias("y0"), F.col("lat").alias("y1"),
        F.col("lon").alias("x0"), F.col("lon").alias("x1"), "lat", "lon")


def _sub_summaries(points: DataFrame, grid: Grid) -> DataFrame:
    """Finer summaries of crowded cells, keyed by the cell one level up.

    The level below the finest holds the points themselves.
    """
    finer = nodes_of(points, grid, ["layer"], range(1, grid.depth + 1), weight="w")
    boxes = finer.select(
        F.col("layer").alias("s_layer"), (F.col("level") - 1).alias("up_level"),
        F.call_function("shiftright", F.col("cy"), F.lit(2)).alias("up_y"),
        F.call_function("shiftright", F.col("cx"), F.lit(2)).alias("up_x"),
        _summary_struct().alias("q"))
    last = (
        points.withColumn("cy", grid.finest_y(F.col("lat")))
        .withColumn("cx", grid.finest_x(F.col("lon")))
        .select(F.col("layer").alias("s_layer"), F.lit(grid.depth).alias("up_level"),
                F.col("cy").alias("up_y"), F.col("cx").alias("up_x"),
                _point_struct(grid.depth + 1).alias("q"))
    )
    return boxes.unionByName(last)


def _around(df: DataFrame, span: int) -> DataFrame:
    """Repeat each row for the cells up to ``span`` away; the target is (ny, nx)."""
    steps = F.sequence(F.lit(-span), F.lit(span))
    return (
        df.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
        .withColumn("ny", F.col("cy") + F.col("dy")).withColumn("nx", F.col("cx") + F.col("dx"))
    )


class DensityClusters:
    """Result tables of one run; ``label`` puts the cluster number on incidents."""

    def __init__(self, grid: Grid, dense: DataFrame, sparse: DataFrame):
        self.grid, self.dense, self.sparse = grid, dense, sparse

    def label(self, df: DataFrame, layers: Column) -> DataFrame:
        """(incident columns, layer, cluster, is_core); -1 is noise. Rows without coordinates
        are left out. Both tables grow with the covered area, not with the incidents."""
        g = self.grid
        rows = (
            df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
            .withColumn("layer", F.explode(layers))
            .withColumn("cy", g.at_level(g.finest_y(F.col("latitude")), 0))
            .withColumn("cx", g.at_level(g.finest_x(F.col("longitude")), 0))
        )
        sparse = self.sparse.select(
            "layer", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
            F.col("cluster").alias("_s"), F.col("core").alias("_core"))
        return (
            rows.join(self.dense.select("layer", "cy", "cx", F.col("cluster").alias("_d")),
                      ["layer", "cy", "cx"], "left")
            .join(sparse, ["layer", "latitude", "longitude"], "left")
            .withColumn("cluster", F.coalesce("_d", "_s", F.lit(-1)).cast("long"))
            .withColumn("is_core", F.col("_d").isNotNull() | F.coalesce("_core", F.lit(False)))
            .drop("cy", "cx", "_d", "_s", "_core")
        )


def density_clusters(df: DataFrame, layers: Column, eps: float = S.EPS_METERS,
                     min_samples: int = S.MIN_SAMPLES) -> DensityClusters:
    """Clusters of every layer. ``layers`` is an array column: the layers of an incident."""
    grid, limit = density_grid(eps), term_of_metres(eps)
    # Questions from points need ``solo`` incidents, questions between cells need one.
    solo = max(min_samples, 2)
    span = _reach(grid, eps)
    points = _points(df, layers).withColumns({
        "cy": grid.at_level(grid.finest_y(F.col("lat")), 0),
        "cx": grid.at_level(grid.finest_x(F.col("lon")), 0)})
    points = cut(points)
    cell = ["layer", "cy", "cx"]
    cells = cut(nodes_of(points, grid, ["layer"], range(1), weight="w"))
    dense = cells.filter(F.col("w") >= min_samples)
    thin = cells.filter(F.col("w") < min_samples).select(*cell)
    sparse = cut(points.join(thin, cell, "left_semi"))

    # Neighbours among the points of sparse cells: at most min_samples - 1 per cell. Each pair
    # is found once, from its own cell or from the cell that comes first.
    there = sparse.select("layer", F.col("cy").alias("ny"), F.col("cx").alias("nx"),
                          F.col("ord").alias("b"), F.col("w").alias("bw"),
                          F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    forward = (F.col("dy") > 0) | ((F.col("dy") == 0) & (F.col("dx") > 0))
    same = (F.col("dy") == 0) & (F.col("dx") == 0)
    close = cut(
        _around(sparse, span).filter(forward | same).join(there, ["layer", "ny", "nx"])
        .filter(forward | (F.col("ord") < F.col("b")))
        .filter(C.haversine_term(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon")) <= limit)
        .select("layer", F.col("ord").alias("a"), F.col("w").alias("aw"), "b", "bw"))
    itself = sparse.select("layer", F.col("ord").alias("a"), F.col("ord").alias("b"),
                           F.col("w").alias("bw"))
    backward = close.select("layer", F.col("b").alias("a"), F.col("a").alias("b"),
                            F.col("aw").alias("bw"))
    near = close.drop("aw").unionByName(backward).unionByName(itself)

    # Questions to crowded cells: from sparse points, and between crowded cells. The cells
    # are the smaller side, so they are the ones repeated for their neighbours.
    target = dense.select(*cell, F.col("rep.ord").alias("b"), _summary_struct().alias("q"))
    from_points = sparse.select(
        "layer", F.col("cy").alias("ny"), F.col("cx").alias("nx"), F.col("ord").alias("a"),
        _point_struct(0).alias("p"),
    ).join(_around(target, span), ["layer", "ny", "nx"]).select(
        "layer", "a", "b", F.lit(solo).cast("long").alias("need"), "p", "q")
    target = target.withColumnsRenamed({"cy": "ny", "cx": "nx"})
    source = dense.select(*cell, F.col("rep.ord").alias("a"), _summary_struct().alias("p"))
    from_cells = _around(source, span).filter(forward).join(
        target, ["layer", "ny", "nx"]).select(
        "layer", "a", "b", F.lit(1).cast("long").alias("need"), "p", "q")
    pairs = cut(_judge(from_points.unionByName(from_cells).filter(
        box_low(_side("p"), _side("q")) <= limit), limit))
    undecided = F.col("open") & (F.col("sure") < F.col("need"))
    few = F.col("p.n") * F.col("q.n") <= SMALL_PAIR
    known = pairs.filter(~undecided).select("layer", "a", "b", "need", F.col("sure").alias("hits"))
    # Links between crowded cells only connect: cells that the known links connect already, also
    # through others, need no answer.
    roots = cut(components(
        dense.select("layer", F.col("rep.ord").alias("v")),
        known.filter((F.col("need") != solo) & (F.col("hits") > 0)).select("layer", "a", "b"), ["layer"]))
    of = lambda v: roots.select("layer", F.col("v").alias(v), F.col("root").alias(f"{v}_root"))
    asked = cut(
        pairs.filter(undecided).join(of("a"), ["layer", "a"], "left").join(of("b"), ["layer", "b"], "left")
        .filter((F.col("need") == solo) | (F.col("a_root") != F.col("b_root"))).select(*pairs.columns))
    listed = _list_pairs(asked.filter(few), points, limit)
    hits = known.unionByName(listed)
    crowded = asked.filter(~few)
    if not crowded.isEmpty():
        # Finer summaries only for the cells whose boxes leave such a question open.
        involved = crowded.select("layer", "q.cy", "q.cx").union(
            crowded.filter("p.n > 1").select("layer", "p.cy", "p.cx")).distinct()
        sub = cut(_sub_summaries(points.join(involved, cell, "left_semi").drop("cy", "cx"), grid))
        hits = hits.unionByName(_resolve(
            crowded.select("layer", "a", "b", "need", "p", "q"), sub, grid, limit))
    hits = cut(hits)

    # Core points of sparse cells.
    counted = near.groupBy("layer", "a").agg(F.sum("bw").alias("m")).unionByName(
        hits.filter(F.col("need") == solo).select(
            "layer", "a", F.col("hits").alias("m")))
    core = cut(counted.groupBy("layer", "a").agg(F.sum("m").alias("m"))
               .filter(F.col("m") >= min_samples).select("layer", F.col("a").alias("v")))
    a_core = core.select("layer", F.col("v").alias("a"))
    b_core = core.select("layer", F.col("v").alias("b"))

    # Graph: crowded cells and core points.
    touching = hits.filter(F.col("hits") > 0)
    vertices = dense.select("layer", F.col("rep.ord").alias("v")).unionByName(core)
    edges = (
        touching.filter(F.col("need") != solo).select("layer", "a", "b")
        .unionByName(touching.filter(F.col("need") == solo)
                     .join(a_core, ["layer", "a"], "left_semi").select("layer", "a", "b"))
        .unionByName(close.join(a_core, ["layer", "a"], "left_semi")
                     .join(b_core, ["layer", "b"], "left_semi").select("layer", "a", "b"))
    )
    rooted = components(vertices, edges, ["layer"])
    # Clusters count from 0 by their lowest core ordinal; the table has one row per cluster.
    numbers = row_numbers(cut(rooted.select("layer", "root").distinct()), ["layer"], "root", "cluster")
    clustered = cut(rooted.join(numbers, ["layer", "root"]).select("layer", "v", "cluster"))

    dense_labels = dense.select(*cell, F.col("rep.ord").alias("v")).join(
        clustered, ["layer", "v"]).select(*cell, "cluster")
    # Border points take the lowest cluster among the core points and cells within eps.
    contacts = near.select("layer", "a", "b").unionByName(
        touching.filter(F.col("need") == solo).select("layer", "a", "b"))
    border = contacts.join(clustered.withColumnRenamed("v", "b"), ["layer", "b"]).groupBy(
        "layer", F.col("a").alias("v")).agg(F.min("cluster").alias("cluster"))
    labels = border.join(core.withColumn("core", F.lit(True)), ["layer", "v"], "left")
    sparse_labels = sparse.select("layer", "lat", "lon", F.col("ord").alias("v")).join(
        labels, ["layer", "v"]).select(
        "layer", "lat", "lon", "cluster", F.coalesce("core", F.lit(False)).alias("core"))
    # Written, Spark knows their size and sends small ones to the incidents, which then stay in place.
    return DensityClusters(grid, cut(dense_labels), cut(sparse_labels))
