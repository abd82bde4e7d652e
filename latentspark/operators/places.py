"""The nearest of many places (points or straight edges) to each position, found through square cells joined by equality.

Positions are looked up by the cell they lie in. For each cell that holds any, the places that can be nearest to some point in it are found once, in
growing rings: tiles of four times the width each time, whose nine around the cell hold all places within a tile's width. Rows are read for their
distinct cells, and joined once with the places of these; no position is compared with a place that can't be its nearest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentspark.sources.shared import passing, saved

#: Places in all cells together that are broadcast at most; beyond, the same join is shuffled.
BROADCAST_PLACES = 500_000
ENDS = ["x0", "y0", "x1", "y1"]


def finite(*columns: str) -> Column:
    """Whether all these are known and finite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)
    return out


def on_edge(x: Column, y: Column, e: Callable[[str], Column]) -> Column:
    """Struct (away, share, at_x, at_y) of the point of edge e nearest to x, y; share is 0 at the edge's start and 1 at its end."""
    dx, dy = e("x1") - e("x0"), e("y1") - e("y0")
    squared = dx * dx + dy * dy
    share = F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e("x0")) * dx + (y - e("y0")) * dy) / squared))).otherwise(0.0)
    at_x, at_y = e("x0") + share * dx, e("y0") + share * dy
    return F.struct(F.sqrt((x - at_x) ** 2 + (y - at_y) ** 2).alias("away"), share.alias("share"), at_x.alias("at_x"), at_y.alias("at_y"))


def _tiles(edges: DataFrame, width: float) -> DataFrame:
    """kx, ky, edge: every tile with each edge that passes it or one of the eight around it. Edges are cut into pieces of a tile's width at most, and a piece goes to all tiles of its box."""
    e = lambda c: F.col(f"edge.{c}")
    pieces = F.greatest(F.ceil(F.sqrt((e("x1") - e("x0")) ** 2 + (e("y1") - e("y0")) ** 2) / width), F.lit(1))
    cut = edges.withColumn("__n", pieces).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    tile = lambda a, b, k: F.floor((e(a) + (e(b) - e(a)) * (F.col("__k") + k) / F.col("__n")) / width)
    box = lambda a, b: F.sequence(F.least(tile(a, b, 0), tile(a, b, 1)) - 1, F.greatest(tile(a, b, 0), tile(a, b, 1)) + 1)
    return cut.withColumn("kx", F.explode(box("x0", "x1"))).withColumn("ky", F.explode(box("y0", "y1"))).select("kx", "ky", "edge").distinct()


def _near_cells(cells: DataFrame, edges: DataFrame, cell: float, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """cx, cy, near: for each cell all edges that can be nearest to a point in it, those at most a diagonal farther from its middle than the nearest one."""
    diagonal, left, width = cell * 2**0.5, cells, 4 * cell
    found = cells.select("cx", "cy", F.array(F.lit(None).cast(edges.schema["edge"].dataType)).alias("near")).where("false")
    middle = lambda c: (F.col(c) + 0.5) * cell
    while not left.isEmpty():
        at = left.withColumns({"kx": F.floor(middle("cx") / width), "ky": F.floor(middle("cy") / width)})
        away = on_edge(middle("cx"), middle("cy"), lambda c: F.col(f"edge.{c}"))["away"]
        pairs = at.join(_tiles(edges, width), ["kx", "ky"]).select("cx", "cy", "edge", away.alias("d"))
        # whatever lies within a tile's width of the middle is in the nine tiles; a little is taken off for rounding
        sure = pairs.groupBy("cx", "cy").agg((F.min("d") + diagonal).alias("reach")).where(F.col("reach") <= width * 0.999)
        done = pairs.join(sure, ["cx", "cy"]).where(F.col("d") <= F.col("reach") * 1.000001).groupBy("cx", "cy").agg(F.collect_list("edge").alias("near"))
        step = save(left.join(done, ["cx", "cy"], "left"))
        found, left = found.unionByName(step.where("near is not null")), step.where("near is null").select("cx", "cy")
        width *= 4
    return found


def nearest_edge(position: DataFrame, edges: DataFrame, carry: list[str] | None = None, cell: float | None = None) -> DataFrame:
    """position (x, y, ...) with away, at_x, at_y, share and the `carry` columns of the edge (x0, y0, x1, y1, carry) nearest to it; of several as near, the one with the least ends.

    Every row stays: without x or y, or where one isn't finite, and without any edge, the added columns are null. Edges with unknown ends don't count; an edge without length is a point.
    `cell` is the width of a cell (by default the larger side of the edges' box by 128); it changes the work, never the result. Coordinates are within 2^50 cells.
    A cell that holds a large share of the positions is one key of the shuffled join, which the adaptive plan splits; mostly the cells are few enough to be broadcast.
    """
    carry = carry or []
    known = edges.where(finite(*ENDS)).select(F.struct(*(F.col(c).cast("double").alias(c) for c in ENDS), *carry).alias("edge")).distinct()
    spark = position.sparkSession
    with passing(spark) as save:
        known = save(known)
        box = known.select(*(F.struct(F.least(f"edge.{a}0", f"edge.{a}1").alias("lo"), F.greatest(f"edge.{a}0", f"edge.{a}1").alias("hi")).alias(a) for a in "xy")).agg(*(F.max(f"{a}.hi") - F.min(f"{a}.lo") for a in "xy")).first()
        added = ["away", "at_x", "at_y", "share", *carry]
        if box[0] is None:
            kinds = {c: edges.schema[c].dataType for c in carry}
            return position.withColumns({c: F.lit(None).cast(kinds.get(c, "double")) for c in added})
        cell = cell or max(*box, 0.0) / 128 or 1.0
        in_cell = lambda c: F.when(finite("x", "y"), F.floor(F.col(c) / cell))
        placed = position.withColumns({"__cx": in_cell("x"), "__cy": in_cell("y")})
        cells = save(placed.where("__cx is not null").select(F.col("__cx").alias("cx"), F.col("__cy").alias("cy")).distinct())
        near = saved(_near_cells(cells, known, cell, save))
    small = (near.agg(F.sum(F.size("near"))).first()[0] or 0) <= BROADCAST_PLACES
    near = near.select(F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.col("near").alias("__near"))
    joined = placed.join(F.broadcast(near) if small else near, ["__cx", "__cy"], "left")

    def measured(e: Column) -> Column:
        on = on_edge(F.col("x"), F.col("y"), lambda c: e[c])
        return F.struct(on["away"].alias("away"), *(e[c].alias(c) for c in ENDS), on["share"].alias("share"), on["at_x"].alias("at_x"), on["at_y"].alias("at_y"), e.alias("edge"))

    best = joined.withColumn("__best", F.array_min(F.transform("__near", measured)))
    return best.select(*position.columns, *(F.col(f"__best.{c}").alias(c) for c in added[:4]), *(F.col(f"__best.edge.{c}").alias(c) for c in carry))


def nearest_point(position: DataFrame, points: DataFrame, carry: list[str] | None = None, cell: float | None = None) -> DataFrame:
    """position with away, at_x, at_y and the `carry` columns of the nearest point (x, y, carry); see `nearest_edge`."""
    ends = points.select(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"), *(carry or []))
    return nearest_edge(position, ends, carry, cell).drop("share")


def polyline(points: DataFrame, order: str) -> DataFrame:
    """x0, y0, x1, y1, start: the edges between points (x, y) in order, and the length of the line before each. As many rows as a maze has points."""
    line = Window.orderBy(order)
    ends = points.select("x", "y", order, F.lead("x").over(line).alias("x1"), F.lead("y").over(line).alias("y1")).where("x1 is not null and y1 is not null")
    length = F.sqrt((F.col("x1") - F.col("x")) ** 2 + (F.col("y1") - F.col("y")) ** 2)
    before = F.coalesce(F.sum(length).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return ends.select(F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"), F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1"), before.alias("start"))


def linear_position(position: DataFrame, edges: DataFrame, cell: float | None = None, name: str = "lin") -> DataFrame:
    """position with `name` (the nearest edge's `start` and the length from its begin to the nearest point), away, at_x and at_y. edges: x0, y0, x1, y1, start."""
    lengths = edges.withColumn("__length", F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2))
    carried = lengths.withColumnRenamed("start", "__start")
    got = nearest_edge(position, carried, ["__start", "__length"], cell)
    return got.withColumn(name, F.col("__start") + F.col("share") * F.col("__length")).drop("share", "__start", "__length")


def projected_points(position: DataFrame, edges: DataFrame, digits: int = 1, cell: float | None = None) -> DataFrame:
    """lin, x, y: of the positions projected to their nearest edge, that of the least linear position for each rounded one. As many rows as the maze has places."""
    at = linear_position(position.select("x", "y"), edges, cell, "__lin").where("__lin is not null")
    least = at.groupBy(F.round("__lin", digits).alias("lin")).agg(F.min(F.struct("__lin", "at_x", "at_y")).alias("__p"))
    return least.select("lin", F.col("__p.at_x").alias("x"), F.col("__p.at_y").alias("y"))
