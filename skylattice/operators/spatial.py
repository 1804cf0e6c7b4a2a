"""Points joined with many regions through quadtree cells, and unions and intersections of polygons by slabs.

Regions are rows (region_id, polygons) with polygons as arrays of closed rings of [x, y]; a polygon is what its rings
enclose an odd number of times, a region what any of its polygons covers. Polygons may overlap, and touch or cross
themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.functions import geo
from skylattice.storage import join_small, materialise

#: Halvings of the box of all regions down to the smallest cells.
MAX_LEVEL = 8
#: Edges of a region for each strip that it is cut into.
STRIP_EDGES = 64


def _touch(edges: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which edges (ax, ay, bx, by) meet a closed box."""
    a, b = edges[:, :2], edges[:, 2:]
    near = ((np.minimum(a, b) <= high) & (np.maximum(a, b) >= low)).all(axis=1)
    corners = np.array([low, [low[0], high[1]], high, [high[0], low[1]]])
    side = (b[:, None, 0] - a[:, None, 0]) * (corners[None, :, 1] - a[:, None, 1]) - (b[:, None, 1] - a[:, None, 1]) * (corners[None, :, 0] - a[:, None, 0])
    return near & (side.min(axis=1) <= 0) & (side.max(axis=1) >= 0)


def _covers(polygons: list[np.ndarray], x: float, y: float) -> bool:
    """Whether the edges of any polygon enclose a point that is on none of them."""
    for e in polygons:
        up = (e[:, 1] > y) != (e[:, 3] > y)
        at = e[up, 0] + (y - e[up, 1]) * (e[up, 2] - e[up, 0]) / (e[up, 3] - e[up, 1])
        if np.count_nonzero(at > x) % 2:
            return True
    return False


def cell_cover(polygons: list, low: np.ndarray, high: np.ndarray, max_level: int) -> list[tuple[int, int, int, bool]]:
    """Cells (level, column, row, interior) of a region: interior ones hold no edge, the others are of the last level."""
    parts = [np.array([[*p, *q] for ring in polygon for p, q in zip(ring, ring[1:])], float).reshape(-1, 4) for polygon in polygons or []]
    edges, found = np.concatenate([np.zeros((0, 4)), *parts]), []
    stack = [(0, 0, 0, edges)] if len(edges) else []
    while stack:
        level, column, row, near = stack.pop()
        side = (high - low) / (1 << level)
        first = low + side * (column, row)
        near = near[_touch(near, first - 1e-9 * side, first + (1 + 1e-9) * side)]
        if not len(near):
            if _covers(parts, *(first + side / 2)):
                found.append((level, column, row, True))
        elif level == max_level:
            found.append((level, column, row, False))
        else:
            stack += [(level + 1, 2 * column + i, 2 * row + j, near) for i in (0, 1) for j in (0, 1)]
    return found


def _cell(level, column, row) -> Column:
    return F.shiftleft(level.cast("long"), 56).bitwiseOR(F.shiftleft(column.cast("long"), 28)).bitwiseOR(row.cast("long"))


def points_in_regions(points: DataFrame, regions: DataFrame, x: str, y: str, max_level: int = MAX_LEVEL) -> DataFrame:
    """``points`` with region_id, a row for each region that a point is in. The cells that cover a region are joined with
    those that a point lies in; only points in cells with an edge are tried against the polygons. Points outside all
    regions, or without coordinates, have no row."""
    regions = materialise(regions.select("region_id", "polygons"), "regions")
    box = regions.select(geo.bounds("polygons").alias("b")).select("b.*")
    low_x, low_y, high_x, high_y = box.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    if low_x is None:
        return points.withColumn("region_id", F.lit(None).cast(regions.schema["region_id"].dataType)).limit(0)
    low, high = np.array([low_x, low_y]), np.array([max(high_x, np.nextafter(low_x, np.inf)), max(high_y, np.nextafter(low_y, np.inf))])

    def run(frames):
        for frame in frames:
            yield frame[["region_id"]].assign(cells=[cell_cover([[[list(p) for p in r] for r in g] for g in x] if x is not None else [], low, high, max_level) for x in frame["polygons"]])

    kind = regions.schema["region_id"].dataType.simpleString()
    covers = regions.mapInPandas(run, f"region_id {kind}, cells array<struct<level:int,column:int,row:int,interior:boolean>>")
    covers = materialise(covers.select("region_id", F.inline("cells")), "cell-covers")
    levels = [r.level for r in covers.select("level").distinct().collect()]  # max_level + 1 at most
    side = 1 << max_level
    place = lambda c, a, b: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((F.col(c) - float(a)) / float(b - a) * side)))
    inside = F.col(x).between(float(low_x), float(high_x)) & F.col(y).between(float(low_y), float(high_y))
    column, row = place(x, low[0], high[0]), place(y, low[1], high[1])
    cells = [_cell(F.lit(n), F.shiftright(column.cast("long"), max_level - n), F.shiftright(row.cast("long"), max_level - n)) for n in sorted(levels)]
    keyed = points.where(inside).withColumn("__cell", F.explode(F.array(*cells) if cells else F.array().cast("array<bigint>")))
    named = covers.select(F.col("region_id").alias("__region"), "interior", _cell(F.col("level"), F.col("column"), F.col("row")).alias("__cell"))
    met = join_small(keyed, named.withColumnRenamed("interior", "__interior"), "__cell")
    shapes = regions.select(F.col("region_id").alias("__region"), F.col("polygons").alias("__polygons"))
    sure = met.where("__interior")
    tried = join_small(met.where("not __interior"), shapes, "__region").where(geo.in_region("__polygons", x, y))
    return sure.unionByName(tried.drop("__polygons")).withColumn("region_id", F.col("__region")).select(*points.columns, "region_id")


def _pieces(regions: DataFrame) -> DataFrame:
    """Edges of regions cut at the strips of their region: region_id, part (names the polygon), the line through (ax, ay)
    and (bx, by) with ax < bx, strip, and the x-range [lo, hi] in it."""
    polygons = regions.select("region_id", F.explode("polygons").alias("rings")).distinct()  # a copy adds nothing to a union
    polygons = materialise(polygons.withColumn("part", F.monotonically_increasing_id()), "polygons")
    rings = polygons.select("region_id", "part", F.explode("rings").alias("ring"))
    ends = rings.select("region_id", "part", F.explode(geo.ring_edges(F.col("ring"))).alias("e"))
    a, b = ((F.col("e")[k][0].cast("double"), F.col("e")[k][1].cast("double")) for k in ("a", "b"))
    first = a[0] < b[0]
    pick = lambda p, q: F.when(first, p).otherwise(q)
    edges = ends.select("region_id", "part", pick(a[0], b[0]).alias("ax"), pick(a[1], b[1]).alias("ay"), pick(b[0], a[0]).alias("bx"), pick(b[1], a[1]).alias("by")).where("ax < bx")
    edges = materialise(edges, "edges")
    sizes = edges.groupBy("region_id").agg(F.min("ax").alias("left"), F.max("bx").alias("right"), F.min(F.least("ay", "by")).alias("bottom"), F.max(F.greatest("ay", "by")).alias("top"), F.ceil(F.count("*") / STRIP_EDGES).alias("strips"))
    sized = join_small(edges, materialise(sizes.withColumn("wide", (F.col("right") - F.col("left")) / F.col("strips")), "strips"), "region_id")
    strip = lambda c: F.least(F.col("strips") - 1, F.floor((F.col(c) - F.col("left")) / F.col("wide")))
    cut = sized.withColumn("strip", F.explode(F.sequence(strip("ax"), strip("bx"))))
    border = lambda k: F.when(k == F.col("strips"), F.col("right")).otherwise(F.col("left") + k * F.col("wide"))
    cut = cut.withColumns({"lo": F.greatest("ax", border(F.col("strip"))), "hi": F.least("bx", border(F.col("strip") + 1))}).where("lo < hi")
    return materialise(cut.withColumn("edge", F.monotonically_increasing_id()), "pieces")


def _y(x: Column | str, of: str = "") -> Column:
    x, (ax, ay, bx, by) = F.col(x) if isinstance(x, str) else x, (F.col(f"{of}{c}") for c in ("ax", "ay", "bx", "by"))
    return ay + (x - ax) * ((by - ay) / (bx - ax))


def _crossings(pieces: DataFrame) -> DataFrame:
    """Where two pieces of a strip cross (region_id, strip, x). Only pieces that share a row of cells meet."""
    tall = F.greatest((F.col("top") - F.col("bottom")) / F.col("strips"), F.lit(1e-300))
    row = lambda c: F.floor((c - F.col("bottom")) / tall)
    ends = F.least(_y("lo"), _y("hi")), F.greatest(_y("lo"), _y("hi"))
    inside = lambda c: F.greatest(F.lit(0), F.least(F.col("strips"), c)).cast("long")
    rows = pieces.select("region_id", "strip", "edge", "ax", "ay", "bx", "by", "lo", "hi", F.explode(F.sequence(inside(row(ends[0])), inside(row(ends[1])))).alias("row"))
    other = rows.select("region_id", "strip", "row", *(F.col(c).alias(f"o_{c}") for c in ("edge", "ax", "ay", "bx", "by", "lo", "hi")))
    pairs = rows.join(other, ["region_id", "strip", "row"]).where("edge < o_edge")
    slope, o_slope = ((F.col(f"{p}by") - F.col(f"{p}ay")) / (F.col(f"{p}bx") - F.col(f"{p}ax")) for p in ("", "o_"))
    x = F.try_divide((F.col("o_ay") - o_slope * F.col("o_ax")) - (F.col("ay") - slope * F.col("ax")), slope - o_slope)
    return pairs.withColumn("x", x).where("x > greatest(lo, o_lo) and x < least(hi, o_hi)").select("region_id", "strip", "x")


def dissolve(regions: DataFrame) -> DataFrame:
    """The union of each region's polygons as trapezoids that don't overlap: region_id, x0, x1, and the lower and upper
    side's heights at both (low0, low1, high0, high1).

    Between neighbouring ends and crossings of edges no two edges cross: in such a slab, edges are sorted by height and
    counted from below, and what any polygon covers lies between the edges at which the count of polygons leaves 0 and
    returns to it. Regions are cut into strips of some ``STRIP_EDGES`` ends, so that a large region is no single group;
    the work grows with the edges that vertical lines through all ends would meet. Vertical edges bound slabs only. Equal
    polygons of a region count once, and a region may have several rows, whose polygons it unites."""
    pieces = _pieces(regions)
    ends = pieces.select("region_id", "strip", F.explode(F.array("lo", "hi")).alias("x")).unionByName(_crossings(pieces)).distinct()
    by_x = W.partitionBy("region_id", "strip").orderBy("x")
    slabs = materialise(ends.withColumn("x1", F.lead("x").over(by_x)).where("x1 is not null").withColumnRenamed("x", "x0"), "slabs")
    met = pieces.join(slabs, ["region_id", "strip"]).where("lo <= x0 and x1 <= hi")
    met = met.select("region_id", "part", "x0", "x1", _y("x0").alias("y0"), _y("x1").alias("y1"), _y((F.col("x0") + F.col("x1")) / 2).alias("y"))
    slab = ["region_id", "x0", "x1"]
    nth = F.row_number().over(W.partitionBy(*slab, "part").orderBy("y", "y0"))
    turned = met.withColumn("change", F.when(nth % 2 == 1, 1).otherwise(-1))
    upward = W.partitionBy(*slab).orderBy("y", F.col("change").desc(), "y0", "part")
    depth = turned.withColumn("depth", F.sum("change").over(upward.rowsBetween(W.unboundedPreceding, 0)))
    sides = depth.where("(change = 1 and depth = 1) or depth = 0")
    paired = sides.withColumns({"high0": F.lead("y0").over(upward), "high1": F.lead("y1").over(upward)}).where("depth = 1")
    return paired.select(*slab, F.col("y0").alias("low0"), F.col("y1").alias("low1"), "high0", "high1")


def areas(trapezoids: DataFrame) -> DataFrame:
    """Rows (region_id, area)."""
    each = (F.col("x1") - F.col("x0")) * (F.col("high0") - F.col("low0") + F.col("high1") - F.col("low1")) / 2
    return trapezoids.groupBy("region_id").agg(F.sum(each).alias("area"))


def _above(w: Column, a: Column, b: Column, level: Column) -> Column:
    """The area between a line that goes from height a to b over a width and what of it is under a level."""
    low, high = F.least(a, b), F.greatest(a, b)
    part = F.try_divide((high - level) * (high - level), 2 * (high - low))
    return w * F.when(low >= level, (low + high) / 2 - level).when(high <= level, 0.0).otherwise(part)


def overlaps(trapezoids: DataFrame, boxes: DataFrame, cells_per_side: int = 64) -> DataFrame:
    """Rows (region_id, box_id, area) of the intersections, with an area, of dissolved regions and boxes (box_id, min_x,
    min_y, max_x, max_y; they may overlap). Boxes and trapezoids meet by the columns of x that both lie in."""
    low, high = boxes.agg(F.min("min_x"), F.max("max_x")).first()
    if low is None or not high > low:
        return trapezoids.sparkSession.createDataFrame([], f"region_id {trapezoids.schema['region_id'].dataType.simpleString()}, box_id {boxes.schema['box_id'].dataType.simpleString()}, area double")
    column = lambda c: F.greatest(F.lit(0), F.least(F.lit(cells_per_side - 1), F.floor((F.col(c) - float(low)) / float(high - low) * cells_per_side)))
    left = trapezoids.where((F.col("x1") > float(low)) & (F.col("x0") < float(high))).withColumns({"first": column("x0"), "column": F.explode(F.sequence(column("x0"), column("x1")))})
    right = boxes.select("box_id", "min_x", "min_y", "max_x", "max_y", column("min_x").alias("o_first"), F.explode(F.sequence(column("min_x"), column("max_x"))).alias("column"))
    met = left.join(right, "column").where((F.col("column") == F.greatest("first", "o_first")) & (F.col("x0") < F.col("max_x")) & (F.col("x1") > F.col("min_x")))
    x0, x1 = F.greatest("x0", "min_x"), F.least("x1", "max_x")
    at = lambda side, x: F.col(f"{side}0") + (x - F.col("x0")) * ((F.col(f"{side}1") - F.col(f"{side}0")) / (F.col("x1") - F.col("x0")))

    def under(side: str) -> Column:
        """The area between the box's bottom and a side of the trapezoid, inside the box."""
        return _above(x1 - x0, at(side, x0), at(side, x1), F.col("min_y")) - _above(x1 - x0, at(side, x0), at(side, x1), F.col("max_y"))

    return met.groupBy("region_id", "box_id").agg(F.sum(under("high") - under("low")).alias("area")).where("area > 0")
