"""Slippy-map tiles and planar geometry as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Imagery release ids and their years.
RELEASE_YEARS = {3026: 2014, 239: 2018, 45134: 2022, 26334: 2026}

# Fixed value: the tile address; the row comes before the column.
TILE_URL = "https://wayback.maptiles.arcgis.com/arcgis/rest/services/World_Imagery/WMTS/1.0.0/default028mm/MapServer/tile/%d/%d/%d/%d"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _tiles(zoom) -> Column:
    return F.pow(F.lit(2.0), _c(zoom))


def tile_x(lon, zoom) -> Column:
    """Column of the tile; truncated toward zero and not clamped (180 degrees gives 2^zoom)."""
    return ((_c(lon) + 180) / 360 * _tiles(zoom)).cast("int")


def tile_y(lat, zoom) -> Column:
    """Row of the tile; truncated toward zero and not clamped near the poles. asinh of a large negative number loses
    precision in the JVM, so it is taken of the magnitude."""
    t = F.tan(F.radians(_c(lat)))
    return ((1 - F.signum(t) * F.asinh(F.abs(t)) / math.pi) / 2 * _tiles(zoom)).cast("int")


def tile_center_lon(x, zoom) -> Column:
    return (_c(x) + 0.5) / _tiles(zoom) * 360 - 180


def tile_center_lat(y, zoom) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (_c(y) + 0.5) / _tiles(zoom)))))


def file_name(release, zoom, x, y) -> Column:
    return F.concat_ws("_", *(_c(v).cast("string") for v in (release, zoom, x, y)))


def tile_key(release, zoom, x, y) -> Column:
    return F.concat_ws("/", *(_c(v).cast("string") for v in (release, zoom, x, y)))


def tile_url(release, zoom, x, y) -> Column:
    return F.format_string(TILE_URL, _c(release), _c(zoom), _c(y), _c(x))


def release_year(release) -> Column:
    return F.create_map(*(F.lit(v) for kv in RELEASE_YEARS.items() for v in kv))[_c(release)]


def ring_edges(ring: Column) -> Column:
    """Structs (a, b) of neighbouring points of a closed ring."""
    return F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))


def in_rings(rings, x, y) -> Column:
    """Whether a point is inside a polygon of rings array<array<array<double>>> (closed; holes included), by crossings."""

    def crossings(ring: Column) -> Column:
        def crosses(e: Column) -> Column:
            (ax, ay), (bx, by) = ((e[k][0], e[k][1]) for k in ("a", "b"))
            at = (bx - ax) * (_c(y) - ay) / F.nullif(by - ay, F.lit(0.0)) + ax
            return F.coalesce(((ay > _c(y)) != (by > _c(y))) & (_c(x) < at), F.lit(False))

        return F.size(F.filter(ring_edges(ring), crosses))

    return F.pmod(F.aggregate(_c(rings), F.lit(0), lambda n, r: n + crossings(r)), F.lit(2)) == 1


def in_region(polygons, x, y) -> Column:
    """Whether a point is in any of several polygons (array of rings), overlapping or not."""
    return F.exists(_c(polygons), lambda p: in_rings(p, x, y))


def overlaps_box(polygons, min_x, min_y, max_x, max_y) -> Column:
    """Whether a region of polygons covers some area of a box: an edge runs through the inside of the box, or none does
    and the whole box, so its centre, is in the region. Touching isn't enough."""
    low_x, low_y, high_x, high_y = map(_c, (min_x, min_y, max_x, max_y))

    def span(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """Where, from 0 to 1 along an edge, one coordinate is between the sides of the box."""
        first, last = ((side - a) / F.nullif(b - a, F.lit(0.0)) for side in (low, high))
        inside = (a > low) & (a < high)
        begin = F.when(a == b, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(first, last))
        return begin, F.when(a == b, F.lit(1.0)).otherwise(F.greatest(first, last))

    def runs_through(e: Column) -> Column:
        (x0, x1), (y0, y1) = span(e["a"][0], e["b"][0], low_x, high_x), span(e["a"][1], e["b"][1], low_y, high_y)
        return F.greatest(F.lit(0.0), x0, y0) < F.least(F.lit(1.0), x1, y1)

    crossed = F.exists(_c(polygons), lambda p: F.exists(p, lambda ring: F.exists(ring_edges(ring), runs_through)))
    return crossed | in_region(polygons, (low_x + high_x) / 2, (low_y + high_y) / 2)


def bounds(polygons) -> Column:
    """Struct (min_x, min_y, max_x, max_y) of an array of polygons."""
    points = F.flatten(F.flatten(_c(polygons)))
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))
