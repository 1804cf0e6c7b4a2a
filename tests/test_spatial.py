import math
import random

import pytest

from skylattice.operators import spatial

SCHEMA = "region_id long, polygons array<array<array<array<double>>>>"


def inside(polygons, x, y):
    def odd(rings):
        edges = [(p, q) for r in rings for p, q in zip(r, r[1:])]
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in edges) % 2

    return any(odd(p) for p in polygons or [])


def star(r, x, y, size, n):
    ring = [[x + size * (0.3 + r.random()) * math.cos(2 * math.pi * k / n), y + size * (0.3 + r.random()) * math.sin(2 * math.pi * k / n)] for k in range(n)]
    return [ring + ring[:1]]


def clipped(polygon, clip):
    """Sutherland-Hodgman for convex counter-clockwise polygons."""
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: E731, B023
        out = []
        for p, q in zip(polygon, polygon[1:] + polygon[:1]):
            if side(p) >= 0:
                out.append(p)
            if (side(p) > 0) != (side(q) > 0) and side(p) != side(q):
                t = side(p) / (side(p) - side(q))
                out.append([p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])])
        polygon = out
        if not polygon:
            break
    return polygon


def area(polygon):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(polygon, polygon[1:] + polygon[:1])) / 2


@pytest.mark.parametrize("max_level", [0, 3, 8])
def test_points_equal_ray_casting(spark, max_level):
    r = random.Random(max_level)
    regions = [(k, [star(r, r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(1, 30), r.randint(3, 40)) for _ in range(r.randint(1, 3))]) for k in range(12)]
    square = [[0.0, 0.0], [8.0, 0.0], [8.0, 8.0], [0.0, 8.0], [0.0, 0.0]]
    hole = [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]]
    regions += [(12, [[square, hole]]), (13, []), (14, None)]
    points = [(i, r.uniform(-90, 90), r.uniform(-90, 90)) for i in range(600)] + [(600 + i, float(i % 9), float(i // 9)) for i in range(81)]
    points += [(700, None, 1.0), (701, math.nan, 1.0), (702, 3.0, 3.0)] + [(800 + i, 5.0, 5.0) for i in range(300)]
    got = spatial.points_in_regions(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(regions, SCHEMA), "x", "y", max_level)
    want = sorted((i, k) for i, x, y in points if x is not None for k, p in regions if inside(p, x, y))
    assert sorted((p.id, p.region_id) for p in got.collect()) == want
    assert got.columns == ["id", "x", "y", "region_id"]


def test_no_regions_or_points(spark):
    points, regions = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"), spark.createDataFrame([], SCHEMA)
    assert spatial.points_in_regions(points, regions, "x", "y").count() == 0
    assert spatial.dissolve(regions).count() == 0
    assert spatial.points_in_regions(points.limit(0), spark.createDataFrame([(1, [star(random.Random(1), 0, 0, 3, 5)])], SCHEMA), "x", "y").count() == 0


def test_union_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(spatial, "STRIP_EDGES", 3)  # several strips each
    r, regions, want = random.Random(2), [], {}
    for k in range(15):
        shapes = []
        while len(shapes) < 3:
            t = [[r.uniform(0, 10), r.uniform(0, 10)] for _ in range(3)]
            shapes.append(t if area(t) > 0 else t[::-1])
        a, b, c = shapes
        pair = lambda p, q: area(clipped(p, q)) if clipped(p, q) else 0.0
        all_three = clipped(clipped(a, b), c) if clipped(a, b) else []
        want[k] = area(a) + area(b) + area(c) - pair(a, b) - pair(a, c) - pair(b, c) + (area(all_three) if all_three else 0.0)
        regions.append((k, [[t + t[:1]] for t in shapes]))
    table = spark.createDataFrame(regions, SCHEMA)
    pieces = spatial.dissolve(table).cache()
    assert {x.region_id: x.area for x in spatial.areas(pieces).collect()} == pytest.approx(want)
    boxes = spark.createDataFrame([(i, 2.5 * (i % 4), 2.5 * (i // 4), 2.5 * (i % 4) + 2.5, 2.5 * (i // 4) + 2.5) for i in range(16)] + [(99, -5.0, -5.0, 50.0, 50.0)], "box_id int, min_x double, min_y double, max_x double, max_y double")
    shared = spatial.overlaps(pieces, boxes, 7).collect()
    assert {x.region_id: x.area for x in shared if x.box_id == 99} == pytest.approx(want)
    assert {k: sum(x.area for x in shared if x.region_id == k and x.box_id < 99) for k in want} == pytest.approx(want)


def test_holes_copies_and_shared_sides(spark):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    regions = [(1, [[square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)]]), (2, [[square(0.0, 0.0, 4.0)]] * 50), (3, [[square(0.0, 0.0, 2.0)], [square(2.0, 0.0, 2.0)], [square(0.0, 2.0, 2.0)]]), (4, [[square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)], [square(1.0, 1.0, 1.0)]])]
    got = spatial.dissolve(spark.createDataFrame(regions, SCHEMA))
    assert {x.region_id: x.area for x in spatial.areas(got).collect()} == pytest.approx({1: 12, 2: 16, 3: 12, 4: 13})


def test_copies_of_polygons_are_dissolved_once(spark):
    """Copies in a region, in one row or in many, go before edges are paired. Polygons of several rows are united as those
    of one."""
    diamond = lambda x, y, r: [[[x - r, y], [x, y - r], [x + r, y], [x, y + r], [x - r, y]]]
    distinct = [diamond(float(x), 0.0, 2.0) for x in range(3)]
    once, often = [(1, distinct)], [(1, distinct * 50)] + [(1, [p]) for p in distinct * 50]
    few, many = (spatial.dissolve(spark.createDataFrame(rows, SCHEMA)) for rows in (once, often))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert spatial._pieces(spark.createDataFrame(often, SCHEMA)).count() == 12
    assert [x.area for x in spatial.areas(many).collect()] == pytest.approx([8 + 2 * 3.5])
