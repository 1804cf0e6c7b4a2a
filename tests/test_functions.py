import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skylattice.functions import geo, text, vector
from skylattice.functions.random_u import draw_without_replacement, uniform
from skylattice.operators import sampling

TILES = [(0, 0, 18, 131072, 131072), (51.5074, -0.1278, 18, 130978, 87169), (40.7128, -74.006, 16, 19295, 24640), (-33.8688, 151.2093, 14, 15073, 9831), (85.0511287798066, -180, 14, 0, 0), (0, 180, 14, 16384, 8192), (89.9, 0, 14, 8192, -10175), (-89.9, 0, 14, 8192, 26559)]
KEYWORDS = [(None, ""), ("", ""), (" ", ""), (",,,", ""), ("Tree, tree , TREE", "Tree"), ('[a], (b), "c"', "a, b, c"), ("( tree ), [ tree ]", "tree"), ("a,b,", "a, b"), ("É,é,e", "É, e"), ("ß,SS,ss", "ß, SS"), ("　w,w", "w"), ("x'y,xy", "xy")]
LABELS = [("Mountain_33.jpg", "Mountain"), ("a/b/dense_residential_7.jpg", "dense"), ("x-y-1.png", "x"), ("a-b_c.jpg", "a-b"), ("beach.jpg", "beach"), ("dir_1/plain.jpg", "plain"), ("_a.jpg", ""), ("-b.png", ""), ("a.tar.gz", "a.tar"), (".jpg", ".jpg")]


def test_tiles(spark):
    df = spark.createDataFrame([(float(a), float(b), z, x, y) for a, b, z, x, y in TILES], "lat double, lon double, z int, x int, y int")
    got = df.select("x", "y", geo.tile_x("lon", "z").alias("gx"), geo.tile_y("lat", "z").alias("gy")).collect()
    assert all((r.x, r.y) == (r.gx, r.gy) for r in got)


@pytest.mark.parametrize("x,y,z,lon,lat", [(131072, 131072, 18, 0.0006866455078125, -0.0006866455077960638), (15073, 9831, 14, 151.204833984375, -33.861293113515515), (0, 0, 14, -179.989013671875, 85.05018093458116)])
def test_tile_centers(spark, x, y, z, lon, lat):
    r = spark.range(1).select(geo.tile_center_lon(x, z).alias("lon"), geo.tile_center_lat(y, z).alias("lat")).first()
    assert (r.lon, r.lat) == pytest.approx((lon, lat), abs=1e-9)


def test_round_trip_of_random_tiles(spark):
    df = spark.range(20_000).select((uniform("id", 1) * 16384).cast("int").alias("x"), (uniform("id", 2) * 16384).cast("int").alias("y"))
    back = df.select("x", "y", geo.tile_x(geo.tile_center_lon("x", 14), 14).alias("bx"), geo.tile_y(geo.tile_center_lat("y", 14), 14).alias("by"))
    assert back.where("x <> bx or y <> by").count() == 0


def test_keywords(spark):
    df = spark.createDataFrame(KEYWORDS, "raw string, want string")
    assert df.where(text.clean_keywords("raw") != F.col("want")).count() == 0
    again = df.select(text.clean_keywords("raw").alias("a")).select("a", text.clean_keywords("a").alias("b"))
    assert again.where("a <> b").count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aAbB éÉ,'[]() \t　\x1c", max_size=20), min_size=20, max_size=40))
def test_keywords_equal_plain_python(spark, raws):
    def plain(raw):
        seen, out = set(), []
        for part in raw.split(","):
            word = "".join(c for c in part if c not in "[]()\"'").strip()
            if word and word.lower() not in seen:
                seen.add(word.lower())
                out.append(word)
        return ", ".join(out)

    got = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", text.clean_keywords("raw").alias("k")).collect()
    assert all(g.k == plain(g.raw) for g in got)


def test_labels(spark):
    df = spark.createDataFrame(LABELS, "path string, want string")
    got = df.select("path", "want", text.label_from_path("path").alias("got"), text.label_from_path("path", "last").alias("last")).collect()
    assert all(r.got == r.want for r in got)
    assert next(r.last for r in got if "dense" in r.path) == "dense_residential"


def test_rings_with_a_hole(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    rings = F.array(*(F.array(*(F.array(*(F.lit(float(v)) for v in p)) for p in ring)) for ring in (square(0, 4), square(1, 2))))
    df = spark.createDataFrame([(0.5, 0.5, True), (1.5, 1.5, False), (3.0, 3.0, True), (5.0, 1.0, False)], "x double, y double, want boolean")
    assert df.where(geo.in_rings(rings, "x", "y") != F.col("want")).count() == 0
    both = F.array(rings, rings)  # overlapping parts: a point in both is inside
    assert df.where(geo.in_region(both, "x", "y") != F.col("want")).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = df.select(vector.normalise("v").alias("a"), vector.normalise("v", guarded=False).alias("b"), vector.first_argmax("v").alias("m")).collect()
    assert list(got[0].a) == [0.6, 0.8] and got[0].m == 1
    assert list(got[1].a) == [0.0, 0.0] and list(got[1].b) == [None, None] and got[1].m == 0


def test_weighted_draws_have_the_exact_shares(spark):
    n = 30_000
    k = (F.floor(uniform("id", "k") * 3) + 1).cast("int")
    drawn = spark.range(n).select(F.explode(draw_without_replacement("id", "z", sampling.ZOOMS, sampling.ZOOM_WEIGHTS, k)).alias("z"))
    got = {r.z: r["count"] for r in drawn.groupBy("z").count().collect()}
    total = sum(got.values())
    assert total / n == pytest.approx(2, abs=0.02)
    for z, share in {14: 0.1129, 15: 0.2038, 16: 0.2398, 17: 0.2038, 18: 0.2398}.items():
        assert got[z] / total == pytest.approx(share, abs=0.006)


def test_uniform_is_independent_by_salt(spark):
    r = spark.range(20_000).agg(F.corr(uniform("id", 1), uniform("id", 2)).alias("c"), F.avg(uniform("id", 1)).alias("m")).first()
    assert abs(r.c) < 0.03 and r.m == pytest.approx(0.5, abs=0.01) and math.isfinite(r.c)


def test_blanks_are_stripped_in_linear_time(spark):
    long = " " * 2_000_000
    words = [f"a{long}b", f"{long}a{long}b{long}", long, "\u3000a\x1c ", "a\nb \n"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").coalesce(1).cache()
    rows.count()
    began = time.perf_counter()
    got = [r.s for r in rows.select("i", text.strip("w").alias("s")).orderBy("i").collect()]
    assert time.perf_counter() - began < 10
    assert got == [f"a{long}b", f"a{long}b", "", "a", "a\nb"]
