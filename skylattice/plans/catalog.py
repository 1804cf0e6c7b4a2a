"""The registered queries of the library and their DuckDB oracles.

The driver's tables stand in for the library's inputs: customers are sample points (longitude and latitude from a
portable uniform of the key), document texts are raw keywords, page addresses are file paths, events are outcomes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.functions import geo, text, vector
from skylattice.functions.random_u import draw_without_replacement, uniform
from skylattice.operators import captions, contrastive, evaluation, fetch, provision, retrieval, sampling, spatial, tiles
from skylattice.sources import tables, writers
from skylattice.sources.images import is_image
from skylattice.storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _r6(c):
    return F.round(c, 6)


# --- SQL pieces -----------------------------------------------------------------------------------------------------


def _u(key: str, salt) -> str:
    return f"(('0x' || substr(md5(concat({key}, ':{salt}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_POINTS = f"(SELECT c_custkey AS id, c_nationkey AS cell, {_u('c_custkey', 'lon')} * 360 - 180 AS lon, {_u('c_custkey', 'lat')} * 170.1 - 85.05 AS lat FROM customer)"


def _tx(zoom: str) -> str:
    return f"trunc((lon + 180) / 360 * pow(2.0::DOUBLE, {zoom}))::INTEGER"


def _ty(zoom: str) -> str:
    t = "tan(radians(lat))"
    return f"trunc((1 - sign({t}) * asinh(abs({t})) / pi()) / 2 * pow(2.0::DOUBLE, {zoom}))::INTEGER"


def _points(spark, d):
    c = _read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cell"), (uniform("c_custkey", "lon") * 360 - 180).alias("lon"), (uniform("c_custkey", "lat") * 170.1 - 85.05).alias("lat"))


# --- tiles ----------------------------------------------------------------------------------------------------------


@query(f"SELECT id, z::INTEGER AS zoom, {_tx('z')} AS x, {_ty('z')} AS y FROM {_POINTS}, generate_series(14, 18) AS g(z)")
def tile_index(spark, d):
    """Tile of every point at every zoom."""
    rows = _points(spark, d).withColumn("zoom", F.explode(F.sequence(F.lit(14), F.lit(18))))
    return rows.select("id", "zoom", geo.tile_x("lon", "zoom").alias("x"), geo.tile_y("lat", "zoom").alias("y"))


_CENTER = "round((x + 0.5) / pow(2.0::DOUBLE, 18) * 360 - 180, 6) AS lon, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 0.5) / pow(2.0::DOUBLE, 18))))), 6) AS lat"


@query(f"SELECT id, {_CENTER} FROM (SELECT id, {_tx('18')} AS x, {_ty('18')} AS y FROM {_POINTS})")
def tile_center(spark, d):
    """Centre of each point's tile."""
    rows = _points(spark, d).select("id", geo.tile_x("lon", 18).alias("x"), geo.tile_y("lat", 18).alias("y"))
    return rows.select("id", _r6(geo.tile_center_lon("x", 18)).alias("lon"), _r6(geo.tile_center_lat("y", 18)).alias("lat"))


@query(f"SELECT count(*) AS n, count(*) AS same FROM {_POINTS}")
def tile_roundtrip(spark, d):
    """P1 after P2 gives the same tile."""
    at = _points(spark, d).select(geo.tile_x("lon", 16).alias("x"), geo.tile_y("lat", 16).alias("y"))
    back = at.select("x", "y", geo.tile_x(geo.tile_center_lon("x", 16), 16).alias("bx"), geo.tile_y(geo.tile_center_lat("y", 16), 16).alias("by"))
    return back.agg(F.count("*").alias("n"), F.count_if((F.col("x") == F.col("bx")) & (F.col("y") == F.col("by"))).alias("same"))


_URL = geo.TILE_URL.replace("%d/%d/%d/%d", "")


@query(f"""SELECT id, concat_ws('_', '239', '17', x, y) AS file_name, concat_ws('/', '239', '17', x, y) AS key, concat('{_URL}', '239/17/', y, '/', x) AS url, 2018 AS year
FROM (SELECT id, {_tx('17')} AS x, {_ty('17')} AS y FROM {_POINTS})""")
def tile_url(spark, d):
    """Names, keys, addresses and years."""
    rows = _points(spark, d).select("id", geo.tile_x("lon", 17).alias("x"), geo.tile_y("lat", 17).alias("y"), F.lit(239).alias("r"), F.lit(17).alias("z"))
    return rows.select("id", geo.file_name("r", "z", "x", "y").alias("file_name"), geo.tile_key("r", "z", "x", "y").alias("key"), geo.tile_url("r", "z", "x", "y").alias("url"), geo.release_year("r").alias("year"))


def _draw(key: str, salt: str, values: list, weights: list | None, size: str) -> str:
    k = [f"{{'k': {_u(key, salt + str(i)) if weights is None else f'-ln(1 - {_u(key, salt + str(i))}) / {float(weights[i])}::DOUBLE'}, 'i': {i}, 'v': {v}}}" for i, v in enumerate(values)]
    return f"list_transform(list_slice(list_sort([{', '.join(k)}]), 1, {size}), lambda s: s.v)"


_RELEASES = "[" + ", ".join(f"{{'r': {r}, 'y': {y}}}" for r, y in geo.RELEASE_YEARS.items()) + "]"
_PLAN = f"""(WITH p AS (SELECT *, row_number() OVER (ORDER BY {_u('id', 'split')}, id) - 1 AS place, count(*) OVER () AS n FROM {_POINTS}),
m AS (SELECT *, place >= n - floor(n * 0.40::DOUBLE) AS is_multi_group FROM p),
q AS (SELECT *, CASE WHEN is_multi_group THEN {_draw('id', 'planR', list(geo.RELEASE_YEARS), None, f"(floor({_u('id', 'planr')} * 3) + 2)::INTEGER")} ELSE [26334] END AS rs,
             CASE WHEN is_multi_group THEN {_draw('id', 'planZ', sampling.ZOOMS, sampling.ZOOM_WEIGHTS, f"(floor({_u('id', 'planz')} * 3) + 1)::INTEGER")} ELSE [18] END AS zs FROM m),
e AS (SELECT q.*, zi, ri, zs[zi] AS zoom, rs[ri] AS release_id FROM q, generate_series(1, 3) AS a(zi), generate_series(1, 4) AS b(ri) WHERE zi <= len(zs) AND ri <= len(rs))
SELECT sha256(concat_ws('/', 'run', id)) AS group_id, is_multi_group, lon AS centroid_lon, lat AS centroid_lat, zoom::INTEGER AS zoom, release_id::INTEGER AS release_id,
  list_filter({_RELEASES}, lambda v: v.r = release_id)[1].y::INTEGER AS year, {_tx('zoom')} AS x, {_ty('zoom')} AS y,
  concat_ws('_', release_id, zoom, {_tx('zoom')}, {_ty('zoom')}) AS file_name, place * 100 + (zi - 1) * 10 + ri - 1 AS seq FROM e)"""


def _requests(spark, d):
    return sampling.request_plan(sampling.split_multi(_points(spark, d), "id"), "id")


@query(f"SELECT group_id, is_multi_group, round(centroid_lon, 6) AS centroid_lon, round(centroid_lat, 6) AS centroid_lat, zoom, release_id, year, file_name, seq FROM {_PLAN}")
def request_plan(spark, d):
    """The plan of requests (the mapping table, with its order)."""
    return _requests(spark, d).select(*tiles.MAPPING, "seq").withColumns({"centroid_lon": _r6("centroid_lon"), "centroid_lat": _r6("centroid_lat")})


@query(f"SELECT is_multi_group, zoom, release_id, year, count(*) AS requests, count(DISTINCT group_id) AS groups FROM {_PLAN} GROUP BY ALL")
def request_counts(spark, d):
    return _requests(spark, d).groupBy("is_multi_group", "zoom", "release_id", "year").agg(F.count("*").alias("requests"), F.countDistinct("group_id").alias("groups"))


# A coarse version of the plan, in which many requests share a tile.
_COARSE = f"(SELECT group_id, is_multi_group, 6 AS zoom, release_id, year, (x >> (zoom - 6))::INTEGER AS x, (y >> (zoom - 6))::INTEGER AS y, seq FROM {_PLAN})"
_UNIQUE = f"(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY release_id, zoom, x, y ORDER BY seq) AS rn FROM {_COARSE}) WHERE rn = 1)"
_KEY = "concat_ws('/', release_id, zoom, x, y)"


def _coarse(spark, d):
    r = _requests(spark, d)
    shift = lambda c: F.expr(f"shiftright({c}, zoom - 6)")
    return r.select("group_id", "is_multi_group", F.lit(6).alias("zoom"), "release_id", "year", shift("x").alias("x"), shift("y").alias("y"), "seq")


@query(f"SELECT group_id, is_multi_group, zoom, release_id, year, x, y, seq FROM {_UNIQUE}")
def unique_tiles(spark, d):
    """The first request of each tile."""
    return tiles.unique_tiles(_coarse(spark, d))


_DONE = f"(SELECT {_KEY} AS key FROM {_UNIQUE} WHERE {_u(_KEY, 'done')} < 0.3)"


@query(f"SELECT {_KEY} AS key, group_id, seq FROM {_UNIQUE} WHERE {_KEY} NOT IN (SELECT key FROM {_DONE})")
def todo_tiles(spark, d):
    """Tiles that aren't done."""
    unique = tiles.unique_tiles(_coarse(spark, d))
    done = tiles.with_key(unique).where(uniform("key", "done") < 0.3).select("key")
    return tiles.todo(unique, done).select("key", "group_id", "seq")


@query(f"SELECT r.group_id, count(*) AS requests, count(DISTINCT {_KEY.replace('release_id, zoom, x, y', 'r.release_id, r.zoom, r.x, r.y')}) AS tiles, min(t.seq) AS first_seq FROM {_COARSE} r JOIN {_UNIQUE} t USING (release_id, zoom, x, y) GROUP BY r.group_id")
def tile_groups(spark, d):
    """Groups rebuilt from requests and unique tiles."""
    name = geo.file_name(*tiles.TILE_KEYS).alias("file_name")
    mapped = _coarse(spark, d).select("group_id", name)
    content = F.encode(F.col("seq").cast("string"), "UTF-8").alias("image_bytes")
    unique = tiles.unique_tiles(_coarse(spark, d)).select(name, geo.tile_center_lat("y", "zoom").alias("tile_lat"), geo.tile_center_lon("x", "zoom").alias("tile_lon"), content)
    first = F.min(F.decode("image_bytes", "UTF-8").cast("long")).alias("first_seq")
    return tiles.tile_groups(mapped, unique).groupBy("group_id").agg(F.count("*").alias("requests"), F.countDistinct("file_name").alias("tiles"), first)


@query("""SELECT k AS cell_seq, greatest(0, least(e, 1000 - k * e))::BIGINT AS quota, (1000 // n + (k < 1000 % n)::BIGINT)::BIGINT AS balanced
FROM (SELECT n_nationkey::BIGINT AS k, count(*) OVER () AS n, ceil(1000 / count(*) OVER ())::BIGINT AS e FROM nation)""")
def grid_quota(spark, d):
    """Quotas of grid cells."""
    cells = _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("cell_seq"))
    both = sampling.cell_quotas(cells, 1000).join(sampling.cell_quotas(cells, 1000, balanced=True).withColumnRenamed("quota", "balanced"), "cell_seq")
    return both.select("cell_seq", "quota", "balanced")


@query(f"SELECT id, cell, nth FROM (SELECT id, cell, row_number() OVER (PARTITION BY cell ORDER BY {_u('id', 'pick')}, id) AS nth FROM {_POINTS}) WHERE nth <= 20")
def grid_assign(spark, d):
    """A quota of points in each cell."""
    return sampling.first_of_cell(_points(spark, d), "cell", 20, uniform("id", "pick"), "id").select("id", "cell", "nth")


_POLYGON = [[[-120.0, -50.0], [130.0, -40.0], [100.0, 60.0], [0.0, 20.0], [-100.0, 70.0], [-120.0, -50.0]], [[-40.0, -20.0], [40.0, -20.0], [40.0, 10.0], [-40.0, 10.0], [-40.0, -20.0]]]
_CROSS = " + ".join(f"(({ay}::DOUBLE > lat) <> ({by}::DOUBLE > lat) AND lon < ({bx}::DOUBLE - {ax}::DOUBLE) * (lat - {ay}::DOUBLE) / nullif({by}::DOUBLE - {ay}::DOUBLE, 0) + {ax}::DOUBLE)::INTEGER" for ring in _POLYGON for (ax, ay), (bx, by) in zip(ring, ring[1:]) if ay != by)


@query(f"SELECT id, cell, ({_CROSS}) % 2 = 1 AS inside FROM {_POINTS}")
def point_in_polygon(spark, d):
    """Points in a polygon with a hole."""
    rings = F.array(*(F.array(*(F.array(*map(F.lit, p)) for p in ring)) for ring in _POLYGON))
    return _points(spark, d).select("id", "cell", geo.in_rings(rings, "lon", "lat").alias("inside"))


_STAR = [(0, 3), (1, 1), (3, 0), (1, -1), (0, -3), (-1, -1), (-3, 0), (-1, 1), (0, 3)]
_SQUARE = [(1, 1), (4, 1), (4, 4), (1, 4), (1, 1)]
_CENTRES = "SELECT n_nationkey AS k, n_nationkey * 37 % 300 - 150 AS cx, n_nationkey * 53 % 140 - 70 AS cy, 3 + n_nationkey % 7 * 2 AS s FROM nation"
_SHAPE_EDGES = ", ".join(f"({part}, {ax}, {ay}, {bx}, {by})" for part, ring in enumerate((_STAR, _SQUARE)) for (ax, ay), (bx, by) in zip(ring, ring[1:]))


@query(f"""WITH r AS ({_CENTRES}), f(part, px, py, qx, qy) AS (VALUES {_SHAPE_EDGES}),
e AS (SELECT k, part, (cx + s * px)::DOUBLE AS px, (cy + s * py)::DOUBLE AS py, (cx + s * qx)::DOUBLE AS qx, (cy + s * qy)::DOUBLE AS qy FROM r, f)
SELECT DISTINCT id, k AS region_id FROM (SELECT id, k, part FROM {_POINTS} p JOIN e ON (py > lat) <> (qy > lat) AND lon < (qx - px) * (lat - py) / (qy - py) + px GROUP BY id, k, part HAVING count(*) % 2 = 1)""")
def points_in_regions(spark, d):
    """Points joined with many regions of overlapping polygons by quadtree cells."""
    return spatial.points_in_regions(_points(spark, d), _shapes(spark, d), "lon", "lat").select("id", "region_id")


def _shapes(spark, d):
    """A star and a square round a centre for each nation."""
    centres = _read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 37 % 300 - 150).alias("cx"), (F.col("n_nationkey") * 53 % 140 - 70).alias("cy"), (3 + F.col("n_nationkey") % 7 * 2).alias("s"))
    ring = lambda shape: F.array(*(F.array((F.col("cx") + F.col("s") * x).cast("double"), (F.col("cy") + F.col("s") * y).cast("double")) for x, y in shape))
    return centres.select(F.col("k").alias("region_id"), F.array(F.array(ring(_STAR)), F.array(ring(_SQUARE))).alias("polygons"))


def _by_nation(rows: DataFrame, ring) -> DataFrame:
    """A row of a region, with one polygon, for each row (nation)."""
    return rows.select(F.col("nation").alias("region_id"), F.array(F.array(F.array(*(F.array(x.cast("double"), y.cast("double")) for x, y in ring)))).alias("polygons"))


@query("""WITH c AS (SELECT c_nationkey AS k, c_custkey * 7919 % 200 AS x, c_custkey * 104729 % 200 AS y, 3 + c_custkey % 8 AS r FROM customer),
u AS (SELECT k, unnest(range(x + y - r, x + y + r)) AS u, x - y AS v, r FROM c), w AS (SELECT k, u, unnest(range(v - r, v + r)) AS v FROM u)
SELECT k AS region_id, round(count(DISTINCT (u, v)) / 2, 6) AS area FROM w GROUP BY k""")
def dissolved_area(spark, d):
    """A1: the union of a nation's diamonds, whose sides cross everywhere; turned by 45 degrees they are whole squares."""
    rows = _read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") * 7919 % 200).alias("x"), (F.col("c_custkey") * 104729 % 200).alias("y"), (3 + F.col("c_custkey") % 8).alias("r"))
    x, y, r = (F.col(c) for c in "xyr")
    regions = _by_nation(rows, [(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)])
    return spatial.areas(spatial.dissolve(regions)).select("region_id", _r6("area").alias("area"))


@query("""WITH s AS (SELECT s_nationkey AS k, s_suppkey * 37 % 190 AS x, s_suppkey * 91 % 190 AS y, 1 + s_suppkey % 9 AS w, 1 + s_suppkey % 10 AS h FROM supplier),
a AS (SELECT k, unnest(range(x, x + w)) AS x, y, h FROM s), b AS (SELECT DISTINCT k, x, unnest(range(y, y + h)) AS y FROM a)
SELECT k AS region_id, (x // 25) * 8 + y // 25 AS box_id, round(count(*)::DOUBLE, 6) AS area FROM b GROUP BY ALL""")
def region_overlaps(spark, d):
    """U3s, J2: the areas that a nation's rectangles share with the cells of a grid."""
    rows = _read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") * 37 % 190).alias("x"), (F.col("s_suppkey") * 91 % 190).alias("y"), (1 + F.col("s_suppkey") % 9).alias("w"), (1 + F.col("s_suppkey") % 10).alias("h"))
    x, y, w, h = (F.col(c) for c in "xywh")
    regions = _by_nation(rows, [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])
    boxes = spark.range(64).select(F.col("id").alias("box_id"), (F.expr("id div 8") * 25.0).alias("min_x"), (F.col("id") % 8 * 25.0).alias("min_y"))
    boxes = boxes.withColumns({"max_x": F.col("min_x") + 25, "max_y": F.col("min_y") + 25})
    return spatial.overlaps(spatial.dissolve(regions), boxes).select("region_id", "box_id", _r6("area").alias("area"))


def _sample_sql(total: int, rounds: int) -> str:
    """The sampling as SQL, as far as ``rounds`` rounds go; a cell that needed more would come short."""
    edges = ", ".join(f"({px}, {py}, {qx}, {qy})" for ring in _POLYGON for (px, py), (qx, qy) in zip(ring, ring[1:]))
    xs, ys = ([p[k] for ring in _POLYGON for p in ring] for k in (0, 1))

    def span(p, q, low, high):
        first, last = (f"({side} - {p}) / nullif({q} - {p}, 0)" for side in (low, high))
        flat = f"{p} = {q}"
        return f"CASE WHEN {flat} THEN CASE WHEN {p} > {low} AND {p} < {high} THEN 0.0 ELSE 2.0 END ELSE least({first}, {last}) END", f"CASE WHEN {flat} THEN 1.0 ELSE greatest({first}, {last}) END"

    (x0, x1), (y0, y1) = span("px", "qx", "min_x", "max_x"), span("py", "qy", "min_y", "max_y")
    parts = []
    for r in range(rounds):
        before = " UNION ALL ".join(f"SELECT cell_id FROM p{k}" for k in range(r))
        lack = f"SELECT k.*, quota - coalesce(got, 0) AS lack FROM k LEFT JOIN (SELECT cell_id, count(*) AS got FROM ({before}) GROUP BY cell_id) USING (cell_id)" if r else "SELECT *, quota AS lack FROM k"
        key = f"concat_ws('/', '0', cell_id, '{r}', i)"
        parts.append(f"""t{r} AS (SELECT *, unnest(range(greatest({1000 if r == 0 else 100}, 3 * lack) * {2**r})) AS i FROM ({lack}) WHERE lack > 0),
d{r} AS (SELECT cell_id, i, lx + {_u(key, 1)} * (hx - lx) AS lon, ly + {_u(key, 2)} * (hy - ly) AS lat FROM (SELECT *, greatest(min_x, {min(xs)}::DOUBLE) AS lx, least(max_x, {max(xs)}::DOUBLE) AS hx, greatest(min_y, {min(ys)}::DOUBLE) AS ly, least(max_y, {max(ys)}::DOUBLE) AS hy FROM t{r})),
p{r} AS (SELECT {r} AS round, * FROM d{r} WHERE ({_CROSS}) % 2 = 1)""")
    found = " UNION ALL ".join(f"SELECT * FROM p{r}" for r in range(rounds))
    return f"""WITH n AS (SELECT n_nationkey AS cell_id, (n_nationkey % 5 * 60 - 150)::DOUBLE AS min_x, (n_nationkey // 5 * 30 - 75)::DOUBLE AS min_y FROM nation),
c AS (SELECT *, min_x + 60 AS max_x, min_y + 30 AS max_y, min_x + 30 AS lon, min_y + 15 AS lat FROM n), e(px, py, qx, qy) AS (SELECT * FROM (VALUES {edges}) v(a, b, c, d)),
o AS (SELECT * FROM c WHERE ({_CROSS}) % 2 = 1 OR EXISTS (SELECT 1 FROM (SELECT px::DOUBLE AS px, py::DOUBLE AS py, qx::DOUBLE AS qx, qy::DOUBLE AS qy FROM e) WHERE greatest(0.0, {x0}, {y0}) < least(1.0, {x1}, {y1}))),
q AS (SELECT *, row_number() OVER (ORDER BY cell_id) - 1 AS cs, ceil({total} / count(*) OVER ())::BIGINT AS share FROM o),
k AS (SELECT * EXCLUDE (lon, lat), coalesce(sum(quota) OVER (ORDER BY cs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT *, greatest(0, least(share, {total} - cs * share)) AS quota FROM q) WHERE quota > 0),
{", ".join(parts)},
f AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round, i) AS nth FROM ({found}))
SELECT f.cell_id, (first + nth - 1)::BIGINT AS seq, lon, lat FROM f JOIN k USING (cell_id) WHERE nth <= quota"""


def _grid(spark, d):
    nation = _read(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    cells = nation.select(F.col("k").alias("cell_id"), (F.pmod("k", F.lit(5)) * 60.0 - 150).alias("min_x"), (F.floor(F.col("k") / 5) * 30.0 - 75).alias("min_y"))
    return cells.withColumns({"max_x": F.col("min_x") + 60, "max_y": F.col("min_y") + 30})


@query(_sample_sql(600, 4))
def region_sample(spark, d):
    """Grid-balanced points in a region."""
    region = F.array(F.array(*(F.array(*(F.array(*map(F.lit, p)) for p in ring)) for ring in _POLYGON)))
    return sampling.sample_in_region(_grid(spark, d), region, 600)


@query(f"""WITH r AS ({_CENTRES}), f(part, px, py, qx, qy) AS (VALUES {_SHAPE_EDGES})
SELECT k AS region_id, min((cx + s * px)::DOUBLE) AS min_x, min((cy + s * py)::DOUBLE) AS min_y, max((cx + s * px)::DOUBLE) AS max_x, max((cy + s * py)::DOUBLE) AS max_y FROM r, f GROUP BY k""")
def region_bounds(spark, d):
    """A2: boxes of regions."""
    return _shapes(spark, d).select("region_id", geo.bounds("polygons").alias("b")).select("region_id", "b.*")


@query(f"SELECT release, count(*) AS groups FROM (SELECT unnest(rs) AS release FROM (SELECT {_draw('id', 'shareR', list(geo.RELEASE_YEARS), None, '2')} AS rs FROM {_POINTS})) GROUP BY release")
def release_draws(spark, d):
    """Releases drawn without replacement."""
    drawn = draw_without_replacement("id", "shareR", list(geo.RELEASE_YEARS), None, F.lit(2))
    return _points(spark, d).select(F.explode(drawn).alias("release")).groupBy("release").agg(F.count("*").alias("groups"))


_EVENT_TILE = "event_id % 1000 AS x, event_id // 1000 AS y"


@query(f"""SELECT concat_ws('_', '239', '14', x, y) AS file_name, round((x + 0.5) / 16384 * 360 - 180, 6) AS tile_lon, octet_length(encode(props)) ::INTEGER AS n_bytes
FROM (SELECT props, event_id, {_EVENT_TILE} FROM events) WHERE event_id % 5 < 3 AND props IS NOT NULL AND event_id % 11 <> 0""")
def fetched_content(spark, d):
    """Outcomes joined to their requests, without those that brought no content."""
    e = _read(spark, d, "events").select("event_id", "props", (F.col("event_id") % 1000).cast("int").alias("x"), F.expr("cast(event_id div 1000 as int)").alias("y"))
    e = e.withColumns({"release_id": F.lit(239), "zoom": F.lit(14), "year": F.lit(2018), "group_id": F.col("event_id").cast("string"), "is_multi_group": F.lit(False)})
    tiles_of = e.withColumn("file_name", geo.file_name("release_id", "zoom", "x", "y"))
    content = F.when(F.col("event_id") % 11 != 0, F.col("props").cast("binary"))
    outcomes = e.select(geo.tile_key("release_id", "zoom", "x", "y").alias("key"), F.when(F.col("event_id") % 5 < 3, "ok").otherwise("failed").alias("status"), content.alias("image_bytes"))
    got = fetch.fetched_tiles(tiles_of.drop("event_id", "props"), outcomes)
    return got.select("file_name", _r6("tile_lon").alias("tile_lon"), F.octet_length("image_bytes").alias("n_bytes"))


@query("SELECT DISTINCT key FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('239/14/', o_custkey, '/1') END AS key FROM orders) WHERE key <> ''")
def done_keys(spark, d):
    """The distinct keys of a written list, without blanks round them and blank lines."""
    line = F.when(F.col("o_orderkey") % 7 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" 239/14/"), F.col("o_custkey").cast("string"), F.lit("/1 \t")))
    path = new_path(spark, "done-keys")
    _read(spark, d, "orders").select(line.alias("value")).write.text(path)
    return tables.read_done_keys(spark, path)


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 42")
def row_lookup(spark, d):
    """A row by its index."""
    return tables.row_at(_read(spark, d, "documents"), 42, "doc_id").select("doc_id", "lang", "source")


@query(f"SELECT id, cell, rn::BIGINT AS rn, ((rn - 1) // 64)::BIGINT AS batch_id FROM (SELECT id, cell, row_number() OVER (ORDER BY {_u('id', 'batches')}, id) AS rn FROM {_POINTS})")
def exact_batches(spark, d):
    """Batches of exactly 64 requests, and the places they come from."""
    points = _points(spark, d)
    placed = provision.global_rank(points, uniform("id", "batches"), "id").select("id", "cell", "rn")
    return placed.join(provision.exact_batches(points, "id", 64).select("id", "batch_id"), "id")


# --- text -----------------------------------------------------------------------------------------------------------

_WORDS = r"""list_filter(list_transform(string_split(text, ','), lambda s: regexp_replace(regexp_replace(s, '[\[\]()"'']', '', 'g'), '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
_UNIQUE_WORDS = f"(SELECT doc_id, list_filter(items, lambda s, k: list_position(list_transform(items, lambda t: lower(t)), lower(s)) = k) AS words FROM (SELECT doc_id, {_WORDS} AS items FROM documents))"


@query(f"SELECT doc_id, coalesce(array_to_string(words, ', '), '') AS keywords FROM {_UNIQUE_WORDS}")
def keyword_clean(spark, d):
    """Cleaned keyword lists."""
    return _read(spark, d, "documents").select("doc_id", text.clean_keywords("text").alias("keywords"))


@query(f"SELECT lang, count(*) AS docs, sum(len(words))::BIGINT AS keywords FROM {_UNIQUE_WORDS} JOIN documents USING (doc_id) GROUP BY lang")
def keyword_counts(spark, d):
    return _read(spark, d, "documents").select("lang", F.size(text.keyword_list("text")).alias("n")).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("keywords"))


@query("SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1")
def caption_success(spark, d):
    """successful rows only."""
    rows = _labelled(spark, d).select("doc_id", "lang", "source", "quality", "status")
    return captions.successes(rows)


def _labelled(spark, d):
    status = F.when(F.col("quality") == 1, "success").otherwise("failed: quality").alias("status")
    return _read(spark, d, "documents").join(_read(spark, d, "labels").select("doc_id", "quality"), "doc_id").select("*", status)


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'success' ELSE 'failed: quality' END AS status, coalesce(CASE WHEN l.quality = 1 THEN d.text END, 'None') AS caption FROM documents d JOIN labels l USING (doc_id)")
def caption_status(spark, d):
    """Status and caption of each labelled row, the word None where there is none."""
    kept = F.when(F.col("status") == "success", F.col("text"))
    return _labelled(spark, d).select("doc_id", "status", text.caption_text(kept, compat=True).alias("caption"))


@query("""SELECT d.doc_id::VARCHAR AS img_name, concat_ws(' ', nullif(d.text, ''), nullif(d.source, ''), nullif(d.lang, '')) AS caption, octet_length(encode(coalesce(d.text, '')))::INTEGER AS n_bytes
FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND concat_ws(' ', nullif(d.text, ''), nullif(d.source, ''), nullif(d.lang, '')) <> ''""")
def caption_assemble(spark, d):
    """Captions joined to their images, all parts of a caption together."""
    answers = F.col("text").alias("scene_caption"), F.col("source").alias("spatial_dense_caption"), F.col("lang").alias("keywords")
    answered = _labelled(spark, d).select(F.col("doc_id").cast("string").alias("id"), *answers, "status")
    images = _read(spark, d, "documents").select(F.col("doc_id").alias("img_name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("image_bytes"))
    joined = captions.assemble(captions.successes(answered), images, "all")
    return joined.select("img_name", "caption", F.octet_length("image_bytes").alias("n_bytes"))


# File names of several shapes made of page numbers.
_PATH = "concat(CASE page_id % 3 WHEN 0 THEN 'set_a/' ELSE 'b-c/' END, CASE page_id % 5 WHEN 0 THEN concat('dense_residential_', page_id, '.JPG') WHEN 1 THEN concat('sea-', page_id, '.png') WHEN 2 THEN 'beach.tar.gz' WHEN 3 THEN concat('_', page_id, '.tif') ELSE concat('park-x_', page_id, '.webp') END)"


def _paths(spark, d):
    return _read(spark, d, "pages").select("page_id", F.expr(_PATH).alias("path"))


_NAME = r"regexp_extract(path, '([^/]+)/*$', 1)"
_STEM = f"regexp_replace({_NAME}, '^(.+)\\.[^.]*$', '\\1')"


@query(f"""SELECT page_id, CASE WHEN contains(n, '_') THEN string_split(n, '_')[1] WHEN contains(n, '-') THEN string_split(n, '-')[1] ELSE regexp_replace(n, '^(.+)\\.[^.]*$', '\\1') END AS label,
CASE WHEN contains(n, '_') THEN regexp_replace(n, '_[^_]*$', '') WHEN contains(n, '-') THEN string_split(n, '-')[1] ELSE regexp_replace(n, '^(.+)\\.[^.]*$', '\\1') END AS last_label
FROM (SELECT page_id, {_NAME} AS n FROM (SELECT page_id, {_PATH} AS path FROM pages))""")
def label_from_name(spark, d):
    """Class labels of file names, in both modes."""
    return _paths(spark, d).select("page_id", text.label_from_path("path").alias("label"), text.label_from_path("path", "last").alias("last_label"))


@query(f"SELECT page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages) WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp|webp|tiff)$')")
def suffix_filter(spark, d):
    """Image files by suffix."""
    return _paths(spark, d).where(is_image("path"))


@query(f"SELECT page_id, {_NAME} AS name, {_STEM} AS stem FROM (SELECT page_id, {_PATH} AS path FROM pages)")
def stem_name(spark, d):
    """P10: base names and stems."""
    return _paths(spark, d).select("page_id", text.base_name("path").alias("name"), text.stem("path").alias("stem"))


@query("SELECT page_id, coalesce(CASE WHEN page_id % 4 <> 0 THEN url END, concat('image_', page_id, '.jpg')) AS path FROM pages WHERE page_id % 7 <> 0")
def image_paths(spark, d):
    """Rows with bytes, and default paths."""
    rows = _read(spark, d, "pages").select("page_id", F.struct(F.when(F.col("page_id") % 7 != 0, F.col("url").cast("binary")).alias("bytes"), F.when(F.col("page_id") % 4 != 0, F.col("url")).alias("path")).alias("image"))
    return writers.named_images(rows, "page_id").select("page_id", "path")


# --- provisioning ---------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {_u('doc_id', 'split')}, doc_id) AS rn, count(*) OVER () AS n FROM documents)")
def train_val_split(spark, d):
    """An exact random split."""
    return provision.train_val_split(_read(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"SELECT l_orderkey, l_linenumber, b AS batch_id, b // 16 AS step_id FROM (SELECT *, (row_number() OVER (ORDER BY {_u('k', '0-epoch-3')}, k) - 1) // 64 AS b, count(*) OVER () AS n FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS k FROM lineitem)) WHERE b < n // 64")
def epoch_batches(spark, d):
    """Shuffled full batches of an epoch."""
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return provision.epoch_batches(rows, "k", 3).drop("k")


@query("SELECT p_type, (row_number() OVER (ORDER BY p_type) - 1)::INTEGER AS code FROM (SELECT DISTINCT p_type FROM part)")
def class_codes(spark, d):
    """Dense codes of sorted classes."""
    return provision.class_codes(_read(spark, d, "part"), "p_type")


@query("SELECT step, round(CASE WHEN step < 2000 THEN step / 2000.0::DOUBLE ELSE greatest(0, 1 - (step - 2000) / 100000.0::DOUBLE) END, 6) AS factor FROM (SELECT o_orderkey * 7 AS step FROM orders)")
def lr_schedule(spark, d):
    """Learning-rate factors."""
    return _read(spark, d, "orders").select((F.col("o_orderkey") * 7).alias("step")).select("step", _r6(provision.lr_factor("step")).alias("factor"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 OR contains(p_name, 'bn') OR contains(p_name, 'ln') OR contains(p_name, 'bias') OR contains(p_name, 'logit_scale') THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS weight_decay FROM part")
def param_groups(spark, d):
    """weight decay by parameter name and rank."""
    rows = _read(spark, d, "part").select("p_partkey", "p_name", (F.col("p_size") % 3).alias("ndim"))
    return rows.select("p_partkey", provision.weight_decay("p_name", "ndim").alias("weight_decay"))


@query("SELECT event_type, count(*) FILTER (value >= 50) AS fetched, count(*) FILTER (NOT value >= 50) AS missing, count(*) AS requests FROM events GROUP BY event_type")
def fetch_summary(spark, d):
    """Counters of outcomes."""
    rows = _read(spark, d, "events").select("event_type", F.when(F.col("value") >= 50, "ok").otherwise("failed").alias("status"))
    return fetch.fetch_summary(rows, ["event_type"])


@query("SELECT (event_id % 8)::BIGINT AS epoch, round(avg(value) FILTER (event_id % 10 <> 0), 6) AS train_loss, round(avg(value) FILTER (event_id % 10 = 0), 6) AS val_loss FROM events GROUP BY 1")
def epoch_losses(spark, d):
    """Means of losses by epoch."""
    rows = _read(spark, d, "events").select((F.col("event_id") % 8).alias("epoch"), F.when(F.col("event_id") % 10 == 0, "val").otherwise("train").alias("split"), F.col("value").alias("loss"))
    return provision.epoch_means(rows).select("epoch", _r6("train_loss").alias("train_loss"), _r6("val_loss").alias("val_loss"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def keep_last(spark, d):
    """Of equal keys the last row."""
    return tiles.keep_last(_read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


# --- embeddings -----------------------------------------------------------------------------------------------------

_VEC = "(SELECT vec_id AS id, label, concat('d', vec_id % 3) AS dataset, embedding::DOUBLE[] AS vec FROM embeddings)"


def _ranked(by: str, self: bool) -> str:
    return f"""(WITH e AS (SELECT id, label, {by} AS dataset, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS vec FROM {_VEC}),
p AS (SELECT a.dataset, a.id, a.label, b.id AS cid, (a.label = b.label)::INTEGER AS rel, list_dot_product(a.vec, b.vec) AS sim FROM e a JOIN e b USING (dataset) {'' if self else 'WHERE a.id <> b.id'}),
r AS (SELECT *, row_number() OVER w AS rk, sum(rel) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM p WINDOW w AS (PARTITION BY dataset, id ORDER BY sim DESC, cid))
SELECT dataset, id, label, min(rk) FILTER (rel = 1) AS fr, coalesce(sum(rel * cum / rk) / nullif(sum(rel), 0), 0) AS ap FROM r GROUP BY ALL)"""


_METRICS = ", ".join([*(f'round(avg(coalesce((fr <= {k})::INTEGER, 0)), 6) AS "R@{k}"' for k in retrieval.KS), "round(avg(coalesce(1.0::DOUBLE / fr, 0)), 6) AS MRR", "round(avg(ap), 6) AS MAP"])


def _emb(spark, d, by_dataset: bool = False):
    rows = _read(spark, d, "embeddings")
    return retrieval.embeddings(rows, "vec_id", "label", "embedding", F.concat(F.lit("d"), (F.col("vec_id") % 3).cast("string")) if by_dataset else None)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_r6(f"`{f.name}`").alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields))


@query(f"SELECT dataset, count(*) AS num_images, {_METRICS} FROM {_ranked(chr(39) + 'all' + chr(39), True)} GROUP BY dataset")
def retrieval_metrics(spark, d):
    """The query itself among its candidates."""
    return _rounded(retrieval.summarise(retrieval.per_query(_emb(spark, d)), ["dataset"]))


@query(f"SELECT label, count(*) AS num_images, {_METRICS} FROM {_ranked(chr(39) + 'all' + chr(39), True)} GROUP BY label")
def retrieval_by_label(spark, d):
    return _rounded(retrieval.summarise(retrieval.per_query(_emb(spark, d)), ["label"]))


@query(f"SELECT label, count(*) AS num_images, {_METRICS} FROM {_ranked(chr(39) + 'all' + chr(39), False)} GROUP BY label")
def retrieval_excl_self(spark, d):
    return _rounded(retrieval.summarise(retrieval.per_query(_emb(spark, d), include_self=False), ["label"]))


_BY_SET = f"(SELECT dataset, count(*) AS num_images, {_METRICS.replace('round(', '(').replace(', 6)', ')')} FROM {_ranked('dataset', False)} GROUP BY dataset)"
_NAMES = [*(f"R@{k}" for k in retrieval.KS), "MRR", "MAP"]


@query("SELECT 'Average' AS dataset, sum(num_images)::BIGINT AS num_images, " + ", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in _NAMES) + f" FROM {_BY_SET}")
def retrieval_macro(spark, d):
    """Unweighted mean over data sets."""
    sets = retrieval.summarise(retrieval.per_query(_emb(spark, d, True), include_self=False), ["dataset"])
    return _rounded(retrieval.macro_average(sets))


_SHOWN = ", ".join(f"""printf('%.4f', "{c}") AS "{c}\"""" for c in _NAMES)


@query(f"""WITH s AS (SELECT m.*, k.num_classes FROM {_BY_SET} m JOIN (SELECT dataset, count(DISTINCT label) AS num_classes FROM {_VEC} GROUP BY dataset) k USING (dataset))
SELECT dataset, num_images, num_classes::VARCHAR AS num_classes, {_SHOWN} FROM s
UNION ALL SELECT 'Average', sum(num_images)::BIGINT, '-', {', '.join(f'''printf('%.4f', avg("{c}"))''' for c in _NAMES)} FROM s""")
def report_rows(spark, d):
    """A10, P19, U1s: rows of the report."""
    emb = _emb(spark, d, True)
    return retrieval.report_rows(evaluation.set_quality(emb, emb.select("dataset", F.col("label").alias("class")), include_self=False))


@query(f"SELECT id, rank, cid, round(sim, 6) AS sim FROM (SELECT id, cid, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cid) AS rank FROM (SELECT a.id, b.id AS cid, list_cosine_similarity(a.vec, b.vec) AS sim FROM {_VEC} a JOIN {_VEC} b ON a.id <> b.id)) WHERE rank <= 10")
def topk_neighbors(spark, d):
    """O1: ten nearest neighbours."""
    return retrieval.top_k(_emb(spark, d), 10).select("id", F.col("rank").cast("long").alias("rank"), "cid", _r6("sim").alias("sim"))


@query(f"SELECT a.id, concat('prompt ', b.id // 2) AS prompt, round(list_cosine_similarity(a.vec, b.vec), 6) AS score FROM {_VEC} a JOIN {_VEC} b ON b.id < 8 AND b.id % 2 = 1")
def zero_shot_scores(spark, d):
    """Image and prompt cosines; of equal prompts the last counts."""
    emb = _emb(spark, d)
    prompts = emb.where("id < 8").select(F.col("id").alias("pos"), F.concat(F.lit("prompt "), F.floor(F.col("id") / 2).cast("string")).alias("prompt"), "vec")
    return retrieval.zero_shot(emb.select("id", "vec"), prompts).select("id", F.explode("scores").alias("prompt", "score")).select("id", "prompt", _r6("score").alias("score"))


def _loss(where: str) -> str:
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings),
p AS (SELECT a.vec_id // 128 AS batch_id, a.vec_id % 128 AS i, b.vec_id % 128 - 64 AS j, list_cosine_similarity(a.vec, b.vec) / 0.07 AS v FROM e a JOIN e b ON a.vec_id // 128 = b.vec_id // 128 AND a.vec_id % 128 < 64 AND b.vec_id % 128 >= 64 WHERE {where}),
r AS (SELECT batch_id, i, ln(sum(exp(v))) - max(v) FILTER (i = j) AS l FROM p GROUP BY ALL), c AS (SELECT batch_id, j, ln(sum(exp(v))) - max(v) FILTER (i = j) AS l FROM p GROUP BY ALL)
SELECT batch_id, round((a.l + b.l) / 2, 6) AS loss FROM (SELECT batch_id, avg(l) AS l FROM r GROUP BY 1) a JOIN (SELECT batch_id, avg(l) AS l FROM c GROUP BY 1) b USING (batch_id)"""


def _pairs(spark, d):
    e = _emb(spark, d).select("id", "vec", F.floor(F.col("id") / 128).alias("batch_id"), (F.col("id") % 64).alias("i"), ((F.col("id") % 128) >= 64).alias("is_text"))
    image, caption = (e.where(F.col("is_text") == t).select("batch_id", "i", F.col("vec").alias(n)) for t, n in ((False, "image"), (True, "text")))
    return image.join(caption, ["batch_id", "i"])


@query(_loss("a.vec_id // 128 < (SELECT count(*) // 128 FROM embeddings)"))
def contrastive_loss_by_batch(spark, d):
    """Every full batch."""
    pairs = _pairs(spark, d)
    full = pairs.groupBy("batch_id").agg(F.count("*").alias("n")).where("n = 64").select("batch_id")
    return contrastive.contrastive_loss(pairs.join(full, "batch_id")).select("batch_id", _r6("loss").alias("loss"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_stats(spark, d):
    """Norms and the first maximum."""
    return _read(spark, d, "embeddings").select("vec_id", vector.first_argmax("embedding").alias("argmax"), _r6(vector.norm("embedding")).alias("norm"))
