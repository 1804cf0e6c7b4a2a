"""Seeded, grid-balanced sampling and the plan of tile requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.functions import geo
from skylattice.functions.random_u import draw_without_replacement, uniform
from skylattice.operators.provision import global_rank
from skylattice.storage import join_small, materialise

# The plan of single and multi-scale, multi-year requests.
MULTI_FRACTION = "0.40"
SINGLE_ZOOM, SINGLE_RELEASE = 18, 26334
ZOOMS, ZOOM_WEIGHTS = [14, 15, 16, 17, 18], [0.10, 0.20, 0.25, 0.20, 0.25]

#: Rounds of rejection sampling before a cell that lacks points is an error; tries that a task numbers at a time, and
#: tasks in a round.
MAX_ROUNDS, CHUNK_ROWS, MAX_TASKS = 12, 1 << 16, 10_000


def cell_quotas(cells: DataFrame, total: int, order: str = "cell_seq", balanced: bool = False) -> DataFrame:
    """Cells (one row each, with a running number from 0) with ``quota``: an equal share rounded up, cut at the total
    in cell order; ``balanced`` shares differ by one at most instead."""
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    if balanced:
        share = F.floor(F.lit(total) / n) + (F.col(order) < F.pmod(F.lit(total), n)).cast("long")
    else:
        each = F.ceil(F.lit(total) / n)
        share = F.greatest(F.lit(0), F.least(each, F.lit(total) - F.col(order) * each))
    return cells.withColumn("quota", share.cast("long"))


def first_of_cell(points: DataFrame, cell: str, quota: int, *order) -> DataFrame:
    """The first ``quota`` points of each cell in an order, with their place ``nth``. A task keeps no more of a cell than
    that before the shuffle."""
    nth = F.row_number().over(W.partitionBy(cell).orderBy(*order))
    return points.withColumn("__nth", nth).where(F.col("__nth") <= quota).withColumn("nth", F.col("__nth").cast("long")).drop("__nth")


def overlapping_cells(cells: DataFrame, region: Column) -> DataFrame:
    """Cells (min_x, min_y, max_x, max_y) that share an area with the region; a shared edge isn't enough. Cells outside
    the region's box are dropped before its edges are looked at."""
    b = geo.bounds(region)
    near = cells.where((F.col("min_x") < b["max_x"]) & (F.col("max_x") > b["min_x"]) & (F.col("min_y") < b["max_y"]) & (F.col("max_y") > b["min_y"]))
    return near.where(geo.overlaps_box(region, "min_x", "min_y", "max_x", "max_y"))


def _in_chunks(cells: DataFrame, tries: Column, chunk_rows: int) -> DataFrame:
    """``cells`` with ``chunk`` and ``i``, the numbers of its tries: chunks are dealt to tasks, which then number theirs."""
    counted = materialise(cells.withColumn("tries", tries.cast("long")), "tries")
    n = counted.agg(F.sum(F.expr(f"(tries - 1) div {chunk_rows} + 1"))).first()[0]
    chunks = counted.withColumn("chunk", F.explode(F.expr(f"sequence(0, (tries - 1) div {chunk_rows})")))
    dealt = chunks.repartition(min(int(n), MAX_TASKS), "cell_id", "chunk")
    return dealt.withColumn("i", F.explode(F.expr(f"sequence(chunk * {chunk_rows}, least(tries, (chunk + 1) * {chunk_rows}) - 1)"))).drop("tries")


def sample_in_region(cells: DataFrame, region: Column, total: int, seed: str = "0", max_rounds: int = MAX_ROUNDS, balanced: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Points (cell_id, seq, lon, lat) uniform in degrees inside each cell and the region, by rejection.

    The first round draws three candidates for each point of a cell, later ones for each that it still lacks, twice as
    many in each round, all as expressions of the cell, round and number, so reruns agree. Numbers are dealt to tasks in
    chunks, and the places of points in a cell come from counts of chunks: no cell is one task, and the points are the
    same for any size of chunks. The points of a round are stored, not drawn again. A cell that stays short after
    ``max_rounds`` is an error, not an endless loop."""
    cells = overlapping_cells(cells, region).withColumn("cell_seq", (F.row_number().over(W.orderBy("cell_id")) - 1).cast("long"))
    quotas = materialise(cell_quotas(cells, total, balanced=balanced).where("quota > 0"), "quotas")
    if not quotas.limit(1).count():
        raise ValueError("no grid cell overlaps the region")
    b = geo.bounds(region)
    lacking, found = quotas.withColumn("lack", F.col("quota")), None
    for r in range(max_rounds):
        tries = F.greatest(F.lit(1000) if r == 0 else F.lit(100), 3 * F.col("lack")) * 2**r
        drawn = _in_chunks(lacking.select("cell_id", "lack", "min_x", "min_y", "max_x", "max_y"), tries, chunk_rows)
        key = F.concat_ws("/", F.lit(seed), F.col("cell_id").cast("string"), F.lit(str(r)), F.col("i").cast("string"))
        low_x, high_x = F.greatest("min_x", b["min_x"]), F.least("max_x", b["max_x"])
        low_y, high_y = F.greatest("min_y", b["min_y"]), F.least("max_y", b["max_y"])
        points = drawn.withColumns({"lon": low_x + uniform(key, 1) * (high_x - low_x), "lat": low_y + uniform(key, 2) * (high_y - low_y)}).where(geo.in_region(region, "lon", "lat"))
        points = materialise(points.select("cell_id", F.lit(r).alias("round"), "chunk", "i", "lon", "lat"), "points")
        found = points if found is None else found.unionByName(points)
        got = found.groupBy("cell_id").agg(F.count("*").alias("got"))
        lacking = quotas.join(got, "cell_id", "left").withColumn("lack", F.col("quota") - F.coalesce("got", F.lit(0))).drop("got").where("lack > 0")
        if not lacking.limit(1).count():
            break
    else:
        raise ValueError(f"cells stay short of points after {max_rounds} rounds")
    per_cell = W.partitionBy(F.lit(0)).orderBy("cell_seq").rowsBetween(W.unboundedPreceding, -1)  # one row per cell
    firsts = quotas.select("cell_id", "quota", F.coalesce(F.sum("quota").over(per_cell), F.lit(0)).alias("first"))
    earlier = W.partitionBy("cell_id").orderBy("round", "chunk").rowsBetween(W.unboundedPreceding, -1)  # one row per chunk
    sizes = found.groupBy("cell_id", "round", "chunk").agg(F.count("*").alias("n"))
    starts = sizes.select("cell_id", "round", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    needed = materialise(starts.join(firsts, "cell_id").where("start < quota"), "chunk-starts")
    inside = F.row_number().over(W.partitionBy("cell_id", "round", "chunk").orderBy("i"))
    ranked = join_small(found, needed, ["cell_id", "round", "chunk"]).withColumn("nth", F.col("start") + inside).where("nth <= quota")
    return ranked.select("cell_id", (F.col("first") + F.col("nth") - 1).alias("seq"), "lon", "lat")


def sample_unstratified(spark: SparkSession, region: Column, total: int, seed: str = "0") -> DataFrame:
    """Points (seq, lon, lat) uniform in degrees inside the region: one cell, its box."""
    cell = spark.range(1).select(F.lit(0).alias("cell_id"), geo.bounds(region).alias("b")).select("cell_id", "b.*")
    return sample_in_region(cell, region, total, seed).drop("cell_id")


def split_multi(points: DataFrame, key: str, seed: str = "split") -> DataFrame:
    """Points with is_multi_group: exactly floor(0.4 n) of them, in random order; ``place`` is the order of requests,
    singles first."""
    n = points.count()
    single = n - int(n * float(MULTI_FRACTION))
    placed = global_rank(points, uniform(key, seed), key, n).withColumn("place", (F.col("rn") - 1).cast("long")).drop("rn")
    return placed.withColumn("is_multi_group", F.col("place") >= single)


def request_plan(points: DataFrame, key: str = "seq", run_id: str = "run", seed: str = "plan") -> DataFrame:
    """Tile requests of points (key, lon, lat, is_multi_group, place): one for a single point; for a multi-group point
    every drawn zoom with every drawn release. ``seq`` is the order of requests."""
    k = F.col(key)
    n_releases = (F.floor(uniform(k, f"{seed}r") * 3) + 2).cast("int")
    n_zooms = (F.floor(uniform(k, f"{seed}z") * 3) + 1).cast("int")
    releases = F.when(F.col("is_multi_group"), draw_without_replacement(k, f"{seed}R", list(geo.RELEASE_YEARS), None, n_releases)).otherwise(F.array(F.lit(SINGLE_RELEASE)))
    zooms = F.when(F.col("is_multi_group"), draw_without_replacement(k, f"{seed}Z", ZOOMS, ZOOM_WEIGHTS, n_zooms)).otherwise(F.array(F.lit(SINGLE_ZOOM)))
    rows = points.withColumns({"releases": releases, "zooms": zooms}).select("*", F.posexplode("zooms").alias("zoom_at", "zoom")).select("*", F.posexplode("releases").alias("release_at", "release_id"))
    rows = rows.withColumns({"x": geo.tile_x("lon", "zoom"), "y": geo.tile_y("lat", "zoom"), "year": geo.release_year("release_id")})
    return rows.select(
        F.sha2(F.concat_ws("/", F.lit(run_id), k.cast("string")), 256).alias("group_id"), "is_multi_group", F.col("lon").alias("centroid_lon"), F.col("lat").alias("centroid_lat"),
        "zoom", "release_id", "year", "x", "y", geo.file_name("release_id", "zoom", "x", "y").alias("file_name"), (F.col("place") * 100 + F.col("zoom_at") * 10 + F.col("release_at")).alias("seq"),
    )
