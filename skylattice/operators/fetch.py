"""Fetching tiles through an injected client, with a table of outcomes for resuming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators.provision import exact_batches
from skylattice.operators.tiles import keep_first, todo, with_key

OUTCOME = "key string, status string, attempts int, http_code int, image_bytes binary"
TILES = "group_id string, is_multi_group boolean, zoom int, release_id int, year int, tile_lat double, tile_lon double, file_name string, image_bytes binary"
BATCHES = "batch_id long, try int, state string, fetched long, missing long, seconds double"
STATUS = "key string, status string, attempts int, http_code int"


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 4
    timeout: float = 15.0
    backoff: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0)


def fetch_one(get: Callable[[str, float], tuple[int, bytes]], url: str, policy: RetryPolicy = RetryPolicy(), sleep: Callable[[float], None] = time.sleep) -> tuple[str, int, int | None, bytes | None]:
    """(status, attempts, last code, content). 200 is ok and 404 final; anything else, errors and timeouts included, is
    tried again after a pause and ends as failed, which a later run tries anew."""
    code = None
    for attempt in range(policy.attempts):
        try:
            code, content = get(url, policy.timeout)
        except Exception:  # a client's error is an outcome of the request
            code, content = None, None
        if code == 200:
            return "ok", attempt + 1, code, content
        if code == 404:
            return "not_found", attempt + 1, code, None
        sleep(policy.backoff[min(attempt, len(policy.backoff) - 1)])
    return "failed", policy.attempts, code, None


def fetch(tiles: DataFrame, client: Callable[[], Callable[[str, float], tuple[int, bytes]]], concurrency: int = 150, tasks: int = 16, policy: RetryPolicy = RetryPolicy(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Outcome of each tile (with its key). ``client()`` is called once for each task; the tasks share the concurrency,
    which a waiting request keeps occupied."""
    each = max(1, concurrency // tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        get = client()
        with ThreadPoolExecutor(each) as pool:
            for frame in frames:
                for at in range(0, len(frame), 64 * each):
                    part = frame.iloc[at : at + 64 * each]
                    rows = list(pool.map(lambda url: fetch_one(get, url, policy, sleep), part["url"]))
                    yield pd.DataFrame([(k, *r) for k, r in zip(part["key"], rows)], columns=["key", "status", "attempts", "http_code", "image_bytes"]).astype({"http_code": "Int32"})

    rows = with_key(tiles).withColumn("url", geo.tile_url("release_id", "zoom", "x", "y")).select("key", "url").repartition(tasks)
    return rows.mapInPandas(run, OUTCOME)


def fetched_tiles(tiles: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Tiles with content, at the centre of the tile."""
    got = outcomes.where("status = 'ok' and image_bytes is not null").select("key", "image_bytes")
    rows = with_key(tiles).join(got, "key").withColumns({"tile_lat": geo.tile_center_lat("y", "zoom"), "tile_lon": geo.tile_center_lon("x", "zoom")})
    return rows.select(*(F.col(x.split()[0]) for x in TILES.split(", ")))


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """The latest outcomes; an absent table is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)
    return spark.read.schema(STATUS).parquet(path) if exists else spark.createDataFrame([], STATUS)


def run_fetch(tiles: DataFrame, client, out: str, batches: int = 1, **options) -> None:
    """Fetch what isn't done in ``batches`` commits: tiles are appended before their status, so a crash between the two
    costs a repeated fetch but never a tile. Only ok and not_found count as done. A repeated fetch may append a tile
    again; ``read_tiles`` keeps one."""
    spark = tiles.sparkSession
    for b in range(batches):
        done = read_status(spark, f"{out}/status").where("status in ('ok', 'not_found')").select("key").distinct()
        left = todo(tiles, done).drop("key")
        part = left.where(F.pmod(F.xxhash64("file_name"), F.lit(batches)) == b)
        outcome_path = f"{out}/outcomes/batch-{b:05d}-{int(time.time() * 1e6)}"
        fetch(part, client, **options).write.parquet(outcome_path)  # the side effect happens once; both tables derive from it
        outcomes = spark.read.schema(OUTCOME).parquet(outcome_path)
        fetched_tiles(part, outcomes).write.mode("append").parquet(f"{out}/tiles")
        outcomes.select("key", "status", "attempts", "http_code").write.mode("append").parquet(f"{out}/status")


def _stored(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """The tries of batches that ended: batch_id, try, state (done, or partial where requests failed), fetched, missing,
    seconds and rate."""
    states = spark.read.schema(BATCHES).parquet(f"{out}/batches") if _stored(spark, f"{out}/batches") else spark.createDataFrame([], BATCHES)
    return states.withColumn("rate", F.coalesce(F.try_divide(F.col("fetched").cast("double"), "seconds"), F.lit(0.0)))


def run_batches(tiles: DataFrame, client, out: str, batch_size: int = 50_000, clock: Callable[[], float] = time.monotonic, **options) -> DataFrame:
    """Fetch tiles in batches of exactly ``batch_size`` requests, each a unit of commit; returns ``read_batches``.

    The plan, which batch a tile is in, is stored first; a later run goes by it and takes no new tiles. The tables of a
    batch's try are replaced until its state is appended: after a crash a try is repeated as a whole and leaves no second
    copy. A batch with failed requests is partial, and a later run tries these again."""
    spark, plan = tiles.sparkSession, f"{out}/plan"
    if not _stored(spark, plan):
        exact_batches(keep_first(with_key(tiles), ["key"], "group_id"), "key", batch_size).write.mode("overwrite").partitionBy("batch_id").parquet(plan)
    planned = spark.read.parquet(plan)
    ended = read_batches(spark, out).groupBy("batch_id").agg(F.max("try").alias("last"), F.max_by("state", "try").alias("state"))
    open_batches = planned.select("batch_id").distinct().join(ended, "batch_id", "left").where("state is null or state <> 'done'")
    for r in open_batches.orderBy("batch_id").collect():  # a row for each open batch
        b, n = r.batch_id, 0 if r.last is None else r.last + 1
        part = planned.where(F.col("batch_id") == b).drop("batch_id")
        if n:
            earlier = spark.read.schema(OUTCOME).parquet(f"{out}/outcomes/batch_id={b}").where("status in ('ok', 'not_found')")
            part = part.join(earlier.select("key"), "key", "left_anti")
        place, began = f"batch_id={b}/try={n}", clock()
        fetch(part, client, **options).write.mode("overwrite").parquet(f"{out}/outcomes/{place}")
        outcomes = spark.read.schema(OUTCOME).parquet(f"{out}/outcomes/{place}")
        counts = fetch_summary(outcomes).first()
        fetched_tiles(part.drop("key"), outcomes).write.mode("overwrite").parquet(f"{out}/tiles/{place}")
        failed = outcomes.where("status = 'failed'").limit(1).count()
        row = [(b, n, "partial" if failed else "done", counts.fetched, counts.missing, float(clock() - began))]
        spark.createDataFrame(row, BATCHES).coalesce(1).write.mode("append").parquet(f"{out}/batches")
    return read_batches(spark, out)


def read_tiles(spark: SparkSession, out: str) -> DataFrame:
    """Each tile once: of copies that a repeated request left, the one of the smallest group."""
    return keep_first(spark.read.schema(TILES).parquet(f"{out}/tiles"), ["file_name"], "group_id")


def fetch_summary(outcomes: DataFrame, by: list[str] | None = None, elapsed: float | None = None) -> DataFrame:
    """Counts of outcomes, and the rate of fetched tiles (0 where no time has passed)."""
    aggs = [F.count_if(F.col("status") == "ok").alias("fetched"), F.count_if(F.col("status") != "ok").alias("missing"), F.count("*").alias("requests")]
    out = outcomes.groupBy(*(by or [])).agg(*aggs)
    return out if elapsed is None else out.withColumn("rate", F.coalesce(F.try_divide(F.col("fetched").cast("double"), F.lit(float(elapsed))), F.lit(0.0)))
