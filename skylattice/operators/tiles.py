"""Unique tiles, resumable work lists and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions import geo

TILE_KEYS = ["release_id", "zoom", "x", "y"]
MAPPING = ["group_id", "is_multi_group", "centroid_lat", "centroid_lon", "zoom", "release_id", "year", "file_name"]


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the first by ``order``. The minimum of a struct is taken, so copies of a key are reduced
    before the shuffle, and a frequent key doesn't gather in one task."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("first")).select(*keys, "first.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("last")).select(*keys, "last.*").select(*df.columns)


def unique_tiles(requests: DataFrame) -> DataFrame:
    return keep_first(requests, TILE_KEYS, "seq")


def mapping(requests: DataFrame, run_id: str | None = None) -> DataFrame:
    """One row per request; with a run id, mappings of several runs can be appended."""
    out = requests.select(*MAPPING)
    return out if run_id is None else out.withColumn("run_id", F.lit(run_id))


def with_key(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("key", geo.tile_key(*TILE_KEYS))


def todo(tiles: DataFrame, done: DataFrame) -> DataFrame:
    """Tiles whose key isn't among the done ones."""
    return with_key(tiles).join(done.select("key"), "key", "left_anti")


def tile_groups(mapped: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each request with its tile: the groups rebuilt after unique tiles were fetched."""
    return mapped.join(tiles.select("file_name", "tile_lat", "tile_lon", "image_bytes"), "file_name")
