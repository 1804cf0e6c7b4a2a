"""Regions and grids: GeoJSON in WGS 84, and polygons of shapefiles through a Python data source."""

from __future__ import annotations

import operator
import os
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from skylattice.functions.geo import bounds

_GEOJSON = "type string, crs struct<properties:struct<name:string>>, geometry struct<type:string,coordinates:string>, features array<struct<geometry:struct<type:string,coordinates:string>>>"
_WGS84 = ("4326", "CRS84")


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Rows (feature, polygons): each feature's polygons as arrays of rings of [lon, lat]. Another reference system than
    WGS 84 is an error."""
    raw = spark.read.schema(_GEOJSON).option("multiLine", True).json(path)
    named = raw.where(F.col("crs.properties.name").isNotNull()).select("crs.properties.name").distinct().collect()  # a row per file at most
    if any(not r.name.rstrip("/").endswith(_WGS84) for r in named):
        raise ValueError("only WGS 84 (EPSG:4326) is read")
    rows = raw.select(F.posexplode(F.coalesce("features", F.array(F.struct(F.col("geometry"))))).alias("feature", "f")).select("feature", "f.geometry.*")
    polygon = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    multi = F.from_json("coordinates", "array<array<array<array<double>>>>")
    return rows.select("feature", F.when(F.col("type") == "Polygon", polygon).when(F.col("type") == "MultiPolygon", multi).alias("polygons")).where("polygons is not null")


def read_region(spark: SparkSession, path: str) -> list:
    """All polygons of a region file. A region is a boundary that a person drew; it becomes a literal of the plan."""
    return [p for r in read_polygons(spark, path).orderBy("feature").collect() for p in r.polygons]


def region_literal(polygons: list):
    return F.from_json(F.lit(str(polygons)), "array<array<array<array<double>>>>")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells (cell_id, min_x, min_y, max_x, max_y): the boxes of a GeoJSON or shapefile, or a Parquet table of them."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("cell_id", "min_x", "min_y", "max_x", "max_y")
    if path.endswith(".shp"):
        spark.dataSource.register(ShapefileSource)
        rows = spark.read.format("polygon_shapefile").load(path)
    else:
        rows = read_polygons(spark, path)
    return rows.select(F.col("feature").alias("cell_id"), bounds("polygons").alias("b")).select("cell_id", "b.*")


class ShapefileSource(DataSource):
    """Polygons of a .shp file with their boxes, on a path that all executors can open.

    Partitions are byte ranges of some ``partitionBytes`` (32 MB by default), planned from the .shx index beside the file;
    without an index the file is one partition. With the option ``pushFilters``, which needs
    ``spark.sql.python.filterPushdown.enabled``, comparisons of a box's columns with numbers are pushed down: shapes whose
    box fails them aren't parsed."""

    @classmethod
    def name(cls) -> str:
        return "polygon_shapefile"

    def schema(self) -> str:
        return "feature int, min_x double, min_y double, max_x double, max_y double, polygons array<array<array<array<double>>>>"

    def reader(self, schema):
        kind = _FilteringReader if str(self.options.get("pushFilters", "")).lower() == "true" else _ShapefileReader
        return kind(self.options["path"], int(self.options.get("partitionBytes", 32 << 20)))


@dataclass
class _Records(InputPartition):
    """Records from number ``first`` on, in a range of bytes."""

    first: int
    start: int
    end: int | None


class _ShapefileReader(DataSourceReader):
    compare = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}

    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes, self.boxes = path.removeprefix("file://"), partition_bytes, []

    def partitions(self):
        index = self.path[:-4] + ".shx"
        if not os.path.exists(index):
            return [_Records(0, 100, None)]
        with open(index, "rb") as f:
            offsets = 2 * np.frombuffer(f.read()[100:], ">i4").reshape(-1, 2).astype(np.int64)
        starts = offsets[:, 0]
        if not len(starts):
            return [_Records(0, 100, 100)]
        part = (starts - starts[0]) // self.partition_bytes
        firsts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        ends = [*(int(starts[i]) for i in firsts[1:]), int(starts[-1] + 8 + offsets[-1, 1])]
        return [_Records(i, int(starts[i]), end) for i, end in zip(firsts, ends)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            head = f.read(100)
            if len(head) < 100 or struct.unpack(">i", head[:4])[0] != 9994:
                raise ValueError(f"{self.path} is not a shapefile")
            f.seek(partition.start)
            feature = partition.first
            while (partition.end is None or f.tell() < partition.end) and (record := f.read(8)):
                content = f.read(2 * struct.unpack(">ii", record)[1])
                kind = struct.unpack_from("<i", content)[0]
                if kind in (5, 15, 25):
                    box = struct.unpack_from("<4d", content, 4)
                    if all(self.compare[test](box[k], value) for k, test, value in self.boxes):
                        yield feature, *box, _polygons(content)
                elif kind:
                    raise ValueError(f"shape type {kind} is no polygon")
                feature += 1


class _FilteringReader(_ShapefileReader):
    def pushFilters(self, filters):
        places = {("min_x",): 0, ("min_y",): 1, ("max_x",): 2, ("max_y",): 3}
        for f in filters:
            if type(f) in self.compare and f.attribute in places and isinstance(f.value, (int, float)):
                self.boxes.append((places[f.attribute], type(f), f.value))
            else:
                yield f


def _polygons(content: bytes) -> list:
    n_parts, n_points = struct.unpack_from("<ii", content, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", content, 44), n_points]
    points = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    return [[points[a:b].tolist() for a, b in zip(starts, starts[1:])]]  # crossings count holes and parts alike
