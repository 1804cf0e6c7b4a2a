import os
import struct

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from skylattice.sources.geo_files import ShapefileSource, read_grid
from skylattice.sources.label_folders import write_label_folders


def files(path):
    return {os.path.relpath(os.path.join(at, f), path): open(os.path.join(at, f), "rb").read() for at, _, found in os.walk(path) for f in found}


def test_last_of_equal_names_stays(spark, tmp_path):
    rows = [("a", "1.png", b"old", 5), ("a", "1.png", b"new", 12), ("b", "1.png", b"other", 0), (None, "x", b"", None)]
    out = str(tmp_path / "out")
    write_label_folders(spark.createDataFrame(rows, "label string, file string, content binary, nth int").repartition(4), out)
    assert files(out) == {"a/1.png": b"new", "b/1.png": b"other", "x": b""}
    write_label_folders(spark.createDataFrame([("a", "2.png", b"2"), ("b", "1.png", b"later")], "label string, file string, content binary"), out)
    assert files(out) == {"a/1.png": b"new", "a/2.png": b"2", "b/1.png": b"later", "x": b""}


@pytest.mark.parametrize("bad", ["../up", "deep/er", ".hidden"])
def test_a_failed_job_leaves_no_file(spark, tmp_path, bad):
    out = str(tmp_path / "out")
    rows = spark.range(40).select(F.lit("a").alias("label"), F.when(F.col("id") == 33, bad).otherwise(F.concat("id", F.lit(".png"))).alias("file"), F.lit(b"x").alias("content")).repartition(4)
    with pytest.raises(PythonException):
        write_label_folders(rows, out)
    assert [f for f in files(out) if not f.startswith(".job-")] == [] and not [x for x in os.listdir(tmp_path) if x != "out"]


def shapefile(path, n):
    """Boxes i, i + 1 by 0, 1 with a hole, and the index of the file."""
    records, index, at = b"", b"", 100
    for i in range(n):
        rings = [[(i, 0), (i, 1), (i + 1, 1), (i + 1, 0), (i, 0)], [(i + 0.25, 0.25), (i + 0.75, 0.25), (i + 0.75, 0.75), (i + 0.25, 0.25)]]
        points = [p for r in rings for p in r]
        content = struct.pack("<i4dii2i", 5, i, 0, i + 1, 1, 2, len(points), 0, 5) + b"".join(struct.pack("<2d", *p) for p in points) if i != 3 else struct.pack("<i", 0)
        index += struct.pack(">ii", at // 2, len(content) // 2)
        records += struct.pack(">ii", i + 1, len(content) // 2) + content
        at += 8 + len(content)
    head = struct.pack(">i", 9994) + bytes(96)
    path.write_bytes(head + records)
    path.with_suffix(".shx").write_bytes(head + index)


def test_shapes_are_read_in_several_tasks(spark, tmp_path):
    path = tmp_path / "grid.shp"
    shapefile(path, 50)
    spark.dataSource.register(ShapefileSource)
    load = lambda **o: spark.read.format("polygon_shapefile").options(**o).load(str(path))
    several = load(partitionBytes=1000)
    assert several.select(F.spark_partition_id().alias("p")).distinct().count() > 5
    rows = sorted(several.collect())
    assert rows == sorted(load().collect()) and [r.feature for r in rows] == [i for i in range(50) if i != 3]
    assert rows[0].polygons[0][1][0] == [0.25, 0.25] and rows[7].max_x == 9.0
    assert read_grid(spark, str(path)).where("cell_id = 9 and min_x = 9 and max_y = 1").count() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        near = load(partitionBytes=1000, pushFilters="true").where("min_x >= 10 and max_x < 15 and feature <> 12")
        assert sorted(r.feature for r in near.collect()) == [10, 11, 13]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    path.with_suffix(".shx").unlink()
    assert sorted(load().collect()) == rows
    path.write_bytes(b"nothing")
    with pytest.raises(PythonException):
        load().collect()
