import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators import fetch, provision, sampling
from skylattice.sources.geo_files import region_literal
from tests.test_operators import client, nap, some_tiles


def test_batches_are_units_of_commit(spark, tmp_path, monkeypatch):
    out, plain, calls = str(tmp_path / "out"), fetch.fetched_tiles, []

    def crashes(part, outcomes):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("crash")
        return plain(part, outcomes)

    monkeypatch.setattr(fetch, "fetched_tiles", crashes)
    tiles = some_tiles(spark, 10).unionByName(some_tiles(spark, 2))  # two requested twice
    with pytest.raises(RuntimeError):
        fetch.run_batches(tiles, client, out, 4, tasks=2, sleep=nap)
    assert fetch.read_batches(spark, out).count() == 1 and fetch.read_tiles(spark, out).count() <= 4
    got = fetch.run_batches(tiles, client, out, 4, tasks=2, sleep=nap, clock=iter(range(100)).__next__).orderBy("batch_id").collect()
    sizes = [r["count"] for r in spark.read.parquet(f"{out}/plan").groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [4, 4, 2] and sum(r.fetched for r in got if r["try"] == 0) == 4 and sum(r.missing for r in got if r["try"] == 0) == 6
    assert spark.read.schema(fetch.TILES).parquet(f"{out}/tiles").count() == 4  # no tile twice
    assert all(r.rate == r.fetched / r.seconds for r in got if r.seconds)
    healed = lambda: lambda url, timeout: (200, b"x")
    last = fetch.run_batches(tiles, healed, out, 4, tasks=2, sleep=nap)
    assert last.groupBy("batch_id").agg(F.max_by("state", "try").alias("s")).where("s <> 'done'").count() == 0
    assert fetch.read_tiles(spark, out).count() == 8  # all but the two that don't exist
    assert fetch.run_batches(tiles, healed, out, 4, tasks=2, sleep=nap).count() == last.count()


def test_ordered_rank(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("n")).unionByName(spark.range(500).select(F.lit(5).cast("long").alias("k"), F.lit("y").alias("n")))
    got = provision.ordered_rank(rows.repartition(7), "k").orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1, 1501)) and [r.k for r in got] == sorted(r.k for r in got)
    batches = provision.epoch_batches(spark.range(10), "id", 0, 4, shuffle=False, drop_last=False)
    assert sorted((r.id, r.batch_id) for r in batches.collect()) == [(i, i // 4) for i in range(10)]


def test_points_do_not_depend_on_chunks(spark):
    ring = [[0.0, 0.0], [10.0, 0.0], [0.0, 10.0], [0.0, 0.0]]
    cells = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (2, 5.0, 0.0, 10.0, 5.0), (3, 9.0, 0.0, 10.0, 1.0), (4, 5.0, 5.0, 10.0, 10.0)], "cell_id int, min_x double, min_y double, max_x double, max_y double")
    draw = lambda rows: sorted(tuple(r) for r in sampling.sample_in_region(cells, region_literal([[ring]]), 3000, chunk_rows=rows).collect())
    whole = draw(1 << 20)
    assert [r[1] for r in sorted(whole, key=lambda r: r[1])] == list(range(3000)) and {r[0] for r in whole} == {1, 2, 3}
    assert draw(700) == whole
    many = sampling._in_chunks(cells.limit(1), F.lit(10_000_000), 1 << 16)
    sizes = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000_000 and len(sizes) > 50 and max(sizes) <= 10 * (1 << 16)
    points = sampling.sample_unstratified(spark, region_literal([[ring]]), 50)
    assert points.count() == 50 and points.where(~geo.in_region(region_literal([[ring]]), "lon", "lat")).count() == 0
