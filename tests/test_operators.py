import json
import struct
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice import storage
from skylattice.functions import text, vector
from skylattice.functions.random_u import uniform
from skylattice.operators import captions, contrastive, fetch, models, provision, retrieval, sampling, tiles
from skylattice.sources import config, geo_files, images, tables, writers
from skylattice.streaming.requests import fetch_stream




SQUARE = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]


def grid(spark):
    cells = [(i, 5.0 * (i % 3), 5.0 * (i // 3), 5.0 * (i % 3) + 5, 5.0 * (i // 3) + 5) for i in range(6)]  # the third column only touches
    return spark.createDataFrame(cells, "cell_id int, min_x double, min_y double, max_x double, max_y double")


def test_sampling_is_exact_balanced_and_repeatable(spark):
    region = geo_files.region_literal([SQUARE])
    got = sampling.sample_in_region(grid(spark), region, 10).collect()
    assert sorted(r.seq for r in got) == list(range(10))
    per = {}
    for r in got:
        per[r.cell_id] = per.get(r.cell_id, 0) + 1
        assert 0 < r.lon < 10 and 0 < r.lat < 10
    assert per == {0: 3, 1: 3, 3: 3, 4: 1}
    assert sorted(map(tuple, got)) == sorted(map(tuple, sampling.sample_in_region(grid(spark).repartition(3), region, 10).collect()))
    even = sampling.sample_in_region(grid(spark), region, 10, balanced=True).groupBy("cell_id").count().collect()
    assert sorted(r["count"] for r in even) == [2, 2, 3, 3]


def test_unstratified_sampling(spark):
    triangle = [[[0.0, 0.0], [4.0, 0.0], [0.0, 4.0], [0.0, 0.0]]]
    got = sampling.sample_unstratified(spark, geo_files.region_literal([triangle]), 200).collect()
    assert sorted(r.seq for r in got) == list(range(200)) and all(r.lon > 0 and r.lat > 0 and r.lon + r.lat < 4 for r in got)


def test_sampling_fails_where_no_cell_overlaps(spark):
    far = [[[x + 100, y] for x, y in SQUARE[0]]]
    with pytest.raises(ValueError):
        sampling.sample_in_region(grid(spark), geo_files.region_literal([far]), 10)


def test_cells_outside_a_concave_or_parted_region_get_no_quota(spark):
    """Cells of the region's box that miss the region, touch it, or lie in a hole have no share."""
    nine = [(i, 10.0 * (i % 3), 10.0 * (i // 3), 10.0 * (i % 3) + 10, 10.0 * (i // 3) + 10) for i in range(9)]
    cells = spark.createDataFrame(nine, "cell_id int, min_x double, min_y double, max_x double, max_y double")
    ring = lambda *p: [[float(x), float(y)] for x, y in (*p, p[0])]
    box = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d))
    shapes = {
        "c": ([[ring((0, 0), (30, 0), (30, 10), (10, 10), (10, 20), (30, 20), (30, 30), (0, 30))]], {0, 1, 2, 3, 6, 7, 8}),
        "parts": ([[box(1, 1, 9, 9)], [box(21, 21, 29, 29)], [box(-5, -5, 0, 0)]], {0, 8}),
        "hole": ([[box(0, 0, 30, 30), box(10, 10, 20, 20)]], {0, 1, 2, 3, 5, 6, 7, 8}),
        "inside one cell": ([[box(12, 12, 13, 13)]], {4}),
        "around all": ([[box(-9, -9, 99, 99)]], set(range(9))),
        "diagonal": ([[ring((0, 1), (29, 30), (0, 30))]], {0, 3, 4, 6, 7, 8}),
    }
    for name, (region, want) in shapes.items():
        literal = geo_files.region_literal(region)
        assert {r.cell_id for r in sampling.overlapping_cells(cells, literal).collect()} == want, name
        got = sampling.sample_in_region(cells, literal, 45).collect()
        assert len(got) == 45 and sorted(r.seq for r in got) == list(range(45)), name


def test_sampling_fills_a_sliver(spark):
    """A cell of which the region covers a five-hundredth takes more rounds, each of twice the draws."""
    sliver = [[[0.0, 0.0], [5.0, 0.0], [5.0, 5.0], [0.0, 5.0], [0.0, 0.0]], [[5.0, 5.0], [10.0, 5.02], [10.0, 5.0], [5.0, 5.0]]]
    got = sampling.sample_in_region(grid(spark), geo_files.region_literal([[sliver[0]], [sliver[1]], [[[9.9, 9.9], [10.0, 9.9], [10.0, 10.0], [9.9, 9.9]]]]), 40)
    assert got.count() == 40


def test_many_keywords_in_one_text(spark):
    words = [f"Word {i % 4000}" if i % 2 else f"WORD {i % 4000}" for i in range(40_000)]
    got = spark.createDataFrame([(", ".join(words),), (None,), (" , ",)], "raw string").select(text.keyword_list("raw").alias("k")).collect()
    first = list({w.lower(): w for w in reversed(words)}.items())
    order = {w: i for i, w in reversed(list(enumerate(x.lower() for x in words)))}
    assert got[0].k == [w for _, w in sorted(first, key=lambda p: order[p[0]])] and got[1].k == got[2].k == []


def test_broadcast_by_rows_and_bytes(spark):
    small = spark.range(10).selectExpr("id", "repeat('x', 1000) AS s")
    assert storage.fits_broadcast(small) and not storage.fits_broadcast(small, max_rows=9) and not storage.fits_broadcast(small, max_bytes=9000)


def requests(spark, n=50):
    points = spark.range(n).select(F.col("id").alias("seq"), (uniform("id", 1) * 10).alias("lon"), (uniform("id", 2) * 10).alias("lat"))
    return sampling.request_plan(sampling.split_multi(points, "seq"), "seq")


def test_request_plan(spark):
    rows = requests(spark).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.group_id, r.is_multi_group), []).append(r)
    assert sum(m for _, m in groups) == 20 and len(groups) == 50
    for (_, multi), g in groups.items():
        zooms, releases = {r.zoom for r in g}, {r.release_id for r in g}
        assert len(g) == len(zooms) * len(releases)
        assert (1 <= len(zooms) <= 3 and 2 <= len(releases) <= 4) if multi else (zooms, releases) == ({18}, {26334})
    assert max(r.seq for r in rows if not r.is_multi_group) < min(r.seq for r in rows if r.is_multi_group)
    assert len({r.seq for r in rows}) == len(rows)


def test_unique_tiles_keep_the_first(spark):
    rows = [("a", 1, 6, 3, 3, 5), ("b", 1, 6, 3, 3, 2), ("c", 1, 6, 3, 4, 9)]
    df = spark.createDataFrame(rows, "group_id string, release_id int, zoom int, x int, y int, seq long")
    assert sorted(r.group_id for r in tiles.unique_tiles(df).collect()) == ["b", "c"]
    done = spark.createDataFrame([("1/6/3/3",)], "key string")
    assert [r.group_id for r in tiles.todo(tiles.unique_tiles(df), done).collect()] == ["c"]


def client():
    """200, 404, busy twice, always failing and raising, by column."""
    tries = {}

    def get(url, timeout):
        x = int(url.rsplit("/", 1)[1])
        tries[url] = tries.get(url, 0) + 1
        if x % 5 == 1:
            return 404, b""
        if x % 5 == 2 and tries[url] < 3:
            return 429, b""
        if x % 5 == 3:
            return 503, b""
        if x % 5 == 4:
            raise TimeoutError
        return 200, url.encode()

    return get


def nap(_):
    return None


def some_tiles(spark, n=10):
    return spark.range(n).select(F.lit("g").alias("group_id"), F.lit(False).alias("is_multi_group"), F.lit(5).alias("zoom"), F.lit(239).alias("release_id"), F.lit(2018).alias("year"), F.col("id").cast("int").alias("x"), F.lit(1).alias("y"), F.concat(F.lit("239_5_"), F.col("id").cast("string"), F.lit("_1")).alias("file_name"), F.col("id").alias("seq"))


def test_fetch_outcomes():
    pauses = []
    assert fetch.fetch_one(client(), "u/0", sleep=pauses.append)[:3] == ("ok", 1, 200)
    assert fetch.fetch_one(client(), "u/1", sleep=pauses.append)[:3] == ("not_found", 1, 404) and pauses == []
    assert fetch.fetch_one(client(), "u/2", sleep=pauses.append)[:3] == ("ok", 3, 200) and pauses == [1, 2]
    assert fetch.fetch_one(client(), "u/3", sleep=pauses.append) == ("failed", 4, 503, None) and pauses[2:] == [1, 2, 4, 8]
    assert fetch.fetch_one(client(), "u/4", sleep=pauses.append) == ("failed", 4, None, None)


def test_fetch_resumes(spark, tmp_path):
    out = str(tmp_path / "out")
    fetch.run_fetch(some_tiles(spark), client, out, batches=2, tasks=2, sleep=nap)
    status = {r.key: r.status for r in fetch.read_status(spark, f"{out}/status").collect()}
    assert sorted(status.values()) == ["failed"] * 4 + ["not_found"] * 2 + ["ok"] * 4
    assert fetch.read_tiles(spark, out).count() == 4
    row = fetch.read_tiles(spark, out).where("file_name = '239_5_0_1'").first()
    assert row.tile_lon == pytest.approx(0.5 / 32 * 360 - 180) and row.image_bytes.endswith(b"239/5/1/0")

    def healed():
        return lambda url, timeout: (200, b"x")

    fetch.run_fetch(some_tiles(spark), healed, out, tasks=2, sleep=nap)
    assert fetch.read_tiles(spark, out).count() == 8
    before = fetch.read_status(spark, f"{out}/status").count()
    fetch.run_fetch(some_tiles(spark), healed, out, tasks=2, sleep=nap)
    assert fetch.read_status(spark, f"{out}/status").count() == before


def test_crash_between_tiles_and_status(spark, tmp_path):
    out = str(tmp_path / "out")
    part = some_tiles(spark, 1)
    outcomes = fetch.fetch(part, client, tasks=1, sleep=nap)
    fetch.fetched_tiles(part, outcomes).write.mode("append").parquet(f"{out}/tiles")  # and no status
    fetch.run_fetch(part, client, out, tasks=1, sleep=nap)
    assert fetch.read_tiles(spark, out).count() == 1


def test_fetch_summary(spark):
    df = spark.createDataFrame([("ok",), ("ok",), ("failed",)], "status string")
    assert tuple(fetch.fetch_summary(df, elapsed=4).first()) == (2, 1, 3, 0.5)
    assert fetch.fetch_summary(df, elapsed=0).first().rate == 0.0


def test_stream_of_requests(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    some_tiles(spark, 5).write.mode("append").parquet(source)
    schema = some_tiles(spark, 1).schema.simpleString()[7:-1].replace(":", " ")
    for _ in range(2):
        fetch_stream(spark, source, schema, client, out, str(tmp_path / "ck"), tasks=1, sleep=nap).awaitTermination(60)
        some_tiles(spark, 7).write.mode("append").parquet(source)
    assert fetch.read_status(spark, f"{out}/status").where("status = 'ok'").count() == 3


def model():
    def ask(content, prompt):
        if content == b"bad" and "comma-separated" in prompt:
            raise RuntimeError("no answer")
        return "  Tree, tree, [Road]\n" if "comma-separated" in prompt else f" {content.decode()} seen "

    return ask


def test_captions(spark):
    df = spark.createDataFrame([("1", b"one"), ("2", b"bad"), ("3", b"two")], "img_name string, image_bytes binary")
    got = captions.caption(df, model, tasks=1).collect()
    good = {r.id: r for r in got if r.status == "success"}
    assert set(good) == {"1", "3"} and good["1"].keywords == "Tree, Road" and good["1"].scene_caption == "one seen"
    bad = next(r for r in got if r.id == "2")
    assert bad.status == "failed: no answer" and (bad.scene_caption, bad.keywords) == ("", "")
    done = captions.caption(df, model, tasks=1)
    assert captions.failures(done).count() == 1 and captions.successes(done).columns == ["id", "scene_caption", "spatial_dense_caption", "keywords"]
    assert {r.caption for r in captions.assemble(done, df, "all").collect()} == {"one seen one seen Tree, Road", "two seen two seen Tree, Road"}
    assert captions.caption(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        captions.caption(df.drop("img_name"), model)


@pytest.mark.parametrize("n,val", [(10, 1), (399, 39), (0, 0), (5, 0)])
def test_split_sizes(spark, n, val):
    got = {r.split: r["count"] for r in provision.train_val_split(spark.range(n), "id").groupBy("split").count().collect()}
    assert got.get("val", 0) == val and got.get("train", 0) == n - val


def test_batches(spark):
    rows = provision.epoch_batches(spark.range(200), "id", 1).collect()
    sizes = {}
    for r in rows:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert sizes == {0: 64, 1: 64, 2: 64} and len({r.id for r in rows}) == 192
    other = provision.epoch_batches(spark.range(200), "id", 2).collect()
    assert {r.id for r in rows if r.batch_id == 0} != {r.id for r in other if r.batch_id == 0}
    assert provision.epoch_batches(spark.range(200), "id", 1, shuffle=False, drop_last=False).agg(F.max("batch_id")).first()[0] == 3


def test_schedule_and_decay(spark):
    got = spark.createDataFrame([(s,) for s in (0, 1000, 2000, 52000, 102000, 200000)], "s int").select(provision.lr_factor("s").alias("f")).collect()
    assert [r.f for r in got] == pytest.approx([0, 0.5, 1, 0.5, 0, 0])
    df = spark.createDataFrame([("conv.weight", 4), ("bn1.weight", 1), ("x.bias", 1), ("logit_scale", 0), ("ln_final.w", 2)], "name string, ndim int")
    assert [r.d for r in df.select(provision.weight_decay("name", "ndim").alias("d")).collect()] == [0.1, 0.0, 0.0, 0.0, 0.0]
    losses = spark.createDataFrame([(0, "train", 1.0), (0, "train", 3.0), (1, "val", 5.0)], "epoch int, split string, loss double")
    assert {tuple(r) for r in provision.epoch_means(losses).collect()} == {(0, 2.0, None), (1, None, 5.0)}


SIMS = [[1, 0.9, 0.2, 0.1], [0.9, 1, 0.3, 0.05], [0.2, 0.3, 1, 0.8], [0.1, 0.05, 0.8, 1]]


def golden(spark):
    vecs = np.linalg.cholesky(np.array(SIMS))
    return spark.createDataFrame([("d", i, i % 2, vecs[i].tolist()) for i in range(4)], "dataset string, id long, label int, vec array<double>")


@pytest.mark.parametrize("forms", ["sql", "one", "many"])
@pytest.mark.parametrize("self,r1,mrr,ap", [(True, 1, 1, 0.770833), (False, 0, 0.375, 0.375)])
def test_retrieval_golden(spark, forms, self, r1, mrr, ap):
    emb = golden(spark)
    per = retrieval.per_query_sql(emb, self) if forms == "sql" else retrieval.per_query(emb, self, block_rows=retrieval.BLOCK_ROWS if forms == "one" else 1)
    got = retrieval.summarise(per, ["dataset"]).first()
    assert (got["R@1"], got.MRR, got.MAP) == pytest.approx((r1, mrr, ap), abs=1e-6)


def test_retrieval_forms_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i % 2}", i, int(rng.integers(0, 5)), rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(60)] + [("s0", 99, 77, [1.0, 1.0, 1.0])]
    emb = spark.createDataFrame(rows, "dataset string, id long, label int, vec array<double>")  # whole numbers: exact products and real ties
    show = lambda df: sorted((r.id, r.relevant, r.first_rank, round(r.average_precision, 9)) for r in df.collect())
    for self in (True, False):
        assert show(retrieval.per_query(emb, self)) == show(retrieval.per_query_sql(emb, self)) == show(retrieval.per_query(emb, self, block_rows=3))


def test_ranks_do_not_depend_on_blocks(spark, monkeypatch):
    """Same figures at a block of 1/20 of the table, with vectors whose products end in different bits, a third of them
    copies of one, and rows without a label."""
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(240, 48))
    vecs[::3] = vecs[0]
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    rows = [("d", i, int(i % 4) if i % 10 else None, v.tolist()) for i, v in enumerate(vecs)]
    emb = spark.createDataFrame(rows, "dataset string, id long, label int, vec array<double>")
    show = lambda df: sorted((r.id, r.relevant, r.first_rank, r.average_precision) for r in df.collect())
    whole = show(retrieval.per_query(emb, False))
    best = sorted(tuple(r) for r in retrieval.top_k(emb, 7).drop("sim").collect())
    sims = vecs @ vecs.T
    for i, relevant, first, average in whole:
        order = sorted((j for j in range(240) if j != i), key=lambda j: (-round(sims[i, j], 9), j))
        ranks = [k for k, j in enumerate(order, 1) if rows[i][2] is not None and rows[j][2] == rows[i][2]]
        assert (relevant, first) == (len(ranks), ranks[0] if ranks else None)
        assert average == pytest.approx(sum(n / k for n, k in enumerate(ranks, 1)) / len(ranks) if ranks else 0)
        assert [c for _, q, _, c in best if q == i] == order[:7]
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 12)
    small = show(retrieval.per_query(emb, False, block_rows=12))
    assert [x[:3] for x in small] == [x[:3] for x in whole] and [x[3] for x in small] == pytest.approx([x[3] for x in whole])
    assert sorted(tuple(r) for r in retrieval.top_k(emb, 7, block_rows=12).drop("sim").collect()) == best
    assert retrieval.per_query(emb.limit(0)).count() == 0 and retrieval.top_k(emb.limit(0), 3).count() == 0


def test_every_pair_is_met_once(spark):
    """A unit has its queries with all candidates, whatever the labels: each vector goes to so many units, not to the square
    of the blocks of a label, and is a query of one."""
    rows = [("d", i, 1, [float(i), 1.0]) for i in range(400)] + [("e", i, i, [1.0, float(i)]) for i in range(10)] + [(None, 0, 1, [1.0, 1.0])]
    emb = spark.createDataFrame(rows, "dataset string, id long, label int, vec array<double>")
    streams = retrieval._streams(emb, 4).groupBy("dataset").agg(F.countDistinct("unit").alias("units"), F.sum(F.octet_length("ids") / 8).alias("met"), F.sum(F.col("own").cast("int") * F.octet_length("ids") / 8).alias("queries"))
    found = {r.dataset: (r.units, r.met, r.queries) for r in streams.collect()}
    (d, d_met, d_own), (e, e_met, e_own) = found["d"], found["e"]
    assert d <= retrieval.UNITS and (d_met, d_own) == (d * 400, 400) and (e_met, e_own) == (e * 10, 10) and set(found) == {"d", "e"}
    per = {(r.dataset, r.id): r for r in retrieval.per_query(emb, block_rows=4).collect()}
    assert len(per) == 411 and per[None, 0].relevant == 0 and per["d", 7].relevant == 400


@pytest.mark.parametrize("scale", [1.0, 1e-3, 300.0])
def test_near_ties_and_any_length(spark, scale):
    """Neighbours that single precision can't tell apart, copies, and vectors far from unit length."""
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 16))
    vecs[100:200] = vecs[0] + 1e-7 * rng.normal(size=(100, 16))
    vecs[200:250] = vecs[1]
    vecs *= scale
    emb = spark.createDataFrame([("d", i, i % 3, v.tolist()) for i, v in enumerate(vecs)], "dataset string, id long, label int, vec array<double>")
    sims = np.rint(np.array([np.einsum("ij,ij->i", np.repeat(v[None], 300, axis=0), vecs) for v in vecs]) * retrieval.GRID)
    orders = [np.argsort(-s, kind="stable") for s in sims]
    best = {(r.id, r.rank): r.cid for r in retrieval.top_k(emb, 5, block_rows=37).collect()}
    assert best == {(i, k): j for i, order in enumerate(orders) for k, j in enumerate(order[order != i][:5].tolist(), 1)}
    for r in retrieval.per_query(emb, block_rows=37).collect():
        ranks = np.flatnonzero(orders[r.id] % 3 == r.id % 3) + 1
        assert (r.relevant, r.first_rank) == (len(ranks), ranks[0]) and r.average_precision == pytest.approx((np.arange(1, len(ranks) + 1) / ranks).mean())


def test_vectors_of_single_precision(spark):
    """They count as the doubles they are, whatever their number of bytes."""
    vecs = np.random.default_rng(4).normal(size=(30, 3)).astype(np.float32)
    for width in (2, 3):
        single, double = (spark.createDataFrame([("d", i, i % 3, v[:width].tolist()) for i, v in enumerate(vecs)], f"dataset string, id long, label int, vec array<{t}>") for t in ("float", "double"))
        for self in (True, False):
            assert sorted(retrieval.per_query(single, self).collect()) == sorted(retrieval.per_query(double, self).collect())
        assert sorted(retrieval.top_k(single, 3).collect()) == sorted(retrieval.top_k(double, 3).collect())


@pytest.mark.parametrize("case", ["apart", "runs", "long runs", "crowded"])
def test_order_of_a_query(case, monkeypatch):
    """Ranks of the relevant are those of the multiples of 1 / GRID, ties to the smaller number, also where similarities
    differ by less than that, in few or many runs, short or long, and with a query left out."""
    monkeypatch.setattr(retrieval, "CACHED", 256)
    rng = np.random.default_rng(len(case))
    n = 3000
    vecs = rng.normal(size=(n, 8)) / 3
    if case == "runs":
        vecs[1::40] = vecs[::40] + 1e-11 * rng.normal(size=(75, 8))
    elif case == "long runs":
        vecs[5:3000:60] = vecs[5] + 1e-11 * rng.normal(size=(50, 8))
    elif case == "crowded":
        vecs = vecs[rng.integers(0, 40, n)]
    labels = rng.integers(0, 3, n)
    unit = retrieval._Unit()
    for low in (1000, 0, 2000):  # blocks in any order
        cut = slice(low, low + 1000)
        unit.add(low == 0, low, "d", np.arange(n)[cut].tobytes(), labels[cut].tobytes(), vecs[cut].tobytes())
    unit.close()
    with unit.file:
        assert np.array_equal(unit.vectors(np.array([0, 1000, 2999])), vecs[[0, 1000, 2999]])
        for self in (True, False):
            got = pa.Table.from_batches(retrieval._ranks(unit, self)).to_pylist()
            assert len(got) == 1000
            for r in got[::3]:
                sims = np.rint(np.einsum("ij,ij->i", np.repeat(vecs[r["id"]][None], n, axis=0), vecs) * retrieval.GRID)
                order = np.argsort(-sims, kind="stable")
                ranks = np.flatnonzero(labels[order if self else order[order != r["id"]]] == r["label"]) + 1
                assert (r["relevant"], r["first_rank"]) == (len(ranks), ranks[0])
                assert r["average_precision"] == pytest.approx((np.arange(1, len(ranks) + 1) / ranks).mean(), abs=1e-12)
        order = retrieval._Order(unit)  # doubles with a number in their last bits are what is sorted
        order.of_label(labels[0])
        negated = -(vecs @ vecs[0])
        ranks = order.places(negated, -vecs[0], 1e-15, 9.0, None)
        sims = np.rint(np.einsum("ij,ij->i", np.repeat(vecs[:1], n, axis=0), vecs) * retrieval.GRID)
        assert np.array_equal(ranks, np.flatnonzero(labels[np.argsort(-sims, kind="stable")] == labels[0]))
        assert (order.at_once > 0) == (case == "crowded")


def test_normalising_takes_the_norm_once(spark):
    """Time grows with the components of a vector, not with their square."""
    rows = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda x: x + F.col("id")).alias("v"))
    began = time.perf_counter()
    got = rows.select(vector.normalise("v").alias("v")).collect()
    assert time.perf_counter() - began < 10
    want = np.arange(1, 6001) / np.linalg.norm(np.arange(1.0, 6001))
    assert got[0].v == pytest.approx(want, rel=1e-12)


def test_report(spark):
    sets = spark.createDataFrame([("a<b", 2, 3, 1.0, 1.0, 1.0, 1.0, 0.5), ("c", 4, 1, 0.0, 0.5, 1.0, 0.25, 0.25)], "dataset string, num_images long, num_classes long, `R@1` double, `R@5` double, `R@10` double, MRR double, MAP double")
    rows = [tuple(r) for r in retrieval.report_rows(sets).collect()]
    assert ("Average", 6, "-", "0.5000", "0.7500", "1.0000", "0.6250", "0.3750") in rows
    page = writers.html_report(sorted(rows, key=lambda r: r[0] == "Average"), "/m/best.ckpt", "/b/bench")
    assert "a&lt;b" in page and "a<b" not in page and "on 6 images in 2 sets" in page


def test_zero_shot_last_prompt_wins(spark):
    img = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    prompts = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (2, "a", [0.0, 1.0])], "pos int, prompt string, vec array<double>")
    assert retrieval.zero_shot(img, prompts).first().scores == {"a": 0.0, "b": 0.0}


def test_contrastive_golden(spark):
    rng = np.random.default_rng(1)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 8, 4)))
    df = spark.createDataFrame([(0, i, a[i].tolist(), b[i].tolist()) for i in range(8)], "batch_id int, i int, image array<double>, text array<double>")
    v = a @ b.T / 0.07
    lse = lambda m: np.log(np.exp(m).sum(axis=1)).mean() - np.diag(m).mean()
    assert contrastive.contrastive_loss(df).first().loss == pytest.approx((lse(v) + lse(v.T)) / 2)


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + bytes([i * 10 % 256 for i in range(3 * w)]) for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    for f in ("s/a/1.png", "s/a/2.JPG", "s/b/x.tif", "s/b/deep/y.png", "s/top.png"):
        p = tmp_path / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(png(3, 2))
    (tmp_path / "s/empty").mkdir()
    got = images.read_image_folder(spark, str(tmp_path)).collect()
    assert sorted((r.dataset, r["class"], r.file) for r in got) == [("s", "a", "1.png"), ("s", "a", "2.JPG")]
    classes = images.list_classes(spark, str(tmp_path))
    assert [(r["class"], r.code) for r in provision.class_codes(classes, "class").orderBy("code").collect()] == [("a", 0), ("b", 1), ("empty", 2)]
    (tmp_path / "s/a/bad.png").write_bytes(b"nothing")
    seen = images.black_if_invalid(images.decode(spark, str(tmp_path / "s/a/*.png")), 4).collect()
    assert sorted((r.height, r.width, len(r.data)) for r in seen) == [(2, 3, 18), (4, 4, 48)]


def test_models(spark):
    assert models.normalise_pixels(np.full((2, 2, 3), 255, np.uint8)).shape == (3, 2, 2)
    assert models.resize_crop(np.full((30, 50, 3), 7, np.uint8), 16).tolist() == np.full((16, 16, 3), 7).tolist()
    crops = [models.random_resized_crop(np.arange(30 * 40 * 3, dtype=np.uint8).reshape(30, 40, 3), np.random.default_rng(5), 8) for _ in range(2)]
    assert (crops[0] == crops[1]).all() and crops[0].shape == (8, 8, 3)
    df = spark.createDataFrame([(1, b"ab"), (2, b"c")], "id long, image_bytes binary")
    vec = models.encode(df, "image_bytes", lambda: lambda xs: np.array([[len(x), 1.0] for x in xs])).collect()
    assert np.allclose(np.linalg.norm([list(r.vec) for r in vec], axis=1), 1)
    ids = models.tokenise(spark.createDataFrame([(1, "a b c"), (2, "a")], "id int, t string"), "t", lambda: lambda xs: [[len(w) for w in x.split()] for x in xs], context=2).collect()
    assert sorted(list(r.token_ids) for r in ids) == [[1, 0], [1, 1]] or sorted(len(r.token_ids) for r in ids) == [1, 2]
    found = models.detect(df, lambda classes: lambda content: [(classes[0], 0.5, 0.0, 0.0, 1.0, float(len(content)))], ["roof"]).collect()
    assert sorted((r.id, r.cls, r.y1) for r in found) == [(1, "roof", 2.0), (2, "roof", 1.0)]


def test_images_by_label(spark, tmp_path):
    rows = [(0, (b"old", "x/lake_1.jpg")), (1, (b"new", "y/lake_1.jpg")), (2, (None, "z_1.jpg")), (3, (b"n", None))]
    df = spark.createDataFrame(rows, "row_idx long, image struct<bytes:binary,path:string>")
    labelled = writers.labelled_images(df)
    assert sorted((r.label, r.file, bytes(r.content)) for r in labelled.collect()) == [("image", "image_3.jpg", b"n"), ("lake", "lake_1.jpg", b"new")]
    writers.write_by_label(labelled, str(tmp_path / "t"))
    writers.write_files_by_label(labelled, str(tmp_path / "f"))
    assert (tmp_path / "f/lake/lake_1.jpg").read_bytes() == b"new" and spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_geojson_and_grid(spark, tmp_path):
    hole = [[2.0, 2.0], [3.0, 2.0], [3.0, 3.0], [2.0, 3.0], [2.0, 2.0]]
    features = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [SQUARE[0], hole]}}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[20.0, 0.0], [21.0, 0.0], [21.0, 1.0], [20.0, 0.0]]]]}}]
    path = tmp_path / "r.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    region = geo_files.read_region(spark, str(path))
    assert len(region) == 2 and len(region[0]) == 2
    cells = {r.cell_id: tuple(r)[1:] for r in geo_files.read_grid(spark, str(path)).collect()}
    assert cells == {0: (0.0, 0.0, 10.0, 10.0), 1: (20.0, 0.0, 21.0, 1.0)}
    path.write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "features": features}))
    with pytest.raises(ValueError):
        geo_files.read_region(spark, str(path))


def test_shapefile(spark, tmp_path):
    points = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    content = struct.pack("<i4d2i1i", 5, 0, 0, 2, 2, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in points)
    record = struct.pack(">ii", 1, len(content) // 2) + content
    (tmp_path / "g.shp").write_bytes(struct.pack(">i", 9994) + b"\0" * 20 + struct.pack(">i", (100 + len(record)) // 2) + b"\0" * 72 + record)
    assert [tuple(r) for r in geo_files.read_grid(spark, str(tmp_path / "g.shp")).collect()] == [(0, 0.0, 0.0, 2.0, 2.0)]


def test_tables_and_config(spark, tmp_path):
    path = tmp_path / "done.txt"
    path.write_text(" 1/2/3/4 \n\n1/2/3/4\n\t\n5/6/7/8\n")
    assert sorted(r.key for r in tables.read_done_keys(spark, str(path)).collect()) == ["1/2/3/4", "5/6/7/8"]
    assert tables.read_done_keys(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.raises(ValueError, match="caption"):
        tables.require_columns(spark.range(1), "id", "caption")
    file = tmp_path / "run.json"
    file.write_text(json.dumps({"data": {"batch_size": 8}}))
    found = config.load_config(str(file), {"trainer.max_epochs": 2})
    assert found["data"]["batch_size"] == 8 and found["trainer"] == {"max_epochs": 2, "accumulate_grad_batches": 16, "log_every_n_steps": 10}
    assert Path(config.save_latest(found, str(file))).name == "run-latest.json"
    built = config.LazyModel("m", lambda p: {"state_dict": {"w": 1}}, lambda hyper, weights, strict: (hyper, weights, strict))
    assert built() == (None, {"w": 1}, True) and built() is built()


def test_metrics_csv(spark, tmp_path):
    epochs = spark.createDataFrame([(1, 0.5, None), (0, 1.0, 2.0)], "epoch int, train_loss double, val_loss double")
    writers.write_metrics_csv(epochs, str(tmp_path / "m"))
    assert next((tmp_path / "m").glob("*.csv")).read_text() == "epoch,train_loss,val_loss\n0,1.0,2.0\n1,0.5,\n"


def test_observed_counters(spark):
    df, seen = writers.observed(spark.createDataFrame([("ok",), ("failed",)], "status string"))
    df.collect()
    assert seen.get == {"fetched": 1, "missing": 1}
