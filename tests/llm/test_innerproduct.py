import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import innerproduct
from skylattice.llm.innerproduct import Block, Rotation, op11_inner_products, search_blocks, top_k, whole_vectors

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, every=20, scale=64):
    kept = [(n, i, [max(-(2**62), min(2**62, math.floor(scale * x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in kept:
        if i is not None and i % every == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j is None, j or 0) for m, j, w in kept if m != n]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k, first_round=1 << 15, schema=SCHEMA):
    got = top_k(whole_vectors(spark.createDataFrame(rows, schema), "vec_id", "embedding"), F.col("id") % 20 == 0, k, first_round)
    return sorted(((r.query_id, r["rank"], r.id, r.score) for r in got.collect()), key=str)


@pytest.mark.parametrize(("first_round", "stripe"), [(1 << 15, 8 << 20), (100, 8 << 20), (64, 4096), (1, 8 << 20)])
def test_against_brute_force(spark, monkeypatch, first_round, stripe):
    monkeypatch.setattr(innerproduct, "STRIPE_BYTES", stripe)
    monkeypatch.setattr(innerproduct, "CHUNK_BYTES", stripe // 4)
    rng = np.random.default_rng(1)
    directions = rng.normal(size=(6, 12))
    rows = [(i, ((directions[i % 6] + 0.3 * rng.normal(size=12)) * rng.lognormal(0, 1)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[20][1]) for i in range(300)]  # a third is one vector
    assert found(spark, rows, 7, first_round) == brute(rows, 7)


def test_data_conditions(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(0, v), (0, v), (20, None), (40, [0.5, None, 1.0]), (60, [math.nan, 0.0, 0.0]), (80, [math.inf, 0.0, 0.0]), (100, []), (120, [0.0, 0.0, 0.0])]
    rows += [(140, [-0.5]), (160, [1e300, -1e300, 3.0]), (180, [-1e300, 1.0, 2.0]), (None, v), (None, [9.0, 9.0, 9.0]), (7, [1e-320, -1e-320, -0.0]), (-20, [2.0, 2.0, 2.0])]
    got = found(spark, rows, 20)
    assert got == brute(rows, 20)
    assert max(r[1] for r in got) == len(rows) - 4 - 1  # all others, as there are fewer than 20
    assert found(spark, rows, 1, first_round=2) == brute(rows, 1)
    assert found(spark, [], 20) == [] and found(spark, [(1, v)], 20) == [] and found(spark, [(20, v)], 20) == []
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", "1 as row", "'x' as length", "2 as id", "3 as vec")
    assert top_k(whole_vectors(wide, "vec_id", "embedding"), F.col("id") == 120).count() == len(rows) - 5


def test_bounds_spare_scores():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5000, 32)) * (0.8 ** np.arange(32)) * rng.lognormal(0, 0.7, 5000)[:, None]
    vecs = np.floor(64 * (base @ np.linalg.qr(rng.normal(size=(32, 32)))[0]))
    turn = Rotation.of(vecs)
    assert turn.ends[0] < 12

    def packed(x, first):
        n = len(x)
        columns = [np.arange(first, first + n), np.arange(first, first + n), np.zeros(n, bool), x, np.full(n, -np.inf)]
        return Block(pa.table({name: [c.tobytes()] for name, c in zip(("rows", "ids", "no_id", "vecs", "least"), columns)}), 32, turn)

    out, scored = search_blocks(packed(vecs[:100], 0), packed(vecs, 0), 20)
    assert scored < 0.35 * 100 * 5000
    true = vecs[:100] @ vecs.T
    true[np.arange(100), np.arange(100)] = -np.inf
    assert sorted(out["score"]) == sorted(np.sort(true, axis=1)[:, -20:].ravel())


def test_every_query_has_twenty(spark):
    got = op11_inner_products(spark, "/root/testdata/sf0.01")
    assert got.groupBy("query_id").count().where("count <> 20").count() == 0 and got.select("query_id").distinct().count() == 25
