import hashlib

import pytest

from skylattice.llm.sharding import shard


def brute(rows, limit):
    h = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)
    items = [(i, t, len((t or "").encode()), h(i, t)) for i, t in rows]
    out = []
    for i, t, n, x in items:
        for depth in range(61):
            group = [m for _, _, m, y in items if y >> (60 - depth) == x >> (60 - depth)]
            if sum(group) <= limit or len(group) == 1:
                out.append((str(i), n, depth, f"{depth}-{x >> (60 - depth)}", sum(group)))
                break
    return sorted(out)


@pytest.mark.parametrize("limit", [10, 60, 5000])
def test_against_brute_force(spark, limit):
    rows = [(i, "é" * (i % 13)) for i in range(200)] + [(None, None), (500, "x" * 300)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    assert sorted((str(r.doc_id), r.bytes, r.depth, r.shard, r.shard_bytes) for r in got) == brute(rows, limit)
    assert [r.doc_id for r in got if r.oversize] == [r for r, t in rows if len((t or "").encode()) > limit] or limit != 60


def test_equal_rows_are_dealt_to_parts(spark):
    rows = [(1, "x" * 10)] * 25 + [(2, "y")]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    assert len(got) == 26
    sums = {}
    for r in got:
        sums[(r.shard, r.part)] = sums.get((r.shard, r.part), 0) + r.bytes
        assert r.shard_bytes <= 40
    assert max(sums.values()) <= 40


def test_empty_table(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string, h int")).count() == 0
