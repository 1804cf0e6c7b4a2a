import re

import pytest

from skylattice.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {s: 0.0 for s in order}, set(order)
    excess = float(sum(sizes.values()))
    while excess > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += excess * w[s] / total
        excess = 0.0
        for s in list(open_):
            if target[s] > most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
        open_ = {s for s in open_ if target[s] < most * sizes[s] - 1e-12}
    return target


def corpus():
    rows, n = [], 0
    for source, count, words in (("b", 40, 30), ("a", 5, 7), (None, 3, 11), ("é", 60, 9), ("hot", 400, 12), ("void", 2, 0)):
        for k in range(count):
            rows.append((n, source, " ".join(["w"] * (words + k % 3 if words else 0)) if k else (None if source == "void" else "x y z")))
            n += 1
    return rows


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_and_taken(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want, source_of = brute_targets(sizes), {i: s for i, s, _ in rows}
    taken = {s: 0 for s in sizes}
    for g in got:
        s = source_of[g.doc_id]
        assert g.size == words(rows[g.doc_id][2]) and g.source_size == sizes[s]
        assert g.target == pytest.approx(want[s], abs=1e-6)
        assert 0 <= g.taken <= 3 * g.size
        taken[s] += g.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    firsts = [g.positions[0] for g in got if g.positions]
    assert firsts == sorted(firsts) and all(0 <= p <= 1 for p in firsts)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_positions_invert_the_schedule(spark):
    schedule = ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5))
    rows = spark.range(101).select((mixing.F.col("id") / 100).alias("q")).select("q", mixing.position(mixing.F.col("q"), schedule).alias("t")).collect()

    def demand(t):
        return 0.5 * t + t * t if t <= 0.5 else 0.5 + 1.5 * (t - 0.5) - (t - 0.5) ** 2

    assert all(demand(r.t) == pytest.approx(r.q, abs=1e-9) for r in rows)


def test_mixed_rows_repeat_whole_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    copies, most = {}, max(words(t) for _, _, t in rows)
    taken = {}
    for r in got.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    assert max(copies.values()) <= 3
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= most


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, "a b c")] * 4 + [(1, "s", "")], "doc_id long, source string, text string")
    assert sum(r.taken for r in mixing.mix(docs).collect()) == 12
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_rows(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs.where("text = ''")).collect())


def test_equal_rows_are_taken_one_by_one(spark):
    """Sources of equal rows reach their targets within a document, whether or not other columns tell the rows apart."""
    for lang in (lambda i: "en", lambda i: f"l{i}"):
        rows = [(k, s, "one two three four five six seven eight nine ten", lang(i), i % 3) for k, s in enumerate("ab") for i in range(100)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, size int").repartition(3)
        got = mixing.mixed_rows(docs).collect()
        taken = {s: 10 * sum(r.source == s for r in got) for s in "ab"}
        assert all(abs(taken[s] - t) <= 5 for s, t in brute_targets({"a": 1000, "b": 1000}).items()), taken
        if lang(0) != lang(1):
            copies = [sum(r.source == s and r.lang == f"l{i}" for r in got) for s in "ab" for i in range(100)]
            assert set(copies[:100]) == {0, 1} and set(copies[100:]) == {1, 2}


def test_copies_are_dealt_to_several_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "s", "a b c")] * 50 + [(i, "t", "d e") for i in range(7)], "doc_id long, source string, text string")
    want = sorted((r.doc_id, r.taken, tuple(r.positions)) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 8)
    assert sorted((r.doc_id, r.taken, tuple(r.positions)) for r in mixing.mix(docs).collect()) == want
    starts = [p for i, _, p in want if i == 1 and p]
    assert len(set(starts)) == len(starts) > 40
