import random

import pytest

from skylattice.llm.repeats import _nearest, matched, remove_repeats


def brute(texts, length):
    starts = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            starts[t[p : p + length]] = starts.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if starts[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs, i = [], 0
        while i < len(t):
            if gone[i]:
                j = i
                while j < len(t) and gone[j]:
                    j += 1
                runs.append([i, j])
                i = j
            else:
                i += 1
        out.append((bytes(c for c, g in zip(t, gone) if not g), runs))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 90)))
    shared = [word() for _ in range(4)]
    texts = []
    for i in range(n):
        kind = r.random()
        if kind < 0.3 and texts:
            t = r.choice(texts)
            p = r.randrange(len(t) + 1)
            t = r.choice((t, t[:p] + "#" + t[p + 1 :], t[p:] + word()))
        else:
            t = word() + r.choice(shared) + word() + (r.choice(shared) if kind > 0.7 else "")
        texts.append(t)
    return [*texts, "", "ab" * 60, texts[0]]


@pytest.mark.parametrize("seed,max_group", [(1, 64), (2, 64), (3, 2), (4, 2)])
def test_against_brute_force(spark, seed, max_group):
    texts = corpus(seed)
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None), (0, texts[0])]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=24, gram=8, max_group=max_group).collect()
    expected = brute([(t or "").encode() for _, t in rows], 24)
    want = sorted((i, k, str(r)) for (i, _), (k, r) in zip(rows, expected))
    assert sorted((g.doc_id, bytes(g.kept), str(g.removed)) for g in got) == want


def test_shared_edges_go_through_ranges(spark):
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = noise(60)
    texts = [noise(30) + passage + noise(30) for _ in range(40)]
    got = {g.doc_id: bytes(g.kept) for g in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=24, gram=8, max_group=3).collect()}
    for i, (kept, _) in enumerate(brute([t.encode() for t in texts], 24)):
        assert got[i] == kept


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, t1 string, khash int")
    assert remove_repeats(docs).count() == 0


def test_nearest_positions():
    assert _nearest([3, 1, 2], smaller=True) == [(-1, 1), (-1, -1), (1, -1)]
    assert _nearest([3, 1, 2], smaller=False) == [(-1, -1), (0, 2), (0, -1)]


def test_matched_prefers_any_context():
    a = (b"xxxabc", b"defyyy", (0,))
    assert matched([a, (b"zzzabc", b"defqqq", (1,))], length=6)[0] == (3, 3)
    assert matched([a, (b"zzzabc", b"deqqqq", (1,))], length=6)[0] == (0, 0)
