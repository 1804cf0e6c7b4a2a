import random
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest

from skylattice.llm import contamination as c


def vocabulary(r, n=3000):
    return ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def brute(rows, items, window=20, similarity=0.8):
    """Every alignment of every item with every document, window by window."""
    words = lambda t: c._WORD.findall((t or "").lower())
    out = set()
    for i, t in rows:
        for k, u in items:
            d, q = words(t), words(u)
            w = min(window, len(q))
            if not q:
                continue
            similarity = 1 if len(q) <= c.MIN_WORDS else 0.8
            for g in range(-len(q), len(d)):
                same = [0 <= p + g < len(d) and d[p + g] == q[p] for p in range(len(q))]
                inside = [0 <= p + g < len(d) for p in range(len(q))]
                if any(all(inside[p : p + w]) and sum(same[p : p + w]) >= similarity * w for p in range(len(q) - w + 1)):
                    out.add((i, k))
    return out


def corpus(seed):
    r = random.Random(seed)
    v = vocabulary(r)
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [(k, text(r.choice((6, 9, 15, 30, 60)))) for k in range(12)] + [(90, "too few words"), (91, None), (92, ""), (93, "just five words in here"), (94, "so short"), (95, "中文测试数据集的问题"), (96, "x")]
    rows = []
    for i in range(80):
        body = text(r.randint(0, 60)).split(" ")
        kind = i % 4
        if kind:
            passage = items[r.randrange(12)][1].split(" ")
            if kind == 2:  # substitutions, some too many
                for p in r.sample(range(len(passage)), r.randint(1, max(1, len(passage) // 3))):
                    passage[p] = r.choice(v).upper()
            if kind == 3 and len(passage) > 30:  # a part of a long item
                passage = passage[5:28]
            at = r.randint(0, len(body))
            body[at:at] = [p.capitalize() + "," for p in passage]
        rows.append((i, " ".join(body)))
    return rows + [(200, None), (201, ""), (202, "Just five, words in HERE"), (203, "too few words"), (204, "it is so short, so short"), (205, "前言：中文测试数据集的问题。后记"), (206, "中文试验"), (0, rows[0][1])], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows, items = corpus(seed)
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = c.contaminated(docs, bench, block_bytes=500 if seed == 3 else c.BLOCK_BYTES).collect()
    expected = brute(rows, items)
    assert {(f.doc_id, f.item_id) for f in found} == expected
    assert all(f.similarity >= 0.8 - 1e-9 or f.n_words > 20 for f in found)
    kept = c.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    short = {k: c._WORD.findall(u.lower()) for k, u in items if u and 0 < len(c._WORD.findall(u.lower())) < c.MIN_WORDS}
    texts = dict(rows)
    gone = {d for d, k in expected if k not in short or c._WORD.findall(texts[d].lower()) == short[k]}
    assert (204, 94) in expected and 204 not in gone and {203, 205} <= gone
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in gone)


def test_masks_find_a_fifth_of_substitutions():
    for n in range(6, 21):
        for gone in combinations(range(n), n // 5):
            assert any(all(s + o not in gone for o in m) for m in c.MASKS for s in range(n - m[-1]))


def test_repeated_words_stay_bounded():
    """A word or a pair of words throughout: every alignment, without a hit for each pair of positions."""
    word = lambda x: np.array(c.word_hashes(x), "u8")
    for unit in ("na ", "na no "):
        table = c.SeedTable(list(range(50)), [word(unit * (20 + i // 5)) for i in range(50)])
        expanded = sum(len(at) for at, _, _ in table.hits(word(unit * 500)))
        assert unit != "na " or expanded < 400_000
        found = table.search([unit * 500, "x " + unit * 10], 20, 0.8)
        assert [len(f) for f in found] == [50, 50 if unit == "na no " else 0]
        assert all(n == equal for _, _, n, equal in found[0])


def test_statement_on_a_fixture(spark):
    """The alignments that the seeds find against those of all pairs of words, by the registered statement."""
    rows, items = corpus(4)
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    benchmark = pd.DataFrame(items, columns=["item_id", "text"])  # noqa: F841
    want = duckdb.sql(c.ORACLE_SQL["op8_spaced_seeds"]).fetchall()
    found = c.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(want) == sorted(tuple(r) for r in found.collect())


def test_alignment():
    a = np.arange(30, dtype=np.uint64)
    assert c.aligned(a, a[5:25], 5, 20, 0.8) == (5, 20, 20)
    assert c.aligned(a, a[5:25], 6, 20, 0.8) is None


def test_empty_tables(spark):
    docs, bench = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    some = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    assert c.contaminated(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert c.contaminated(some, bench).count() == 0
    assert c.decontaminate(some, bench).count() == 1
