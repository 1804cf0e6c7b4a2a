import math
import random
import re
from collections import Counter

import pytest

from skylattice.llm import ranking
from skylattice.llm.ranking import op13_ranked_search, rank, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    found = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in found for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for w, x in df.items()}
    out = []
    for q, text in items:
        scored = []
        for (i, c), size in zip(found, sizes):
            if size:
                m = 100 - 50 + (50 * size * n) // total
                score = sum(weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(words(text)) if c[w])
                if score:
                    scored.append((-score, i is None, i or 0))
        out += [(str(q), r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k, **options):
    got, asked = rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k, **options)
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in got.collect()), key=str), asked


def corpus(n, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda size: " ".join(vocabulary[min(399, int(r.paretovariate(0.6)) - 1)] for _ in range(size))
    docs = [(i, text(r.randint(1, 60))) for i in range(n)]
    items = [(i, text(r.randint(1, 12))) for i in range(20)]
    docs += [(n + i, f"{text(5)} {t} {text(5)}") for i, (_, t) in enumerate(items)]
    return docs, items


@pytest.mark.parametrize(("shard_docs", "candidates", "block"), [(1 << 14, 200, 1 << 16), (37, 200, 1 << 16), (64, 3, 16)])
def test_against_brute_force(spark, monkeypatch, shard_docs, candidates, block):
    monkeypatch.setattr(ranking, "BLOCK_TERMS", block)
    docs, items = corpus(500)
    docs += [(9000 + i, docs[7][1]) for i in range(200)]  # a large group of copies
    monkeypatch.setattr(ranking, "SHARD_DOCS", shard_docs)  # read where the tasks are made
    got, asked = found(spark, docs, items, 10, candidates=candidates)
    assert got == brute(docs, items, 10)
    assert asked[0] == 20 and asked == sorted(asked, reverse=True)


def test_some_items_are_proven_early(spark):
    docs, _ = corpus(2000)
    items = [(1, "w300 w350"), (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"), (3, "zebra")]
    docs += [(5000 + i, "w300 w350 zebra") for i in range(12)]
    got, asked = found(spark, docs, items, 10)
    assert got == brute(docs, items, 10)
    assert asked[1] < 3  # not all items need a second tier


def test_all_terms_are_indexed_where_items_are_many(spark, monkeypatch):
    monkeypatch.setattr(ranking, "fits_broadcast", lambda df: False)
    docs, items = corpus(150)
    assert found(spark, docs, items, 10)[0] == brute(docs, items, 10)


def test_data_conditions(spark):
    docs = [(1, "Äb x"), (1, "Äb x"), (None, "äb X"), (None, None), (2, ""), (3, " .,;"), (4, "long " * 300_000 + "x"), (-5, "x1 X1 日本 x\x7f"), (6, "a_b-c")]
    items = [(1, "x"), (1, "x"), (None, "Äb äb"), (2, None), (3, ""), (4, "日本 B long"), (5, "nothing here")]
    assert found(spark, docs, items, 50)[0] == brute(docs, items, 50)
    assert found(spark, docs, items, 1)[0] == brute(docs, items, 1)
    assert found(spark, [], items, 50)[0] == [] and found(spark, docs, [], 50)[0] == [] and found(spark, [(1, None)], items, 50)[0] == []
    wide = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as term", "2 as shard", "3 as item", "'n' as n")
    assert rank(wide, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item", "2 as block"))[0].count() == len(brute(docs, items, 50))


def test_terms():
    for text in ("", "Ab-c1é_Ü x\x00y", "日本 ÀB", "[{A}] @`~^"):
        assert [w.decode() for w in terms(text.encode())] == words(text)


def test_every_item_is_ranked(spark):
    got = op13_ranked_search(spark, "/root/testdata/sf0.01")
    assert got.groupBy("item_id").count().count() == 40 and got.groupBy("item_id").count().where("count > 50").count() == 0
