import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from skylattice.llm import toxicity as t

BAD = ["grumble", "snarl", "growl", "hiss"]


def corpus(n=600, seed=1):
    r = random.Random(seed)
    v = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(v) for _ in range(r.randint(5, 80))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(BAD).upper() + "!")
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, toxic))
    return rows, labels


def plain_terms(text):
    found = Counter(w for w in re.split(r"[^a-zé]+", (text or "").lower()) if w)
    for w, n in list(found.items()):
        for k in (4, 5):
            if len(w) > k:
                found[w[:k] + "*"] += n
    return found


class Plain:
    """The scores as the module's text states them, with dictionaries and a scan over all pairs."""

    def __init__(self, rows, labels):
        texts = dict(rows)
        self.ids = sorted(i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2)
        self.y = [dict(labels)[i] for i in self.ids]
        counts = [plain_terms(texts[i]) for i in self.ids]
        df = Counter(w for _, x in rows for w in plain_terms(x))
        unique = {(y, tuple(sorted(c.items()))) for y, c in zip(self.y, counts)}
        by = [Counter(w for y, c in unique for w, _ in c if y == k) for k in (0, 1)]
        size = [self.y.count(0), self.y.count(1)]
        self.weight = {}
        for w in {w for c in counts for w in c}:
            a, b = by[0][w], by[1][w]
            rate = math.log((b + 0.5) / (size[1] + 1) / ((a + 0.5) / (size[0] + 1)))
            sure = max(0.0, rate - 1.5 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) - 0.5) if b >= 3 else 0.0
            self.weight[w] = math.log((1 + len(rows)) / (1 + df[w])) * (1 + 10 * sure)
        self.vectors = [self.vector(c) for c in counts]
        votes = sorted((self.vote(self.near(v, i)), self.y[i]) for i, v in enumerate(self.vectors) if self.near(v, i))
        mean = lambda j, k: sum(y for _, y in votes[j : k + 1]) / (k + 1 - j)
        fitted = [max(min(mean(j, k) for k in range(i, len(votes))) for j in range(i + 1)) for i in range(len(votes))]
        self.curve = [(sum(v for v, _ in g) / len(g), f) for f, g in ((f, [x for x, h in zip(votes, fitted) if h == f]) for f in sorted(set(fitted)))]

    def vector(self, counts):
        found = {w: (1 + math.log(n)) * self.weight[w] for w, n in counts.items() if w in self.weight}
        length = math.sqrt(sum(x * x for x in found.values()))
        return {w: x / length for w, x in found.items()} if length else {}

    def near(self, vector, skip=None):
        cosines = [(-round(sum(x * v.get(w, 0) for w, x in vector.items()), 9), i) for i, v in enumerate(self.vectors) if i != skip]
        return [(-c, i) for c, i in sorted(cosines) if c < 0]

    def vote(self, near):
        near = near[: t.NEIGHBOURS]
        return sum(c * c * self.y[i] for c, i in near) / sum(c * c for c, _ in near)

    def score(self, vote):
        return float(np.interp(vote, [x for x, _ in self.curve], [y for _, y in self.curve]))


def test_scores_equal_a_scan_over_all_pairs(spark):
    rows, labels = corpus(400)
    rows[7] = (7, rows[0][1])  # a copy of a labelled toxic text under another id
    rows[11] = (11, "Émile été " + rows[11][1])
    plain = Plain(rows, labels)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted(index.ids) == plain.ids and index.n_blocks > 2 and len(index.hashes) == len(plain.weight)
    for r in t.score_toxicity(docs, index).collect():
        near = plain.near(plain.vector(plain_terms(r.text)))
        want = near[: t.NEIGHBOURS]
        assert near and np.allclose([e.cosine for e in r.toxic_evidence], [c for c, _ in want])
        cosine = {plain.ids[i]: c for c, i in near}
        assert all(abs(cosine[e.doc_id] - e.cosine) < 1e-9 for e in r.toxic_evidence)
        if len(near) == len(want) or want[-1][0] - near[len(want)][0] > 1e-9:  # which of equal ones is the index's choice
            assert abs(r.toxic_score - plain.score(plain.vote(near))) < 1e-6, r.doc_id
        if r.doc_id == 7:
            assert r.toxic_evidence[0].doc_id == 0 and abs(r.toxic_evidence[0].cosine - 1) < 1e-9


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} x1" for i in range(2000)) + " end"
    whole = t.count_terms(pa.array(["a b", text, None, "", text]))
    monkeypatch.setattr(t, "PIECE", 100)
    pieces = t.count_terms(pa.array(["a b", text, None, "", text]))
    assert whole.row.tolist() == pieces.row.tolist() and whole.term.tolist() == pieces.term.tolist() and whole.n.tolist() == pieces.n.tolist()
    assert len(t._pieces(text)) > 100 and set(whole.row.tolist()) == {0, 1, 4}


def test_clashing_columns_equal_rows_and_bytes(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame([(i, x, 0, "n") for i, x in rows + [rows[3]] * 2], "doc_id long, text string, toxic int, toxic_score string")
    named = spark.createDataFrame([(i, y, "q") for i, y in labels], "doc_id long, toxic int, text string")
    index = t.fit(docs, named, max_bytes=4000)
    assert 0 < len(index.ids) < len(t.fit(docs, named).ids)
    got = t.score_toxicity(docs, index)
    assert got.columns == ["doc_id", "text", "toxic", "toxic_score", "toxic_evidence"]
    assert len({r.toxic_score for r in got.collect() if r.doc_id == 3}) == 1
    assert t.reject_toxic(docs, index).columns == docs.columns


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(None, "a SNARL, a hiss"), (9001, None), (9002, ""), (0, rows[0][1])], "doc_id long, text string").repartition(4)
    index = t.fit(docs, spark.createDataFrame(labels + [(None, 1), (4, None), (777777, 1)], "doc_id long, toxic int"))
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in index.ids)
    got = t.score_toxicity(docs, index).withColumn("held", t.held_out()).collect()
    assert len(got) == len(rows) + 4
    for g in got:
        assert 0 <= g.toxic_score <= 1
        assert g.held == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 4 == 2)
        if g.doc_id is not None and g.doc_id < 600:
            assert (g.toxic_score >= t.THRESHOLD) == (g.doc_id % 5 == 0), g.doc_id
        if g.doc_id in (9001, 9002):
            assert g.toxic_score < t.THRESHOLD and g.toxic_evidence == []
        if g.doc_id is None:
            assert g.toxic_score >= t.THRESHOLD and all(e.doc_id % 5 == 0 for e in g.toxic_evidence)


def test_sample_is_bounded_and_empty_tables_work(spark):
    rows, labels = corpus()
    docs, named = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert len(t.fit(docs, named, max_examples=10).ids) <= 20
    index = t.fit(docs, named.limit(0))
    assert {r.toxic_score for r in t.score_toxicity(docs, index).collect()} == {0.0}
    assert t.score_toxicity(docs.limit(0), index).count() == 0


def test_a_long_text_does_not_push_out_a_class(spark):
    rows, labels = corpus(300)
    longest = {c: min((i for i, y in labels if y == c and zlib.crc32(str(i).encode()) % 4 != 2)) for c in (0, 1)}
    rows = [(i, x + " word" * 60_000 if i in longest.values() else x) for i, x in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 0, y) for i, y in labels], "doc_id long, quality int, toxic int")
    index = t.fit(docs, marks, max_bytes=1 << 22)
    assert min(sum(index.toxic == c) for c in (0, 1)) > 10 and not set(longest.values()) & set(index.ids)
