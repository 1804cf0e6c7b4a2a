import random

import numpy as np

import corpus_pipeline
from skylattice.llm import neardup, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def similar(a, b):
    common = len(a & b)
    return 5 * common >= 4 * (len(a) + len(b) - common)


def corpus():
    r = random.Random(4)
    v = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = [(900, None), (901, " \n"), (902, "just four words here"), (903, "Just  four words HERE"), (904, "just four words")]
    for base in range(25):
        words = [r.choice(v) for _ in range(r.choice((8, 60, 150, 400)))]
        for copy in range(6):
            edited = list(words)
            for p in r.sample(range(len(words)), min(len(words), copy * len(words) // 60)):
                edited[p] = r.choice(v)
            rows.append((base + 30 * copy, " ".join(edited)))
    passage = " ".join(r.choice(v) for _ in range(30))
    rows += [(1000 + i, passage + " " + " ".join(r.choice(v) for _ in range(40))) for i in range(10)]
    return rows + [(0, rows[5][1]), (None, "text without an id in the table")]


def test_stage_against_brute_force(spark):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    for i, j in pairs:
        label = [label[j] if x == label[i] else x for x in label]
    want = sorted(str(min(i for (i, _), x in zip(rows, label) if x == c)) for c in set(label))
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    assert any((prints[i] ^ prints[j]).bit_count() > 3 for i, j in pairs)  # op6's rule would miss these
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, sig int").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == want
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return sorted(min(i for (i, _), x in zip(rows, label) if x == c) for c in set(label))


def test_crowds_of_copies_and_near_misses(spark, monkeypatch):
    """Copies of a text with edits of their own: some within 0.8 of it, some just under; families that share edits."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for base, with_base in ((0, True), (1, False)):
        words = [word() for _ in range(120)]

        def edited(text, places):
            return [word() if p in places else w for p, w in enumerate(text)]  # noqa: B023

        families = [edited(words, set(r.sample(range(120), 2))) for _ in range(4)]
        texts = [words] if with_base else []
        texts += [edited(words, set(r.sample(range(5, 115), n))) for n in (1, 2, 3, 3, 4, 4) for _ in range(25)]
        texts += [edited(f, set(r.sample(range(5, 115), n))) for f in families for n in (1, 2, 3) for _ in range(6)]
        rows += [(1000 * base + i, " ".join(t)) for i, t in enumerate(texts)]
    asked, plain = [], neardup._verified

    def counting(pairs, sets):
        stored = neardup.materialise(pairs, "counted")
        asked.append(stored.count())
        return plain(stored, sets)

    monkeypatch.setattr(neardup, "_verified", counting)
    got = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(x.doc_id for x in got.collect()) == brute_kept(rows)
    assert sum(asked) < 16 * len(rows), asked  # all pairs would be a hundred for each row


def test_survivor_among_rows_of_equal_id_and_text(spark):
    rows = [(1, "a b c d e f", lang, k) for lang in ("x", "y", None) for k in range(2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, k int")
    kept = [tuple(neardup.deduplicate(docs.repartition(n)).first()) for n in (1, 4)]
    assert kept[0] == kept[1] and neardup.deduplicate(docs).count() == 1


def test_keys_meet_at_the_similarity():
    assert (1 - 0.8**neardup.MINIMA) ** neardup.KEYS <= 5e-8
    r = np.random.default_rng(5)
    a = np.unique(r.integers(0, 2**63, 9000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:8000], r.integers(0, 2**63, 1000, dtype=np.uint64)]))  # a similarity of 0.8
    assert len(neardup.bands(a)) == neardup.KEYS and set(neardup.bands(a)) & set(neardup.bands(b))
    assert not len(neardup.bands(a[:0]))
