import re
from collections import Counter

import pytest

from skylattice.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c a b c", "x x x x", "é# *b\n\né# *b\nc\x0bd", "l\nl\nl \n l", "one two three four one two three", "　wide space\x85 x\x1cy", "a b c d a b c e a b"]


@pytest.mark.parametrize("text", TEXTS)
def test_word_stats(text):
    assert quality.word_stats((text or "").encode()) == plain(text)


def prose(i, n=80):
    return " ".join(f"w{(i * 7919 + k * (k + i)) % 997:03d}" for k in range(n))


def test_rules(spark):
    rows = [(i, "en", "s1" if i % 2 else "s2", prose(i)) for i in range(500)]
    junk = [(1000 + i, "en", "s1", prose(i).replace(" ", "*** ")) for i in range(60)]
    mesh = [(2000, None, None, prose(1)), (2001, "en", "tiny", prose(2).replace(" ", "### ")), (2002, "en", "s1", None), (2003, "en", "s1", "too short"), (2004, "en", "s2", "again and again " * 40), (0, "en", "s2", prose(0))]
    docs = spark.createDataFrame([(*r, 1) for r in rows + junk + mesh], "doc_id long, lang string, source string, text string, size int").repartition(5)
    got = {}
    for r in quality.quality_rules(docs).collect():
        text = next(t for i, _, _, t in rows + junk + mesh if i == r.doc_id)
        n = plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.kept and r.base_failed)
        got[r.doc_id] = r.kept
    assert all(got[i] for i in range(500)) and got[2000]
    assert not any(got[i] for i in (*range(1000, 1060), 2001, 2002, 2003, 2004))


def test_sketches_merge_and_bound_the_error(spark):
    rows = [(i, "en", f"s{i % 3}", prose(i, 60 + i % 40) + " #" * (i % 30)) for i in range(300)]
    stats = quality.document_stats(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"))
    whole = quality.ratio_sketches(stats, ["lang"])
    merged = quality.merge_sketches(quality.ratio_sketches(stats, ["lang", "source"]), ["lang"])
    assert sorted(map(tuple, whole.select(*merged.columns).collect())) == sorted(map(tuple, merged.collect()))
    values = sorted(r.n_symbols / r.n_words for r in stats.collect())
    fence = quality.sketch_fences(quality.sketch_quartiles(whole, ["lang"]), ["lang"], 1.0).first().fences.symbols
    q1, q3 = values[len(values) // 4 - 1], values[3 * len(values) // 4 - 1]
    assert fence.high == pytest.approx(q3 + max(0.1, q3 - q1), rel=0.03)


def test_small_groups_lean_on_wider_ones_without_a_switch(spark):
    rows = [("en", "s", 0.1)] * 199 + [("en", "t", 0.5)] * 2 + [("de", "s", 0.3)]
    stats = spark.createDataFrame([(l, s, 1000, 0, int(1000 * v), 0, 0) for l, s, v in rows], "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    keys = ["lang", "source"]
    own = quality.ratio_sketches(stats, keys)
    langs = quality.merge_sketches(own, keys[:1])
    lang = quality.shrunk(quality.sketch_quartiles(langs, keys[:1]), quality.sketch_quartiles(quality.merge_sketches(langs, []), []), [], 50)
    got = {(r.lang, r.source): r.q3 for r in quality.shrunk(quality.sketch_quartiles(own, keys), lang, keys[:1], 50).where("ratio = 'symbols'").collect()}
    de = (1 * 0.3 + 50 * 0.1) / 51
    assert got["en", "s"] == pytest.approx(0.1, rel=0.02)
    assert got["en", "t"] == pytest.approx((2 * 0.5 + 50 * 0.1) / 52, rel=0.02)
    assert got["de", "s"] == pytest.approx((1 * 0.3 + 50 * de) / 51, rel=0.02)


def test_empty_table(spark):
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).count() == 0
