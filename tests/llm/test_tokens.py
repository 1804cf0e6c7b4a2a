import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skylattice.llm import tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokens.tokenizer_path())


HARD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "a\n\n  b", "\t \tb", "don't  stop", "x   y", "x　 z", "<|endoftext|> a", "a <|endoftext|>b  c\n", "<|endoftext|><|endoftext|>", "<|endoftext| >", "é è 123 4,5", "a\x1c b", "tab\t\n \tb", "  lead and trail  ", "\r\n \r\n"]


@pytest.mark.parametrize("start", [0, 7])
def test_encoding_by_word_equals_the_library(library, start):
    r = random.Random(1)
    texts = HARD + ["".join(r.choice(" \n\tab'sé1., ") for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["été naïve ﬁne straße ǅ ªb x² 東京 都 ا ب"]
    ids, sizes = tokens.WordEncoder(tokens.tokenizer_path()).encode(pa.array(texts).slice(start))
    for t, g in zip(texts[start:], np.split(ids, np.cumsum(sizes)[:-1])):
        assert g.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(ids) == sum(sizes)


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_words_of_earlier_slices_are_remembered(library, monkeypatch, most):
    """Only new words reach the tokenizer while they fit; ids are the library's when they don't as well."""
    monkeypatch.setattr(tokens, "KNOWN_WORDS", most)
    r, encoder, new = random.Random(2), tokens.WordEncoder(tokens.tokenizer_path()), []
    plain = encoder._distinct
    monkeypatch.setattr(encoder, "_distinct", lambda words, odd: new.append(words.to_pylist()) or plain(words, odd))
    slices = [HARD + [" ".join(r.choice(["the", "the,", "sea\nis", "\nblue", "7th", "été"]) + str(r.randint(0, n)) for _ in range(40)) for _ in range(5)] for n in (3, 30, 3)]
    for texts in [*slices, slices[2], ["x" * 2_000_000, "the sea"]]:
        ids, sizes = encoder.encode(pa.array(texts))
        for t, g in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            assert g.tolist() == library.encode(t, add_special_tokens=False).ids
    if most == 1 << 20:
        assert sum(map(len, new)) == len(set().union(*new)) and new[3] == []
    assert len(encoder.known) <= most


def test_special_tokens_as_text(library):
    texts = ["a <|endoftext|> b", "c"]
    library = tokenizers.Tokenizer.from_file(tokens.tokenizer_path())
    library.encode_special_tokens = True
    ids, sizes = tokens.WordEncoder(tokens.tokenizer_path(), special_as_text=True).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_lookup_unpacks_little_of_a_file():
    r = np.random.default_rng(3)
    ids = r.integers(0, 50_000, 400_000)
    w = tokens.WaveletMatrix(tokens.write_wavelet(ids, [1], [len(ids)], 16))
    for i in (0, 77_777, 399_999):
        w.unpacked.clear()
        assert w.access(i) == ids[i] and len(w.unpacked) <= w.bits < w.bits * w.per_plane / 5
    common = int(np.bincount(ids).argmax())
    assert w.occurrences(common) == np.flatnonzero(ids == common).tolist()


@pytest.mark.parametrize("uri", ["file:{}", "file://{}", "{}"])
def test_folders_as_hadoop_writes_them(tmp_path, uri):
    for attempt in (1, 2):
        tokens.put_file(uri.format(tmp_path / "shards"), "a.wvm", b"x" * attempt, attempt)
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "shards").iterdir()] == [("a.wvm", b"xx")]


@pytest.mark.parametrize("n,high", [(0, 5), (1, 2), (5000, 7), (9000, 50257), (4096, 2), (8192, 70000)])
def test_wavelet_matrix(n, high):
    r = np.random.default_rng(n)
    ids = r.integers(0, high, n)
    bits = max(1, int(high - 1).bit_length())
    w = tokens.WaveletMatrix(tokens.write_wavelet(ids, [3, None], [n, 0], bits))
    assert w.decode().tolist() == ids.tolist() and w.doc_ids == [3, None]
    for i in r.integers(0, n, 40) if n else []:
        token = int(ids[i])
        places = np.flatnonzero(ids == token)
        assert w.access(int(i)) == token and w.count(token) == len(places)
        assert w.rank(token, int(i)) == int((ids[:i] == token).sum())
        k = int(r.integers(0, len(places)))
        assert w.select(token, k) == places[k]
    if n == 5000:
        assert w.occurrences(3) == np.flatnonzero(ids == 3).tolist()
    assert w.count(high + 1 if high + 1 < 1 << bits else 0) == int((ids == (high + 1 if high + 1 < 1 << bits else 0)).sum())


def test_corpus_round_trip(spark, library):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "beta,", "γάμμα", "x  y"]) for _ in range(r.randint(0, 40)))) for i in r.sample(range(10_000), 300)]
    rows += [(7, None), (8, ""), (8, ""), (9, "word " * 3000)]
    got = tokens.encode_corpus(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, start int").repartition(4), tokens.tokenizer_path(), shard_tokens=500).collect()
    got.sort(key=lambda g: g.start)
    assert [g.doc_id for g in got] == sorted(i for i, _ in rows)
    at, texts = 0, {}
    for i, t in rows:
        texts.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    for g in got:
        assert g.start == at and (g.n_tokens, g.ids_crc32) in [(len(x), zlib.crc32(x.tobytes())) for x in texts[g.doc_id]]
        at += g.n_tokens


def test_empty_table(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), tokens.tokenizer_path()).count() == 0
