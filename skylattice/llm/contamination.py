"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words: the hash of five selected words, those between are ignored. The masks
in ``MASKS`` were chosen so that any two passages of 6 to 20 words with at most a fifth of the words substituted share a
seed. All seeds of the benchmark, in blocks of bounded size, form a hash table; the seeds of every document are joined
to it, behind a bitmap that discards nearly all. Each hit proposes an alignment of the document with an item, which is
verified on the words: somewhere along it, ``window`` neighbouring words (or the whole item, if shorter) must agree in
a share of ``similarity`` or more.

Words are lower-cased runs of letters and digits; in scripts without spaces each character is a word. An item of five
words or fewer must match exactly, and ``decontaminate`` removes a document for an item of fewer than five only if it is
the whole document: so short a passage says nothing of where it is from. Where a word repeats, as a run of one word does,
hits that the hit before them implies are left out, and hits are reduced to alignments a portion at a time. Null and
empty texts have no words. Repeated rows are judged each; a document gives one row for each item (by item_id and text)
found in it. Extra columns are ignored by ``contaminated`` and kept by ``decontaminate``; an empty table on either side
gives no hits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.arrow import map_batches

MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5), (0, 1, 2, 3, 6))
SIMILARITY, WINDOW, MIN_WORDS = 0.8, 20, 5
BLOCK_BYTES = 4 << 20
BITMAP_BITS = 23
CHUNK = 1 << 16
CACHE_WORDS = 200_000
#: Hits that are expanded at a time.
HITS = 1 << 20
#: Thai, kana and Han characters, which stand for words of their own.
_UNSPACED = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_FACTORS = np.array([xxhash.xxh64_intdigest(f"factor {i}") | 1 for i in range(5)], np.uint64)
_MASK_SALT = np.array([xxhash.xxh64_intdigest(f"mask {i}") for i in range(len(MASKS))], np.uint64)
_words: dict[str, int] = {}


def word_hashes(text: str | None) -> list[int]:
    """A 64-bit hash of each word."""
    words = _WORD.findall(text.lower()) if text else []
    try:
        return [_words[w] for w in words]
    except KeyError:
        if len(_words) > CACHE_WORDS:
            _words.clear()
        for w in words:
            if w not in _words:
                _words[w] = xxhash.xxh64_intdigest(w)
        return [_words[w] for w in words]


def seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    """The seed from each position at which the mask fits."""
    offsets = MASKS[mask]
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = hashes[:n] * _FACTORS[0]
    for o, f in zip(offsets[1:], _FACTORS[1:]):
        s = s + hashes[o : o + n] * f
    s ^= _MASK_SALT[mask]
    return s ^ (s >> np.uint64(31))


def aligned(words: np.ndarray, item: np.ndarray, diagonal: int, window: int, similarity: float) -> tuple[int, int, int] | None:
    """Along one alignment (document position minus item position): the first word in the document, the number of words
    and of equal words of the union of all windows that agree enough."""
    low, high = max(0, -diagonal), min(len(item), len(words) - diagonal)
    w = min(window, len(item))
    if high - low < w:
        return None
    same = item[low:high] == words[low + diagonal : high + diagonal]
    sums = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(sums[w:] - sums[:-w] >= similarity * w - 1e-9)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + w
    return low + diagonal + first, last - first, int(sums[last] - sums[first])


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n (one to four) neighbouring words from each position."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    s = sum((hashes[i : len(hashes) - n + 1 + i] * _FACTORS[i] for i in range(1, n)), hashes[: len(hashes) - n + 1] * _FACTORS[0])
    return s ^ (s >> np.uint64(31))


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    rows = np.unique(np.stack(columns, axis=1), axis=0)
    return [rows[:, i] for i in range(len(columns))]


@dataclass
class SeedTable:
    """A block of the benchmark: words of its items, and their seeds sorted by hash."""

    ids: list
    items: list[np.ndarray]

    def __post_init__(self):
        hashes, items, places, follows = ([np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64, bool))
        for i, item in enumerate(self.items):
            for m in range(len(MASKS)):
                s = seeds(item, m)
                hashes.append(s)
                items.append(np.full(len(s), i))
                places.append(np.arange(len(s)))
                follows.append(np.append(False, s[1:] == s[:-1])[: len(s)])
        hashes, items, places, follows = map(np.concatenate, (hashes, items, places, follows))
        order = np.lexsort((follows, hashes))
        self.item, self.place = items[order], places[order]
        # of each hash, all its entries, and first those that no equal seed precedes in their item
        self.hashes, self.starts, self.sizes = np.unique(hashes[order], return_index=True, return_counts=True)
        self.leading = np.add.reduceat((~follows[order]).astype(np.int64), self.starts) if len(self.hashes) else self.sizes
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[self.hashes >> np.uint64(64 - BITMAP_BITS)] = True
        self.short = {}
        for n in range(1, MIN_WORDS):
            found = sorted((int(run_hashes(item, n)[0]), i) for i, item in enumerate(self.items) if len(item) == n)
            if found:
                self.short[n] = np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found])

    def hits(self, hashes: np.ndarray):
        """Positions in a run of words, with the item and place that each seed hit proposes, a portion at a time. Of a
        seed equal to the one before it, only entries that begin a run of equal seeds count: the others lie on the
        diagonal of a hit of the seed before."""
        for m in range(len(MASKS)):
            s = seeds(hashes, m)
            maybe = np.flatnonzero(self.bitmap[s >> np.uint64(64 - BITMAP_BITS)])
            at = np.minimum(np.searchsorted(self.hashes, s[maybe]), len(self.hashes) - 1) if len(self.hashes) else maybe[:0]
            same = self.hashes[at] == s[maybe[: len(at)]]
            at, maybe = at[same], maybe[: len(at)][same]
            again = (maybe > 0) & (s[maybe] == s[maybe - 1])
            n = np.where(again, self.leading[at], self.sizes[at])
            sums, low = np.cumsum(n), 0
            while low < len(n):
                high = max(low + 1, int(np.searchsorted(sums, sums[low] - n[low] + HITS, "right")))
                part = n[low:high]
                inner = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part) + np.repeat(self.starts[at[low:high]], part)
                yield np.repeat(maybe[low:high], part), self.item[inner], self.place[inner]
                low = high

    def _short_hits(self, flat: np.ndarray, starts: np.ndarray, words: list[np.ndarray]):
        """(document, item, first word) of each short item in each document that has all its words in a row."""
        for n, (hashes, items) in self.short.items():
            for low in range(0, len(flat), CHUNK):
                s = run_hashes(flat[low : low + CHUNK + n - 1], n)
                first, last = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
                at = np.flatnonzero(last > first)
                doc = np.searchsorted(starts, at + low, "right") - 1
                # of equal runs in a document the first; the number of items of one hash is that of equal items
                _, once = np.unique(np.stack((doc, first[at]), axis=1), axis=0, return_index=True)
                for d, x in zip(doc[once].tolist(), at[once].tolist()):
                    place = x + low - int(starts[d])
                    for i in items[first[x] : last[x]].tolist():
                        if np.array_equal(words[d][place : place + n], self.items[i]):
                            yield d, i, place

    def search(self, texts: list[str | None], window: int, similarity: float) -> list[list[tuple]]:
        """For each text, (item_id, first word, words, equal words) of the best alignment with each item found."""
        words = [np.array(word_hashes(x), np.uint64) for x in texts]
        found: list[dict[int, tuple]] = [{} for _ in texts]
        reach = max(m[-1] for m in MASKS)
        gap = np.zeros(reach, np.uint64)  # seeds across two texts cover it; a zero is no word's hash
        flat = np.concatenate([x for w in words for x in (w, gap)]) if words else gap
        starts = np.cumsum([0, *(len(w) + reach for w in words[:-1])])
        for low in range(0, len(flat), CHUNK):
            proposed = [np.zeros(0, np.int64)] * 3
            for at, item, place in self.hits(flat[low : low + CHUNK + reach]):
                fresh = at < CHUNK
                at, item, place = at[fresh] + low, item[fresh], place[fresh]
                doc = np.searchsorted(starts, at, "right") - 1
                proposed = _distinct(*(np.concatenate(x) for x in zip(proposed, (doc, item, at - starts[doc] - place))))
            for d, i, g in zip(*(x.tolist() for x in proposed)):
                if (x := aligned(words[d], self.items[i], g, window, similarity)) and x[2] > found[d].get(i, (0, 0, 0))[2]:
                    found[d][i] = x
        for d, i, place in self._short_hits(flat, starts, words):
            n = len(self.items[i])
            found[d].setdefault(i, (place, n, n))
        return [[(self.ids[i], *x) for i, x in sorted(f.items())] for f in found]

    def is_contaminated(self, texts: list[str | None], window: int, similarity: float) -> list[bool]:
        """Whether an item is found in a text: one of five words or more, or one that is the whole text."""
        found = self.search(texts, window, similarity)
        return [any(n >= MIN_WORDS or n == len(word_hashes(t)) for _, _, n, _ in f) for t, f in zip(texts, found)]


def seed_tables(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark as seed tables of some ``block_bytes`` of text each, one at a time."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
        pairs = [(r.item_id, np.array(h, np.uint64)) for r in rows if (h := word_hashes(r.text))]
        if pairs:
            yield SeedTable([p[0] for p in pairs], [p[1] for p in pairs])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, first_word, n_words, n_equal, similarity."""
    spark, (doc_kind, item_kind) = docs.sparkSession, (docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString())
    schema = f"doc_id {doc_kind}, item_id {item_kind}, first_word long, n_words long, n_equal long"
    parts = []
    for table in seed_tables(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(table)

        def run(batch, shared=shared):
            found = shared.value.search(batch.column("text").to_pylist(), window, similarity)
            out = [(i, *x) for i, f in zip(batch.column("doc_id").to_pylist(), found) for x in f]
            return dict(zip(("doc_id", "item_id", "first_word", "n_words", "n_equal"), zip(*out))) if out else None

        parts.append(map_batches(docs.select("doc_id", "text"), run, schema))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return found.withColumn("similarity", F.col("n_equal") / F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item of the benchmark is found; of fewer than five words, that are no item."""
    for table in seed_tables(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def run(batch, shared=shared):
            found = shared.value.is_contaminated(batch.column("text").to_pylist(), window, similarity)
            clean = batch.filter(pa.array([not f for f in found], pa.bool_()))
            return dict(zip(clean.schema.names, clean.columns))

        docs = map_batches(docs, run, docs.schema)
    return docs


def op8_spaced_seeds(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_UNSPACED = r"\x{0e00}-\x{0e7f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
_SQL_WORDS = rf"regexp_extract_all(lower(text), '[{_SQL_UNSPACED}]|(?:[^\P{{L}}{_SQL_UNSPACED}]|[^\P{{N}}{_SQL_UNSPACED}])+')"

ORACLE_SQL = {
    "op8_spaced_seeds": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS iid, item_id, w, len(w) AS n, least({WINDOW}, len(w)) AS k FROM (SELECT DISTINCT item_id, text, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
x AS (SELECT rid, len(w) AS nd, unnest(w) AS word, unnest(range(len(w))) AS dp FROM d),
y AS (SELECT iid, n, k, unnest(w) AS word, unnest(range(n)) AS ip FROM i),
m AS (SELECT rid, iid, dp - ip AS g, any_value(nd) AS nd, any_value(n) AS n, any_value(k) AS k, list(ip) AS hits FROM x JOIN y USING (word) GROUP BY ALL HAVING count(*) >= {SIMILARITY} * any_value(k) - 1e-9),
s AS (SELECT m.*, unnest(range(greatest(0, -g), least(n, nd - g) - k + 1)) AS start FROM m),
f AS (SELECT rid, iid, g, any_value(hits) AS hits, min(start) AS first, max(start) + any_value(k) AS last FROM s
      WHERE len(list_filter(hits, lambda p: p >= start AND p < start + k)) >= CASE WHEN n <= {MIN_WORDS} THEN n ELSE {SIMILARITY} * k - 1e-9 END GROUP BY rid, iid, g),
e AS (SELECT *, len(list_filter(hits, lambda p: p >= first AND p < last)) AS n_equal FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY rid, iid ORDER BY n_equal DESC, g) AS r FROM e)
SELECT doc_id, item_id, (first + g)::BIGINT AS first_word, (last - first)::BIGINT AS n_words, n_equal::BIGINT AS n_equal, n_equal / (last - first) AS similarity
FROM b JOIN d USING (rid) JOIN i USING (iid) WHERE r = 1""",
}
