"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

The index is fitted on a bounded sample of the labelled rows: at most ``MAX_EXAMPLES`` of each class and ``MAX_BYTES`` of
their texts, those of the smallest hash of their id; a text of over a 32nd of these bytes is no example. Terms are
lower-cased words and the beginnings of longer ones, held as 64-bit hashes. Every term of every example is in the index; a
term of a document that no example has would add nothing to a cosine but length, the same for all examples, and is left
out of both. A term weighs ``(1 + ln count) * idf * boost``: the inverse document frequency is counted over all documents, and the boost, 1 for most
terms, grows with the certainty that a term points to toxic examples. A verbatim copy of an example has cosine 1.

Examples lie in blocks. Terms that few examples have are kept as postings and summed in full. For the frequent ones the
index keeps the weights of each block as a matrix, and the largest weight of each term in each block: what the postings
give and these maxima bound the cosines of a block from above. Two blocks of the highest bound are scored first, then
only blocks whose bound reaches the ``NEIGHBOURS``-th best cosine so far. Cosines are summed again in double precision
for the neighbours and those as near as rounding could confuse, so the result equals a full scan.

The neighbours vote, weighted by squared cosine and by the share of their class that was sampled. The votes are
calibrated on the examples themselves, each scored without itself (monotone regression). A document whose cosine with
all examples is 0 gets the toxic rate of examples that are as lonely, drawn towards that of all. Whole texts of all
documents are scored; a very long one is counted in pieces that are cut between words.

Null and empty texts have no terms. Null ids are never held out. Labels that are null or name no document are not
learnt from; without any example all scores are 0. Ties between examples go to the earlier in index order, equal rows
get equal scores. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from skylattice.llm.arrow import map_batches
from skylattice.storage import materialise

MAX_EXAMPLES, MAX_BYTES, NEIGHBOURS, BLOCK = 1024, 16 << 20, 15, 64
#: Letters of a word's beginning that are terms as well.
STEMS = (4, 5)
#: How much a term weighs more for each unit by which its log ratio of rates, less some standard errors, is over MIN_LOG_RATE.
BOOST, MIN_LOG_RATE, STANDARD_ERRORS, MIN_TOXIC = 10.0, 0.5, 1.5, 3
#: A term that one in so many examples has is a frequent one.
FREQUENT = 16
THRESHOLD = 0.3
#: Characters of text that are counted at a time, and postings that are summed at a time.
PIECE, POSTINGS = 1 << 21, 1 << 20
_BREAK = re.compile(r"[\s\d]")
_NOT_WORD = r"[^\p{L}]+"


@dataclass
class Counts:
    """Terms of some rows: by row and term, how often."""

    row: np.ndarray
    term: np.ndarray
    n: np.ndarray


def _pieces(text: str) -> list[str]:
    """A text in pieces of some ``PIECE`` characters, cut at a blank or digit where there is one."""
    found, at = [], 0
    while at < len(text):
        cut = _BREAK.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        found.append(text[at:end])
        at = end
    return found


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))


def _count(row: np.ndarray, texts: pa.Array) -> Counts:
    """Counts of term hashes; ``row`` names the row of each text."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), _NOT_WORD)
    coded = lists.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    row = np.repeat(row, pc.list_value_length(lists).to_numpy())
    length = pc.utf8_length(words).to_numpy()
    table, present = np.zeros((len(words), 1 + len(STEMS)), np.uint64), np.zeros((len(words), 1 + len(STEMS)), bool)
    table[:, 0], present[:, 0] = _hashes(words), length > 0
    for i, k in enumerate(STEMS, 1):
        present[:, i] = length > k
        stems = pc.utf8_slice_codeunits(words.filter(pa.array(present[:, i])), 0, k).dictionary_encode()
        table[present[:, i], i] = _hashes(pc.binary_join_element_wise(stems.dictionary, "*", ""))[stems.indices.to_numpy()]
    distinct, local = np.unique(table, return_inverse=True)
    local = local.reshape(table.shape)
    kept = present[code]
    key = row[:, None] * len(distinct) + local[code]
    keys, n = np.unique(key[kept], return_counts=True)
    return Counts(keys // max(1, len(distinct)), distinct[keys % max(1, len(distinct))], n)


def count_terms(texts: pa.Array) -> Counts:
    """Counts by row of a slice of texts, in order of row and hash."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
    parts, low = [], 0
    while low < len(size):
        high = max(low + 1, low + int(np.searchsorted(np.cumsum(size[low:]), PIECE, "right")))
        if size[low] > PIECE:
            pieces = [_count(np.full(1, low), pa.array([x], pa.string())) for x in _pieces(texts[low].as_py())]
            term, inverse = np.unique(np.concatenate([c.term for c in pieces]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([c.n for c in pieces]), len(term)).astype(np.int64)
            parts.append(Counts(np.full(len(term), low), term, n))
        else:
            parts.append(_count(np.arange(low, high), pc.fill_null(texts.slice(low, high - low), "")))
        low = high
    join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(getattr(c, name) for c in parts)])
    return Counts(join("row", np.int64), join("term", np.uint64), join("n", np.int64))


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in an ascending array of those of ``wanted`` that it has, and which these are."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    which = np.flatnonzero(known[at] == wanted)
    return at[which], which


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class BlockMaxIndex:
    """TF-IDF vectors of examples with their votes; ``nearest`` is exact."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, counts: Counts, toxic: np.ndarray, ids: list, class_sizes: tuple[int, int]):
        """hashes: all terms, ascending, with their weights; counts: of the examples, whose rows are numbered from 0;
        class_sizes: labelled documents of each class, of which the examples are a sample."""
        self.hashes, self.weights = hashes, weights
        n = len(toxic)
        row, term, weight = self.vectors(counts, n)
        frequent = np.bincount(term, minlength=len(hashes)) * FREQUENT >= max(n, 1)
        # examples that share their weightiest frequent term lie side by side, which keeps the block maxima low
        lead = np.full(n, -1)
        heavy = np.flatnonzero(frequent[term])
        heavy = heavy[np.lexsort((term[heavy], weight[heavy]))]
        lead[row[heavy]] = term[heavy]
        order = np.lexsort((np.arange(n), lead))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sampled = np.bincount(toxic, minlength=2)
        shares = np.array([class_sizes[c] / max(1, sampled[c]) for c in (0, 1)])
        self.toxic, self.ids, self.shares = toxic[order], [ids[i] for i in order], shares[toxic[order]]
        at = place[row]
        # by example, in order of term
        by = np.lexsort((term, at))
        self.terms, self.values = term[by].astype(np.int32), weight[by]
        self.starts = np.searchsorted(at[by], np.arange(n + 1))
        # postings of the rare terms
        rare = np.flatnonzero(~frequent[term])
        rare = rare[np.lexsort((at[rare], term[rare]))]
        self.posting_at, self.posting_w = at[rare].astype(np.int32), weight[rare].astype(np.float32)
        self.posting_starts = np.searchsorted(term[rare], np.arange(len(hashes) + 1)).astype(np.int64)
        # the frequent terms by block, and their largest weights
        self.n_blocks = -(-n // BLOCK)
        self.dense_of = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
        often = np.flatnonzero(frequent[term])
        self.dense = np.zeros((int(frequent.sum()), self.n_blocks * BLOCK), np.float32)
        self.dense[self.dense_of[term[often]], at[often]] = weight[often]
        self.most = self.dense.reshape(len(self.dense), self.n_blocks, BLOCK).max(axis=2, initial=0)
        self._calibrate()

    def vectors(self, counts: Counts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term number, weight) of unit vectors over the terms of the index, in order of row and term; the rows
        are 0 to n - 1. A row without terms of weight has none."""
        term, known = _find(self.hashes, counts.term)
        row = counts.row[known]
        weight = (1 + np.log(counts.n[known])) * self.weights[term]
        length = np.sqrt(np.bincount(row, weight * weight, n))
        some = length[row] > 0
        return row[some], term[some], weight[some] / length[row[some]]

    def _approximate(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, skip: np.ndarray | None, k: int) -> np.ndarray:
        """Cosines of n rows with the examples in single precision; -1 where a block can't hold one of the k nearest."""
        width = self.n_blocks * BLOCK
        sizes = self.posting_starts[term + 1] - self.posting_starts[term]
        places = _spread(self.posting_starts[term], sizes)
        flat = np.repeat(row * width, sizes) + self.posting_at[places]
        base = np.bincount(flat, self.posting_w[places] * np.repeat(weight, sizes), n * width).astype(np.float32).reshape(n, width)
        queries = np.zeros((n, len(self.dense)), np.float32)
        often = self.dense_of[term] >= 0
        queries[row[often], self.dense_of[term[often]]] = weight[often]
        bound = base.reshape(n, self.n_blocks, BLOCK).max(axis=2) + queries @ self.most
        scores = np.full((n, width), -1, np.float32)

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows, cut = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                scores[rows, cut] = base[rows, cut] + queries[rows] @ self.dense[:, cut]
            scores[:, len(self.toxic) :] = -1
            if skip is not None:
                scores[np.arange(n), skip] = -1

        seen = np.zeros(bound.shape, bool)
        np.put_along_axis(seen, np.argsort(-bound, axis=1)[:, :2], True, axis=1)
        visit(seen)
        kth = np.partition(scores, width - k, axis=1)[:, width - k] if width >= k else np.full(n, -1)
        visit((bound >= np.maximum(kth, 0)[:, None] - 1e-5) & (bound > 0) & ~seen)
        return scores

    def nearest(self, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, skip: np.ndarray | None = None, k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n rows, the places and cosines of the k nearest examples with a cosine over 0. ``skip``: a place
        for each row that is left out."""
        if not len(self.toxic):
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        row, term, weight = vectors
        ends = np.searchsorted(row, np.arange(n + 1))
        work = np.cumsum(np.append(0, self.posting_starts[term + 1] - self.posting_starts[term]))[ends]
        found, low, scratch = [], 0, np.zeros(len(self.hashes))
        while low < n:
            # as many rows as keep the postings and the scores small
            high = min(n, low + 64, max(low + 1, int(np.searchsorted(work, work[low] + POSTINGS, "right")) - 1))
            cut = slice(ends[low], ends[high])
            scores = self._approximate(row[cut] - low, term[cut], weight[cut], high - low, None if skip is None else skip[low:high], k)
            for i in range(low, high):
                own = slice(ends[i], ends[i + 1])
                scratch[term[own]] = weight[own]
                found.append(self._exact(scores[i - low], scratch, k))
                scratch[term[own]] = 0
            low = high
        return found

    def _exact(self, scores: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest among those whose approximate cosine could be."""
        kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else 0
        places = np.flatnonzero((scores > 0) & (scores >= kth - 1e-5))
        if not len(places):
            return places, np.zeros(0)
        runs = zip(self.starts[places].tolist(), self.starts[places + 1].tolist())
        cosines = np.array([self.values[x:y] @ query[self.terms[x:y]] for x, y in runs]).round(12)
        best = np.lexsort((places, -cosines))[:k]
        return places[best], cosines[best]

    def _vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines**2 * self.shares[places]
        return float((w @ self.toxic[places]) / w.sum())

    def _calibrate(self) -> None:
        """The curve from votes to scores, and the score of what has no neighbour."""
        n = len(self.toxic)
        row = np.repeat(np.arange(n), np.diff(self.starts))
        near = self.nearest((row, self.terms.astype(np.int64), self.values), n, skip=np.arange(n))
        lonely = np.array([not len(p) for p, _ in near], bool)
        total = self.shares.sum()
        rate = float(self.shares @ self.toxic / total) if n else 0.0
        self.base = float((self.shares[lonely] @ self.toxic[lonely] + rate) / (self.shares[lonely].sum() + 1)) if n else 0.0
        votes = np.array([self._vote(*x) for x in near if len(x[0])])
        self.points = monotone(votes, self.toxic[~lonely], self.shares[~lonely]) if len(votes) else (np.zeros(1), np.zeros(1))

    def score(self, texts: pa.Array) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each text, the calibrated score, and the places and cosines of its neighbours."""
        near = self.nearest(self.vectors(count_terms(texts), len(texts)), len(texts))
        return [(float(np.interp(self._vote(p, c), *self.points)) if len(p) else self.base, p, c) for p, c in near]


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression by pooling adjacent violators: the points of a curve."""
    merged: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        merged.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
            last = merged.pop()
            merged[-1] = [a + b for a, b in zip(merged[-1], last)]
    return np.array([m[0] / m[2] for m in merged]), np.array([m[1] / m[2] for m in merged])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def document_frequencies(docs: DataFrame, hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that have each term. A task sends its sums."""
    shared = docs.sparkSession.sparkContext.broadcast(hashes)  # terms of the sample, bounded by its bytes

    def run(batches):
        known, total, n = shared.value, np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                total += np.bincount(_find(known, count_terms(part.column("text")).term)[0], minlength=len(known))
                n += part.num_rows
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], n), pa.int64())], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    df = np.zeros(len(hashes), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def _examples(docs: DataFrame, usable: DataFrame, max_examples: int, max_bytes: int) -> DataFrame:
    """The sample, a row for each example: doc_id, toxic, and its terms as bytes (hashes, counts) in order of hash."""
    rank = F.xxhash64("doc_id", F.lit("example"))
    pick = lambda c: usable.where(F.col("toxic") == c).orderBy(rank, "doc_id").limit(max_examples)
    sample = pick(0).unionByName(pick(1))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # 2 * max_examples rows at most
    # one text for an id; then as many as fit the bytes of their class
    one = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    until = W.partitionBy("toxic").orderBy(rank, "doc_id").rowsBetween(W.unboundedPreceding, 0)
    sized = materialise(one.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "example-texts")
    # a text over a sixteenth of these bytes would push out the examples after it
    short = sized.where(F.col("bytes") <= max_bytes // 32)
    chosen = short.select("doc_id", "toxic", F.sum("bytes").over(until).alias("total")).where(F.col("total") <= max_bytes // 2)

    def run(batch):
        counts = count_terms(batch.column("text"))
        ends = np.searchsorted(counts.row, np.arange(batch.num_rows + 1)).tolist()
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "terms": cut(counts.term), "counts": cut(counts.n)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sized.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("doc_id", "toxic", "text")
    return map_batches(rows, run, f"doc_id {kind}, toxic int, terms binary, counts binary")


def boosts(counts: Counts, toxic: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """What each term weighs more: 1 unless it is surely more frequent in toxic examples. Equal examples count once."""
    ends = np.searchsorted(counts.row, np.arange(len(toxic) + 1)).tolist()
    first: dict[tuple, int] = {}
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        first.setdefault((toxic[i], counts.term[a:b].tobytes(), counts.n[a:b].tobytes()), i)
    once = np.zeros(len(toxic), bool)
    once[list(first.values())] = True
    term = np.searchsorted(hashes, counts.term)
    df = [np.bincount(term[once[counts.row] & (toxic[counts.row] == c)], minlength=len(hashes)) for c in (0, 1)]
    n = np.bincount(toxic, minlength=2)
    log_rate = np.log((df[1] + 0.5) / (n[1] + 1) / ((df[0] + 0.5) / (n[0] + 1)))
    error = np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))
    sure = np.maximum(0, log_rate - STANDARD_ERRORS * error - MIN_LOG_RATE)
    return 1 + BOOST * np.where(df[1] >= MIN_TOXIC, sure, 0)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES) -> BlockMaxIndex:
    """The index on a bounded sample of the labelled rows that are not held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = sorted(_examples(docs, usable, max_examples, max_bytes).collect(), key=lambda r: r["doc_id"])
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    term, n = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in rows)]) for c, kind in (("terms", np.uint64), ("counts", np.int64)))
    row = np.repeat(np.arange(len(rows)), [len(r["terms"]) // 8 for r in rows])
    counts, hashes = Counts(row, term, n), np.unique(term)
    n_docs, df = document_frequencies(docs, hashes) if len(rows) else (0, np.zeros(0, np.int64))
    weights = np.log((1 + n_docs) / (1 + df)) * boosts(counts, toxic, hashes)
    return BlockMaxIndex(hashes, weights, counts, toxic, [r["doc_id"] for r in rows], (sizes.get(0, 0), sizes.get(1, 0)))


def score_toxicity(docs: DataFrame, index: BlockMaxIndex, evidence: bool = True) -> DataFrame:
    """``docs`` with toxic_score and, on request, toxic_evidence: the ids and cosines of the nearest examples. Columns of
    these names are replaced."""
    docs = docs.drop("toxic_score", "toxic_evidence")
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_EXAMPLES and MAX_BYTES

    def run(batch):
        model = shared.value
        found = model.score(batch.column("text"))
        out = dict(zip(batch.schema.names, batch.columns)) | {"toxic_score": [x[0] for x in found]}
        if evidence:
            near = [zip(p.tolist(), c.tolist()) for _, p, c in found]
            out["toxic_evidence"] = [[{"doc_id": model.ids[i], "cosine": c} for i, c in pairs] for pairs in near]
        return out

    schema = T.StructType([*docs.schema.fields]).add("toxic_score", "double")
    if evidence:
        pair = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("cosine", T.DoubleType())])
        schema = schema.add("toxic_evidence", T.ArrayType(pair))
    return map_batches(docs, run, schema)


def reject_toxic(docs: DataFrame, index: BlockMaxIndex, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batch):
        clean = batch.filter(pa.array([x[0] < threshold for x in shared.value.score(batch.column("text"))], pa.bool_()))
        return dict(zip(clean.schema.names, clean.columns))

    return map_batches(docs, run, docs.schema)


def op10_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score_toxicity(docs, index)
    predicted = (F.col("toxic_score") >= THRESHOLD).cast("int")
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), predicted.alias("predicted"), F.col("toxic_evidence").alias("evidence"))
