"""Ranked lexical search over a tiered index: high impacts first, lower tiers only for items without a proof.

A document's score for an item is a sum over the item's terms of an impact, a whole number that depends on the term's
rarity, its occurrences in the document and the document's length. The index has, for each term and shard of documents,
the postings in tiers of falling impact, and the largest impact of each tier. A search reads the first tier of the terms
of all items. What it has found of a document bounds the score from below; with the largest impacts of the unread tiers,
the residual bounds, it also bounds it from above, and so do the residuals alone for documents not met at all. An item is
proven when in every shard documents not met stay below the item's k-th lower bound, and few documents that were met can
reach it. Items without that proof fall through to the next tier; at the last one nothing is left unread. The candidates of
proven items are then completed from their unread tiers, so all scores are exact.

Terms are the maximal runs of ASCII letters and digits and of other code points, only A-Z lower-cased. Whole texts are
counted. Shards are bounded in documents and postings, so a frequent term is never whole in one task. Only terms of items
are indexed where these fit a broadcast; otherwise all are.

Null and empty texts have no terms: such documents are never found, such items find nothing. Repeated documents are found
each, repeated items each get their rows. Ties go to the smaller doc_id, null last. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.llm.arrow import map_batches, text_bytes
from skylattice.storage import fits_broadcast, join_small, materialise, release

K = 50
#: Tiers of the index: the first ends at a sixth of the highest impact, each of the next a third as high, the last at 0.
TIERS, FIRST, FALL = 4, 6, 3
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Terms of the items that a task searches for.
BLOCK_TERMS = 1 << 16
#: Documents of a shard that may still reach an item's k-th bound; with more, the next tier is read instead.
CANDIDATES = 4 * K
#: The row of a shard's documents in place of a term.
DOCUMENTS = b""
_FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
_FOUND = "block long, shard long, item long, unseen long, crowded boolean, docs array<int>, ids array<long>, low array<long>, high array<long>"
_EXACT = "item long, shard long, doc int, id long, score long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Rows (item, item_id, block, term); ``item`` numbers the rows of ``items``."""
    numbered = materialise(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    found = map_batches(numbered, lambda b: {"item": b.column("item"), "item_id": b.column("item_id"), "terms": [sorted(set(terms(x))) for x in text_bytes(b.column("text"))]}, "item long, item_id long, terms array<binary>")
    found = materialise(found, "item-terms")
    blocks = max(1, -(-(found.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    return found.select("item", "item_id", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), F.explode("terms").alias("term"))


def postings(docs: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """Rows (shard, term, n, total, docs, tfs, sizes): the documents of a shard that have a term, how often, and their
    sizes; n counts them. Documents are numbered by id in a shard. The row ``DOCUMENTS`` has all ids (docs), which are null
    (tfs), in n the documents with a term and in total their terms."""
    kind = "shard long, term binary, n long, total long, docs binary, tfs binary, sizes binary"
    named = [x.split()[0] for x in kind.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        only, first = shared.value, TaskContext.get().partitionId() << 24
        made, codes, code, tf, per_doc, size, ids = 0, {}, [], [], [], [], []

        def shard() -> pa.RecordBatch:
            id_of, sizes = np.array([i or 0 for i in ids], np.int64), np.array(size, np.int64)
            no_id = np.array([i is None for i in ids])
            by = np.lexsort((id_of, no_id))
            place = np.empty(len(by), np.int32)
            place[by] = np.arange(len(by), dtype=np.int32)
            doc, what, many = np.repeat(place, per_doc), np.array(code, np.int64), np.array(tf, np.int32)
            order = np.lexsort((doc, what))
            doc, what, many = doc[order], what[order], many[order]
            lengths = sizes[by][doc]
            ends = np.searchsorted(what, np.arange(len(codes) + 1)).tolist()
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            columns = [
                [first + made] * (len(codes) + 1), [*codes, DOCUMENTS], [*np.diff(ends).tolist(), int((sizes > 0).sum())], [*[0] * len(codes), int(sizes.sum())],
                [*cut(doc), id_of[by].tobytes()], [*cut(many), no_id[by].tobytes()], [*cut(lengths), b""],
            ]
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], named)

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                words = terms(text)
                counts = Counter(words)
                kept = counts if only is None else counts.keys() & only
                ids.append(i)
                size.append(len(words))
                per_doc.append(len(kept))
                for word in kept:
                    code.append(codes.setdefault(word, len(codes)))
                    tf.append(counts[word])
                if len(ids) >= SHARD_DOCS or len(code) >= SHARD_POSTINGS:
                    yield shard()
                    made, codes, code, tf, per_doc, size, ids = made + 1, {}, [], [], [], [], []
        if ids:
            yield shard()

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind), "postings")


def tiers(found: DataFrame) -> DataFrame:
    """The index: rows (shard, term, tops, d0, i0, d1, ...): documents and impacts of each tier, and its largest impact."""
    n, total = found.where(F.col("term") == DOCUMENTS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    n, total = int(n), max(1, int(total))
    df = found.where(F.col("term") != DOCUMENTS).groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = materialise(df.select("term", weight.alias("w")), "term-weights")
    most = (weights.agg(F.max("w")).first()[0] or 0) * 1_000_000
    starts = [most // (FIRST * FALL**t) for t in range(TIERS - 1)] + [0]
    weights = weights.unionByName(found.sparkSession.range(1).select(F.lit(DOCUMENTS).alias("term"), F.lit(0).cast("long").alias("w")))

    def run(batch):
        columns = {c: batch.column(c).to_pylist() for c in ("term", "w", "docs", "tfs", "sizes")}
        out = {"shard": batch.column("shard"), "term": batch.column("term"), "tops": []} | {f"{c}{t}": [] for t in range(TIERS) for c in "di"}
        for term, w, docs, tfs, sizes in zip(*columns.values()):
            if term == DOCUMENTS:
                parts, tops = [(docs, tfs)] + [(b"", b"")] * (TIERS - 1), [0] * TIERS
            else:
                doc, tf, size = np.frombuffer(docs, np.int32), np.frombuffer(tfs, np.int32).astype(np.int64), np.frombuffer(sizes, np.int64)
                length = 100 - 50 + 50 * size * n // total
                impact = w * (1_000_000_000 * tf // (1000 * tf + 20 * length))
                tier = np.searchsorted(-np.array(starts), -impact)
                parts = [(doc[tier == t].tobytes(), impact[tier == t].tobytes()) for t in range(TIERS)]
                tops = [int(impact[tier == t].max(initial=0)) for t in range(TIERS)]
            out["tops"].append(tops)
            for t, (d, i) in enumerate(parts):
                out[f"d{t}"].append(d)
                out[f"i{t}"].append(i)
        return out

    weighed = join_small(found, weights.where((F.col("w") > 0) | (F.col("term") == DOCUMENTS)), "term").select("shard", "term", "w", "docs", "tfs", "sizes")
    kind = "shard long, term binary, tops array<long>, " + ", ".join(f"d{t} binary, i{t} binary" for t in range(TIERS))
    return materialise(map_batches(weighed, run, kind), "tiered-index")


class Shard:
    """The postings of some terms in a shard, as far as tiers ``low`` to ``high`` go."""

    def __init__(self, rows: pa.Table, low: int, high: int):
        columns = {c: rows.column(c).to_pylist() for c in rows.column_names}
        self.ids, self.no_id, self.by_item, self.kth, self.of = np.zeros(0, np.int64), np.zeros(0, bool), {}, {}, []
        for at, term in enumerate(columns["term"]):
            if term == DOCUMENTS:
                if "d0" in columns:
                    self.ids, self.no_id = np.frombuffer(columns["d0"][at], np.int64), np.frombuffer(columns["i0"][at], bool)
                self.of.append(None)
                continue
            read = [(np.frombuffer(columns[f"d{t}"][at], np.int32), np.frombuffer(columns[f"i{t}"][at], np.int64)) for t in range(low, high + 1)]
            self.of.append((read, max(columns["tops"][at][high + 1 :], default=0)))
            for x in columns["items"][at]:
                self.by_item.setdefault(x["item"], []).append(at)
                self.kth[x["item"]] = x["kth"]

    def bounds(self, item: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The scores of all documents from below and above, and what a document not met may reach."""
        low, more, unseen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64), 0
        for at in self.by_item[item]:
            read, residual = self.of[at]
            unseen += residual
            for docs, impacts in read:
                low[docs] += impacts
                if residual:
                    more[docs] += residual
        return low, low + (unseen - more), unseen

    def missing(self, item: int, docs: np.ndarray) -> np.ndarray:
        """What the tiers add to the scores of some documents."""
        add = np.zeros(len(docs), np.int64)
        for at in self.by_item.get(item, ()):
            for have, impacts in self.of[at][0]:
                if len(have):
                    place = np.minimum(np.searchsorted(have, docs), len(have) - 1)
                    add += np.where(have[place] == docs, impacts[place], 0)
        return add


def _search(shard: Shard, last: bool, k: int, candidates: int):
    """For each item: what documents not met may reach, whether too many are left, and the documents that may be among
    the k best, the highest lower bounds first (ids order them in a shard); at the last tier only the k best."""
    for item in shard.by_item:
        low, high, unseen = shard.bounds(item)
        met = np.flatnonzero(low)
        bar = max(1, shard.kth[item], int(np.partition(low[met], -k)[-k]) if len(met) >= k else 0)
        kept = met[high[met] >= bar]
        kept = kept[np.argsort(-low[kept], kind="stable")]
        crowded = not last and len(kept) > candidates
        kept = kept[:k] if last or crowded else kept
        yield item, unseen, crowded, kept, low[kept], high[kept]


def _met(index: DataFrame, wanted: DataFrame, low: int, high: int) -> DataFrame:
    """The index's rows for the terms of some items (item, block, term, kth), with block and the items of each term; and
    the rows of the documents for every block."""
    lists = wanted.groupBy("block", "term").agg(F.collect_list(F.struct("item", "kth")).alias("items"))
    documents = wanted.select("block").distinct().select("block", F.lit(DOCUMENTS).alias("term"), F.array().cast("array<struct<item:long,kth:long>>").alias("items"))
    lists = materialise(lists.unionByName(documents), "block-terms")
    columns = sorted({"d0", "i0"} | {f"{c}{t}" for t in range(low, high + 1) for c in "di"})
    return join_small(index.select("shard", "term", "tops", *columns), lists, "term")


def _reading(tier: int, k: int, candidates: int):
    """A group's function: the rows ``_FOUND`` of a block of items and a shard, tiers up to ``tier`` read."""

    def read(key, rows):
        columns = {c: [] for c in ("item", "unseen", "crowded", "docs", "ids", "low", "high")}
        shard = Shard(rows, 0, tier)
        for item, unseen, crowded, docs, low, high in _search(shard, tier == TIERS - 1, k, candidates):
            ids = pa.array(shard.ids[docs], mask=shard.no_id[docs]).to_pylist()
            for c, x in zip(columns, (item, unseen, crowded, docs.tolist(), ids, low.tolist(), high.tolist())):
                columns[c].append(x)
        n = len(columns["item"])
        columns = {"block": [key[0].as_py()] * n, "shard": [key[1].as_py()] * n} | columns
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
        return pa.table([pa.array(c, t) for c, t in zip(columns.values(), types)], list(columns))

    return read


def _completing(tier: int):
    """A group's function: candidates with what the tiers after ``tier`` add to their scores."""

    def complete(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        shard = Shard(rows, tier + 1, TIERS - 1)
        item, doc = wanted.column("item").to_numpy(), wanted.column("doc").to_numpy()
        score = wanted.column("low").to_numpy().copy()
        for i in np.unique(item):
            score[item == i] += shard.missing(int(i), doc[item == i])
        return wanted.select(["item", "shard", "doc", "id"]).append_column("score", pa.array(score))

    return complete


def search(index: DataFrame, items: DataFrame, k: int = K, candidates: int = CANDIDATES) -> tuple[DataFrame, list[int]]:
    """Rows (item, shard, doc, id, score) that include the k best of each item, and how many items each tier was read for.
    ``items``: item, block, term, as stored."""
    last, exact, pending, asked = TIERS - 1, None, [], []
    open_items = items.withColumn("kth", F.lit(0).cast("long"))
    add = lambda rows: rows if exact is None else exact.unionByName(rows)
    each = F.inline(F.arrays_zip("docs", "ids", "low", "high"))
    for tier in range(TIERS):
        asked.append(open_items.select("item").distinct().count())
        if not asked[-1]:
            break
        groups = _met(index, open_items, 0, tier).groupBy("block", "shard")
        found = materialise(groups.applyInArrow(_reading(tier, k, candidates), _FOUND), "found")
        if tier == last:
            exact = add(found.select("item", "shard", each).select("item", "shard", F.col("docs").alias("doc"), F.col("ids").alias("id"), F.col("low").alias("score")))
            break
        nth = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc()))
        best = found.select("item", F.explode(F.slice("low", 1, k)).alias("score")).withColumn("nth", nth).where(F.col("nth") <= k)
        reached = materialise(best.groupBy("item").agg(F.max(F.when(F.col("nth") == k, F.col("score"))).alias("kth")), "reached")
        marked = join_small(found, reached, "item", "left").withColumn("kth", F.coalesce("kth", F.lit(0)))
        lacking = marked.where(((F.col("unseen") > 0) & (F.col("unseen") >= F.col("kth"))) | F.col("crowded"))
        lacking = materialise(lacking.select("item", "kth").distinct(), "lacking")
        proven = marked.join(lacking, "item", "left_anti").select("block", "item", "shard", "kth", each).where("high >= kth")
        pending.append(materialise(proven.select("block", "shard", "item", F.col("docs").alias("doc"), F.col("ids").alias("id"), "low", "high"), "proven"))
        open_items = materialise(join_small(items, lacking, "item"), "open-items")
        release(found)
    for tier, proven in enumerate(pending):
        exact = add(proven.where("high = low").select("item", "shard", "doc", "id", F.col("low").alias("score")))
        partial = proven.where("high > low")
        if partial.limit(1).count():
            wanted = items.join(partial.select("item").distinct(), "item", "left_semi").withColumn("kth", F.lit(0).cast("long"))
            rows = _met(index, wanted, tier + 1, last).where(F.col("term") != DOCUMENTS)
            rows = join_small(rows, partial.select("block", "shard").distinct(), ["block", "shard"], "left_semi")
            exact = add(rows.groupBy("block", "shard").cogroup(partial.groupBy("block", "shard")).applyInArrow(_completing(tier), _EXACT))
    return exact if exact is not None else index.sparkSession.createDataFrame([], _EXACT), asked


def rank(docs: DataFrame, items: DataFrame, k: int = K, candidates: int = CANDIDATES) -> tuple[DataFrame, list[int]]:
    """Rows (item_id, rank, doc_id, score), the k best documents of each item, and how many items each tier was read for."""
    wanted = materialise(item_terms(items), "wanted")
    distinct = materialise(wanted.select("term").distinct(), "terms")
    only = frozenset(bytes(r.term) for r in distinct.collect()) if fits_broadcast(distinct) else None
    index = tiers(postings(docs, only))
    found, asked = search(index, wanted.drop("item_id"), k, candidates)
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "shard", "doc")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = wanted.select("item", "item_id").distinct()
    return join_small(best, named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"), asked


def op13_ranked_search(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return rank(docs, items)[0]


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op13_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TERM}') AS words FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*)::BIGINT AS nn, sum(len(words))::BIGINT AS ll FROM d WHERE len(words) > 0),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term), g),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS terms FROM benchmark),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(words)::BIGINT * nn) // ll) AS m FROM d, g WHERE len(words) > 0),
s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM (SELECT q, item_id, unnest(terms) AS term FROM i) JOIN w USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50"""
}
