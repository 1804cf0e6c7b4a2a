"""Exact top-k search by inner product over vectors of whole numbers, the longest vectors first.

A round takes the candidates between two quantiles of length; rounds go from the longest vectors down and double in size.
After each, a query keeps its k best so far, and the k-th score is its threshold. By Cauchy-Schwarz no score exceeds the
product of the lengths, so a query whose product with the longest remaining candidate stays below its threshold is
finished; when all are, no further round is read.

In a round, blocks of queries meet blocks of candidates as groups of a shuffle. A task goes through its candidates by
descending length. Vectors are turned by the right singular vectors of a sample (at most ``SAMPLE_BYTES`` of vectors, by
hash), which gather most of the length in the first coordinates: the partial sum over these, plus the product of the
lengths of what is left, bounds a score from above. Pairs whose bound stays below the threshold are dropped after each
section of the coordinates; the survivors are scored in whole numbers. Any rotation gives the same results; the sample
only decides how early pairs drop out. All rows are searched.

Null vectors, and those with null or non-finite components, take no part. A shorter vector counts as padded with zeros.
Components are limited to 2^62 in magnitude, and scores to the range of 64 bits. A query isn't its own candidate, but an
equal row is. A candidate without id is found, last of equal scores; it is never a query of ``op11_inner_products``.
Repeated queries each get their rows. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.storage import materialise, release

K, SCALE, EVERY = 20, 64, 20
#: Candidates of the first round; each later one takes twice as many.
FIRST_ROUND = 1 << 15
#: Bytes of vectors in a packed chunk, and in the candidates of a task.
CHUNK_BYTES, STRIPE_BYTES = 2 << 20, 8 << 20
SAMPLE_BYTES = 8 << 20
#: Bounds are checked after the coordinates that leave these parts of the sample's squared length; pairs are handled one
#: by one once so few of a block are left.
SECTIONS, FEW = (1 / 2, 1 / 4, 1 / 16), 1 / 16
#: Queries and candidates in one matrix product.
QUERIES_AT_ONCE, CANDIDATES_AT_ONCE = 256, 1024
LONGEST, NO_ID = float(1 << 62), np.iinfo(np.int64).max
_FOUND = "q_row long, c_row long, c_id long, score long"
_PACKED = "part long, rows binary, ids binary, no_id binary, vecs binary, least binary"


def whole_vectors(df: DataFrame, id: str, vec: str, scale: float = SCALE) -> DataFrame:
    """Rows (row, id, length, vec) of the vectors that take part, as whole numbers floor(scale * x); ``row`` is unique."""
    x = F.col(vec).cast("array<double>")
    fit = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-LONGEST), F.least(F.lit(LONGEST), _floor(v * scale))))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    kept = df.where(fit).select(F.col(id).cast("long").alias("id"), whole.alias("vec"))
    return materialise(kept.select(F.monotonically_increasing_id().alias("row"), "id", length.alias("length"), "vec"), "vectors")


def _floor(x: Column) -> Column:
    """As a double: the built-in floor ends at the range of a long."""
    return F.when(F.abs(x) < LONGEST, F.floor(x).cast("double")).otherwise(x)


@dataclass
class Rotation:
    """Right singular vectors as columns, those of the largest singular values first, and where sections end."""

    axes: np.ndarray
    ends: list[int]

    @classmethod
    def of(cls, x: np.ndarray) -> Rotation:
        values, axes = np.linalg.eigh(x.T @ x)
        by = np.argsort(-values, kind="stable")
        rest = 1 - np.cumsum(np.maximum(values[by], 0)) / max(values.sum(), 1e-300)
        ends = {int(np.searchsorted(-rest, -part - 1e-12)) + 1 for part in SECTIONS}
        return cls(axes[:, by], sorted(e for e in ends if e < len(values)))


def rotation(vectors: DataFrame, width: int) -> Rotation:
    """That of a sample of the vectors."""
    sample = vectors.orderBy(F.xxhash64("row")).limit(max(1, SAMPLE_BYTES // (8 * width))).select("vec").toArrow()
    x = _matrix(sample.column("vec").combine_chunks(), width)
    return Rotation.of(x / max(1.0, np.abs(x).max(initial=0)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(rows: DataFrame, width: int, n: int, parts: int) -> DataFrame:
    """Chunks of n rows (row, id, vec and, for queries, least) as binary columns, dealt to parts at random."""
    at_once = max(1, min(CHUNK_BYTES // (8 * width), -(-n // (4 * parts))))

    def run(batches):
        kept: list[pa.RecordBatch] = []

        def chunk(t: pa.Table) -> pa.RecordBatch:
            first = t.column("row")[0].as_py()
            ids = t.column("id").combine_chunks()
            columns = [t.column("row").to_numpy(), ids.fill_null(NO_ID).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), _matrix(t.column("vec").combine_chunks(), width), t.column("least").to_numpy()]
            part = int(np.random.default_rng(first).integers(parts))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns)], ["part", "rows", "ids", "no_id", "vecs", "least"])

        for batch in batches:
            kept.append(batch)
            while sum(b.num_rows for b in kept) >= at_once:
                t = pa.Table.from_batches(kept)
                yield chunk(t.slice(0, at_once))
                kept = t.slice(at_once).to_batches()
        if sum(b.num_rows for b in kept):
            yield chunk(pa.Table.from_batches(kept))

    if "least" not in rows.columns:
        rows = rows.withColumn("least", F.lit(-math.inf))
    return rows.select("row", "id", "vec", "least").mapInArrow(run, _PACKED)


class Block:
    """Some vectors, from the longest to the shortest."""

    def __init__(self, packed: pa.Table, width: int, turn: Rotation):
        join = lambda name, kind: np.frombuffer(b"".join(packed.column(name).to_pylist()), kind)
        vecs = join("vecs", np.float64).reshape(-1, width)
        length = np.sqrt((vecs * vecs).sum(axis=1))
        by = np.argsort(-length, kind="stable")
        self.length, self.vecs = length[by], vecs[by]
        self.rows, self.ids, self.no_id, self.least = (join(name, kind)[by] for name, kind in (("rows", np.int64), ("ids", np.int64), ("no_id", bool), ("least", np.float64)))
        turned = self.vecs @ turn.axes
        left = lambda end: np.sqrt((turned[:, end:] ** 2).sum(axis=1, keepdims=True))
        #: For each section the coordinates up to its end and the length of the rest: products of these are bounds.
        self.bounds = [np.ascontiguousarray(np.hstack([turned[:, :end], left(end)])) for end in turn.ends]


def _exact(q: np.ndarray, c: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of rows, one by one, as longs."""
    if largest < 1 << 52:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.array([max(low, min(high, sum(int(a) * int(b) for a, b in zip(x, y)))) for x, y in zip(q, c)], np.int64)


def _survivors(queries: Block, candidates: Block, i: np.ndarray, j: slice, least: np.ndarray, largest: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in i, place in j) whose bounds reach the threshold after every section, or that of their block."""
    floor = np.where(least > -(2.0**63), least - 1e-9 * largest - 1e-6, -math.inf)
    pairs = None
    for q, c in zip(queries.bounds, candidates.bounds):
        q, c = q[i], c[j]
        if pairs is None:
            alive = q @ c.T >= floor[:, None]
            if np.count_nonzero(alive) <= FEW * alive.size:
                pairs = np.nonzero(alive)
        else:
            a, b = pairs
            alive = np.einsum("ij,ij->i", q[a], c[b]) >= floor[a]
            pairs = a[alive], b[alive]
    if pairs is None:
        sums = queries.vecs[i] @ candidates.vecs[j].T
        if sums.shape[1] > k:  # of these candidates k others reach this much
            floor = np.maximum(floor, np.partition(sums, -k - 1, axis=1)[:, -k - 1] - 1e-9 * largest - 1e-6)
        pairs = np.nonzero(sums >= floor[:, None])
    return pairs


def search_blocks(queries: Block, candidates: Block, k: int) -> tuple[dict[str, np.ndarray], int]:
    """The k best candidates of each query (q_row, c_row, c_id, no_id, score), and the number of pairs that were scored.
    Scores below the threshold that a query came with are left out."""
    found, scored = [], 0
    for low in range(0, len(queries.rows), QUERIES_AT_ONCE):
        mine = np.arange(low, min(low + QUERIES_AT_ONCE, len(queries.rows)))
        least = queries.least[mine].copy()
        top = np.zeros((4, 0), np.int64)  # place in mine, score, place of candidate, its id
        for at in range(0, len(candidates.rows), CANDIDATES_AT_ONCE):
            j = slice(at, min(at + CANDIDATES_AT_ONCE, len(candidates.rows)))
            reach = queries.length[mine] * candidates.length[at]
            asked = np.flatnonzero(reach * (1 + 1e-9) + 1e-6 >= least)
            if not len(asked):
                break  # the candidates that follow are no longer
            a, b = _survivors(queries, candidates, mine[asked], j, least[asked], reach.max(initial=0), k)
            a, b = asked[a], b + at
            other = queries.rows[mine[a]] != candidates.rows[b]
            a, b = a[other], b[other]
            scored += len(a)
            score = _exact(queries.vecs[mine[a]], candidates.vecs[b], reach.max(initial=0))
            kept = score >= least[a]
            top = np.concatenate([top, np.stack([a, score, b, candidates.ids[b]])[:, kept]], axis=1)
            # ~score turns the order without leaving the range of 64 bits
            top = top[:, np.lexsort((candidates.rows[top[2]], top[3], candidates.no_id[top[2]], ~top[1], top[0]))]
            nth = np.arange(top.shape[1]) - np.searchsorted(top[0], top[0])
            top, nth = top[:, nth < k], nth[nth < k]
            full = nth == k - 1
            least[top[0, full]] = np.maximum(least[top[0, full]], top[1, full])
        c = top[2]
        found.append({"q_row": queries.rows[mine[top[0]]], "c_row": candidates.rows[c], "c_id": candidates.ids[c], "no_id": candidates.no_id[c], "score": top[1]})
    names = ("q_row", "c_row", "c_id", "no_id", "score")
    return {n: np.concatenate([np.zeros(0, bool if n == "no_id" else np.int64), *(x[n] for x in found)]) for n in names}, scored


def _round(asked: DataFrame, candidates: DataFrame, n_asked: int, n_candidates: int, width: int, turn: Rotation, k: int) -> DataFrame:
    """The best of some candidates for each query, as found in each group of blocks."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_asked * 8 * width // STRIPE_BYTES))
    # two tasks a core, where there are candidates enough for it
    stripes = max(1, -(-n_candidates * 8 * width // STRIPE_BYTES), min(2 * cores // groups, n_candidates // CANDIDATES_AT_ONCE))
    left = _packed(asked, width, n_asked, groups).withColumnRenamed("part", "g").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    right = _packed(candidates, width, n_candidates, stripes).withColumnRenamed("part", "s").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out, _ = search_blocks(Block(q, width, turn), Block(c, width, turn), k)
        c_id = pa.array(out["c_id"], mask=out["no_id"])
        return pa.table({"q_row": out["q_row"], "c_row": out["c_row"], "c_id": c_id, "score": out["score"]})

    return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(run, _FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, first_round: int = FIRST_ROUND) -> DataFrame:
    """Rows (query_id, rank, id, score, q_row) of a table of ``whole_vectors``: for each row that is a query its k best
    others, ties to the smaller id."""
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    width = max(1, width or 0)
    queries = vectors.where(is_query)
    n_asked = queries.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long, q_row long")
    turn = rotation(vectors, width)
    rounds = max(1, math.ceil(math.log2(n / first_round + 1)))
    parts = [1 - first_round * (2**r - 1) / n for r in range(1, rounds)]
    cuts = [math.inf, *(vectors.agg(F.percentile_approx("length", parts, 10_000)).first()[0] if parts else []), -1.0]
    by_score = W.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("c_id").asc_nulls_last(), "c_row")
    best = None
    for high, low in zip(cuts, cuts[1:]):
        if high == low:
            continue
        asked = queries
        if best is not None:
            full = best.where(F.col("rank") == k).select("q_row", F.col("score").cast("double").alias("kth"))
            asked = queries.join(full, queries.row == full.q_row, "left").withColumn("least", F.coalesce("kth", F.lit(-math.inf)))
            # what is left is no longer than ``high``
            asked = materialise(asked.where(F.col("length") * high * (1 + 1e-9) + 1e-6 >= F.col("least")).select("row", "id", "vec", "least"), "asked")
            n_asked = asked.count()
            if not n_asked:
                release(asked)
                break
        here = vectors.where((F.col("length") <= high) & (F.col("length") > low))
        found = _round(asked, here, n_asked, here.count(), width, turn, k)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        after = materialise(ranked.select("q_row", "rank", "c_row", "c_id", "score"), "best")
        if best is not None:
            release(best, asked)
        best = after
    names = queries.select("row", F.col("id").alias("query_id"))
    return best.join(names, best.q_row == names.row).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("c_id").alias("id"), "score", "q_row")


def op11_inner_products(spark, sf_dir):
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, F.col("id") % EVERY == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE_SQL = {
    "op11_inner_products": """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS vec FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
}
