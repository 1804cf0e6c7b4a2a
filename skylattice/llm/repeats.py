"""Removal of passages that occur more than once, from longest-previous-factor arrays.

Every string of ``length`` bytes holds an anchor: the leftmost smallest hash among its ``gram``-byte substrings. Equal
strings have their anchor in the same place, so a string can repeat only where the anchor's substring does. One pass
emits the anchors (one in some 70 bytes) with a hash of their context, which is all strings of which they are the
anchor; counts by hash, aggregated before any shuffle, drop the anchors that occur once and settle contexts that
occur as a whole elsewhere. What is left are the contexts in which a passage begins, ends or was edited.

These are gathered by anchor. A task sorts the suffixes that start at the anchors of a group, takes the longest common
prefixes of neighbours, and finds for each suffix the previous and next smaller position in suffix order: the longer of
the two matches is its longest previous factor. The same with larger positions gives the longest later match. Each
match is extended to the left as well; matched bytes of ``length`` or more are marked. Where these two do not cover a
context, the other suffixes of the group are visited in suffix order, until the common prefix is too short.

A group with more than ``max_group`` different contexts (a passage that a large part of the corpus shares) is not
solved in one task: its contexts are cut into narrower ranges of strings, which are grouped by the bytes that all
strings of a range share, and so on down to single strings, whose count decides. Nothing is capped.

Matches never cross documents. Null texts are empty; texts shorter than ``length`` stay whole. Repeated rows and
copies are occurrences like others. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.arrow import map_batches, text_bytes
from skylattice.storage import drop_shuffles, materialise, release

LENGTH, GRAM = 200, 64
#: Strings by window start that are hashed at a time: bounds the memory for a very long text.
SEGMENT = 1 << 20
#: Numbers of strings in a range, for the groups that are too large for a task.
RANGES = (64, 16, 4, 1)
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_POSITION = np.uint64((1 << 24) - 1)
_KEY = ["khash", "start", "core"]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` (a power of two) bytes from each position, by doubling."""
    h, size, i = _BYTE[data], 1, 0
    while size < gram:
        h = h[:-size] * _STEP[i] + h[size:]
        size, i = size * 2, i + 1
    h = (h ^ (h >> np.uint64(32))) * _STEP[i]
    return h ^ (h >> np.uint64(29))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: position, hash, and the first and last string start that it is the anchor of."""
    found = []
    for at in range(0, len(text) - length + 1, SEGMENT):
        data = np.frombuffer(text, np.uint8, min(SEGMENT + length - 1, len(text) - at), at)
        h = gram_hashes(data, gram)
        w = length - gram + 1
        n = len(h) - w + 1
        tagged = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = tagged
        blocks = padded.reshape(-1, w)
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        least = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & _POSITION).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [n - 1]))
        a = least[first]
        found.append((a + at, h[a], first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))


def _common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            n = mid
    return low


def _nearest(positions: list, smaller: bool) -> list[tuple[int, int]]:
    """For each place in suffix order, the nearest places to the left and right with a smaller (larger) position; -1: none."""
    n, left, right, stack = len(positions), [-1] * len(positions), [-1] * len(positions), []
    for i in range(n):
        while stack and (positions[stack[-1]] > positions[i] if smaller else positions[stack[-1]] < positions[i]):
            right[stack.pop()] = i
        left[i] = stack[-1] if stack else -1
        stack.append(i)
    return list(zip(left, right))


def matched(group: list[tuple[bytes, bytes, tuple]], length: int = LENGTH) -> list[tuple[int, int]]:
    """group: (bytes before the anchor, bytes from the anchor, position) of different contexts. For each, how many
    bytes before and from its anchor are covered by strings of ``length`` bytes that occur in another context (0, 0: none)."""
    order = sorted(range(len(group)), key=lambda i: group[i][1])
    lefts, rights = [group[i][0][::-1] for i in order], [group[i][1] for i in order]
    lcp = [_common(x, y) for x, y in zip(rights, rights[1:])]
    positions = [group[i][2] for i in order]
    out = [(0, 0)] * len(order)

    def extend(i: int, j: int, right: int) -> None:
        if right + len(lefts[i]) >= length and (left := _common(lefts[i], lefts[j])) + right >= length:
            out[i] = max(out[i][0], left), max(out[i][1], right)

    full = lambda i: out[i] == (len(lefts[i]), len(rights[i]))
    for smaller in (True, False):
        for i, near in enumerate(_nearest(positions, smaller)):
            shared = [(min(lcp[min(i, j) : max(i, j)]), j) for j in near if j >= 0]
            if shared and not full(i):  # the longest previous factor, and the longest later one
                right, j = max(shared)
                extend(i, j, right)
    for i in range(len(order)):
        for step in (-1, 1):
            j, right = i, len(rights[i])
            while not full(i) and 0 <= j + step < len(order):
                right = min(right, lcp[min(j, j + step)])
                if right + len(lefts[i]) < length:
                    break
                j += step
                extend(i, j, right)
    result = [(0, 0)] * len(group)
    for i, x in zip(order, out):
        result[i] = x
    return result


def _place(position: dict) -> tuple:
    """The corpus order of positions, a null id first."""
    return tuple((x is not None, x) for x in position.values())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batch):
        rows, hashes, contexts, at, before, behind = [], [], [], [], [], []
        for i, text in enumerate(text_bytes(batch.column("text"))):
            if len(text) >= length:
                a, h, first, last = anchors(text, length, gram)
                rows.append(np.full(len(a), i, np.int64))
                hashes.append(h)
                at.append(a)
                before.append(a - first)
                behind.append(last + length - a)
                digest = xxhash.xxh64_intdigest
                contexts.append(np.fromiter((digest(text[x:y]) for x, y in zip(first.tolist(), (last + length).tolist())), np.uint64, len(a)))
        if not rows:
            return None
        rows = pa.array(np.concatenate(rows))
        join = lambda x, kind=np.int64: np.concatenate(x).astype(kind)
        return {c: batch.column(c).take(rows) for c in ("doc_id", "t1", "t2")} | {"a": join(at, np.int32), "o2": join(before, np.int32), "r": join(behind, np.int32), "khash": np.concatenate(hashes).view(np.int64), "chash": np.concatenate(contexts).view(np.int64)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, t1 long, t2 long, a int, o2 int, r int, khash long, chash long")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Texts of the wanted contexts: khash, chash, n, position, o1 and o2 (the strings start o2 to o1 bytes before the anchor) and ctx."""
    lists = wanted.groupBy("t1", "t2", F.col("position.doc_id").alias("of")).agg(F.collect_list(F.struct("khash", "chash", "n", "a", "o2", "r", "position")).alias("wanted"))
    joined = docs.join(lists.withColumnsRenamed({"t1": "w1", "t2": "w2"}), (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("of")))

    def run(batch):
        texts, lists = text_bytes(batch.column("text")), batch.column("wanted")
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        a, o2, r = (flat.field(c).to_numpy() for c in ("a", "o2", "r"))
        ctx = [texts[i][x:y] for i, x, y in zip(owner.tolist(), (a - o2).tolist(), (a + r).tolist())]
        return {c: flat.field(c) for c in ("khash", "chash", "n", "position")} | {"o1": length - r, "o2": o2, "ctx": ctx}

    kind = wanted.schema["position"].dataType.simpleString()
    found = map_batches(joined.select("text", "wanted"), run, f"khash long, chash long, n long, position {kind}, o1 int, o2 int, ctx binary")
    first = F.first(F.struct("n", "position", "o1", "o2", "ctx")).alias("first")
    return found.groupBy("khash", "chash").agg(first).select("khash", "chash", "first.*")  # equal rows give equal contexts


def _solve(groups: DataFrame, length: int) -> DataFrame:
    """groups: the key and members (sub, o1, o2, position, ctx). Rows (key, sub, left, right) for what is matched."""

    def run(batch):
        keys, out = [batch.column(c).to_pylist() for c in _KEY], []
        for i, members in enumerate(batch.column("members").to_pylist()):
            ends = matched([(m["ctx"][: m["o2"]], m["ctx"][m["o2"] :], (_place(m["position"]), m["sub"])) for m in members], length)
            out += [(*(k[i] for k in keys), m["sub"], *x) for m, x in zip(members, ends) if x[1]]
        return dict(zip((*_KEY, "sub", "left", "right"), zip(*out))) if out else None

    return map_batches(groups, run, "khash long, start int, core long, sub long, left int, right int")


def _cut(pieces: DataFrame, size: int, length: int) -> DataFrame:
    """Pieces of ``size`` strings at most, aligned to multiples of it; core: a hash of the bytes that the strings of the range share."""
    names = ("khash", "chash", "n", "position", "start", "core", "sub", "o1", "o2", "ctx")

    def run(batch):
        out = []
        for khash, chash, n, position, o1, o2, ctx in zip(*(batch.column(c).to_pylist() for c in ("khash", "chash", "n", "position", "o1", "o2", "ctx"))):
            for start in range(o1 // size * size, o2 + 1, size):
                low, high = max(start, o1), min(start + size - 1, o2)
                core = ctx[o2 - start : o2 + length - (start + size - 1)] if start + size - 1 < length else b""
                part = ctx[o2 - high : o2 + length - low]
                out.append((khash, chash, n, position, start, _signed(xxhash.xxh64_intdigest(core)), _signed(xxhash.xxh64_intdigest(part)), low, high, part))
        return dict(zip(names, zip(*out)))

    kind = pieces.schema["position"].dataType.simpleString()
    return map_batches(pieces, run, f"khash long, chash long, n long, position {kind}, start int, core long, sub long, o1 int, o2 int, ctx binary")


def _partly_repeated(contexts: DataFrame, length: int, max_group: int) -> DataFrame:
    """Rows (khash, chash, left, right): bytes around the anchor that are covered by repeated strings."""
    found = []
    pieces = contexts.select("*", F.lit(0).alias("start"), F.lit(0).cast("long").alias("core"), F.col("chash").alias("sub"))
    for size in (*RANGES, None):
        subs = pieces.groupBy(*_KEY, "sub", "o1", "o2").agg(F.sum("n").alias("n"), F.min("position").alias("position"), F.first("ctx").alias("ctx"))
        subs = materialise(subs, "subs")
        sizes = materialise(subs.groupBy(*_KEY).agg(F.count("*").alias("m")).where("m > 1"), "sub-sizes")
        if found:
            whole = subs.where("n > 1").select(*_KEY, "sub")
            found.append(pieces.join(whole, [*_KEY, "sub"]).select("khash", "chash", F.col("o2").alias("left"), (length - F.col("o1")).alias("right")))
        small = materialise(subs.join(sizes.where(F.col("m") <= max_group).select(*_KEY), _KEY), "small-groups")  # written, so that Spark can split the join
        groups = small.groupBy(*_KEY).agg(F.collect_list(F.struct("sub", "o1", "o2", "position", "ctx")).alias("members"))
        solved = _solve(groups, length)
        found.append(pieces.join(solved, [*_KEY, "sub"]).select("khash", "chash", "left", "right"))
        large = sizes.where(F.col("m") > max_group).select(*_KEY)
        if size is None or not large.limit(1).count():
            break
        pieces = materialise(_cut(pieces.join(large, _KEY), size, length), "pieces")
    return reduce(DataFrame.unionByName, found)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = 64) -> DataFrame:
    """docs: doc_id, text, t1, t2 (two hashes of the text). Rows (t1, t2, spans) for texts with bytes to remove;
    spans is an array of (start, stop), which may overlap."""
    spark = docs.sparkSession
    table = materialise(_anchor_table(docs, length, gram), "anchors")
    grams = materialise(table.groupBy("khash").agg(F.count("*").alias("n"), (F.min("chash") == F.max("chash")).alias("uniform")).where("n > 1").drop("n"), "grams")
    drop_shuffles(spark)
    # written before it is grouped: a join with nothing above it is one whose frequent keys Spark can split
    occurring = materialise(table.join(grams, "khash"), "occurring-anchors")
    release(table)
    # equal texts share their anchors from here on: n counts the occurrences
    found = occurring.groupBy("khash", "t1", "t2", "a", "o2", "r", "chash", "uniform").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    found = materialise(found, "repeated-anchors")
    release(occurring)
    drop_shuffles(spark)
    span = lambda left, right: F.struct((F.col("a") - left).alias("start"), (F.col("a") + right).alias("stop")).alias("span")
    mixed = found.where(~F.col("uniform"))
    first = F.struct("doc_id", "t1", "t2", "a")
    contexts = mixed.groupBy("khash", "chash").agg(F.sum("n").alias("n"), F.min(F.struct(first.alias("position"), "o2", "r")).alias("first"))
    contexts = materialise(contexts.select("khash", "chash", "n", "first.*"), "contexts")
    wanted = contexts.select("khash", "chash", "n", F.col("position.t1").alias("t1"), F.col("position.t2").alias("t2"), F.col("position.a").alias("a"), "o2", "r", "position")
    texts = materialise(_contexts(docs, wanted, length), "context-texts")
    drop_shuffles(spark)
    partly = _partly_repeated(texts, length, max_group).unionByName(contexts.where("n > 1").select("khash", "chash", F.col("o2").alias("left"), F.col("r").alias("right")))
    partly = materialise(partly.groupBy("khash", "chash").agg(F.max("left").alias("left"), F.max("right").alias("right")), "partly")
    spans = found.where("uniform").select("t1", "t2", span(F.col("o2"), F.col("r"))).unionByName(mixed.join(partly, ["khash", "chash"]).select("t1", "t2", span(F.col("left"), F.col("right"))))
    return materialise(spans.groupBy("t1", "t2").agg(F.collect_list("span").alias("spans")), "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = 64) -> DataFrame:
    """One row per document: doc_id, kept (the bytes that stay), n_bytes, removed (maximal runs as [start, stop])."""
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("repeats"), "text").alias("t2"))
    spans = repeated_spans(marked, length, gram, max_group)
    drop_shuffles(docs.sparkSession)

    def run(batch):
        kept, removed, sizes = [], [], []
        for text, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist()):
            runs = []
            for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop)
                else:
                    runs.append([start, stop])
            ends = [0, *(x for r in runs for x in r), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(ends[::2], ends[1::2])))
            removed.append(runs)
            sizes.append(len(text))
        return {"doc_id": batch.column("doc_id"), "kept": kept, "n_bytes": sizes, "removed": removed}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(marked.join(spans, ["t1", "t2"], "left"), run, f"doc_id {kind}, kept binary, n_bytes long, removed array<array<long>>")


def op9_repeats(spark, sf_dir):
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op9_repeats": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT rid, p, md5(substr(hx, 2 * p + 1, {2 * LENGTH})) AS h FROM (SELECT rid, hx, unnest(range(0, n - {LENGTH} + 1)) AS p FROM d)),
m AS (SELECT rid, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT rid, p, sum(gap) OVER (PARTITION BY rid ORDER BY p) AS run FROM (SELECT rid, p, coalesce(p > lag(p) OVER (PARTITION BY rid ORDER BY p) + {LENGTH}, false)::INTEGER AS gap FROM m)),
r AS (SELECT rid, min(p) AS low, max(p) + {LENGTH} AS high FROM g GROUP BY rid, run),
k AS (SELECT rid, low, high, coalesce(lag(high) OVER (PARTITION BY rid ORDER BY low), 0) AS last FROM r),
s AS (SELECT rid, sum(high - low)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(substr(hx, 2 * last + 1, 2 * (low - last)), '' ORDER BY low) || substr(any_value(hx), 2 * max(high) + 1) AS kept
      FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256
FROM d LEFT JOIN s USING (rid)""",
}
