"""Near-duplicate groups by Jaccard similarity of word shingles: SimHash and MinHash keys propose pairs, the shingles decide.

Texts of equal shingles are grouped first. Their SimHash fingerprints go through the pivot tables of ``simhash``, whose
links propose the first pairs. A Jaccard similarity of 0.8 means some ten differing bits of 64, and up to twenty by
chance, for which neither pivots nor blocks of bits prune: the links of three bits are completed by keys of a few MinHash
minima of each text; texts with an equal key are a bucket. Every proposed pair is verified on its shingles.

The members of a bucket are verified against its smallest, the centre. Other pairs are looked for only where that leaves
members in different components, among all members that share a centre, and by how they differ from their consensus C (what
over half of them have). Let D(x) be the shingles that only one of x and C has. |D(A)| + |D(B)| - 2 |D(A) & D(B)| shingles
are in one of A and B only, and a similarity of 0.8 allows (|A| + |B|) / 9. With ``excess`` for |D(x)| - |x| / 9, a similar
pair thus shares (excess(A) + excess(B)) / 2 of its differences or more. Where that is none the pair is similar without a
look, and so are both to the member of the smallest excess, against which all are verified. All other similar pairs meet
at a difference that both have: members are listed under the differences that others have as well, the rarest first, and
only under as many as a shared one must be among; those that have too few for any partner under none. Again all of a list
are verified against its member of the smallest excess, and only then all pairs of a list in different components whose
numbers allow it. Copies with edits of their own share no difference: a large group of them costs a few pairs for each
member, whether they reach 0.8 with each other or just miss it. Nothing depends on the size of a bucket, and no similar
pair of a bucket is left in different components.

Words are those of ``simhash.fingerprint``. A text of fewer than ``WIDTH`` words is one shingle; null and empty texts have
none and are equal. Very long texts are hashed in pieces and compared as sets. Texts and sets are told apart by 128 bits.
Of a group the row of the smallest doc_id stays (null last, then of the smallest text hash, then of the smallest hash of
its other columns; of rows equal in all of them one). Extra columns are kept (``__text_hash``, ``__other``, ``__id``,
``__hash`` and ``__rest`` are reserved); an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.arrow import map_batches, text_bytes
from skylattice.llm.components import components
from skylattice.llm.simhash import fingerprint_links, majority
from skylattice.storage import materialise, release

WIDTH = 5
#: Minima in a key, keys of a text: a pair at exactly 0.8 shares no key with a probability of 5e-8.
MINIMA, KEYS = 4, 32
#: Similarity from which texts are near-duplicates, as a fraction of whole numbers; the bounds on differences are for it.
SIMILARITY = (4, 5)
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_draw = lambda name, n: np.array([xxhash.xxh64_intdigest(f"{name} {i}") for i in range(n)], np.uint64)
#: Factors and shifts of the hash functions, and the factors that make a key of minima.
_FACTORS, _SHIFTS = _draw(f"minhash factor {MINIMA}", MINIMA * KEYS) | np.uint64(1), _draw(f"minhash shift {MINIMA}", MINIMA * KEYS)
_MIX = _draw(f"minhash mix {MINIMA}", MINIMA) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = [b" ".join(words)] if len(words) < WIDTH else map(b" ".join, zip(*(words[k:] for k in range(WIDTH))))
    return np.unique(np.fromiter(map(_hash, found), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set of shingles; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least, step = np.full(MINIMA * KEYS, np.iinfo(np.uint64).max, np.uint64), 4096
    for i in range(0, len(hashes), step):  # a very long text in pieces
        least = np.minimum(least, (hashes[i : i + step, None] * _FACTORS + _SHIFTS).min(axis=0))
    return (least.reshape(-1, MINIMA) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sketches(marked: DataFrame) -> DataFrame:
    """Rows (doc_id, __text_hash, __other, set, fp, bands); set is equal for texts of equal shingles, fp is their
    fingerprint."""

    def run(batch):
        sets = [shingles(x) for x in text_bytes(batch.column("text"))]
        fps = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        named = {c: batch.column(c) for c in ("doc_id", "__text_hash", "__other")}
        return named | {"set": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "fp": fps, "bands": [bands(s) for s in sets]}

    kind = marked.schema["doc_id"].dataType.simpleString()
    return map_batches(marked.select("doc_id", "text", "__text_hash", "__other"), run, f"doc_id {kind}, __text_hash string, __other long, set binary, fp long, bands array<long>")


def _fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints the pivot tables link, or which share one."""
    prints = materialise(distinct.groupBy("fp").agg(F.min("sig").alias("least")), "set-prints")
    ends = [prints.select(F.col("fp").alias(x), F.col("least").alias(y)) for x, y in (("u", "a"), ("v", "b"))]
    across = fingerprint_links(prints.select("fp")).join(ends[0], "u").join(ends[1], "v").select("a", "b")
    within = distinct.select("fp", "sig").join(prints, "fp").where("sig <> least").select(F.col("least").alias("a"), F.col("sig").alias("b"))
    return across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sets(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (sig, n, items): the shingles of each wanted (sig, __text_hash)."""

    def run(batch):
        sets = [shingles(x).view(np.int64) for x in text_bytes(batch.column("text"))]
        return {"sig": batch.column("sig"), "n": [len(s) for s in sets], "items": sets}

    texts = marked.select("__text_hash", "text").join(wanted, "__text_hash").dropDuplicates(["sig"])
    return materialise(map_batches(texts.select("sig", "text"), run, "sig long, n long, items array<long>"), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity reaches ``SIMILARITY``; sizes that rule it out are dropped before the shingles
    are fetched."""
    over, under = SIMILARITY
    sizes = sets.select("sig", "n")
    for end in "ab":
        pairs = pairs.join(sizes.withColumnsRenamed({"sig": end, "n": f"n_{end}"}), end)
    pairs = fitting = materialise(pairs.where(under * F.least("n_a", "n_b") >= over * F.greatest("n_a", "n_b")), "proposed")
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("sig").alias(end), F.col("items").alias(f"items_{end}")), end)
    common = F.size(F.array_intersect("items_a", "items_b"))
    near = materialise(pairs.where((over + under) * common >= over * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "near")
    release(fitting)
    return near


def _stars(distinct: DataFrame) -> DataFrame:
    """Rows (lo, sig) of the sets that share a key with another, lo the smallest of a bucket: once for each centre."""
    each = distinct.select("sig", F.posexplode("bands").alias("t", "part"))
    buckets = each.groupBy("t", "part").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"))
    buckets = materialise(buckets.where("lo <> hi").select("t", "part", "lo"), "buckets")
    stars = materialise(each.join(buckets, ["t", "part"]).where("sig <> lo").select("lo", "sig").distinct(), "stars")
    release(buckets)
    return stars


def _crowds(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``stars`` of centres whose members, the centre aside, the links so far leave in several components."""
    return materialise(_labelled(stars, roots, ["lo"]).select("lo", "sig"), "crowds")


def _differing(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (lo, sig, excess, shared) for the members of a centre: nine times the excess over the consensus, and those of
    the differences from it that another member has as well, the rarest first. The consensus is the centre but for the
    differences from it that over half of the members have."""
    rows = crowds.select("lo", "sig")
    for end, prefix in (("lo", "c_"), ("sig", "")):
        rows = rows.join(sets.select(F.col("sig").alias(end), F.col("n").alias(f"{prefix}n"), F.col("items").alias(f"{prefix}items")), end)
    xor = lambda x, y: F.concat(F.array_except(x, y), F.array_except(y, x))
    apart = materialise(rows.select("lo", "sig", "n", xor("items", "c_items").alias("d")), "differences")
    often = apart.select("lo", F.explode("d").alias("e")).groupBy("lo", "e").agg(F.count("*").alias("f"))
    often = often.join(apart.groupBy("lo").agg(F.count("*").alias("members")), "lo").where("2 * f > members")
    turned = often.groupBy("lo").agg(F.collect_list("e").alias("turned"))  # fewer than twice a set's shingles
    apart2 = apart.join(turned, "lo", "left").withColumn("d", F.when(F.col("turned").isNull(), F.col("d")).otherwise(xor("d", "turned")))
    apart2 = materialise(apart2.select("lo", "sig", (9 * F.size("d") - F.col("n")).alias("excess"), "d"), "consensus-differences")
    each = apart2.select("lo", "sig", F.explode("d").alias("e"))
    common = materialise(each.groupBy("lo", "e").agg(F.count("*").alias("f")).where("f > 1"), "shared-differences")
    shared = each.join(common, ["lo", "e"]).groupBy("lo", "sig").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("shared"))
    out = apart2.select("lo", "sig", "excess").join(shared, ["lo", "sig"], "left")
    out = materialise(out.withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<f:bigint,e:bigint>>"))), "differing")
    release(apart, apart2, common)
    return out


def _labelled(rows: DataFrame, roots: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with the components of their sets as labels, where a group has several."""
    rows = materialise(rows.join(roots, rows.sig == roots.node, "left").withColumn("label", F.coalesce("root", "sig")).drop("node", "root"), "labelled")
    apart = rows.groupBy(*group).agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    return rows.join(apart.select(*group), group)


def _nearest(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows with ``near``, the member of the smallest excess of their group, where it has another label."""
    near = rows.groupBy(*group).agg(F.min(F.struct("excess", "sig", "label", "reach")).alias("near"))
    return rows.join(near, group).where("label <> near.label")


def _meeting(differing: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (lo, e, sig, excess, reach): members by the differences at which similar ones meet. ``reach`` is the most that
    a partner's excess may be, for what a member has to share."""
    members = _labelled(differing.withColumn("reach", 18 * F.size("shared") - F.col("excess")), roots, ["lo"])
    bounds = members.groupBy("lo").agg(F.min("excess").alias("least"), F.max("reach").alias("most"))
    need = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("least")) / 18)).cast("int")  # shared with any partner
    able = members.join(bounds, "lo").withColumn("need", need).where("excess <= most and reach >= least and need <= size(shared)")
    first = F.expr("transform(slice(shared, 1, size(shared) - need + 1), x -> x.e)")
    return materialise(able.select("lo", F.explode(first).alias("e"), "sig", "excess", "reach"), "meeting")


def _completed(roots: DataFrame, crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """``roots`` with the links among the members of crowded centres: first to the member nearest to the consensus, then,
    among members that share a difference, to the nearest of these, then all pairs that this leaves."""
    differing = _differing(crowds, sets)
    reach = (18 * F.size("shared") - F.col("excess")).alias("reach")
    stars = _nearest(_labelled(differing.select("lo", "sig", "excess", reach), roots, ["lo"]), ["lo"])
    roots = _joined(roots, _verified(stars.select(F.col("near.sig").alias("a"), F.col("sig").alias("b")).distinct(), sets))
    meeting, group = _meeting(differing, roots), ["lo", "e"]
    fits = "excess <= near.reach and near.excess <= reach"
    stars = _nearest(_labelled(meeting, roots, group), group).where(fits)
    roots = _joined(roots, _verified(stars.select(F.col("near.sig").alias("a"), F.col("sig").alias("b")).distinct(), sets))
    left = materialise(_labelled(meeting, roots, group), "left")
    other = left.select(*group, *(F.col(c).alias(f"o_{c}") for c in ("sig", "label", "excess", "reach")))
    pairs = left.join(other, group).where("sig < o_sig and label <> o_label and excess <= o_reach and o_excess <= reach")
    roots = _joined(roots, _verified(pairs.select(F.col("sig").alias("a"), F.col("o_sig").alias("b")).distinct(), sets))
    release(differing, meeting, left)
    return roots


def _joined(roots: DataFrame | None, near: DataFrame) -> DataFrame:
    """Rows (node, root) of ``roots`` (None: no links yet) after the links ``near`` (a, b). Only links between different
    roots go into the rounds of ``components``: what earlier links joined isn't joined again. Both tables are deleted."""
    links = near
    if roots is None:
        joined = materialise(components(near, "a", "b"), "roots")
        release(links)
        return joined
    for end in "ab":
        near = near.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    across = near.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    above = materialise(components(across, "a", "b"), "roots-above")
    moved = roots.join(above.withColumnsRenamed({"root": "top", "node": "root"}), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    joined = materialise(moved.unionByName(above).distinct(), "roots")
    release(links, above, roots)
    return joined


def _roots(marked: DataFrame, distinct: DataFrame) -> DataFrame:
    """Rows (node, root) for all distinct sets (sig, __text_hash, fp, bands) that are similar to another."""
    proposed = materialise(_fingerprint_pairs(distinct), "fingerprint-pairs")
    stars = _stars(distinct)
    ends = stars.select(F.explode(F.array("lo", "sig")).alias("sig")).unionByName(proposed.select(F.explode(F.array("a", "b")).alias("sig")))
    sets = _sets(marked, distinct.select("sig", "__text_hash").join(ends.distinct(), "sig"))
    roots = _joined(None, _verified(proposed.unionByName(stars.toDF("a", "b")).distinct(), sets))
    crowds = _crowds(stars, roots)
    release(proposed, stars)
    if crowds.limit(1).count():
        roots = _completed(roots, crowds, sets)
    release(crowds, sets)
    return roots


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, as the module says."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    marked = docs.withColumns({"__text_hash": F.coalesce(F.md5("text"), F.lit("")), "__other": F.xxhash64(F.to_json(F.struct(F.lit(0).alias("none"), *others)))})
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "__text_hash", "__other")).alias("first")
    sketches = materialise(_sketches(marked), "sketches")
    distinct = sketches.groupBy("set").agg(first, F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    distinct = materialise(distinct.select(F.monotonically_increasing_id().alias("sig"), "first", "fp", "bands", F.col("first.__text_hash").alias("__text_hash")), "sets")
    release(sketches)
    roots = _roots(marked, distinct)
    kept = distinct.select("sig", "first").join(roots, F.col("sig") == F.col("node"), "left").groupBy(F.coalesce("root", "sig").alias("c")).agg(F.min("first").alias("first"))
    kept = materialise(kept.select(*(F.col(f"first.{c}").alias(n) for c, n in (("doc_id", "__id"), ("__text_hash", "__hash"), ("__other", "__rest")))), "kept")
    release(distinct, roots)
    is_it = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")) & (F.col("__other") == F.col("__rest"))
    return marked.join(kept, is_it, "left_semi").dropDuplicates(["doc_id", "__text_hash"]).select(*docs.columns)
