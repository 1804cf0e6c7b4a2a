"""Near-duplicate groups from SimHash fingerprints, found with pivot distance tables.

Copies of a fingerprint are grouped first, so that only distinct fingerprints are compared. Two that differ in at
most three bits agree on whole blocks of bits: each fingerprint is dealt to one bucket for every choice of blocks.
In a bucket, a table holds the Hamming distance of each member to many reference fingerprints (the pivots). By the
triangle inequality a pair whose distances to any pivot differ by more than three can't be a match, so pairs are
discarded by their largest coordinate difference, and the survivors are verified on the bits.

A bucket with more than ``max_bucket`` members is not compared: its members are dealt again, on a choice of more
blocks, which is exact by the same argument. The last choice leaves 16 free bits and takes buckets of any size: it has
at most 65,536 distinct members, whatever the number of documents. Links found in a bucket are reported as a spanning
forest, and components of the links are found on tables.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share a fingerprint and so a
component. A component of rows without any id has a null component_id. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.arrow import map_batches, text_bytes
from skylattice.llm.components import components
from skylattice.storage import materialise

MAX_BITS = 3
#: (blocks of the 64 bits, blocks that must agree): with 3 differing bits, all but 3 blocks agree.
LEVELS = ((5, 2), (6, 3), (8, 5), (12, 9))
N_PIVOTS = 16
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(N_PIVOTS)], np.uint64)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit fingerprint of the 3-word shingles of a text in UTF-8, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    return majority(np.fromiter(map(_hash, shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):  # a very long text in pieces
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``fp`` (the fingerprint as a signed long)."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batch):
        fps = np.array([fingerprint(x) for x in text_bytes(batch.column("text"))], np.uint64).view(np.int64)
        return {f.name: batch.column(f.name) for f in kept} | {"fp": fps}

    return map_batches(docs, run, type(docs.schema)([*kept]).add("fp", "long"))


def block_masks(blocks: int, agree: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``agree`` of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(sum(x)).astype(np.int64)) for x in combinations(parts, agree)]


def bucket_links(buckets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each bucket of distinct fingerprints."""
    us, vs = [], []
    fps = np.concatenate(buckets)
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    at = 0
    for bucket in buckets:
        n, near = len(bucket), table[at : at + len(bucket)]
        at += n
        label = np.arange(n)
        for i in range(n):  # pivots prune, the bits decide; a row at a time keeps memory in proportion to the bucket
            rest = np.flatnonzero(np.abs(near[i + 1 :, 0] - near[i, 0]) <= MAX_BITS) + i + 1
            rest = rest[label[rest] != label[i]]
            if len(rest):
                rest = rest[np.abs(near[rest] - near[i]).max(axis=1) <= MAX_BITS]
                rest = rest[np.bitwise_count(bucket[rest] ^ bucket[i]) <= MAX_BITS]
            for j in rest:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    us.append(bucket[i])
                    vs.append(bucket[j])
    return np.array(us, np.uint64), np.array(vs, np.uint64)


def fingerprint_links(distinct: DataFrame, max_bucket: int = 128, levels=LEVELS) -> DataFrame:
    """Links (u, v) among distinct fingerprints (column ``fp``) that connect all that are within 3 bits of another."""
    found, left = None, distinct
    for level, (blocks, agree) in enumerate(levels):
        last = level == len(levels) - 1
        masks = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(block_masks(blocks, agree))))
        keys = left.select("fp", F.inline(masks))
        sizes = materialise(keys.groupBy("t", "part").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "buckets")
        fits = F.lit(True) if last else F.col("n") <= max_bucket
        pairs = sizes.where("n = 2").select(F.array("lo", "hi").alias("fps"))
        more = keys.join(sizes.where(fits & (F.col("n") > 2)).select("t", "part"), ["t", "part"]).groupBy("t", "part").agg(F.collect_list("fp").alias("fps"))

        def run(batch):
            lists = batch.column("fps")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())
            u, v = bucket_links(np.split(flat, ends[:-1]))
            return {"u": u.view(np.int64), "v": v.view(np.int64)}

        links = map_batches(pairs.unionByName(more.select("fps")), run, "u long, v long")
        found = links if found is None else found.unionByName(links)
        crowded = None if last else sizes.where(~fits)
        if crowded is None or not crowded.limit(1).count():
            break
        left = materialise(keys.join(crowded.select("t", "part"), ["t", "part"]).select("fp").distinct(), "crowded")
    return found


def components_of(prints: DataFrame, max_bucket: int = 128) -> DataFrame:
    """Rows (fp, component_id) for the fingerprints of a stored table with doc_id and fp."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = materialise(components(fingerprint_links(distinct.select("fp"), max_bucket), "u", "v"), "roots")
    grouped = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    grouped = materialise(grouped, "grouped")
    ids = materialise(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    return materialise(grouped.join(ids, "root").select("fp", "component_id"), "component-of")


def near_duplicates(prints: DataFrame, max_bucket: int = 128) -> DataFrame:
    """``prints`` (a stored table with doc_id and fp) with component_id, the smallest doc_id of its component."""
    return prints.join(components_of(prints, max_bucket), "fp")


def op6_simhash(spark, sf_dir):
    prints = materialise(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "prints")
    return near_duplicates(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
