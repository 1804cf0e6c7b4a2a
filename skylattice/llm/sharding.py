"""Sharding by extendible hashing, with DataFrame functions only.

A document's hash is 60 bits of an MD5 of its id and text. A shard is a hash prefix: of the prefixes of a document the
shortest whose documents together fit the byte limit. A directory indexed by the first bits lists the shard of each
cell; only cells that are still too large are split further, on six more bits at a time.

A document larger than the limit has a shard of its own (``oversize``). Rows equal in id and text can't be told apart
by any bit: where they don't fit together, they are dealt to numbered parts. Null texts have no bytes and null ids are
hashed as empty. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.storage import join_small, materialise

BITS = 60
SHARD_BYTES = 1 << 20
MORE_BITS = 6


def _prefix(depth):
    return F.expr(f"shiftright(h, {BITS} - {depth})")


def _sums(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Rows (depth, prefix, shard_bytes, n) for the prefixes of ``low`` to ``high`` bits of the cells (``high`` bits). A step
    sums over some depths and hands the next one the prefixes that are left."""
    found, level, top = None, cells.withColumnRenamed("cell", "prefix"), high
    while True:
        bottom = max(low, top - MORE_BITS + 1)
        depths = F.explode(F.sequence(F.lit(bottom), F.lit(top))).alias("depth")
        nodes = level.select("prefix", depths, "bytes", "n").withColumn("prefix", F.expr(f"shiftright(prefix, {top} - depth)"))
        sums = materialise(nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n")), "shard-sums")
        found = sums if found is None else found.unionByName(sums)
        if bottom == low:
            return found
        shortest = sums.where(F.col("depth") == bottom)
        level, top = shortest.select(F.expr("shiftright(prefix, 1)").alias("prefix"), F.col("shard_bytes").alias("bytes"), "n"), bottom - 1


def shard(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, bytes, depth (bits of the prefix), shard (depth and prefix), part, shard_bytes and oversize."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))), 1, 15), 16, 10).cast("long")
    left = materialise(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), h.alias("h")), "shard-hashes")
    total = left.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / shard_bytes)))) + 3)
    found = None
    while True:
        cells = materialise(left.groupBy(_prefix(high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "shard-cells")
        sums = _sums(cells, low, high)
        fits = sums.where((F.col("shard_bytes") <= shard_bytes) | (F.col("n") == 1))
        # a prefix longer than one that fits, fits as well: shards are those that don't fit when one bit shorter
        longer = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.expr("array(2 * prefix, 2 * prefix + 1)")).alias("prefix"))
        shards = fits.join(longer, ["depth", "prefix"], "left_anti")
        # the directory: for each cell, its shard
        under = F.expr(f"sequence(shiftleft(prefix, {high} - depth), shiftleft(prefix + 1, {high} - depth) - 1)")
        directory = materialise(shards.select(F.explode(under).alias("cell"), "depth", "prefix", "shard_bytes"), "shard-directory")
        rows = join_small(left.withColumn("cell", _prefix(high)), directory, "cell").select("doc_id", "bytes", "depth", "prefix", F.lit(0).cast("long").alias("part"), "shard_bytes")
        found = rows if found is None else found.unionByName(rows)
        crowded = cells.join(directory, "cell", "left_anti")
        if not crowded.limit(1).count():
            break
        left = materialise(join_small(left.withColumn("cell", _prefix(high)), crowded.select("cell"), "cell").drop("cell"), "shard-crowded")
        if high == BITS:  # equal rows: as many in a part as fit
            same = materialise(left.groupBy("h", "doc_id", "bytes").agg(F.count("*").alias("n")), "shard-same")
            each = F.greatest(F.lit(1), F.expr(f"{shard_bytes} div greatest(bytes, 1)"))
            parts = same.withColumn("each", each).select("doc_id", "bytes", F.col("h").alias("prefix"), F.col("each"), "n", F.posexplode(F.expr("sequence(1, cast(ceil(n / each) as bigint))")).alias("part", "one"))
            size = F.least("each", F.col("n") - F.col("part") * F.col("each"))
            found = found.unionByName(parts.withColumn("size", size).select("doc_id", "bytes", F.lit(BITS).alias("depth"), "prefix", F.col("part").cast("long").alias("part"), (F.col("size") * F.col("bytes")).alias("shard_bytes"), F.explode(F.expr("sequence(1, size)")).alias("copy")).drop("copy"))
            break
        low, high = high + 1, min(BITS, high + MORE_BITS)
    return found.select("doc_id", "bytes", "depth", F.concat_ws("-", F.col("depth").cast("string"), F.col("prefix").cast("string")).alias("shard"), "part", "shard_bytes", (F.col("bytes") > shard_bytes).alias("oversize"))


def op4_extendible_shards(spark, sf_dir):
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op4_extendible_shards": f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
     n AS (SELECT d.*, depth::INTEGER AS depth, h >> ({BITS} - depth) AS prefix FROM d, generate_series(0, 40) AS g(depth)),
     s AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS k FROM n GROUP BY ALL),
     f AS (SELECT doc_id, h, bytes, depth, prefix, shard_bytes, row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) AS r
           FROM n JOIN s USING (depth, prefix) WHERE shard_bytes <= {SHARD_BYTES} OR k = 1)
SELECT doc_id, bytes, depth, depth::VARCHAR || '-' || prefix::VARCHAR AS shard, 0::BIGINT AS part, shard_bytes, bytes > {SHARD_BYTES} AS oversize
FROM f WHERE r = 1""",
}
