"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Sizes are words. Each source's target is its share of all sizes by weight, at most ``MAX_REPEATS`` times its own
size; what is above is shared again by weight. The documents of a source are put in a fixed order by hash; the mix takes
them in whole passes and then a last pass that stops at the target, so the taken words equal the rounded target.
Each source has a schedule of its rate over the training time 0 to 1 (piecewise linear). Its integral is the source's
cumulative demand; inverting it at the words that come before a document gives the document's training position in
each pass. Documents are sorted by range of their first position.

The order by hash is that of 60 bits of an MD5 of id and text. The words before a document are a prefix sum in three
steps, so that no task holds a whole source: sums of small hash ranges, sums of coarse ranges over those, and a window in
each small range.

Null text: size 0. Null source: a source of its own, the last. Documents of size 0 are never taken and have no
position. Rows equal in doc_id and text are taken in either order, and counted one by one. A text of any length is one
number here. Extra columns are ignored by ``mix`` and kept by ``mixed_rows`` (those that begin with two underscores and
``mix`` are reserved there); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.storage import join_small, materialise, partitions_for

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Rate over time as knots (time, rate), given to the sources in turn: more early, more late, a hump, steady.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)))
RANGE_ROWS = 128
COARSE_BITS = 10
#: Copies of a row that one task makes.
COPIES_AT_ONCE = 1 << 16
HASH_BITS = 60
_WORD = r"[^\x20\x09-\x0D]+"


def _key(source: str = "source") -> Column:
    """A source as a string that is never null; null sorts last."""
    return F.concat(F.when(F.col(source).isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def _size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _hash() -> Column:
    """Where a document stands in its source: the same on every engine."""
    text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source (``key``): source_size, n_docs, rank (from 0), target and budget (its words, a whole number).

    With the sources in order of their limit by weight, the fair rate after capping those before a source settles which
    is the first that isn't capped. These windows run over one row per source."""
    sums = materialise(sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "mix-sources")
    rank = F.row_number().over(W.orderBy("key")) - 1
    ranked = sums.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1).cast("double"))
    most = max_repeats * F.col("source_size")
    order = W.orderBy("limit", "key")
    all_rows = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    steps = (
        ranked.withColumn("limit", most / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("rate", (F.col("total") - F.coalesce(F.sum(most).over(before), F.lit(0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    fair = F.min(F.when(F.col("rate") <= F.col("limit"), F.struct("limit", "key", "rate"))).over(all_rows)["rate"]
    target = F.least(most.cast("double"), F.coalesce(fair * F.col("weight"), most.cast("double")))
    return materialise(steps.select("key", "source_size", "n_docs", "rank", target.alias("target"), F.round(target).cast("long").alias("budget")), "mix-targets")


def position(share: Column, schedule: tuple) -> Column:
    """The time at which a share of a schedule's whole demand is used up: the inverse of its integral."""
    segments, area = [], 0.0
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:]):
        segments.append(F.struct(*(F.lit(float(x)).alias(n) for n, x in (("area", area), ("t", t0), ("rate", r0), ("slope", (r1 - r0) / (t1 - t0))))))
        area += (r0 + r1) / 2 * (t1 - t0)
    demand = share * area
    at = F.element_at(F.filter(F.array(*segments), lambda s: s["area"] <= demand), -1)
    rest = demand - at["area"]
    root = F.sqrt(F.greatest(F.lit(0.0), at["rate"] * at["rate"] + 2 * at["slope"] * rest))
    return F.least(F.lit(1.0), at["t"] + F.when(rest <= 0, 0.0).otherwise(2 * rest / (at["rate"] + root)))


def _ranges(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Sizes with their source's row, and the small and coarse hash range of each document."""
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("n_docs") / RANGE_ROWS)))).cast("int")
    joined = join_small(sizes, targets.withColumn("bits", bits), "key")
    return joined.withColumn("fine", F.expr(f"shiftright(h, {HASH_BITS} - bits)")).withColumn("coarse", F.expr("shiftright(fine, bits - least(bits, %d))" % COARSE_BITS))


def _placed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct sizes with ``copies`` and ``before``: the words of the source that come before the first of them."""
    ranged = _ranges(sizes, targets)
    fine = materialise(ranged.groupBy("key", "coarse", "fine").agg(F.sum("size").alias("n")), "mix-ranges")
    earlier = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    bases = fine.groupBy("key", "coarse").agg(F.sum("n").alias("n")).select("key", "coarse", total("n", earlier("key", "coarse")).alias("base"))
    starts = fine.join(bases, ["key", "coarse"]).select("key", "fine", (F.col("base") + total("n", earlier("key", "coarse", "fine"))).alias("start"))
    # rows equal in all of this are counted first: however many there are, they are one row of a window
    same = ranged.groupBy(*ranged.columns).agg(F.count("*").alias("copies"))
    inside = W.partitionBy("key", "fine").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = join_small(same, materialise(starts, "mix-starts"), ["key", "fine"])
    return placed.withColumn("before", F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))


def _each_copy(placed: DataFrame) -> DataFrame:
    """A row for each copy, one after another; groups of many copies are dealt to several tasks."""
    placed = materialise(placed, "mix-placed")
    few, many = placed.where(F.col("copies") <= COPIES_AT_ONCE), placed.where(F.col("copies") > COPIES_AT_ONCE)
    portions = many.withColumn("portion", F.explode(F.expr(f"sequence(0, (copies - 1) div {COPIES_AT_ONCE})"))).repartition(partitions_for(placed), "h", "portion")
    copy = F.expr(f"explode(sequence(portion * {COPIES_AT_ONCE}, least(copies, (portion + 1) * {COPIES_AT_ONCE}) - 1))")
    rows = few.withColumn("portion", F.lit(0).cast("long")).unionByName(portions).withColumn("copy", copy)
    return rows.withColumn("before", F.col("before") + F.col("copy") * F.col("size")).drop("copies", "portion", "copy")


def _sizes(docs: DataFrame) -> DataFrame:
    return materialise(docs.select("doc_id", _key().alias("key"), _size().alias("size"), _hash().alias("h")), "mix-sizes")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row per document, in order of first position: doc_id, size, source_size, target, taken (words, repeats
    counted) and positions (one for each pass that takes it)."""
    sizes = _sizes(docs)
    placed = _each_copy(_placed(sizes, source_targets(sizes, weights, max_repeats)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.expr("budget div source_size"))).otherwise(0).cast("int")
    rest = F.col("budget") - F.col("passes") * F.col("source_size")
    last = F.least("size", F.greatest(F.lit(0), rest - F.col("before")))
    starts = F.when(F.col("n_passes") > 0, F.transform(F.sequence(F.lit(0), F.col("n_passes") - 1), lambda k: (k * F.col("source_size") + F.col("before")) / F.col("budget"))).otherwise(F.array().cast("array<double>"))
    kind = F.pmod("rank", F.lit(len(schedules)))
    positions = F.transform(starts, lambda s: F.coalesce(*(F.when(kind == i, position(s, x)) for i, x in enumerate(schedules))))
    out = (
        placed.withColumn("passes", passes)
        .withColumn("last", last)
        .withColumn("n_passes", F.when(F.col("size") > 0, F.col("passes") + (F.col("last") > 0).cast("int")).otherwise(0))
        .select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("last")).alias("taken"), positions.alias("positions"), "h")
    )
    first = F.get("positions", F.lit(0))
    return out.orderBy(first.asc_nulls_last(), "h", "doc_id").drop("h")


def _split_group(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of groups of equal id and text of which the last pass takes some: with __mix_pass, a row for each pass. Rows
    equal in all columns are counted before they meet; the others are numbered by hash, in 1,024 ranges a group."""
    group = ["__mix_key", "__mix_h"]
    variant = F.xxhash64(F.to_json(F.struct(*columns)))
    same = rows.withColumn("__mix_v", variant).groupBy(*group, "__mix_v")
    same = same.agg(F.first(F.struct(*columns)).alias("__mix_row"), F.first("__mix").alias("__mix"), F.count("*").alias("__mix_n"))
    same = materialise(same.withColumn("__mix_range", F.shiftright("__mix_v", 54)), "mix-variants")
    earlier = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranges = same.groupBy(*group, "__mix_range").agg(F.sum("__mix_n").alias("__mix_sum"))
    ranges = ranges.select(*group, "__mix_range", total("__mix_sum", earlier(*group, "__mix_range")).alias("__mix_base"))
    placed = join_small(same, ranges, [*group, "__mix_range"]).withColumn("__mix_at", F.col("__mix_base") + total("__mix_n", earlier(*group, "__mix_range", "__mix_v")))
    extra = F.greatest(F.lit(0), F.least("__mix_n", F.col("__mix.last") - F.col("__mix_at")))
    copies = (F.col("__mix.passes") * F.col("__mix_n") + extra).cast("long")
    each = placed.withColumn("__mix_copies", copies).where("__mix_copies > 0").withColumn("__mix_i", F.explode(F.expr("sequence(1, __mix_copies)")))
    nth = F.least(F.col("__mix.passes"), F.expr("(__mix_i - 1) div __mix_n"))
    return each.select("__mix_row.*", "__mix", "__mix_h", nth.alias("__mix_pass"))


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: tuple = SCHEDULES) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, sorted by range of training position: a row for each whole pass, and
    one more for documents of which the last pass takes half or more. Rows equal in doc_id and text share positions."""
    sizes = _sizes(docs)
    targets = source_targets(sizes, weights, max_repeats)
    placed = _placed(sizes, targets).where("size > 0").withColumn("passes", F.expr("budget div source_size"))
    same = ("source_size", "budget", "rank", "passes", "size")
    groups = placed.groupBy("key", "h", "doc_id").agg(F.min("before").alias("before"), F.sum("copies").alias("n"), *(F.first(c).alias(c) for c in same))
    due = F.col("budget") - F.col("passes") * F.col("source_size") - F.col("before")
    last = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((2 * due + F.col("size")) / (2 * F.col("size")))))
    taken = groups.withColumn("last", last.cast("long")).where("passes + last > 0")
    mark = F.struct("passes", "last", "n", "before", "source_size", "budget", "rank").alias("__mix")
    taken = materialise(taken.select(mark, F.col("key").alias("__mix_key"), F.col("h").alias("__mix_h"), F.col("doc_id").alias("__mix_id")), "mix-taken")
    marked = docs.withColumns({"__mix_source": _key(), "__mix_hash": _hash()})
    is_of = (F.col("__mix_source") == F.col("__mix_key")) & (F.col("__mix_hash") == F.col("__mix_h")) & F.col("doc_id").eqNullSafe(F.col("__mix_id"))
    partly = F.col("__mix.last").between(1, F.col("__mix.n") - 1)
    copies = F.col("__mix.passes") + (F.col("__mix.last") > 0).cast("int")
    whole = join_small(marked, taken.where(~partly), is_of).withColumn("__mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    rows = whole.select(*docs.columns, "__mix", "__mix_h", "__mix_pass")
    split = taken.where(partly)  # one group of each source at most
    if split.limit(1).count():
        rows = rows.unionByName(_split_group(join_small(marked, split, is_of), docs.columns))
    share = (F.col("__mix_pass") * F.col("__mix.source_size") + F.col("__mix.before")) / F.col("__mix.budget")
    kind = F.pmod("__mix.rank", F.lit(len(schedules)))
    rows = rows.withColumn("__mix_position", F.coalesce(*(F.when(kind == i, position(share, x)) for i, x in enumerate(schedules))))
    order = ["__mix_position", "__mix_h", "doc_id", "__mix_pass"]
    return rows.repartitionByRange(partitions_for(docs), *order).sortWithinPartitions(*order).select(*docs.columns)


def op1_mix_sources(spark, sf_dir):
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({"n_passes": F.size("positions").cast("long"), "position": F.round(F.get("positions", F.lit(0)), 6)}).drop("positions")


def _oracle() -> str:
    def place(schedule: tuple) -> str:
        cases, area = [], 0.0
        for (t0, r0), (t1, r1) in zip(schedule, schedule[1:]):
            rest = f"(q * total_area - {area})"
            cases.insert(0, f"WHEN q * total_area >= {area} THEN {t0} + CASE WHEN {rest} <= 0 THEN 0 ELSE 2 * {rest} / ({r0} + sqrt(greatest(0, {r0 * r0} + 2 * {(r1 - r0) / (t1 - t0)} * {rest}))) END")
            area += (r0 + r1) / 2 * (t1 - t0)
        return "least(1.0::DOUBLE, CASE " + " ".join(c.replace("total_area", str(area)) for c in cases) + " END)"

    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    at = " ".join(f"WHEN {i} THEN {place(s)}" for i, s in enumerate(SCHEDULES))
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {HASH_BITS // 4}))::BIGINT AS h FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY key) - 1 AS rank FROM d GROUP BY key),
w AS (SELECT *, (CASE rank % {len(WEIGHTS)} {weight} END)::DOUBLE AS weight FROM s),
r AS (SELECT *, {MAX_REPEATS} * source_size / weight AS lim, sum(source_size) OVER () - coalesce(sum({MAX_REPEATS} * source_size) OVER o, 0) AS left_over, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight
  FROM w WINDOW o AS (ORDER BY {MAX_REPEATS} * source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(left_over / left_weight, (lim, key)) AS fair FROM r WHERE left_over / left_weight <= lim),
t AS (SELECT key, source_size, rank, least(({MAX_REPEATS} * source_size)::DOUBLE, coalesce(fair * weight, ({MAX_REPEATS} * source_size)::DOUBLE)) AS target FROM r, f),
b AS (SELECT d.*, source_size, rank, target, round(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY key ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t USING (key)),
p AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM b),
l AS (SELECT *, least(size, greatest(0, budget - passes * source_size - before)) AS last, before / budget AS q FROM p),
n AS (SELECT *, CASE WHEN size > 0 THEN passes + (last > 0)::BIGINT ELSE 0 END AS n_passes FROM l)
SELECT doc_id, size, source_size, target, (passes * size + last)::BIGINT AS taken, n_passes::BIGINT AS n_passes,
  round(CASE WHEN n_passes > 0 THEN CASE rank % {len(SCHEDULES)} {at} END END, 6) AS position FROM n"""


ORACLE_SQL = {"op1_mix_sources": _oracle()}
