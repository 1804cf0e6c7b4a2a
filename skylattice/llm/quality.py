"""Quality rules whose cutoffs come from mergeable quantile sketches of each language and source.

Each document gets word statistics. Each (language, source) group has, for every ratio, a sketch: counts in
logarithmic bins of 2 % relative width. Sketches of a group merge by adding counts, so one pass with map-side
aggregation builds them at any size, in any order, with the same result. Fences taken from a group's quartiles replace
fixed cutoffs. Quartiles of few documents are uncertain: each group's are averaged with those of its language, and these
with those of the whole corpus, which count as much as ``strength`` documents each. A join brings the fences to the
documents.

Null or empty text: all counts 0 and ``base_failed``. Null language or source: a group of its own. Repeated rows:
each is judged. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.llm.arrow import map_batches, text_bytes
from skylattice.storage import join_small, materialise

SYMBOLS = b"#*$%&|<>"
#: Ratio: (numerator, smallest fence width above the upper quartile, checked below as well)
RATIOS = {
    "word_len": ("word_chars", 1.0, True),
    "symbols": ("n_symbols", 0.1, False),
    "dup_lines": ("n_dup_lines", 0.02, False),
    "repeats": ("n_repeat_words", 0.3, False),
}
BIN_WIDTH = 1.02
#: Documents that the quartiles of a wider group count for.
STRENGTH = 50.0


def word_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if windows and len(set(windows)) < len(windows):
        found, end = Counter(windows), 0
        for i, x in enumerate(windows):
            if found[x] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def document_stats(docs: DataFrame) -> DataFrame:
    def stats(batch):
        found = list(zip(*map(word_stats, text_bytes(batch.column("text")))))
        return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "source": batch.column("source")} | dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), found))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "lang", "source", "text"), stats, f"doc_id {kind}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def ratio_sketches(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, ratio, bin, n). Bin 0 holds values under a thousandth. Documents without words give nothing."""
    value = F.col("value")
    bin_of = F.when(value < 0.001, 0).otherwise(1 + F.floor(F.log(value * 1000) / F.log(F.lit(BIN_WIDTH)))).cast("int")
    ratios = F.array(*(F.struct(F.lit(name).alias("ratio"), (F.col(column) / F.col("n_words")).alias("value")) for name, (column, _, _) in RATIOS.items()))
    return stats.where("n_words > 0").select(*keys, F.inline(ratios)).groupBy(*keys, "ratio", bin_of.alias("bin")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of fewer keys, by adding counts."""
    return sketches.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))


def sketch_quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, ratio, size, q1, q3). A sketch has at most some 1,500 bins, whatever the size of its group."""
    below = W.partitionBy(*keys, "ratio")
    at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("total"), F.col("bin")))
    value = lambda b: F.when(b == 0, 0.0).otherwise(F.pow(F.lit(BIN_WIDTH), b - 0.5) / 1000)
    counted = sketches.withColumn("cum", F.sum("n").over(below.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
    counted = counted.withColumn("total", F.sum("n").over(below))
    return counted.groupBy(*keys, "ratio").agg(F.max("total").alias("size"), value(at(0.25)).alias("q1"), value(at(0.75)).alias("q3"))


def shrunk(quartiles: DataFrame, wider: DataFrame, on: list[str], strength: float) -> DataFrame:
    """Quartiles averaged by size with those of wider groups, which count as ``strength`` documents."""
    both = join_small(quartiles, wider.select(*on, "ratio", F.col("q1").alias("w1"), F.col("q3").alias("w3")), [*on, "ratio"])
    mean = lambda q, w: (F.col("size") * F.col(q) + strength * F.col(w)) / (F.col("size") + strength)
    return both.withColumns({"q1": mean("q1", "w1"), "q3": mean("q3", "w3")}).drop("w1", "w3")


def sketch_fences(quartiles: DataFrame, keys: list[str], spread: float) -> DataFrame:
    """Per key the struct ``fences`` of ratio -> (low, high)."""
    least = F.create_map(*(x for name, (_, width, _) in RATIOS.items() for x in (F.lit(name), F.lit(width))))
    width = F.greatest(spread * (F.col("q3") - F.col("q1")), least[F.col("ratio")])
    fence = F.struct((F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))
    of = lambda name: F.max(F.when(F.col("ratio") == name, fence)).alias(name)
    return quartiles.groupBy(*keys).agg(F.struct(*(of(x) for x in RATIOS)).alias("fences"))


def quality_rules(docs: DataFrame, spread: float = 3.0, strength: float = STRENGTH) -> DataFrame:
    """One row per document: doc_id, lang, source, the statistics, base_failed, kept and the names of failed ratios."""
    stats = materialise(document_stats(docs), "quality-stats")
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(f"key_{c}")
    keyed = stats.select("*", mark("lang"), mark("source"))
    keys = ["key_lang", "key_source"]
    own = materialise(ratio_sketches(keyed, keys), "quality-sketches")
    langs = materialise(merge_sketches(own, keys[:1]), "quality-sketches")
    whole = sketch_quartiles(merge_sketches(langs, []), [])  # a row for each ratio
    by_lang = materialise(shrunk(sketch_quartiles(langs, keys[:1]), whole, [], strength), "quality-quartiles")
    by_group = shrunk(sketch_quartiles(own, keys), by_lang, keys[:1], strength)
    fences = materialise(sketch_fences(by_group, keys, spread), "quality-fences")
    ratio = lambda name: F.col(RATIOS[name][0]) / F.col("n_words")

    def out(name: str):
        high = ratio(name) > F.col(f"fences.{name}.high")
        return high | (ratio(name) < F.col(f"fences.{name}.low")) if RATIOS[name][2] else high

    names = F.filter(F.array(*(F.when(out(name), F.lit(name)) for name in RATIOS)), F.isnotnull)
    failed = F.when(F.col("n_words") > 0, names).otherwise(F.array().cast("array<string>"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = join_small(keyed, fences, keys, "left")
    found = joined.select(*stats.columns, base.alias("base_failed"), failed.alias("failed"))
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op2_quality_rules(spark, sf_dir):
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def _oracle(spread: float = 3.0, strength: float = STRENGTH) -> str:
    blank, keys = r"[^\x20\x09-\x0D]", "coalesce('=' || lang, '') AS kl, coalesce('=' || source, '') AS ks"
    value = f"CASE WHEN {{0}} = 0 THEN 0.0::DOUBLE ELSE pow({BIN_WIDTH}::DOUBLE, {{0}} - 0.5) / 1000 END"
    least = "CASE ratio " + " ".join(f"WHEN '{n}' THEN {w}::DOUBLE" for n, (_, w, _) in RATIOS.items()) + " END"

    def fences(keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""(SELECT {by}ratio, total AS size, {value.format("b1")} AS q1, {value.format("b3")} AS q3 FROM (
  SELECT {by}ratio, any_value(total) AS total, min(bin) FILTER (cum >= 0.25 * total) AS b1, min(bin) FILTER (cum >= 0.75 * total) AS b3 FROM (
    SELECT {by}ratio, bin, sum(n) OVER (PARTITION BY {by}ratio ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY {by}ratio) AS total FROM (
      SELECT {by}ratio, bin, sum(n) AS n FROM k GROUP BY ALL)) GROUP BY ALL))"""

    out = lambda n, both: f"(v{n} > h{n}" + (f" OR v{n} < l{n})" if both else ")")
    failed = "coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {out(n, both)} THEN '{n}' END" for n, (_, _, both) in RATIOS.items()) + "], lambda x: x IS NOT NULL), ','), '')"
    sides = ", ".join(f"max(q1 - width) FILTER (ratio = '{n}') AS l{n}, max(q3 + width) FILTER (ratio = '{n}') AS h{n}" for n in RATIOS)
    return f"""
WITH t AS (SELECT doc_id, {keys}, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{blank}+') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t))),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, range(3) AS o(j) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT doc_id, kl, ks, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{blank}')) AS l FROM t) LEFT JOIN r USING (doc_id)),
v AS (SELECT s.*, {", ".join(f"CASE WHEN n_words > 0 THEN {c} / n_words END AS v{n}" for n, (c, _, _) in RATIOS.items())} FROM s),
k AS (SELECT kl, ks, ratio, CASE WHEN x < 0.001 THEN 0 ELSE 1 + floor(ln(x * 1000) / ln({BIN_WIDTH}::DOUBLE)) END::INTEGER AS bin, count(*) AS n
  FROM ({" UNION ALL ".join(f"SELECT kl, ks, '{n}' AS ratio, v{n} AS x FROM v WHERE n_words > 0" for n in RATIOS)}) GROUP BY ALL),
f AS (SELECT kl, ks, {sides} FROM (SELECT kl, ks, ratio, q1, q3, greatest({spread} * (q3 - q1), {least}) AS width FROM (
  SELECT a.kl, a.ks, ratio, {", ".join(f"(a.size * a.{q} + {strength} * (b.size * b.{q} + {strength} * c.{q}) / (b.size + {strength})) / (a.size + {strength}) AS {q}" for q in ("q1", "q3"))}
  FROM {fences("kl, ks")} a JOIN {fences("kl")} b USING (kl, ratio) JOIN {fences("")} c USING (ratio))) GROUP BY ALL),
d AS (SELECT v.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, CASE WHEN n_words > 0 THEN {failed} ELSE '' END AS failed FROM v LEFT JOIN f USING (kl, ks))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM d"""


ORACLE_SQL = {"op2_quality_rules": _oracle()}
