"""Language of web pages by fusion of evidence under Bayes' rule.

Four kinds of evidence speak for a language: the text (byte trigrams, against counts over all documents with a known
language), the language that the markup declares, the suffix of the address, and the host. The log likelihood of the
text is scaled to ``text_weight`` trigrams, since neighbouring trigrams aren't independent. How often a declared
language or a suffix goes with a language is counted over all pages by their text alone, with smoothing. The prior of a
host is its own counts smoothed towards those of its domain, and these towards all pages; a page's own count is taken
out first, so that it can't vote for itself. All counts come from grouped aggregation.

Null or empty html has no text evidence, a missing declaration or address is a value of its own. Repeated rows are
judged each. Languages are those of the training table (null ones are left out), of any number: the text is scored
against ``LANG_BLOCK`` of them in a pass. Without any, lang is null. Tags and comments are cut in one pass over a page of
any length; what an unclosed comment, script or style opens goes up to the page's end. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.arrow import map_batches, text_bytes
from skylattice.storage import join_small, materialise

BUCKETS = 1 << 13
TEXT_WEIGHT = 40.0
HOST_STRENGTH, DOMAIN_STRENGTH = 10.0, 20.0
#: Languages whose trigram table (BUCKETS numbers each) is sent to the tasks at a time.
LANG_BLOCK = 256
_HIDDEN = re.compile(r"<(script|style)\b", re.I)
_CLOSED = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style")}
_LETTERS = re.compile(r"[\W\d_]+")


def _without_tags(page: str) -> str:
    """A page without tags, comments, scripts and styles, each replaced by a blank."""
    found, at, last = [], 0, page.rfind(">")
    while 0 <= (low := page.find("<", at)) < last:
        found.append(page[at:low])
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            at = end + 3 if end >= 0 else len(page)
        elif hidden := _HIDDEN.match(page, low):
            close = _CLOSED[hidden[1].lower()].search(page, hidden.end())
            at = close.end() if close else len(page)
        else:
            at = page.find(">", low) + 1
    found.append(page[at:])
    return " ".join(found)


def page_text(page: str | None) -> str:
    """What a reader sees of a page."""
    return entities.unescape(_without_tags(page)) if page else ""


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the words, lower-cased, each between single spaces."""
    data = np.frombuffer(f" {_LETTERS.sub(' ', text.lower())} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    x = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
    return (x >> np.uint32(19)).astype(np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, bucket, n) over all documents with a language; a task sends its sums."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
                if lang is not None:
                    total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total += np.bincount(trigrams(text.decode("utf-8", "replace")), minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def languages(counts: DataFrame) -> list[str]:
    return [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]  # a name for each language


def log_probabilities(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """The log probability of each bucket for some languages, neighbours in order."""
    table = np.full((len(langs), BUCKETS), 0.5)
    if not langs:
        return table
    rows = counts.where(F.col("lang").between(langs[0], langs[-1])).toArrow()
    at = pc.index_in(rows.column("lang"), value_set=pa.array(langs)).to_numpy()
    table[at, rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    return np.log(table / table.sum(axis=1, keepdims=True))


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """All languages in order with their log probabilities at once."""
    counts = materialise(trigram_counts(docs), "trigrams")
    langs = languages(counts)
    return langs, log_probabilities(counts, langs)


def _scored(marked: DataFrame, docs: DataFrame, text_weight: float, lang_block: int) -> tuple[list[str], DataFrame]:
    """The languages, and ``marked`` with its html replaced by ``text``: the scaled log likelihoods."""
    spark = docs.sparkSession
    counts = materialise(trigram_counts(docs), "trigrams")
    langs = languages(counts)
    blocks = [langs[i : i + lang_block] for i in range(0, len(langs), lang_block)] or [[]]
    fields = [f for f in marked.schema.fields if f.name != "html"]
    df = marked.withColumn("text", F.array().cast("array<double>"))
    for block in blocks:
        shared, last = spark.sparkContext.broadcast(log_probabilities(counts, block)), block is blocks[-1]

        def run(batch, shared=shared, last=last):
            found = []
            for page, before in zip(batch.column("html").to_pylist(), batch.column("text").to_pylist()):
                seen = np.bincount(trigrams(page_text(page)), minlength=BUCKETS)
                n = seen.sum()
                logs = np.append(before, shared.value @ seen if n >= 2 else np.zeros(len(shared.value)))
                if last and n >= 2 and len(logs):
                    logs = (logs - logs.max()) * min(1.0, text_weight / n)
                found.append(logs)
            return dict(zip(batch.schema.names, batch.columns)) | {"text": found}

        kind = type(marked.schema)([*fields] if last else [*marked.schema.fields]).add("text", T.ArrayType(T.DoubleType()))
        df = map_batches(df, run, kind)
        if not last:
            df = materialise(df, "page-scores")
            shared.destroy()
    return langs, df


def _features(url: str = "url", html: str = "html") -> dict[str, Column]:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    tag = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b([^>]*+)", 1)  # one cut: no search begins at every tag
    declared = F.lower(F.regexp_extract(tag, r"(?i)\blang\s*+=\s*+[\"']?([A-Za-z]{2,3})\b", 1))
    return {
        "host": host,
        "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "suffix": F.regexp_extract(host, r"\.([a-z]+)$", 1),
        "declared": declared,
    }


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often a lambda of ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def identify(pages: DataFrame, docs: DataFrame, text_weight: float = TEXT_WEIGHT, lang_block: int = LANG_BLOCK) -> DataFrame:
    """One row per page: page_id, host, domain, suffix, declared, text_lang, lang, confidence and posterior (by language)."""
    marked = pages.select("page_id", "html", *(c.alias(n) for n, c in _features().items()))
    langs, scored = _scored(marked, docs, text_weight, lang_block)
    shown = ("page_id", "host", "domain", "suffix", "declared")
    if not langs:
        empty = F.lit(None).cast("string")
        none = F.lit(None).cast("map<string,double>")
        return scored.select(*shown, empty.alias("text_lang"), empty.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("posterior"))
    best = F.array_position("text", F.array_max("text")).cast("int") - 1
    scored = materialise(scored.withColumn("best", best), "page-texts")

    def votes(by: str) -> DataFrame:
        """Pages by text language for each value, as a map by language, and their number."""
        counts = scored.groupBy(by, "best").agg(F.count("*").cast("double").alias("n"))
        lists = F.map_from_entries(F.collect_list(F.struct("best", "n")))  # an entry for each language at most
        return materialise(counts.groupBy(by).agg(lists.alias(f"votes_{by}"), F.sum("n").alias(f"size_{by}")), "votes")

    total = np.zeros(len(langs))
    for r in scored.groupBy("best").agg(F.count("*").alias("n")).collect():
        total[r.best] = r.n
    flat = ((total + 1) / (total.sum() + len(langs))).tolist()
    out = scored
    for name in ("declared", "suffix", "domain", "host"):
        out = join_small(out, votes(name), name)

    def evidence(text: Column, i: Column) -> Column:
        """The log posterior of language i, up to a constant; a page's own vote is taken out."""
        flat_i, total_i = (F.array(*map(F.lit, x))[i] for x in (flat, total.tolist()))
        own = F.when(F.col("best") == i, 1.0).otherwise(0.0)
        at = lambda by: F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(f"votes_{by}", i), F.lit(0.0)) - own)
        domain = (at("domain") + DOMAIN_STRENGTH * flat_i) / (F.col("size_domain") - 1 + DOMAIN_STRENGTH)
        prior = (at("host") + HOST_STRENGTH * domain) / (F.col("size_host") - 1 + HOST_STRENGTH)
        # of the pages of a language, the share with this declaration or suffix; one page is spread over all values
        given = [(at(by) + flat_i) / (total_i + 1) for by in ("declared", "suffix")]
        return F.log(prior) + F.log(given[0]) + F.log(given[1]) + text

    logp = F.transform("text", evidence)
    raw = _once(logp, lambda v: _once(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    p = _once(raw, lambda v: _once(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda norm: F.transform(v, lambda x: x / norm)))
    names = F.array(*map(F.lit, langs))
    text_lang = F.when(F.array_max("text") > F.array_min("text"), names[F.col("best")])
    lang = names[F.array_position("p", F.array_max("p")).cast("int") - 1]
    return out.withColumn("p", p).select(*shown, text_lang.alias("text_lang"), lang.alias("lang"), F.array_max("p").alias("confidence"), F.map_from_arrays(names, "p").alias("posterior"))


def op7_language_id(spark, sf_dir):
    found = identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({"confidence": F.round("confidence", 6), "posterior": F.transform_values("posterior", lambda _, v: F.round(v, 6))})
