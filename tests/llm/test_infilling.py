import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skylattice.llm.infilling import restore, transform

TEXTS = [None, "", " ", "a", "ab cd", "ab<P>cd", "x<S>", "<M>", "é😀 zß\n\t\\n$1\\E|", "<" * 7 + "P>S", "< P><S <M", "one two  three\r\nfour", "日本語 text 123", "\x00a\x00"]


def brute(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", prefix, middle, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", prefix, middle, f"<P>{prefix}<S>{suffix}<M>{middle}"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_brute_force_and_back(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(400)] + [(None, "ab cd"), (None, None), (7, "same"), (7, "same")]
    got = transform(table(spark, rows)).withColumn("back", restore("output", "form")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.output) for r in got), key=key) == sorted(((i, *brute(i, t)) for i, t in rows), key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("text", ["long " * 200_000, "x" * 1_000_000, "é" * 300_000, "< " * 200_000])
def test_very_long_texts(spark, text):
    rows = [(i, text) for i in range(4)]
    got = transform(table(spark, rows)).withColumn("back", restore("output", "form")).select("doc_id", "n", "form", F.sha2("output", 256).alias("o"), (F.col("back") == F.col("text")).alias("same")).collect()
    for r in got:
        n, form, _, _, output = brute(r.doc_id, text)
        assert (r.n, r.form, r.o, r.same) == (n, form, hashlib.sha256(output.encode()).hexdigest(), True)


def test_shares_clashing_columns_and_empty_table(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("x").alias("output"), F.lit(1).alias("form"), F.lit("k").alias("kept"))
    got = transform(docs)
    assert got.columns.count("output") == 1 and got.columns.count("form") == 1 and got.first().kept == "k"
    shares = {r.form: r["count"] / 3000 for r in got.groupBy("form").count().collect()}
    assert abs(shares["plain"] - 0.1) < 0.02 and abs(shares["spm"] - 0.18) < 0.03
    assert transform(docs.limit(0)).count() == 0
    assert {r.form for r in transform(docs, transformed=0).select("form").distinct().collect()} == {"plain"}
