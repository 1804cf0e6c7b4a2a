import html
import math
import random
import re
import time
import urllib.parse
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from skylattice.llm import language

WORDS = {"en": "the of and that with from this have which their".split(), "de": "der die und nicht mit eine auch wird werden über".split(), "fr": "les des une dans pour avec être était leurs où".split()}


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def page(text, declared=None):
    return f"<html{f' lang={chr(34)}{declared}{chr(34)}' if declared else ''}><head><script>the the the</script></head><body><!-- of and --><p>{text}</p></body></html>"


def frames(spark):
    r = random.Random(1)
    docs = [(i, x, prose(r, x, 60)) for i in range(90) for x in [list(WORDS)[i % 3]]] + [(900, None, "the der les")]
    pages = []
    for i in range(150):
        x = list(WORDS)[i % 3]
        pages.append((i, f"https://www.{x}-site.example.{ {'en': 'com', 'de': 'de', 'fr': 'fr'}[x] }/p{i}", page(prose(r, x, 30), x if i % 2 else None), x))
    pages += [(500, "http://www.de-site.example.de/x", page("", None), "de"), (501, None, page(prose(r, "fr", 30), "fr-CA"), "fr"), (502, "http://www.en-site.example.com/", None, "en"), (503, "http://www.en-site.example.com/", page(prose(r, "de", 40), "en"), "de"), (504, "", "", None), (0, "", page(prose(r, "en", 30)), "en")]
    truth = [(p[0], p[3]) for p in pages]
    return spark.createDataFrame([p[:3] + (1,) for p in pages], "page_id long, url string, html string, lang int"), spark.createDataFrame(docs, "doc_id long, lang string, text string"), truth


def test_fusion(spark):
    pages, docs, truth = frames(spark)
    got = language.identify(pages.repartition(3), docs).collect()
    assert len(got) == len(truth)
    by = {g.page_id: g for g in got if g.page_id}
    for i, x in truth:
        if i and x:
            assert by[i].lang == x, i
    assert by[500].text_lang is None and by[503].text_lang == "de" and by[501].declared == "fr" and by[501].host == ""
    for g in got:
        assert abs(sum(g.posterior.values()) - 1) < 1e-9 and g.confidence == max(g.posterior.values())


def test_posterior_by_hand(spark):
    """The posterior of one page against a plain computation from the text scores of all pages."""
    pages, docs, _ = frames(spark)
    got = [g for g in language.identify(pages, docs).collect()]
    langs, logs = language.text_model(docs)
    rows = []
    for p in pages.collect():
        x = language.trigrams(language.page_text(p.html))
        ll = np.zeros(3) if len(x) < 2 else logs[:, x].sum(axis=1)
        rows.append((ll - ll.max()) * min(1, language.TEXT_WEIGHT / max(1, len(x))) if len(x) >= 2 else ll)
    best = [int(x.argmax()) for x in rows]
    feats = {g.page_id: g for g in got}
    ps = pages.collect()
    k = next(i for i, p in enumerate(ps) if p.page_id == 503)
    n = len(langs)
    total = np.bincount(best, minlength=n).astype(float)
    flat = (total + 1) / (total.sum() + n)

    def votes(field):
        v = np.zeros(n)
        for i, p in enumerate(ps):
            if i != k and p.page_id and getattr(feats[p.page_id], field) == getattr(feats[503], field):
                v[best[i]] += 1
        return v

    d, h = votes("domain"), votes("host")
    domain = (d + 20 * flat) / (d.sum() + 20)
    prior = (h + 10 * domain) / (h.sum() + 10)
    logp = np.log(prior) + sum(np.log((votes(f) + flat) / (total + 1)) for f in ("declared", "suffix")) + rows[k]
    p = np.exp(logp - logp.max())
    p /= p.sum()
    assert np.allclose([feats[503].posterior[x] for x in langs], p, atol=1e-9)


def test_empty_tables(spark):
    pages, docs, _ = frames(spark)
    assert language.identify(pages.limit(0), docs).count() == 0
    assert {g.lang for g in language.identify(pages, docs.limit(0)).collect()} == {None}


def plain_posteriors(pages, docs, weight=40.0, buckets=1 << 13):
    """The module's text in plain Python: tags cut by a regular expression, trigrams of bytes in a dictionary, hashed as
    stated, votes counted by loops over all pages."""

    def buckets_of(text):
        data = f" {re.sub(r'[^a-zäöüßéèàêûç]+', ' ', text.lower())} ".encode()
        return Counter((int.from_bytes(data[i : i + 3], "big") * 2654435761 % 2**32) >> 19 for i in range(len(data) - 2))

    seen = defaultdict(Counter)
    for lang, text in docs:
        if lang is not None:
            seen[lang].update(buckets_of(text or ""))
    langs = sorted(seen)
    sums = {x: sum(c.values()) + buckets / 2 for x, c in seen.items()}
    rows = []
    for _, url, page in pages:
        text = html.unescape(re.sub(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<[^>]*>", " ", page or ""))
        found = buckets_of(text)
        n = sum(found.values())
        ll = [sum(k * math.log((seen[x][b] + 0.5) / sums[x]) for b, k in found.items()) for x in langs]
        ll = [(x - max(ll)) * min(1, weight / n) for x in ll] if n >= 2 else [0.0] * len(langs)
        host = (urllib.parse.urlsplit(url or "").hostname or "") if "://" in (url or "") else ""
        declared = re.search(r"(?i)<html[^>]*? lang=.([a-z]{2,3})\b", page or "")
        rows.append({"ll": ll, "best": ll.index(max(ll)), "host": host, "domain": ".".join(host.split(".")[-2:]) if "." in host else "", "suffix": host.rsplit(".", 1)[-1] if "." in host else "", "declared": declared[1].lower() if declared else ""})
    total = [sum(r["best"] == i for r in rows) for i in range(len(langs))]
    flat = [(x + 1) / (len(rows) + len(langs)) for x in total]
    for k, r in enumerate(rows):
        votes = {f: [sum(o["best"] == i and o[f] == r[f] for j, o in enumerate(rows) if j != k) for i in range(len(langs))] for f in ("host", "domain", "declared", "suffix")}
        logs = []
        for i in range(len(langs)):
            domain = (votes["domain"][i] + 20 * flat[i]) / (sum(votes["domain"]) + 20)
            host = (votes["host"][i] + 10 * domain) / (sum(votes["host"]) + 10)
            logs.append(r["ll"][i] + math.log(host) + sum(math.log((votes[f][i] + flat[i]) / (total[i] + 1)) for f in ("declared", "suffix")))
        top = [math.exp(x - max(logs)) for x in logs]
        yield dict(zip(langs, (x / sum(top) for x in top)))


def test_posteriors_of_all_pages_by_brute_force(spark):
    pages, docs, _ = frames(spark)
    rows = pages.select("page_id", "url", "html").collect()
    want = sorted((p.page_id, sorted((x, round(v, 7)) for x, v in post.items())) for p, post in zip(rows, plain_posteriors(rows, docs.select("lang", "text").collect())))
    for block in (language.LANG_BLOCK, 2, 1):
        got = language.identify(pages, docs, lang_block=block).collect()
        assert sorted((g.page_id, sorted((x, round(v, 7)) for x, v in g.posterior.items())) for g in got) == want


def test_tags_of_long_and_broken_pages():
    began = time.perf_counter()
    for part in ("<!--", "<script ", "<", "<style>", "</script  ", "<p>x"):
        language.page_text("a b " + part * 400_000)
    assert time.perf_counter() - began < 20
    assert language.page_text("a<b>c</b>d <!-- x > y --> e<STYLE>no</Style >f&amp;g < h").split() == ["a", "c", "d", "e", "f&g", "<", "h"]
    assert language.page_text("a <!-- open > b").split() == ["a"] and language.page_text("1 < 2") == "1 < 2"


def test_declared_language_of_long_markup(spark):
    """Unclosed and repeated tags are searched in linear time; the first tag decides."""
    pages = ["<html " * 350_000, "<html " * 350_000 + "lang=de", "x" * 100 + "<HTML class=a lang = 'FR-be'>", "<html><html lang=en>", "<html " + "lang " * 400_000, "<html lang" + " " * 2_000_000 + ">", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("http://a.b/")).coalesce(1).cache()
    rows.count()
    began = time.perf_counter()
    got = [r.declared for r in rows.select("page_id", language._features()["declared"].alias("declared")).orderBy("page_id").collect()]
    assert time.perf_counter() - began < 10
    assert got == ["", "de", "fr", "", "", "", ""]
