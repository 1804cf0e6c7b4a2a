"""Fill-in-middle transformation, with DataFrame functions only.

A text is cut into units: runs of ASCII letters, and every other code point by itself. Two cuts, taken from a SHA-256 of
the document's id, make a prefix, a middle and a suffix. The output puts the middle last, behind sentinels: prefix,
suffix, middle (``psm``) or suffix, prefix, middle (``spm``). Some documents stay as they are (``plain``): a share drawn
from the same hash, empty texts, and texts that contain a sentinel, which could not be told apart from the inserted ones.
``restore`` parses the sentinels and puts the parts back in order.

A null text counts as empty, a null id is hashed as an empty one. Repeated rows give equal outputs. Texts of any length
are cut as a whole. Extra columns are kept, but for columns of the names that are added, which are replaced; an empty
table gives no rows. Every row is transformed by itself, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Of 100 documents, those that are transformed; of 100 of these, those whose suffix comes first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SALT = "1:"


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits (from 0) as an unsigned number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, salt: str = SALT) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    has_sentinel = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | has_sentinel | (_draw(digest, 2) % 100 >= transformed), "plain").when(_draw(digest, 3) % 100 < suffix_first, "spm").otherwise("psm")

    def parts(of: Column) -> Column:
        n = F.size(of)
        cuts = [_draw(digest, k) % (n + 1) for k in (0, 1)]
        first, second = F.least(*cuts).cast("int"), F.greatest(*cuts).cast("int")
        piece = lambda after, until: F.array_join(F.slice(of, after + 1, until - after), "")
        return F.struct(n.cast("long").alias("n"), piece(F.lit(0), first).alias("prefix"), piece(first, second).alias("middle"), piece(second, n).alias("suffix"))

    cut = F.transform(F.array(units), parts)[0]  # a one-element array binds the units once
    rows = docs.withColumns({"__cut": cut, "form": form})
    piece = {c: F.when(F.col("form") != "plain", F.col(f"__cut.{c}")) for c in ("prefix", "middle", "suffix")}
    rows = rows.withColumns({"n": F.col("__cut.n")} | piece).drop("__cut")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text))


def restore(output: Column | str, form: Column | str) -> Column:
    """The text that an output of a form was made of: its parts, as found between the sentinels, in their first order."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))

    def parsed(first: str, second: str) -> tuple[Column, Column, Column]:
        """``first`` a ``second`` b ``MIDDLE`` c: the parts a, b, c."""
        head, tail = F.substring_index(output, second, 1), F.substring_index(output, second, -1)
        return F.substr(head, F.lit(len(first) + 1)), F.substring_index(tail, MIDDLE, 1), F.substring_index(tail, MIDDLE, -1)

    (p, s, m), (s2, p2, m2) = parsed(PREFIX, SUFFIX), parsed(SUFFIX, PREFIX)
    psm, spm = F.concat(p, m, s), F.concat(p2, m2, s2)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir):
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    chars = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    digests = [F.sha2(x, 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (restore("output", "form"), "restored_sha256"))]
    return made.select("doc_id", "n", "form", *chars, *digests)


ORACLE_SQL = {
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT FOR k IN range(4)] AS h FROM d),
c AS (SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(units[1 : a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle, array_to_string(units[b + 1 : n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p"""
}
