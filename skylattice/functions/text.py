"""Text and path expressions of the captioning and labelling steps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# blanks at the end are tried from the first of a run only, which keeps the search linear
_BLANKS = r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text) -> Column:
    """Without blanks at the ends, Unicode ones included (``trim`` knows the space only)."""
    return F.regexp_replace(_c(text), _BLANKS, "")


def keyword_list(raw) -> Column:
    """Keywords of a comma-separated text: brackets and quotes deleted, stripped, empty ones dropped, the first spelling
    of each kept. Null gives an empty array."""
    parts = F.split(F.coalesce(_c(raw), F.lit("")), ",", -1)
    items = F.filter(F.transform(parts, lambda s: strip(F.regexp_replace(s, r"[\[\]()\"']", ""))), lambda s: s != "")
    # sorted by spelling in lower case and place, the first of each spelling follows another one
    spelled = F.array_sort(F.transform(items, lambda s, k: F.struct(F.lower(s).alias("low"), k.alias("at"), s.alias("word"))))

    def firsts(a: Column) -> Column:
        lows = F.transform(a, lambda x: x["low"])
        pairs = F.arrays_zip(a.alias("x"), F.concat(F.array(F.lit(None).cast("string")), lows).alias("before"))
        new = F.filter(pairs, lambda p: F.isnotnull(p["x"]) & ~p["x"]["low"].eqNullSafe(p["before"]))
        return F.transform(F.array_sort(F.transform(new, lambda p: F.struct(p["x"]["at"].alias("at"), p["x"]["word"].alias("word")))), lambda x: x["word"])

    return F.transform(F.array(spelled), firsts)[0]  # a one-element array binds the sorted words once


def clean_keywords(raw) -> Column:
    return F.array_join(keyword_list(raw), ", ")


def base_name(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+)/*$", 1)


def stem(path) -> Column:
    """The name without its last suffix; a leading dot isn't a suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path) -> Column:
    """Lower-cased last suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1))


def label_from_path(path, mode: str = "first") -> Column:
    """Class label in a file name: what is before the first underscore (``mode="last"``: before the last), else before
    the first hyphen, else the stem."""
    name = base_name(path)
    cut = F.substring_index(name, "_", 1) if mode == "first" else F.regexp_replace(name, r"_[^_]*$", "")
    return F.when(F.contains(name, F.lit("_")), cut).when(F.contains(name, F.lit("-")), F.substring_index(name, "-", 1)).otherwise(stem(path))


def image_path(path, row) -> Column:
    """The path, or a name made of the row number where there is none."""
    return F.coalesce(_c(path), F.concat(F.lit("image_"), _c(row).cast("string"), F.lit(".jpg")))


def caption_text(caption, compat: bool = False) -> Column:
    """The caption as a string; in compat mode null becomes the word None."""
    text = _c(caption).cast("string")
    return F.coalesce(text, F.lit("None")) if compat else text


def fixed4(x) -> Column:
    return F.format_string("%.4f", _c(x))
