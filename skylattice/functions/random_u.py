"""Seeded uniforms that any SQL engine reproduces: the first 32 bits of an MD5 of a key and a salt."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column | str, salt: int | str) -> Column:
    """In [0, 1), independent for different salts."""
    text = F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def draw_without_replacement(key: Column | str, salt: str, values: list, weights: list[float] | None, size: Column) -> Column:
    """``size`` of the values, in order of draw: by exponential keys where weighted, by uniform keys otherwise."""
    keys = []
    for i, v in enumerate(values):
        u = uniform(key, f"{salt}{i}")
        keys.append(F.struct((u if weights is None else -F.log(1 - u) / F.lit(float(weights[i]))).alias("k"), F.lit(i).alias("i"), F.lit(v).alias("v")))
    return F.transform(F.slice(F.array_sort(F.array(*keys)), F.lit(1), size), lambda s: s["v"])
