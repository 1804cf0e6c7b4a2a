"""Vectors as array columns."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGIT_SCALE = math.exp(math.log(1 / 0.07))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a, guarded: bool = True) -> Column:
    """Unit length. A zero vector stays zero if guarded, else becomes null elements."""
    by = lambda n: (lambda x: x / F.greatest(n, F.lit(1e-12))) if guarded else (lambda x: F.try_divide(x, n))
    # the norm as an element of an array is taken once for a vector, not for each of its components
    return F.transform(F.array(norm(a)), lambda n: F.transform(_c(a).cast("array<double>"), by(n)))[0]


def first_argmax(a) -> Column:
    """Index from 0 of the first maximum."""
    return F.array_position(_c(a), F.array_max(_c(a))).cast("int") - 1
