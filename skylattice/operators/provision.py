"""Training sets: exact splits, epoch order, batches, class codes, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.functions.random_u import uniform
from skylattice.storage import join_small, materialise

# Fixed values of the optimizer.
WARM_UP, DECAY = 2000, 100_000
NO_DECAY_NAMES = ("bn", "ln", "bias", "logit_scale")
#: Rows of a range that are ranked together, on average.
RANGE_ROWS = 1 << 17


def global_rank(df: DataFrame, order: Column, tie: str, n: int | None = None) -> DataFrame:
    """``df`` (n rows, counted if not given) with rn (from 1) in the order of a uniform in [0, 1), without sorting in one
    task: ranks inside equal ranges of the uniform, plus the sizes of the ranges before, a row for each range."""
    n = df.count() if n is None else n
    ranges = max(1024, -(-n // RANGE_ROWS))
    ranged = df.withColumn("__u", order).withColumn("__range", F.floor(F.col("__u") * ranges))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy("__u", tie))
    joined = ranged.join(F.broadcast(sizes) if ranges <= 100_000 else sizes, "__range")
    return joined.withColumn("rn", F.col("__before") + inside).drop("__u", "__range", "__before")


def ordered_rank(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with rn (from 1) in the order of columns: sorted by range, numbered inside partitions, plus the sizes of the
    partitions before. Ties have a rank each. The sorted rows are stored, so reruns of a task agree."""
    at = F.monotonically_increasing_id()  # partition in the high 31 bits, row in the low 33
    stored = materialise(df.orderBy(*order).withColumn("__at", at), "ordered").withColumn("__part", F.shiftright("__at", 33))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sizes = stored.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__at") - F.shiftleft("__part", 33)
    return join_small(stored, sizes, "__part").withColumn("rn", F.col("__before") + place + 1).drop("__at", "__part", "__before")


def exact_batches(df: DataFrame, key: str, batch_size: int, seed: str = "batches") -> DataFrame:
    """``df`` with batch_id: batches of exactly ``batch_size`` rows, the last one of the rest, in a random order that only
    depends on the keys."""
    return global_rank(df, uniform(key, seed), key).withColumn("batch_id", F.expr(f"(rn - 1) div {batch_size}")).drop("rn")


def train_val_split(df: DataFrame, key: str, fraction: float = 0.1, seed: str = "split") -> DataFrame:
    """``df`` with split: exactly int(n * fraction) rows are val."""
    n = df.count()
    n_val = int(n * fraction)
    return global_rank(df, uniform(key, seed), key, n).withColumn("split", F.when(F.col("rn") <= n_val, "val").otherwise("train")).drop("rn")


def epoch_batches(df: DataFrame, key: str, epoch: int, batch_size: int = 64, shuffle: bool = True, drop_last: bool = True, accumulate: int = 16, seed: str = "0") -> DataFrame:
    """``df`` with batch_id and step_id (batches accumulated in one optimizer step), in the order of the epoch."""
    n = df.count()
    ranked = global_rank(df, uniform(key, f"{seed}-epoch-{epoch}"), key, n) if shuffle else ordered_rank(df, key)
    out = ranked.withColumn("batch_id", F.floor((F.col("rn") - 1) / batch_size))
    if drop_last:
        out = out.where(F.col("batch_id") < n // batch_size)
    return out.withColumn("step_id", F.floor(F.col("batch_id") / accumulate)).drop("rn")


def class_codes(names: DataFrame, column: str) -> DataFrame:
    """Dense codes from 0 of the sorted class names, one row per class; empty classes count if they are listed."""
    return names.select(column).distinct().withColumn("code", (F.row_number().over(W.orderBy(column)) - 1).cast("int"))


def lr_factor(step) -> Column:
    """Linear warm-up, then linear decay to zero."""
    s = (F.col(step) if isinstance(step, str) else step).cast("double")
    return F.when(s < WARM_UP, s / WARM_UP).otherwise(F.greatest(F.lit(0.0), 1 - (s - WARM_UP) / DECAY))


def weight_decay(name, ndim, decay: float = 0.1) -> Column:
    """0 for vectors and for parameters with a name of normalisation, bias or scale, else ``decay``."""
    n = F.col(name) if isinstance(name, str) else name
    exempt = F.col(ndim) < 2 if isinstance(ndim, str) else ndim < 2
    for part in NO_DECAY_NAMES:
        exempt = exempt | n.contains(part)
    return F.when(exempt, 0.0).otherwise(float(decay))


def epoch_means(losses: DataFrame) -> DataFrame:
    """epoch, train_loss, val_loss from step losses (epoch, split, loss)."""
    mean = lambda s: F.avg(F.when(F.col("split") == s, F.col("loss"))).alias(f"{s}_loss")
    return losses.groupBy("epoch").agg(mean("train"), mean("val"))
