"""Symmetric contrastive cross-entropy within batches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.vector import LOGIT_SCALE, dot


def contrastive_loss(pairs: DataFrame, logit_scale: float = LOGIT_SCALE) -> DataFrame:
    """loss for each batch_id of rows (batch_id, i, image, text) with unit vectors; row i of either side belongs to row i of
    the other. A batch has a bounded number of rows, so its pairs have too. Logits are shifted by their maximum."""
    image = pairs.select("batch_id", "i", "image")
    text = pairs.select("batch_id", F.col("i").alias("j"), "text")
    logits = image.join(text, "batch_id").select("batch_id", "i", "j", (dot("image", "text") * logit_scale).alias("v"))

    def side(key: str):
        top = logits.groupBy("batch_id", key).agg(F.max("v").alias("top"), F.collect_list("v").alias("vs"), F.max(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("own"))
        lse = F.col("top") + F.log(F.aggregate(F.transform("vs", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, x: a + x))
        return top.groupBy("batch_id").agg(F.avg(lse - F.col("own")).alias(f"loss_{key}"))

    return side("i").join(side("j"), "batch_id").select("batch_id", ((F.col("loss_i") + F.col("loss_j")) / 2).alias("loss"))
