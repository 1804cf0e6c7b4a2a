"""Table sources: Parquet with required columns, done-key lists, rows by index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.text import strip


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), "image_bytes", "caption").select("image_bytes", "caption")


def read_done_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct, stripped, non-blank lines of a text file; an absent file gives none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        return spark.createDataFrame([], "key string")
    return spark.read.text(path).select(strip("value").alias("key")).where("key <> ''").distinct()


def row_at(df: DataFrame, index: int, column: str = "row_idx") -> DataFrame:
    return df.where(F.col(column) == index)
