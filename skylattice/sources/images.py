"""Image folders as tables: root/dataset/class/file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.text import base_name, suffix

# The suffixes that count as images.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff")


def is_image(path) -> Column:
    return suffix(path).isin(*SUFFIXES)


def read_image_folder(spark: SparkSession, root: str) -> DataFrame:
    """Rows (dataset, class, file, path, content) of images exactly two folders below the root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rest = F.split(F.regexp_replace("path", f"^.*?{_quoted(plain)}/", ""), "/")
    rows = raw.select("path", "content", rest.alias("rest")).where((F.size("rest") == 3) & is_image("path"))
    return rows.select(F.col("rest")[0].alias("dataset"), F.col("rest")[1].alias("class"), base_name("path").alias("file"), "path", "content")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def list_classes(spark: SparkSession, root: str) -> DataFrame:
    """Rows (dataset, class) of all class folders, empty ones included, from the file system's listing."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    folders = lambda p: sorted((s.getPath() for s in fs.listStatus(p) if s.isDirectory()), key=lambda x: x.getName())
    datasets = folders(top)
    if not datasets:
        raise ValueError(f"no data set below {root}")
    return spark.createDataFrame([(d.getName(), c.getName()) for d in datasets for c in folders(d)], "dataset string, class string")


def decode(spark: SparkSession, paths: str, drop_invalid: bool = False) -> DataFrame:
    """Images by Spark's own reader (BGR bytes; a height of -1 where decoding failed, unless dropped)."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(paths).select("image.*")


def black_if_invalid(images: DataFrame, size: int = 224) -> DataFrame:
    """Undecodable images become black ones of ``size`` squared, which stay in the metrics."""
    bad = F.col("height") <= 0
    black = F.unhex(F.repeat(F.lit("00"), 3 * size * size))
    return images.select("origin", F.when(bad, size).otherwise(F.col("height")).alias("height"), F.when(bad, size).otherwise(F.col("width")).alias("width"), F.when(bad, 3).otherwise(F.col("nChannels")).alias("nChannels"), F.when(bad, black).otherwise(F.col("data")).alias("data"))
