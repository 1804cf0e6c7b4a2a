"""From a folder of labelled images and a model to the report of retrieval quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import models, retrieval
from skylattice.sources.images import list_classes, read_image_folder
from skylattice.sources.writers import write_html_report
from skylattice.storage import join_small, materialise


def image_embeddings(spark: SparkSession, root: str, encoder: Callable, transform: Callable | None = None, size: int = 224, batch_size: int = 64) -> DataFrame:
    """Rows (dataset, id, label, vec) of the images root/dataset/class/file. Ids follow data set, class and file; a label
    is the place of the class among those of its data set, empty ones included. Undecodable images stay, as black ones."""
    files = read_image_folder(spark, root)
    order = ["dataset", "class", "file"]
    ids = materialise(files.select(*order).orderBy(*order).withColumn("id", F.monotonically_increasing_id()), "image-ids")
    listed = list_classes(spark, root).groupBy("dataset").agg(F.sort_array(F.collect_list("class")).alias("classes"))  # names of folders
    label = (F.array_position("classes", F.col("class")) - 1).cast("int").alias("label")
    rows = join_small(files.join(ids, order), listed, "dataset").select("dataset", "id", label, "content")
    return models.image_vectors(rows, "content", "id", encoder, transform, size=size, batch_size=batch_size)


def evaluate(spark: SparkSession, root: str, encoder: Callable, transform: Callable | None = None, size: int = 224, batch_size: int = 64, include_self: bool = True) -> DataFrame:
    """A row for each data set that has images: dataset, num_images, num_classes (folders, empty ones included), R@k, MRR
    and MAP."""
    emb = materialise(image_embeddings(spark, root, encoder, transform, size, batch_size), "image-vectors")
    return set_quality(emb, list_classes(spark, root), include_self)


def set_quality(emb: DataFrame, classes: DataFrame, include_self: bool = True) -> DataFrame:
    """Quality by data set of embeddings (dataset, id, label, vec), with the number of classes (dataset, class) that are
    listed for it, with images or without. Data sets without images have no row."""
    quality = retrieval.summarise(retrieval.per_query(emb, include_self), ["dataset"])
    counts = classes.groupBy("dataset").agg(F.countDistinct("class").alias("num_classes"))
    return quality.join(counts, "dataset", "left").withColumn("num_classes", F.coalesce("num_classes", F.lit(0)))


def evaluate_to_html(spark: SparkSession, root: str, encoder: Callable, checkpoint: str, path: str, **options) -> DataFrame:
    """The report's rows, which are also written as a page. ``encoder`` is usually the ``LazyModel`` of the checkpoint."""
    report = materialise(retrieval.report_rows(evaluate(spark, root, encoder, **options)), "report")
    write_html_report(report, checkpoint, root, path)
    return report
