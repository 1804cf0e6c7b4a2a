"""Captions through an injected model: three prompts for each image, failures kept apart."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions import text
from skylattice.sources.tables import require_columns

# The default prompts, word for word.
PROMPTS = {
    "scene_caption": "Provide a single-line scene description of this image. Keep it concise, focused, and accurate.",
    "spatial_dense_caption": (
        "Provide a few detailed line (3-5) describing everything in this image. Dont write a prose or story just what you see, and how are they spaially aligned."
        "Emphasize spatial relationships and reasoning (e.g., 'above the big tree is a red house', 'to the left of the road')."
    ),
    "keywords": (
        "List all objects, entities, and visible concepts in this image as a comma-separated list. Do not list irrelevant items, like 'earth surface;, mention all objects, no made up stuff."
        "Each keyword or phrase should be 1 to 5 words long. Do not use brackets, bullet points, numbering, or introductory text. "
        "Return ONLY the comma-separated list."
    ),
}
RAW = "id string, scene_caption string, spatial_dense_caption string, keywords string, status string"


def caption(images: DataFrame, model: Callable[[], Callable[[bytes, str], str]], in_flight: int = 20, tasks: int = 4, prompts: dict[str, str] = PROMPTS) -> DataFrame:
    """id, the three answers and status for img_name and image_bytes. ``model()`` is called once for each task. An
    image for which any prompt fails has empty answers and the status ``failed: <error>``."""
    require_columns(images, "img_name", "image_bytes")
    each = max(1, in_flight // tasks)

    def ask(model_call, pool, content):
        jobs = [pool.submit(model_call, content, p) for p in prompts.values()]
        try:
            return [*(j.result() for j in jobs), "success"]
        except Exception as error:  # an outcome of the row
            return [*[""] * len(prompts), f"failed: {error}"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        call = model()
        with ThreadPoolExecutor(each) as rows, ThreadPoolExecutor(each * len(prompts)) as pool:
            for frame in frames:
                out = list(rows.map(lambda content: ask(call, pool, content), frame["image_bytes"]))
                yield pd.DataFrame([(i, *o) for i, o in zip(frame["img_name"].astype(str), out)], columns=["id", *prompts, "status"])

    raw = images.select(F.col("img_name").cast("string").alias("img_name"), "image_bytes").mapInPandas(run, RAW)
    return raw.withColumns({"scene_caption": text.strip("scene_caption"), "spatial_dense_caption": text.strip("spatial_dense_caption"), "keywords": text.clean_keywords("keywords")})


def successes(captions: DataFrame) -> DataFrame:
    return captions.where("status = 'success'").drop("status")


def failures(captions: DataFrame) -> DataFrame:
    return captions.where("status <> 'success'").select("id", "status")


def assemble(captions: DataFrame, images: DataFrame, policy: str = "scene") -> DataFrame:
    """The training input (image_bytes, caption): captions joined to images on the name, the caption chosen by
    ``policy``: scene, spatial, keywords or all (those that aren't empty, joined by a space)."""
    parts = {"scene": ["scene_caption"], "spatial": ["spatial_dense_caption"], "keywords": ["keywords"], "all": list(PROMPTS)}[policy]
    chosen = F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in parts))
    rows = captions.select(F.col("id").alias("img_name"), chosen.alias("caption")).where("caption <> ''")
    return images.select(F.col("img_name").cast("string").alias("img_name"), "image_bytes").join(rows, "img_name").select("img_name", "image_bytes", "caption")
