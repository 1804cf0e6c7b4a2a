"""Sinks: images by label, HTML and CSV reports, progress."""

from __future__ import annotations

import html
import os
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from skylattice.functions.text import base_name, image_path, label_from_path
from skylattice.operators.tiles import keep_last

REPORT = ("Dataset", "Images", "Classes", "R@1", "R@5", "R@10", "MRR", "MAP")


def named_images(images: DataFrame, row: str = "row_idx") -> DataFrame:
    """Rows whose image struct<bytes, path> has bytes, with ``path``, made up from the row's number where it is missing."""
    return images.where("image.bytes is not null").withColumn("path", image_path("image.path", row))


def labelled_images(images: DataFrame, mode: str = "first") -> DataFrame:
    """Rows (label, file, content) of row_idx and image struct<bytes, path>; rows without bytes are left out, and of equal
    files the last stays."""
    named = named_images(images).select(label_from_path("path", mode).alias("label"), base_name("path").alias("file"), F.col("image.bytes").alias("content"), "row_idx")
    return keep_last(named, ["label", "file"], "row_idx").drop("row_idx")


def write_by_label(labelled: DataFrame, out: str) -> None:
    """Parquet partitioned by label, one folder per class."""
    labelled.write.mode("overwrite").partitionBy("label").parquet(out)


def write_files_by_label(labelled: DataFrame, out: str) -> None:
    """Plain files out/label/file on a path that all executors share; a repeated task replaces its own files."""

    def put(rows):
        for r in rows:
            folder = os.path.join(out, r.label)
            os.makedirs(folder, exist_ok=True)
            part = os.path.join(folder, f".{r.file}.part")
            with open(part, "wb") as f:
                f.write(r.content)
            os.replace(part, os.path.join(folder, r.file))

    labelled.foreachPartition(put)


def html_report(rows: list, checkpoint: str, benchmark: str) -> str:
    """The retrieval report from a handful of collected report rows, the Average row last; values are escaped."""
    e = lambda x: html.escape(str(x))
    cells = lambda r: "".join(f"<td>{e(x)}</td>" for x in r)
    body = "\n".join(f'<tr{" class=avg" if r[0] == "Average" else ""}>{cells(r)}</tr>' for r in rows)
    images = next((r[1] for r in rows if r[0] == "Average"), 0)
    title = os.path.splitext(os.path.basename(checkpoint))[0]
    sets, where = len(rows) - 1, os.path.basename(benchmark.rstrip("/"))
    facts = f"Model {e(os.path.basename(checkpoint))}, measured on {e(images)} images in {sets} sets of {e(where)}"
    style = "body{font-family:sans-serif;margin:2rem auto;max-width:70rem}td,th{padding:.4rem .8rem;text-align:left;border-bottom:1px solid #ddd}.avg td{font-weight:bold}"
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>Retrieval quality of {e(title)}</title><style>{style}</style></head><body><h1>How well images find their class</h1><p>{facts}</p><table><tr>{"".join(f"<th>{x}</th>" for x in REPORT)}</tr>\n{body}\n</table></body></html>'


def write_html_report(report: DataFrame, checkpoint: str, benchmark: str, path: str) -> None:
    rows = sorted((tuple(r) for r in report.select("dataset", "num_images", "num_classes", "`R@1`", "`R@5`", "`R@10`", "MRR", "MAP").collect()), key=lambda r: (r[0] == "Average", r[0]))
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(html_report(rows, checkpoint, benchmark))


def write_metrics_csv(epochs: DataFrame, path: str) -> None:
    """epoch, train_loss, val_loss; a missing loss is empty. A run has a row per epoch: one file."""
    text = epochs.select("epoch", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("train_loss", "val_loss")))
    text.orderBy("epoch").coalesce(1).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def fetch_counters() -> dict[str, Column]:
    return {"fetched": F.count_if(F.col("status") == "ok"), "missing": F.count_if(F.col("status") != "ok")}


def caption_counters() -> dict[str, Column]:
    return {"captioned": F.count_if(F.col("status") == "success"), "uncaptioned": F.count_if(F.col("status") != "success")}


def observed(outcomes: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Counters of fetched and missing rows that fill while another action runs."""
    seen = Observation(name)
    return outcomes.observe(seen, *(c.alias(n) for n, c in fetch_counters().items())), seen


class Progress(StreamingQueryListener):
    """Counters that fill while other actions run: those of batch tables when ``snapshot`` is taken, after their actions,
    and those of streams, once the object is added to ``spark.streams``, with each micro-batch."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.began, self.streamed, self.batches = clock, clock(), {}, []

    def watch(self, rows: DataFrame, name: str, counters: dict[str, Column]) -> DataFrame:
        columns = [c.alias(n) for n, c in counters.items()]
        if rows.isStreaming:
            return rows.observe(name, *columns)
        self.batches.append(Observation(name))
        return rows.observe(self.batches[-1], *columns)

    def snapshot(self) -> dict[str, float]:
        """Sums of all counters, and with ``_rate`` what each gains in a second. Waits for the actions of batch tables."""
        sums = dict(self.streamed)
        for seen in self.batches:
            for n, x in seen.get.items():
                sums[n] = sums.get(n, 0) + x
        seconds = self.clock() - self.began
        return sums | {f"{n}_rate": x / seconds if seconds > 0 else 0.0 for n, x in sums.items()}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for row in event.progress.observedMetrics.values():
            for n, x in row.asDict().items():
                self.streamed[n] = self.streamed.get(n, 0) + x

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_name(now: datetime, prefix: str = "CLIP") -> str:
    return now.strftime(f"{prefix}_%Y-%m-%d_%H:%M:%S")


