"""A sink of plain files in a folder for each label, with a commit protocol."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


class LabelFolders(DataSource):
    """Rows (label, file, content, nth) as files path/label/file on a path that the driver and all executors share.

    Tasks write into a hidden folder of their attempt. Only when all have ended the driver moves what the attempts that
    count have written into place, those of the smallest ``nth`` first: of files of one name the one of the largest stays,
    of equal ones that of the later partition. When a job fails, its hidden folder goes and no file of a label has changed (a
    task that is still running then may leave its own hidden folder); files of earlier jobs are replaced by name."""

    @classmethod
    def name(cls) -> str:
        return "label_folders"

    def writer(self, schema, overwrite: bool):
        return _FolderWriter(self.options["path"].removeprefix("file://"))


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    partition: int


class _FolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.hidden = path, os.path.join(path, f".job-{uuid.uuid4().hex}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        folder = os.path.join(self.hidden, f"{partition}-{uuid.uuid4().hex}")
        for batch in batches:
            for row in batch.to_pylist():
                label, file = row["label"] or "", row["file"]
                if os.path.basename(file) != file or label in (".", "..") or os.sep in label or file.startswith("."):
                    raise ValueError(f"not a file of a folder: {label!r}, {file!r}")
                place = os.path.join(folder, f"{row['nth'] or 0:020d}", label)
                os.makedirs(place, exist_ok=True)
                with open(os.path.join(place, file), "wb") as f:
                    f.write(row["content"])
        return _Written(folder, partition)

    def commit(self, messages: list[_Written | None]) -> None:
        found = []
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            if os.path.isdir(m.folder):
                found += [(nth, m.partition, os.path.join(m.folder, nth)) for nth in os.listdir(m.folder)]
        for _, _, folder in sorted(found):
            for at, _, files in os.walk(folder):
                to = os.path.join(self.path, os.path.relpath(at, folder))
                os.makedirs(to, exist_ok=True)
                for file in files:
                    os.replace(os.path.join(at, file), os.path.join(to, file))
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


def write_label_folders(labelled: DataFrame, path: str) -> None:
    """Write rows (label, file, content) and, where there is one, ``nth``, by which the last of equal names stays."""
    labelled.sparkSession.dataSource.register(LabelFolders)
    nth = "nth" if "nth" in labelled.columns else "0L as nth"
    rows = labelled.selectExpr("label", "file", "content", f"cast({nth} as bigint) as nth" if nth == "nth" else nth)
    rows.write.format("label_folders").mode("append").save(path)
