"""One file for each row: a Python data source whose tasks commit what they wrote, or leave nothing.

A task writes its files into a folder of its own below the job's staging folder, which lies beside the target, lists them
there and moves them to their places at its end. A task that fails deletes what it staged; its successor replaces what the
list of its partition names. The driver's commit adds up the tasks' messages and removes the staging folder. Its abort leaves
a mark, deletes the tasks' folders and then all that the lists name. A task that still runs then has nothing left to move,
one that starts later finds the mark after it made its folder; so a task may be killed at any time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cadenza.session import spread

#: Files of a task, and files that a task asks the store about at a time.
TASK_FILES, ASKED = 1 << 14, 1 << 10


@dataclass
class Wrote(WriterCommitMessage):
    written: int
    reused: int
    bytes: int


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the folder's path in it."""
    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(content)


def _drop(store: fs.FileSystem, path: str, times: int = 50) -> None:
    """Delete a folder; one into which a task still writes takes several goes."""
    while store.get_file_info(path).type == fs.FileType.Directory:
        try:
            store.delete_dir(path)
        except OSError:
            times -= 1
            if not times:
                raise


def _listed(store: fs.FileSystem, path: str) -> set[str]:
    if store.get_file_info(path).type != fs.FileType.File:
        return set()
    with store.open_input_stream(path) as f:
        return set(json.loads(f.read()))


def _take_away(store: fs.FileSystem, files: Iterable[str]) -> None:
    for f in files:
        if store.get_file_info(f).type == fs.FileType.File:
            store.delete_file(f)


class FileWriter(DataSourceWriter):
    def __init__(self, root: str, job: str, replace: bool):
        self.root, self.job, self.replace = root, job, replace

    def _there(self, store: fs.FileSystem, targets: list[str], mine: set[str]) -> list[bool]:
        """Which of the targets are there and not of this partition's making."""
        if self.replace:
            return [False] * len(targets)
        return [i.type == fs.FileType.File and t not in mine for t, i in zip(targets, store.get_file_info(targets))]

    def _go_on(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}-counts/{self.job}.aborted").type == fs.FileType.File:
            raise RuntimeError("the write was aborted")

    def write(self, iterator: Iterator) -> Wrote:
        store, root = opened(self.root)
        part = f"{root}-staging/{self.job}/{TaskContext.get().partitionId()}"
        mine, attempt = _listed(store, f"{part}.list"), f"{part}-{uuid.uuid4().hex}"
        staged, reused, size = [], 0, 0
        try:
            store.create_dir(attempt, recursive=True)
            self._go_on(store, root)
            while rows := list(islice(iterator, ASKED)):
                targets = [f"{root}/{row['rel_path']}" for row in rows]
                for row, target, there in zip(rows, targets, self._there(store, targets, mine)):
                    if there:
                        reused += 1
                        continue
                    content = row["content"]
                    content = content.encode() if isinstance(content, str) else bytes(content or b"")
                    with store.open_output_stream(f"{attempt}/{len(staged)}") as f:
                        f.write(content)
                    staged.append(target)
                    size += len(content)
            if staged:
                with store.open_output_stream(f"{part}.list") as f:
                    f.write(json.dumps(sorted(mine.union(staged))).encode())
            for folder in {t.rsplit("/", 1)[0] for t in staged}:
                store.create_dir(folder, recursive=True)
            for i, target in enumerate(staged):
                store.move(f"{attempt}/{i}", target)
            self._go_on(store, root)
        finally:
            _drop(store, attempt)
        return Wrote(len(staged), reused, size)

    def commit(self, messages: list[Wrote | None]) -> None:
        store, root = opened(self.root)
        done = [m for m in messages if m is not None]
        total = {"written": sum(m.written for m in done), "reused": sum(m.reused for m in done), "bytes": sum(m.bytes for m in done)}
        _put(store, f"{root}-counts/{self.job}.json", json.dumps(total).encode())
        _drop(store, f"{root}-staging/{self.job}")

    def abort(self, messages: list[Wrote | None]) -> None:
        store, root = opened(self.root)
        staging = f"{root}-staging/{self.job}"
        _put(store, f"{root}-counts/{self.job}.aborted", b"")
        inside = lambda: store.get_file_info(fs.FileSelector(staging, allow_not_found=True))
        for info in inside():
            if info.type == fs.FileType.Directory:
                _drop(store, info.path)
        for info in inside():  # no task moves a file any more
            if info.path.endswith(".list"):
                _take_away(store, _listed(store, info.path))
        _drop(store, staging)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one-file-per-row"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"].rstrip("/"), self.options["job"], self.options["replace"] == "true")


def write_files(df: DataFrame, path: str, replace: bool = False) -> dict:
    """SNK-05: ``df`` (rel_path, content as text or bytes) as one file each below ``path``; how many were written and reused, and their bytes.

    ``df``'s tasks write; ``by_files`` deals it over as many as the files ask for.

    Files that are there already are reused unless ``replace``. A failed write leaves none of its own files; those
    that it replaced are lost. Of rows with one path the last stays.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(FileSink)
    rows = df.select("rel_path", "content")
    rows.write.format(FileSink.name()).option("path", path).option("job", job).option("replace", str(replace).lower()).mode("append").save()
    return spark.read.schema("written long, reused long, bytes long").json(f"{path}-counts/{job}.json").first().asDict()


def by_files(df: DataFrame) -> DataFrame:
    """``df`` (rel_path and more) by path over tasks of about TASK_FILES files, at least one for each core: rows of a few bytes lie in a task or two otherwise."""
    return spread(df, TASK_FILES, "rel_path")


def read_files(df: DataFrame, path: str) -> DataFrame:
    """(rel_path, content) of the files below ``path`` that ``df`` (rel_path) names and that are there.

    Each task opens the files of its rows; no folder is listed, so none needs to fit into the driver or into one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path.rstrip("/"))
        for b in batches:
            names, found = [], []
            for name in b.column(0).to_pylist():
                try:
                    with store.open_input_stream(f"{root}/{name}") as f:
                        found.append(f.read())
                except FileNotFoundError:
                    continue
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], names=["rel_path", "content"])

    return df.select("rel_path").mapInArrow(run, "rel_path string, content binary")
