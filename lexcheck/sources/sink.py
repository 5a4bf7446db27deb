"""Texts written as files under a folder, all of them or none: a Spark data sink with a commit.

Tasks write whole files into a staging folder beside the target, under their own paths. Nothing in the target changes before every
task is done; then the commit renames the staging folder to the target, or, where the target exists, moves the staged files
into it. A failed job removes the staging folder and leaves the target as it was
(a task that is still being stopped then may leave hidden files beside it). A task that runs again, or twice at a
time, writes the same files again. Two rows with one path and different texts are an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "lexcheck_files"
THREADS = 16


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's place in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.rstrip("/"))


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceArrowWriter):
    """Rows ``path, content``."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        head, _, name = self.folder.rpartition("/")
        self.staging = f"{head}/.{name}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.staging)
        known: set[str] = set()
        n = 0
        for batch in iterator:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if path is None or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} is not inside the folder")
                self._put(system, f"{root}/{path}", (text.as_py() or "").encode(), known)
                n += 1
        return Written(n)

    @staticmethod
    def _put(system: fs.FileSystem, path: str, data: bytes, known: set[str]) -> None:
        parent = path.rsplit("/", 1)[0]
        if parent not in known:
            system.create_dir(parent, recursive=True)
            known.add(parent)
        if system.get_file_info(path).type == fs.FileType.File:
            with system.open_input_stream(path) as there:
                if there.read() != data:
                    raise ValueError(f"two texts for {path}")
            return
        part = f"{path}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as out:
            out.write(data)
        system.move(part, path)

    def commit(self, messages: list[Written | None]) -> None:
        """Runs on the driver when all tasks are done. Parts that a lost task left behind are not moved."""
        system, staged = opened(self.staging)
        _, target = opened(self.folder)
        if system.get_file_info(staged).type == fs.FileType.NotFound:
            return
        found = system.get_file_info(fs.FileSelector(staged, recursive=True))
        parts = [i.path for i in found if i.type == fs.FileType.File and i.path.endswith(".part")]
        for path in parts:
            system.delete_file(path)
        if system.get_file_info(target).type == fs.FileType.NotFound:
            system.move(staged, target)
            return
        paths = [i.path[len(staged) + 1 :] for i in found if i.type == fs.FileType.File and not i.path.endswith(".part")]
        for folder in sorted({f"{target}/{p}".rsplit("/", 1)[0] for p in paths}):
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda p: system.move(f"{staged}/{p}", f"{target}/{p}"), paths))
        system.delete_dir(staged)

    def abort(self, messages: list[Written | None]) -> None:
        system, staged = opened(self.staging)
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["folder"])
