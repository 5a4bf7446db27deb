"""A file tree as a Spark data source: one walk that prunes, rules and files together.

The planner lists folders breadth first, several at a time, and reads the ignore files it meets. A folder that is hidden,
excluded or ignored is never listed. Found files become partitions of bounded bytes. After ``FOLDERS`` listed
folders the planner stops: each folder left becomes part of a partition that a task walks by the same
rules, so neither the driver's memory nor its time grows with the tree.

Rows: ``path`` (relative to the folder of the check), ``length``, ``content`` (null unless asked for) and ``problem`` (null, or why a
folder could not be listed or a file not be read). Names that begin with an underscore and empty files are
files like all others. Links are not followed.

Paths without a scheme and ``file:`` are this machine's (on a cluster a mount that all see); others are opened by
pyarrow's file systems.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexcheck.sources import ignore
from lexcheck.sources.globs import any_of, exclude_globs, glob_regex, python_regex

FORMAT = "lexcheck_tree"
SCHEMA = "path string, length long, content binary, problem string"
PARTITION_BYTES = 64 << 20
FILE_COST = 64 << 10  # opening a file counts as so many bytes
FOLDERS = 4_096
THREADS = 16
BATCH_BYTES = 8 << 20

Rules = list[ignore.Rule]


def plain(path: str) -> str:
    """A path without its scheme."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]+:/*(?=/)", "", path)


class Store:
    """Folders and files by full path."""

    def __init__(self) -> None:
        self._systems: dict[str, object] = {}

    def _local(self, path: str) -> str | None:
        return plain(path) if "://" not in path or path.startswith("file:") else None

    def _opened(self, path: str):
        from pyarrow import fs

        head = path.split("://", 1)[0]
        if head not in self._systems:
            self._systems[head] = fs.FileSystem.from_uri(path)[0]
        return self._systems[head], self._systems[head].normalize_path(path.split("://", 1)[1])

    def kind(self, path: str) -> tuple[bool, int] | None:
        """(is a folder, size); None if there is nothing, or neither a file nor a folder."""
        local = self._local(path)
        if local is not None:
            if os.path.isdir(local):
                return True, 0
            return (False, os.path.getsize(local)) if os.path.isfile(local) else None
        from pyarrow import fs

        system, at = self._opened(path)
        info = system.get_file_info(at)
        return None if info.type not in (fs.FileType.Directory, fs.FileType.File) else (info.type == fs.FileType.Directory, info.size or 0)

    def listed(self, folder: str) -> list[tuple[str, bool, int]]:
        """(name, is a folder, size) of what is in a folder, by name."""
        local = self._local(folder)
        if local is not None:
            with os.scandir(local or "/") as entries:
                found = [(e.name, e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False).st_size) for e in entries if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)]
            return sorted(found)
        from pyarrow import fs

        system, at = self._opened(folder)
        return sorted((i.base_name, i.type == fs.FileType.Directory, i.size or 0) for i in system.get_file_info(fs.FileSelector(at)) if i.type in (fs.FileType.Directory, fs.FileType.File))

    def read(self, path: str) -> bytes:
        local = self._local(path)
        if local is not None:
            with open(local, "rb") as f:
                return f.read()
        system, at = self._opened(path)
        with system.open_input_stream(at) as f:
            return f.read()


@dataclass
class Folder:
    """A folder still to be listed, with the rules that hold in it: of ``.gitignore`` and of ``.ignore`` files above it."""

    full: str
    rel: str  # relative to the check's folder, with its last slash; empty for that folder itself
    rules: dict[str, Rules] = field(default_factory=lambda: {n: [] for n in ignore.NAMES})


@dataclass
class File:
    full: str
    rel: str
    length: int
    problem: str | None = None


class Walk:
    """What is in and under the roots, by the rules of a check."""

    def __init__(self, folder: str, excludes: Iterable[str] = (), selections: Iterable[list[str]] = (), suppress: bool = False, first: Rules = ()) -> None:
        self.folder, self.suppress, self.first = folder.rstrip("/"), suppress, list(first)
        self.excluded = None if suppress else re.compile(python_regex(any_of([g for p in excludes for g in exclude_globs(p)])))
        self.selected = [re.compile(python_regex("|".join(glob_regex(g) for p in s for g in (p, f"**/{p}")))) for s in selections if s]

    def relative(self, full: str) -> str:
        inside = plain(self.folder).rstrip("/") + "/"
        path = plain(full)
        return path[len(inside) :] if path.startswith(inside) else "" if path + "/" == inside else path

    def left_out(self, rules: dict[str, Rules], rel: str, is_folder: bool) -> bool:
        """Whether hiding, an exclude or an ignore rule takes this file or folder out; those above it did not."""
        name = rel.rstrip("/").rsplit("/", 1)[-1]
        if name.startswith(".") and name not in (".", ".."):
            return True
        if self.suppress:
            return False
        if self.excluded.match(rel.rstrip("/")):
            return True
        known = self.first + [r for n in ignore.NAMES for r in rules[n]]
        return ignore.fits(known, rel.rstrip("/") + ("/" if is_folder else ""))

    def wanted(self, rel: str) -> bool:
        return all(s.match(rel) for s in self.selected)

    def enter(self, store: Store, at: Folder) -> tuple[list[Folder], list[File]]:
        """One folder: its subfolders to be listed, and its files; an error is a file row with a problem."""
        try:
            found = store.listed(at.full)
            rules = at.rules
            names = {n for n, is_folder, _ in found if not is_folder}
            for name in () if self.suppress else [n for n in ignore.NAMES if n in names]:
                text = store.read(f"{at.full.rstrip('/')}/{name}").decode("utf-8", "replace")
                rules = rules | {name: rules[name] + ignore.parse(text, at.rel)}
        except OSError as e:
            return [], [File(at.full, at.rel, 0, str(e))]
        folders, files = [], []
        for name, is_folder, size in found:
            full, rel = f"{at.full.rstrip('/')}/{name}", at.rel + name
            if self.left_out(rules, rel + ("/" if is_folder else ""), is_folder):
                continue
            if is_folder:
                folders.append(Folder(full, rel + "/", rules))
            elif self.wanted(rel):
                files.append(File(full, rel, size))
        return folders, files

    def start(self, store: Store, root: str) -> tuple[list[Folder], list[File]]:
        """A root with the rules of the folders between the check's folder and it."""
        kind = store.kind(root)
        rel = self.relative(root)
        if kind is None:
            return [], [File(root, rel, 0, "there is no such file or folder")]
        rules = Folder(root, rel).rules
        if not rel.startswith("/"):  # inside the check's folder
            parts = [p for p in rel.split("/") if p]
            for k in range(len(parts)):
                above = "".join(f"{p}/" for p in parts[:k])
                where = f"{self.folder}/{above}".rstrip("/") or "/"
                for name in () if self.suppress else ignore.NAMES:
                    if store.kind(f"{where}/{name}"):
                        rules = rules | {name: rules[name] + ignore.parse(store.read(f"{where}/{name}").decode("utf-8", "replace"), above)}
                if self.left_out(rules, f"{above}{parts[k]}", k + 1 < len(parts) or kind[0]):
                    return [], []
        if kind[0]:
            return [Folder(root, f"{rel.rstrip('/')}/" if rel else "", rules)], []
        return [], [File(root, rel, kind[1])] if self.wanted(rel) else []

    def under(self, store: Store, at: Folder) -> Iterator[File]:
        """All files under a folder; what is held grows with the tree's depth and width, not its size."""
        todo = [at]
        while todo:
            below, files = self.enter(store, todo.pop())
            todo += reversed(below)
            yield from files


@dataclass
class Part(InputPartition):
    files: list[File]
    folders: list[Folder]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], store: Store | None = None) -> None:
        given = json.loads(options["walk"])
        rules = [ignore.Rule(p, i) for p, i in given.pop("first")]
        self.roots, self.content = given.pop("roots"), given.pop("content")
        self.walk = Walk(**given, first=rules)
        self.store = store or Store()
        self.most_folders = int(options.get("folders", FOLDERS))
        self.most_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[Part]:
        todo: list[Folder] = []
        parts: list[Part] = [Part([], [])]
        size = 0

        def put(files: list[File]) -> None:
            nonlocal size
            for f in files:
                cost = FILE_COST + (f.length if self.content else 0)
                if parts[-1].files and size + cost > self.most_bytes:
                    parts.append(Part([], []))
                    size = 0
                parts[-1].files.append(f)
                size += cost

        for root in self.roots:
            folders, files = self.walk.start(self.store, root)
            todo += folders
            put(files)
        seen = 0
        with ThreadPoolExecutor(THREADS) as pool:
            while todo and seen < self.most_folders:
                now, todo = todo[: self.most_folders - seen], todo[self.most_folders - seen :]
                seen += len(now)
                for folders, files in pool.map(lambda at: self.walk.enter(self.store, at), now):
                    todo += folders
                    put(files)
        # the tree is larger than the planner cares to see: tasks walk the rest, neighbours dealt apart
        apart = min(len(todo), 1_024)
        parts += [Part([], todo[k::apart]) for k in range(apart)]
        return [p for p in parts if p.files or p.folders] or [Part([], [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for f in self._files(partition):
            content, problem = None, f.problem
            if self.content and problem is None:
                try:
                    content = self.store.read(f.full)
                except OSError as e:
                    problem = str(e)
            rows.append((f.rel, f.length, content, problem))
            size += 200 + len(content or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _files(self, partition: Part) -> Iterator[File]:
        yield from partition.files
        for folder in partition.folders:
            yield from self.walk.under(self.store, folder)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "length", "content", "problem"])


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
