from __future__ import annotations

import os
import pickle

import pytest

from lexcheck.sources import files, settings, tree
from lexcheck.sources.ignore import parse

CONFIG = settings.build(settings.DEFAULTS)
FIVE = {"a.rb": "one", "_form.rb": "two", "pkg/__init__.py": "three", "_drafts/b.rb": "four", "empty.rb": ""}


def plant(root, found):
    for path, text in found.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def paths(frame):
    return sorted(r["path"] for r in frame.select("path").collect())


def test_underscore_and_empty_files_count(spark, tmp_path):
    plant(tmp_path, FIVE)
    assert paths(files.file_list(spark, [], CONFIG, str(tmp_path))) == sorted(FIVE)
    assert {r["path"]: r["content"] for r in files.read_files(spark, [], CONFIG, str(tmp_path)).collect()} == FIVE
    assert paths(files.file_list(spark, ["_form.rb"], CONFIG, str(tmp_path))) == ["_form.rb"]
    assert paths(files.file_list(spark, ["_drafts", "pkg"], CONFIG, str(tmp_path))) == ["_drafts/b.rb", "pkg/__init__.py"]
    assert paths(files.file_list(spark, ["file://" + str(tmp_path / "_drafts")], CONFIG, str(tmp_path))) == ["_drafts/b.rb"]


class Counting(tree.Store):
    """Remembers which folders were listed and which files were read."""

    def __init__(self):
        super().__init__()
        self.folders, self.opened = [], []

    def listed(self, folder):
        self.folders.append(folder)
        return super().listed(folder)

    def read(self, path):
        self.opened.append(path)
        return super().read(path)


def reader(root, store, content=False, **options):
    import json

    walk = {"folder": str(root), "roots": [str(root)], "excludes": ["node_modules/", "*.png", "gen/x"], "selections": [], "suppress": False, "first": [], "content": content}
    return tree.TreeReader({"walk": json.dumps(walk), **{k: str(v) for k, v in options.items()}}, store)


MANY = {
    "node_modules/deep/er/a.rb": "x", "src/a.rb": "x", "src/.hidden/b.rb": "x", "src/b.png": "x", "gen/x/c.rb": "x", "gen/y/c.rb": "x", "old/d.rb": "x", "old/sub/e.rb": "x",
    "pics.png/f.rb": "x", ".gitignore": "old/\nlog\n", "src/.ignore": "!log\n", "src/log": "x", "gen/log": "x",
}


@pytest.mark.parametrize("folders", [1, 2, 4096])
def test_left_out_folders_are_never_listed(tmp_path, folders):
    plant(tmp_path, MANY)
    store = Counting()
    walk = reader(tmp_path, store, folders=folders)
    found = [row for part in walk.partitions() for batch in walk.read(part) for row in batch.to_pylist()]
    assert sorted(r["path"] for r in found) == ["gen/y/c.rb", "src/a.rb", "src/log"]
    assert sorted(os.path.relpath(f, tmp_path) for f in store.folders) == [".", "gen", "gen/y", "src"]  # each once
    assert sorted(os.path.relpath(f, tmp_path) for f in store.opened) == [".gitignore", "src/.ignore"]


def test_partitions_are_bounded_in_bytes_and_tasks_walk_the_rest(spark, tmp_path):
    plant(tmp_path, {f"d{i}/s{j}/f{k}.rb": "x" * 1000 for i in range(5) for j in range(3) for k in range(4)})
    whole = reader(tmp_path, tree.Store(), content=True, partitionbytes=10 * (tree.FILE_COST + 1000)).partitions()
    assert [len(p.files) for p in whole] == [10] * 6
    early = reader(tmp_path, tree.Store(), content=True, folders=8).partitions()
    assert sum(len(p.folders) for p in early) > 5 and pickle.loads(pickle.dumps(early)) == early
    frame = files.tree(spark, [], CONFIG, str(tmp_path), content=True, folders=8)
    assert frame.rdd.getNumPartitions() == len(early)
    assert frame.count() == 60 and frame.filter("length = 1000 and length(content) = 1000").count() == 60


def test_what_cannot_be_opened_is_named(spark, tmp_path):
    plant(tmp_path, {"a.rb": "x", "sub/b.rb": "y"})

    class Broken(tree.Store):
        def listed(self, folder):
            if folder.endswith("sub"):
                raise PermissionError("not yours")
            return super().listed(folder)

        def read(self, path):
            raise OSError("gone")

    walk = reader(tmp_path, Broken(), content=True)
    rows = {r["path"]: r for p in walk.partitions() for b in walk.read(p) for r in b.to_pylist()}
    assert rows["sub/"]["problem"] == "not yours" and rows["a.rb"]["problem"] == "gone" and rows["a.rb"]["content"] is None
    missing = tree.Walk(str(tmp_path)).start(tree.Store(), str(tmp_path / "nowhere"))
    assert missing[1][0].problem


def test_links_are_not_followed(spark, tmp_path):
    plant(tmp_path, {"sub/a.rb": "x"})
    (tmp_path / "sub" / "loop").symlink_to(tmp_path)
    (tmp_path / "link.rb").symlink_to(tmp_path / "sub" / "a.rb")
    assert paths(files.file_list(spark, [], CONFIG, str(tmp_path))) == ["sub/a.rb"]


def test_rules_hold_for_named_roots(spark, tmp_path):
    plant(tmp_path, {".gitignore": "*.log\nbuild/\n", "app/.gitignore": "!keep.log\n", "app/x/keep.log": "x", "app/x/y.log": "x", "build/z.rb": "x", "app/x/z.rb": "x"})
    assert paths(files.file_list(spark, ["app/x"], CONFIG, str(tmp_path))) == ["app/x/keep.log", "app/x/z.rb"]
    assert paths(files.file_list(spark, ["build"], CONFIG, str(tmp_path))) == []
    assert paths(files.file_list(spark, ["build"], CONFIG, str(tmp_path), suppress_file_rules=True)) == ["build/z.rb"]
    assert [r.ignores for r in parse("a\n!b\n")] == [True, False]
