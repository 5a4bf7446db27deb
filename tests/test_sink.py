from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexcheck.sources import files, sink, wordlists


def held(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file() and p.suffix != ".crc"}


def test_all_files_or_none(spark, tmp_path):
    target = tmp_path / "out"
    rows = spark.createDataFrame([(f"d{i % 3}/_f{i}.txt", f"text {i} é") for i in range(40)] + [("empty.txt", None)], "path string, content string").repartition(4)
    assert files.write_files(rows, str(target)) == 41
    want = {f"d{i % 3}/_f{i}.txt": f"text {i} é" for i in range(40)} | {"empty.txt": ""}
    assert held(target) == want
    # into a folder that exists: one file is replaced, one comes, the others stay
    more = spark.createDataFrame([("d0/_f0.txt", "new"), ("e/g.txt", "more")], "path string, content string")
    assert files.write_files(more, "file://" + str(target)) == 2
    assert held(target) == want | {"d0/_f0.txt": "new", "e/g.txt": "more"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


@pytest.mark.parametrize("there", [False, True])
def test_a_task_that_dies_half_way_leaves_the_target_as_it_was(spark, tmp_path, there):
    target = tmp_path / "out"
    if there:
        target.mkdir()
        (target / "f1.txt").write_text("old")
    before = held(target)
    rows = spark.range(30).repartition(3).select(F.format_string("f%d.txt", "id").alias("path"), F.when(F.col("id") < 29, "x").otherwise(F.raise_error(F.lit("dies"))).alias("content"))
    with pytest.raises(Exception, match="dies"):
        files.write_files(rows, str(target))
    assert held(target) == before and [p.name for p in tmp_path.iterdir() if p.name[0] != "."] == (["out"] if there else [])


def test_paths_that_lead_out_and_two_texts_of_one_path_are_refused(spark, tmp_path):
    for rows in ([("../a.txt", "x")], [("/a.txt", "x")], [("a.txt", "x"), ("a.txt", "y")]):
        with pytest.raises(Exception, match="not inside the folder|two texts"):
            files.write_files(spark.createDataFrame(rows, "path string, content string").coalesce(1), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    assert files.write_files(spark.createDataFrame([("a.txt", "x")] * 2, "path string, content string"), str(tmp_path / "out")) == 2
    assert held(tmp_path / "out") == {"a.txt": "x"}


def test_parts_of_lost_tasks_are_not_committed(tmp_path):
    writer = sink.FileWriter(str(tmp_path / "out"))
    (tmp_path / writer.staging.rsplit("/", 1)[1]).mkdir()
    (tmp_path / writer.staging.rsplit("/", 1)[1] / "x.txt.abc.part").write_text("half")
    writer.commit([])
    assert held(tmp_path) == {} and (tmp_path / "out").is_dir()


def test_a_list_is_the_old_or_the_new_one(spark, tmp_path, monkeypatch):
    words = spark.createDataFrame([("english", w) for w in ("b", "a", "b")], wordlists.SCHEMA)
    wordlists.store(words, str(tmp_path), "english")
    assert held(tmp_path)["english.txt"] == "a\nb\n"

    def broken(*_):
        raise OSError("full")

    monkeypatch.setattr(wordlists, "replace_file", broken)
    with pytest.raises(OSError):
        wordlists.store(words.limit(1), str(tmp_path), "english")
    assert held(tmp_path)["english.txt"] == "a\nb\n" and {p.name for p in tmp_path.iterdir()} <= {"english.txt", ".english.txt.crc"}
