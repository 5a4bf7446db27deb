"""Files as a DataFrame (path, content), by a walk that never enters what is left out, and texts written back as files."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexcheck import storage
from lexcheck.shipping import ship
from lexcheck.sources import ignore, sink
from lexcheck.sources.settings import Settings
from lexcheck.sources.sink import FileSink
from lexcheck.sources.tree import FORMAT, TreeSource


def absolute(folder: str) -> str:
    return folder.rstrip("/") or "/" if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", folder) else os.path.abspath(folder)


def split_patterns(spark: SparkSession, patterns: list[str], folder: str) -> tuple[list[str], list[str]]:
    """Arguments that exist are roots, the others globs; without roots the folder is the root."""
    roots = [p for p in patterns if storage.exists(spark, storage.join(absolute(folder), p))]
    return (roots or ["."]), [p for p in patterns if p not in roots]


def distinct_roots(roots: list[str], folder: str) -> list[str]:
    """Roots as full paths, none inside another: every file is listed once."""
    full = sorted({os.path.normpath(r) if r.startswith("/") else r.rstrip("/") for r in (absolute(folder) if r == "." else storage.join(absolute(folder), r) for r in roots)})
    return [r for r in full if not any(r != other and r.startswith(other.rstrip("/") + "/") for other in full)]


def tree(spark: SparkSession, patterns: list[str], settings: Settings, folder: str = ".", suppress_file_rules: bool = False, content: bool = False, **options: int) -> DataFrame:
    """path (relative), length, content (if asked for) and problem of all files of a check, and of the folders and files that
    could not be opened. Hidden files never; excludes and ignore rules unless suppressed; given globs select; the
    settings' own ``includes`` select if there are any."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    roots, globs = split_patterns(spark, patterns, folder)
    walk = {
        "folder": absolute(folder),
        "roots": distinct_roots(roots, folder),
        "excludes": list(settings.excludes),
        "selections": [globs, list(settings.includes)],
        "suppress": suppress_file_rules,
        "first": [] if suppress_file_rules else [(r.pattern, r.ignores) for r in ignore.first_rules(spark, absolute(folder))],
        "content": content,
    }
    return spark.read.format(FORMAT).options(walk=json.dumps(walk), **options).load()


def file_list(spark: SparkSession, patterns: list[str], settings: Settings, folder: str = ".", suppress_file_rules: bool = False) -> DataFrame:
    """path, length of the files of a check; none is opened."""
    return tree(spark, patterns, settings, folder, suppress_file_rules).filter("problem is null").select("path", "length")


def read_files(spark: SparkSession, patterns: list[str], settings: Settings, folder: str = ".", suppress_file_rules: bool = False) -> DataFrame:
    """path, content. A line that is no UTF-8 is blanked, character by character, so that what follows it
    keeps its place. Files that cannot be read are left out; ``tree`` names them."""
    found = tree(spark, patterns, settings, folder, suppress_file_rules, content=True).filter("problem is null")
    raw = F.col("content").cast("string")
    blanked = F.transform(F.split(F.make_valid_utf8(raw), "\n", -1), lambda line: F.when(line.contains("\ufffd"), F.regexp_replace(line, ".", " ")).otherwise(line))
    return found.select("path", F.when(F.is_valid_utf8(raw), raw).otherwise(F.array_join(blanked, "\n")).alias("content"))


def first_line(content: Column) -> Column:
    """The first line without its line end; null if the text is empty."""
    line = F.regexp_replace(F.substring_index(content, "\n", 1), "\r$", "")
    return F.when(F.length(content) > 0, line)


def write_files(texts: DataFrame, folder: str, key: str = "path", content: str = "content") -> int:
    """One file per row of ``texts`` at its relative path under ``folder`` (on a cluster a shared one), all of them or none;
    returns how many. Files there of other names stay. Paths that lead out of the folder are refused."""
    spark = texts.sparkSession
    ship(spark)
    spark.dataSource.register(FileSink)
    storage.small_batches(spark)
    written = Observation()
    rows = texts.select(F.col(key).cast("string").alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    rows.observe(written, F.count(F.lit(1)).alias("n")).write.format(sink.FORMAT).mode("append").option("folder", absolute(folder)).save()
    return written.get["n"]
