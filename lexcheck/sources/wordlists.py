"""Dictionaries: text files of one word a line, or tables, as DataFrames (name, word)."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.functions.text import normalise, normalise_text
from lexcheck.sources.settings import Language
from lexcheck.storage import children, exists, file_system, hadoop_path, join, replace_file

SCHEMA = "name string, word string"


def parse(lines: DataFrame) -> DataFrame:
    """``(name, word)`` lines to a word list: blank lines dropped, distinct, words verbatim."""
    return lines.filter(F.trim("word") != "").select("name", "word").distinct()


def read(spark: SparkSession, folder: str, name: str, file: str | None = None) -> DataFrame:
    """``<folder>/<name>.txt``; a missing file is an empty list."""
    path = join(folder, file or f"{name}.txt")
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return parse(spark.read.text(path).select(F.lit(name).alias("name"), F.col("value").alias("word")))


def bundled_folder() -> str:
    """Where the package's own lists lie; there need not be any."""
    return os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "wordlists")


def paths_for(spark: SparkSession, language: Language, bundled: str | None, project: str | None) -> list[str]:
    """Existing word list files of a language: its own, one per locale, the project's."""
    bundled = bundled or bundled_folder()
    places = [join(bundled, f"{language.name}.txt"), *(join(bundled, f"{language.name}/{x}.txt") for x in language.locales)]
    if project:
        places += [join(project, f"{language.name}.txt")]
    return [p for p in places if exists(spark, p)]


def bundled_list(spark: SparkSession, name: str, locale: str | None = None, bundled: str | None = None) -> DataFrame | None:
    """A language's list, or that of one locale; None if there is none."""
    path = join(bundled or bundled_folder(), f"{name}/{locale}.txt" if locale else f"{name}.txt")
    return parse(spark.read.text(path).select(F.lit(name).alias("name"), F.col("value").alias("word"))) if exists(spark, path) else None


def of_languages(spark: SparkSession, languages: list[Language], bundled: str | None = None, project: str | None = None) -> DataFrame:
    """(name, word) of all languages; lists that several languages name are read once each."""
    out = spark.createDataFrame([], SCHEMA)
    for language in languages:
        files = paths_for(spark, language, bundled, project)
        if files:
            out = out.unionByName(spark.read.text(files).select(F.lit(language.name).alias("name"), F.col("value").alias("word")))
    return parse(out)


@dataclass
class Wordlist:
    """A handle on one list: its words are read when they are first asked for and kept until cleared."""

    spark: SparkSession
    folder: str
    name: str
    _words: DataFrame | None = None

    def exists(self) -> bool:
        return exists(self.spark, join(self.folder, f"{self.name}.txt"))

    def words(self) -> DataFrame:
        """The distinct words; none of a list that does not exist."""
        if self._words is None:
            self._words = read(self.spark, self.folder, self.name).persist()
        return self._words

    def contains(self, term: str) -> bool:
        return not self.words().filter(F.col("word") == normalise_text(term)).isEmpty()

    def count(self) -> int:
        return self.words().count()

    def is_empty(self) -> bool:
        return self.words().isEmpty()

    def add(self, term: str) -> None:
        """Writes the list with the normalised word, sorted."""
        added = push(self.words(), self.spark.createDataFrame([(self.name, term)], SCHEMA))
        store(added, self.folder, self.name)
        self.clear_cache()

    def clear_cache(self) -> None:
        if self._words is not None:
            self._words.unpersist()
            self._words = None


def merge(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("name", "word")
    for other in lists[1:]:
        out = out.unionByName(other.select("name", "word"))
    return parse(out)


def push(words: DataFrame, added: DataFrame) -> DataFrame:
    """The list with normalised new words, distinct; order it by word to write it."""
    return merge(words, added.select("name", normalise(F.col("word")).alias("word")))


def contains(words: DataFrame, terms: DataFrame, column: str = "word") -> DataFrame:
    """The rows of ``terms`` whose normalised ``column`` is in the list (semi join)."""
    known = words.select(F.col("word").alias("_known")).distinct()
    return terms.join(known, normalise(terms[column]) == F.col("_known"), "left_semi")


def store(words: DataFrame, folder: str, name: str) -> None:
    """The words as ``<folder>/<name>.txt``: written beside it, then put in its place in one step, so the list is at every
    moment the old or the new one."""
    spark = words.sparkSession
    beside, target = join(folder, f"{name}.{uuid.uuid4().hex}"), join(folder, f"{name}.txt")
    where = hadoop_path(spark, beside)
    try:
        write(words, beside)
        part = next(n for n, _ in children(spark, beside) if n.startswith("part-"))
        replace_file(spark, f"{beside}/{part}", target)
    finally:
        file_system(spark, where).delete(where, True)


def write(words: DataFrame, folder: str) -> None:
    """One sorted text file of words, in a new folder."""
    words.select("word").distinct().orderBy("word").coalesce(1).write.text(folder)
