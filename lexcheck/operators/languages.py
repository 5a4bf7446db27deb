"""Which languages a file is checked in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcheck.sources.globs import any_of, include_globs
from lexcheck.sources.settings import Language


def matches(language: Language, path: Column, first_line: Column) -> Column:
    """No includes and no hashbangs: every file. Else an include fits the path or the bare file name, or
    the first line starts with ``#!`` and contains a hashbang."""
    if not language.includes and not language.hashbangs:
        return F.lit(True)
    out = F.lit(False)
    if language.includes:
        pattern = any_of([g for p in language.includes for g in include_globs(p)])
        out = out | path.rlike(pattern) | F.element_at(F.split(path, "/"), -1).rlike(pattern)
    if language.hashbangs:
        line = F.coalesce(first_line, F.lit(""))
        named = F.lit(False)
        for h in language.hashbangs:
            named = named | line.contains(h)
        out = out | (line.startswith("#!") & named)
    return out


def languages_of(files: DataFrame, languages: list[Language], path: str = "path", first_line: str = "first_line") -> DataFrame:
    """Adds ``languages``: the names in order. A handful of languages is one array expression, no join."""
    names = [F.when(matches(x, F.col(path), F.col(first_line)), F.lit(x.name)) for x in languages]
    return files.withColumn("languages", F.array_compact(F.array(*names)))


def addable_of(files: DataFrame, languages: list[Language], path: str = "path", first_line: str = "first_line") -> DataFrame:
    """Adds ``addable``: (key, name) of the matching languages that words may be added to."""
    kind = "struct<key:string,name:string>"
    pairs = [F.when(matches(x, F.col(path), F.col(first_line)), F.struct(F.lit(x.key).alias("key"), F.lit(x.name).alias("name"))).otherwise(F.lit(None).cast(kind)) for x in languages if x.addable]
    return files.withColumn("addable", F.array_compact(F.array(*pairs)) if pairs else F.array().cast(f"array<{kind}>"))
