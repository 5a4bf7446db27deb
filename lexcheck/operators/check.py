"""Unknown words: an anti join of tokens with the dictionaries of their file's languages, and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcheck.functions.text import highlight, location, pluralise
from lexcheck.operators.tokenize import normalised


def unknown(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens whose normal form is in no list. Join sides are picked by size at run time: a small dictionary is
    broadcast, a large one is shuffled."""
    rows = tokens if "norm" in tokens.columns else normalised(tokens)
    return rows.join(words.select(F.col("word").alias("norm")).distinct(), "norm", "left_anti")


def known(tokens: DataFrame, words: DataFrame) -> DataFrame:
    rows = tokens if "norm" in tokens.columns else normalised(tokens)
    return rows.join(words.select(F.col("word").alias("norm")).distinct(), "norm", "left_semi")


SET = "language_set"


def language_set(languages: Column) -> Column:
    """A file's languages as one short string, carried by its tokens."""
    return F.array_join(languages, ",").alias(SET)


def unknown_by_language(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``tokens`` with their file's ``language_set``, ``words(name, word)``: a token is known if any list of its file's languages
    has it. Tokens are made once and meet the lists in one anti join. Adds ``languages``."""
    rows = tokens if "norm" in tokens.columns else normalised(tokens)
    names = F.filter(F.split(SET, ","), lambda n: n != "")
    listed = words.select(F.col("word").alias("_word"), F.concat(F.lit(","), "name", F.lit(",")).alias("_name")).distinct()
    left = rows.join(listed, (F.col("norm") == F.col("_word")) & F.contains(F.concat(F.lit(","), F.col(SET), F.lit(",")), F.col("_name")), "left_anti")
    return left.withColumn("languages", names).drop(SET)


def word_report(errors: DataFrame) -> DataFrame:
    """Distinct normal forms, sorted."""
    return errors.select("norm").distinct().orderBy("norm")


def summary(files: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """files, files_with_errors, errors, exit_code: one row; both sides are aggregates before they meet."""
    checked = files.agg(F.countDistinct(key).alias("files"))
    found = errors.agg(F.countDistinct(key).alias("files_with_errors"), F.count(F.lit(1)).alias("errors"))
    return checked.crossJoin(found).withColumn("exit_code", (F.col("errors") > 0).cast("int"))


def any_error(errors: DataFrame) -> bool:
    return not errors.isEmpty()


def error_lines(errors: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """``key:line:column line`` with the word in red, for errors with offsets."""
    return shown_lines(errors.join(lines, [key, "line_number"]), key)


def shown_lines(errors: DataFrame, key: str) -> DataFrame:
    """``error_lines`` of errors that carry their ``line``."""
    shown: Column = F.concat_ws(" ", location(F.col(key).cast("string"), F.col("line_number"), F.col("char_offset")), highlight(F.col("line"), F.col("char_offset"), F.col("value")))
    return errors.select(key, "line_number", "char_offset", "value", shown.alias("shown"))


def summary_lines(report: DataFrame) -> DataFrame:
    return report.select(F.array(pluralise("file", F.col("files")), pluralise("error", F.col("errors"))).alias("lines"))
