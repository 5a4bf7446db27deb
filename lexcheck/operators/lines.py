"""Lines of texts, their positions in the text, and disabled regions, by scans over the lines: nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcheck.functions.patterns import OWN_NAME, any_marker, line_marker
from lexcheck.storage import small_batches

KEY = "__key"


def split_lines(content: Column) -> Column:
    """The lines of a text without their line feeds; a last line feed opens no line."""
    lines = F.split(content, "\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def explode_lines(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, line_number (from 1), line."""
    return df.select(key, F.posexplode(split_lines(F.coalesce(F.col(content), F.lit("")))).alias("_at", "line")).select(key, (F.col("_at") + 1).alias("line_number"), "line")


def _scan(df: DataFrame, key: str, content: str, last: Column | None = None) -> DataFrame:
    """key, line_number, line, line_char_offset, line_byte_offset and, with ``last`` (what a line's last marker does, or empty),
    ``state``: what the last marker before the line did, or empty.

    A segmented scan: the lines of a text leave ``explode`` together and in order, so running sums over a batch's columns,
    each text's from its first line on, and what is carried to the next batch give every line what stands before it."""
    rows = explode_lines(df.select(F.col(f"`{key}`").alias(KEY), F.col(f"`{content}`").alias("content")), KEY, "content")
    kind = rows.schema[KEY].dataType.simpleString()
    names = [KEY, "line_number", "line", "line_char_offset", "line_byte_offset", "state"]
    rows = rows.select(KEY, "line_number", "line", (F.lit("") if last is None else last).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, state = [0, 0], ""
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.arange(batch.num_rows)
            begun = np.maximum.accumulate(np.where(batch.column(1).to_numpy() == 1, at, -1))  # -1: in a batch before
            offsets = []
            for k, length in enumerate((pc.utf8_length, pc.binary_length)):
                ends = np.cumsum(length(batch.column(2)).to_numpy().astype(np.int64) + 1)
                starts = np.concatenate(([0], ends[:-1]))
                base = np.where(begun >= 0, starts[begun], -carried[k])
                offsets.append(pa.array(starts - base))
                carried[k] = int(ends[-1] - base[-1])
            said = np.array(batch.column(3).to_pylist(), object)
            marks = np.maximum.accumulate(np.where(said != "", at, -1))
            before = np.concatenate(([-1], marks[:-1]))
            states = np.where((before >= 0) & (before >= begun), said[before], np.where(begun < 0, state, ""))
            inside = marks[-1] >= max(begun[-1], 0)
            state = said[marks[-1]] if inside else state if begun[-1] < 0 else ""
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *offsets, pa.array(states, pa.string())], names)

    small_batches(df.sparkSession)
    made = rows.mapInArrow(run, f"`{KEY}` {kind}, line_number int, line string, line_char_offset long, line_byte_offset long, state string")
    return made.withColumnRenamed(KEY, key)


def line_offsets(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, line_number, line, line_char_offset, line_byte_offset: the lines with what stands before each in its text."""
    return _scan(df, key, content).drop("state")


def without_disabled_lines(lines: DataFrame, name: str = OWN_NAME) -> DataFrame:
    return lines.filter(~F.col("line").rlike(line_marker(name)))


def active_lines(df: DataFrame, key: str, content: str, name: str = OWN_NAME) -> DataFrame:
    """key, line_number, line: lines outside disabled regions, for markers that fill a line of their own or end one; the state
    is the last marker of the lines before. Only texts that hold a marker are scanned."""
    marked = F.coalesce(F.col(f"`{content}`").rlike(any_marker(name)), F.lit(False))
    plain = explode_lines(df.filter(~marked).select(F.col(f"`{key}`"), F.col(f"`{content}`").alias("_text")), key, "_text")
    counts = ~F.col("line").rlike(line_marker(name))
    last = F.when(counts, F.regexp_extract(F.col("line"), rf"(?s)^.*(?:{name}):(disable|enable)", 1)).otherwise("")
    kept = _scan(df.filter(marked), key, content, last).filter(counts & (last == "") & F.col("state").isin("", "enable"))
    return plain.unionByName(kept.select(key, "line_number", "line"))
