"""Helpers shared by the training-data operators; ``lexcheck.storage`` keeps their intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck import storage
from lexcheck.shipping import ship
from lexcheck.storage import discard, materialise, scratch_dir

__all__ = ["discard", "materialise", "scratch_dir"]

#: ASCII white space that separates words: 0x20 and 0x09-0x0D, the set ``bytes.split()`` uses.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(rows: DataFrame, bytes_each: int, least: int = 48) -> int:
    """Number of blocks that keeps a block's texts near ``bytes_each``; it grows with the input. The sum is
    taken, not estimated: estimates of joined inputs can be off by any factor."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(least, total // bytes_each + 1))


def small_batches(spark: SparkSession) -> None:
    """Before Python stages: the package goes to the workers, and Arrow batches have few rows, so that
    very long texts do not meet in one batch. The setting is one for all operators."""
    ship(spark)
    storage.small_batches(spark)


def gathered(batches, rows: int = 4_096, size: int = 8 << 20):
    """The batches of a ``mapInArrow``, joined until they have so many rows or bytes: array operations pay from some
    thousand short rows on, while batches of long texts stay as small as they come."""
    held: list[pa.RecordBatch] = []
    n = total = 0
    for batch in batches:
        if held and (n + batch.num_rows > rows or total + batch.nbytes > size):
            yield pa.concat_batches(held)
            held, n, total = [], 0, 0
        held.append(batch)
        n, total = n + batch.num_rows, total + batch.nbytes
    if held:
        yield pa.concat_batches(held)


_MEMO: dict[str, object] = {}


def worker_memo(name: str, make):
    """A Python worker's memo. Workers are reused by later stages, so it outlives a task, but a worker holds
    only one: asking for another drops what the stage before remembered."""
    if name not in _MEMO:
        forget()
        _MEMO[name] = make()
    return _MEMO[name]


def forget() -> None:
    """Drop the memo of a stage before and hand free memory back to the system: an idle worker's pages count
    against its executor."""
    if _MEMO:
        _MEMO.clear()
        release_memory()


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; extra input columns never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])
