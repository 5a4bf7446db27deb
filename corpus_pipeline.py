"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages
are removed, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and, but for the last,
returns the columns of ``documents`` (extra ones too). Stages are written as tables in the shared folder and
read again, so a lost executor repeats no earlier stage.

Defined cases, for all stages: null texts are empty, are kept and pack as the end id alone; rows without an id are
no copies of other rows and come last in the order of passages; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexcheck.llm.common import materialise, table
from lexcheck.llm.minhash import without_duplicates
from lexcheck.llm.packing import pack_documents
from lexcheck.llm.substrings import without_repeats
from lexcheck.llm.toxicity import drop_toxic, train_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the model is fitted on a bounded sample of labelled rows. Without
    labels, or with labels of one class, nothing is known and everything stays."""
    return drop_toxic(docs, train_on(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group; of rows that repeat id and text one stays."""
    return without_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, also one of which no word is left."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place; pieces of over a sequence's length are cut."""
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: No stage of this pipeline can be said in SQL as a whole; tests hold it against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
