"""Suggestions: a pruned similarity join of distinct unknown words with the dictionary, tiers, top k.

Both sides are packed into blocks of bounded size. A block of words is an index of signatures (``similarity.Words``), which
names the few words that a term's letters and first characters allow, without loss; only those are scored. Nothing is
broadcast and no pair is emitted that does not reach the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexcheck.functions import similarity
from lexcheck.functions.text import apply_case, case_style
from lexcheck.shipping import ship
from lexcheck.storage import materialise, small_batches

TERM_BLOCK, WORD_BLOCK, MOST_TASKS = 2_000, 20_000, 10_000
TIERS = ("mistype", "misspell", "wild")


def _blocks(df: DataFrame, column: str, size: int, name: str) -> tuple[DataFrame, int]:
    count = df.count()
    n = max(1, -(-count // size))
    packed = df.groupBy(F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias(name)).agg(F.sort_array(F.collect_list(column)).alias(column))
    return packed, n


NEAR = "array<struct<word:string,jw:double>>"


def similar(terms: DataFrame, words: DataFrame, listed: bool = False) -> DataFrame:
    """term, word, jw for all pairs at or over the term's threshold; ``terms(term)`` and ``words(word)``
    are made distinct and written once, since both are counted and then read. A task goes through its pairs by
    block of words, so it builds each index once. ``listed``: term, near (``NEAR``) instead, one row for each block with such words."""
    ship(terms.sparkSession)
    small_batches(terms.sparkSession)
    terms, m = _blocks(materialise(terms.select("term").distinct()), "term", TERM_BLOCK, "_term_block")
    words, n = _blocks(materialise(words.select("word").distinct()), "word", WORD_BLOCK, "_word_block")
    pairs = terms.withColumn("_word_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(words, "_word_block")

    def run(batches):
        last, index = None, None
        for batch in batches:
            for block, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != last:
                    last, index = block, similarity.Words([w for w in right.as_py() if w])
                terms = [t for t in left if t]
                t, w, score = index.matches(terms)
                # rounded: ties are ties, whatever the last bit
                score = np.round(score, 12)
                names, near = pa.array(terms, pa.string()), pa.array(index.words, pa.string()).take(pa.array(w))
                if listed:  # terms come in order
                    some, first = np.unique(t, return_index=True)
                    ends = pa.array(np.concatenate((first, [len(t)])), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([near, pa.array(score)], ["word", "jw"]))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), lists], ["term", "near"])
                else:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(t)), near, pa.array(score)], ["term", "word", "jw"])

    # a number of tasks that Spark does not join again: their rows are few, their work is not
    dealt = pairs.repartition(min(m * n, MOST_TASKS), "_word_block", "_term_block").sortWithinPartitions("_word_block")
    return dealt.select("_word_block", "term", "word").mapInArrow(run, f"term string, near {NEAR}" if listed else "term string, word string, jw double")


def tiers(pairs: DataFrame) -> DataFrame:
    """Adds lev and keeps each term's first non-empty tier: mistypes (edit distance at most a quarter of the
    length less one), misspellings (under the length less one), else what is within 2 % of the best."""
    n = F.char_length("term")
    rows = pairs.withColumn("lev", F.levenshtein("word", "term"))
    best = F.max("jw").over(Window.partitionBy("term"))
    tier = F.when(F.col("lev") <= F.floor((n - 1) * 0.25), 0).when(F.col("lev") < F.greatest(n - 1, F.lit(0)), 1).when(F.col("jw") >= 0.98 * best, 2)
    rows = rows.withColumn("tier", tier).filter("tier is not null")
    return rows.withColumn("_first", F.min("tier").over(Window.partitionBy("term"))).filter("tier = _first").drop("_first")


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each term: similarity first, then the word."""
    order = Window.partitionBy("term").orderBy(F.desc("jw"), F.asc("word"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def suggestions(terms: DataFrame, words: DataFrame, k: int = 1) -> DataFrame:
    """term, rank, word, jw, lev, tier."""
    return top(tiers(similar(terms, words)), k).select("term", "rank", "word", "jw", "lev", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("tier"))


def nearest(terms: DataFrame, words: DataFrame) -> DataFrame:
    """term, word: what ``suggestions`` gives with k = 1, without a sort. The first of a term's pairs by tier, similarity and word needs no
    bound of the third tier, which its most similar word always meets."""
    n = F.char_length("term")
    pairs = F.transform("near", lambda x: F.struct(F.levenshtein(x["word"], F.col("term")).alias("lev"), x["jw"].alias("jw"), x["word"].alias("word")))
    tier = lambda lev: F.when(lev <= F.floor((n - 1) * 0.25), 0).when(lev < F.greatest(n - 1, F.lit(0)), 1).otherwise(2)
    first = F.array_min(F.transform(pairs, lambda x: F.struct(tier(x["lev"]).alias("tier"), (-x["jw"]).alias("far"), x["word"].alias("word"))))
    return similar(terms, words, listed=True).select("term", first.alias("first")).groupBy("term").agg(F.min("first").alias("first")).select("term", "first.word")


def recased(rows: DataFrame, value: str = "value", word: str = "word") -> DataFrame:
    """Adds ``suggestion``: the word in the case style of the token."""
    return rows.withColumn("suggestion", apply_case(case_style(F.col(value)), F.col(word)))
