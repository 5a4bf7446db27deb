"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by and joins on the table; the driver sees two numbers per step. Each step's edges
are written to the shared folder, which ends their lineage. A component ends as a star, whose centre has all
its edges: joins on a node are dealt over ``SALTS`` parts of its edges, so no task holds a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcheck.llm.common import discard, materialise


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


SALTS = 16


def with_least(edges: DataFrame, node: str, other: str, least: DataFrame) -> DataFrame:
    """``edges`` joined with ``least(node, m)``, a node's edges dealt over parts; least rows go to every part, by a
    shuffle: they grow with the edges, so no driver collects them for a broadcast."""
    salt = F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")
    spread = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("_salt", salt).join(spread.hint("merge"), [node, "_salt"]).drop("_salt")


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)`` for every node with an edge; the component is its smallest node."""
    now = materialise(
        edges.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    seen = _print(now)
    for _ in range(most_steps):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = with_least(both, "u", "v", least).filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))  # doubles go below
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = with_least(large, "hi", "lo", root)
        small = hung.select("hi", F.col("m").alias("lo")).unionByName(hung.filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        after = materialise(small.distinct())
        mark = _print(after)
        discard(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
