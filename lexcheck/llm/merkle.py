"""Merkle manifest of a dataset: a tree per group of rows over all their leaves, a tree over the groups' roots, and an
inclusion proof per row.

Leaves are numbered within their group without any task seeing a whole group: rows are dealt by range and sorted, a
partition's rows are counted, and the counts (a row per partition and group) give each partition its first number.

Superblock reduction. ``SPAN = fanout ** k`` consecutive nodes are a bucket; ``applyInPandas`` collapses the k levels of
a bucket to its root and keeps the bucket's nodes as one packed row. The buckets' roots are the next nodes, until each
group has one. Then the proofs go down: a bucket's row meets the proof of its root, and each of its nodes gets
its own lower steps with the root's upper ones behind. A task holds one bucket at a time, whatever the group's size.

``H`` is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text. While several nodes remain, each
``fanout`` consecutive ones (the last run: fewer, even one) become their ``H``.

A proof is packed steps, one for each level from the leaf up: two bytes, the numbers of siblings before and after
the node, then their digests of 32 bytes. ``fold_proof`` recomputes the root.

Defined cases: null fields are ``-`` and differ from empty ones; the group null comes first and differs from the empty group; ids
ascend with nulls first; rows that repeat an id are leaves of their own, ordered by digest (equal rows are
interchangeable); a group of one leaf has the leaf as its root, a single group's root is the whole root; an empty
table gives no rows; extra columns are ignored. Tampering with a null ``n_chars`` or at a null id changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexcheck.llm.common import materialise, only, small_batches, table

FANOUT = 2
LEVELS = 10  # collapsed per bucket: 1,024 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The 32 bytes of the leaf's digest."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0 within the group, in the given order) and ``n`` (rows of the group)."""
    spread = materialise(
        rows.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    sizes = spread.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    one = Window.partitionBy(group)  # a row per partition, so as many as there are partitions at most
    firsts = materialise(
        sizes.select(group, "_part", "_first", (F.sum("_n").over(one.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(one).alias("n"))
    )
    return spread.join(firsts, [group, "_part"]).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def pyramid(nodes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """All levels above and with ``nodes``: ``levels`` of them, or until one node remains."""
    made = [nodes]
    while len(made[-1]) > 1 if levels is None else len(made) <= levels:
        now = made[-1]
        made.append([digest("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)])
    return made


def steps_of(levels: list[list[str]], at: int, fanout: int) -> bytes:
    """The packed steps from node ``at`` to the top of the pyramid."""
    out = []
    for nodes in levels[:-1]:
        lo = at - at % fanout
        run = nodes[lo : lo + fanout]
        here = at - lo
        out.append(bytes((here, len(run) - here - 1)) + bytes.fromhex("".join(run[:here] + run[here + 1 :])))
        at //= fanout
    return b"".join(out)


def siblings(steps: bytes) -> Iterator[tuple[str, str]]:
    """Per level the digests before and after, concatenated hex."""
    at = 0
    while at < len(steps):
        before, after = steps[at], steps[at + 1]
        mid, end = at + 2 + 32 * before, at + 2 + 32 * (before + after)
        yield steps[at + 2 : mid].hex(), steps[mid:end].hex()
        at = end


def fold_proof(leaf_hex: str, steps: bytes) -> str:
    """The root that a leaf and its proof lead to."""
    for before, after in siblings(steps):
        leaf_hex = digest(before + leaf_hex + after)
    return leaf_hex


def collapse(nodes: DataFrame, fanout: int, levels: int, carried: list[str]) -> DataFrame:
    """``nodes(tree, place, n, digest)`` to a row per bucket: tree, place (the bucket's), n (buckets of the tree), size (nodes of
    the tree), digest (the bucket's root), digests (its nodes, packed in order) and an array of each carried column."""
    span = fanout**levels
    kinds = [f"`{c}` array<{nodes.schema[c].dataType.simpleString()}>" for c in carried]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, bucket, n = key
        rows = rows.sort_values("place")
        made = pyramid([d.hex() for d in rows["digest"]], fanout, levels if n > span else None)
        row = [tree, bucket, -(-n // span), n, bytes.fromhex(made[-1][0]), b"".join(rows["digest"]), *(list(rows[c]) for c in carried)]
        return pd.DataFrame([row], columns=["tree", "place", "n", "size", "digest", "digests", *carried])

    keyed = nodes.select("tree", F.floor(F.col("place") / span).cast("long").alias("bucket"), "n", "place", "digest", *carried)
    schema = ", ".join(["tree binary, place long, n long, size long, digest binary, digests binary", *kinds])
    return keyed.groupBy("tree", "bucket", "n").applyInPandas(one, schema)


def reduce_trees(nodes: DataFrame, fanout: int, levels: int, carried: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """(the trees' roots, the buckets of each turn from the leaves up); trees end at different turns."""
    turns: list[DataFrame] = []
    roots: DataFrame | None = None
    while True:
        turns.append(materialise(collapse(nodes, fanout, levels, [] if turns else carried)))
        ended = turns[-1].filter("n = 1").select("tree", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
        nodes = turns[-1].filter("n > 1").select("tree", "place", "n", "digest")
        if nodes.isEmpty():
            return roots, turns


def push_down(turns: list[DataFrame], tops: DataFrame, fanout: int, levels: int, carried: list[str], finish: Check | None = None) -> DataFrame:
    """``tops(tree, steps, subroot, root)``, what stands above each tree, to tree, place, leaf, steps, subroot, root and the carried
    columns for every node of the first turn, or to what ``finish`` makes of them."""
    span = fanout**levels
    proofs: DataFrame | None = None
    for turn in reversed(turns):
        also, last = (carried, finish) if turn is turns[0] else ([], None)
        above = turn.filter("n = 1").join(tops, "tree")
        if proofs is not None:
            above = above.unionByName(turn.filter("n > 1").join(proofs.drop("leaf"), ["tree", "place"]))
        kinds = [f"`{c}` {turn.schema[c].dataType.elementType.simpleString()}" for c in also]

        def spread(frames: Iterator[pd.DataFrame], also: list[str] = also, last: Check | None = last) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for tree, bucket, size, packed, upper, subroot, root, *lists in frame.itertuples(index=False, name=None):
                    nodes = [packed[i : i + 32] for i in range(0, len(packed), 32)]
                    made = pyramid([d.hex() for d in nodes], fanout, levels if size > span else None)
                    steps = [steps_of(made, i, fanout) + upper for i in range(len(nodes))]
                    places = range(bucket * span, bucket * span + len(nodes))
                    made = pd.DataFrame({"tree": [tree] * len(nodes), "place": places, "leaf": nodes, "steps": steps, "subroot": subroot, "root": root} | dict(zip(also, map(list, lists), strict=True)))
                    yield last(made) if last else made

        schema = last.schema if last else ", ".join(["tree binary, place long, leaf binary, steps binary, subroot string, root string", *kinds])
        proofs = above.select("tree", "place", "size", "digests", "steps", "subroot", "root", *also).mapInPandas(spread, schema)
        if turn is not turns[0]:
            proofs = materialise(proofs)
    return proofs


def prove(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, finish: Check | None = None) -> DataFrame:
    """``leaves(tree binary, key long, leaf binary)`` and carried string or binary columns to key, leaf, steps, subroot, root and the
    carried columns, or to what ``finish`` makes of them. Trees are ordered by their bytes, leaves by key, then digest."""
    small_batches(leaves.sparkSession)
    carried = [c for c in leaves.columns if c not in ("tree", "key", "leaf")]
    rows = materialise(leaves.withColumn("row", F.monotonically_increasing_id()))
    nodes = materialise(numbered(rows, "tree", ["key", "leaf", "row"]).select("tree", "place", "n", F.col("leaf").alias("digest"), F.col("key").cast("string").alias("key"), *carried))
    roots, turns = reduce_trees(nodes, fanout, levels, ["key", *carried])
    heads = roots.select(F.lit(b"").alias("tree"), F.col("tree").alias("name"), "digest")
    heads = materialise(numbered(heads, "tree", ["name"]))
    top, head_turns = reduce_trees(heads, fanout, levels, ["name"])
    summit = top.select("tree", F.lit(b"").alias("steps"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    tops = push_down(head_turns, summit, fanout, levels, ["name"])
    tops = materialise(tops.select(F.col("name").alias("tree"), "steps", F.lower(F.hex("leaf")).alias("subroot"), "root"))
    proved = push_down(turns, tops, fanout, levels, ["key", *carried], finish)
    return proved.drop("tree", "place").withColumn("key", F.col("key").cast("long"))


class Check:
    """What ``prove`` may do with each bucket's frame before it leaves the task: each row's ``claimed`` leaf (its own where null) is
    folded through its proof. Returns key, leaf, subroot, root, proof_sha256, folded_root, verified."""

    schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def __init__(self, claimed: str) -> None:
        self.claimed = claimed

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        proofs = [digest("".join(a + b for a, b in siblings(s))) for s in frame["steps"]]
        folded = [fold_proof((c or x).hex(), s) for x, s, c in zip(frame["leaf"], frame["steps"], frame[self.claimed], strict=True)]
        made = frame[["key", "leaf", "subroot", "root"]].assign(proof_sha256=proofs, folded_root=folded)
        made["leaf"] = [x.hex() for x in made["leaf"]]
        made["verified"] = made["folded_root"] == made["root"]
        return made


def tree_key(group: Column) -> Column:
    """Bytes that order groups as their UTF-8 does, null first."""
    return F.when(group.isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\x01"), F.encode(group.cast("string"), "UTF-8")))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", carried: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS, finish: Check | None = None) -> DataFrame:
    """The proved leaves of ``docs``: key, leaf, steps, subroot, root and the carried (string or binary) columns, or what ``finish``
    makes of them."""
    docs = only(docs, *dict.fromkeys([*fields, group, key]))
    leaves = docs.select(
        tree_key(F.col(f"`{group}`")).alias("tree"), F.col(f"`{key}`").cast("long").alias("key"), leaf([F.col(f"`{f}`") for f in fields]).alias("leaf"), *[c.alias(n) for n, c in (carried or {}).items()]
    )
    return prove(leaves, fanout, levels, finish)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(
        F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0,
        leaf([F.col("n_chars").cast("long") + 1 if f == "n_chars" else F.col(f) for f in FIELDS]),
    )
    proved = manifest(table(spark, sf_dir, "documents"), carried={"claimed": tampered}, finish=Check("claimed"))
    return proved.withColumnRenamed("key", "doc_id")


def _sql() -> str:
    """The same by recursive queries: levels of nodes per tree and CRC-32 bit by bit."""
    leaf_of = lambda n_chars: " || ".join(
        f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")
    )
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE crc(doc_id, step, c) AS (
    SELECT DISTINCT doc_id, 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT doc_id, step + 1, CASE WHEN step % 9 = 0 THEN xor(c, ascii(substr(CAST(doc_id AS VARCHAR), step // 9 + 1, 1))) ELSE {bit} END
    FROM crc WHERE step < 9 * length(CAST(doc_id AS VARCHAR))
),
hit AS (SELECT doc_id AS hit_id FROM crc WHERE step = 9 * length(CAST(doc_id AS VARCHAR)) AND xor(c, 4294967295) % {TAMPER_EVERY} = 0),
leaves AS (
    SELECT doc_id, lang, sha256({leaf_of("n_chars")}) AS leaf,
        CASE WHEN hit_id IS NULL THEN sha256({leaf_of("n_chars")}) ELSE sha256({leaf_of("(n_chars + 1)")}) END AS claimed
    FROM documents d LEFT JOIN hit ON doc_id = hit_id
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(lang, level, place, n, d) AS (
    SELECT lang, 0, place, n, leaf FROM placed
    UNION ALL
    SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(d || coalesce(lead(d) OVER (PARTITION BY lang ORDER BY place), ''))
    FROM (SELECT * FROM nodes WHERE n > 1) QUALIFY place % 2 = 0
),
subroots AS (SELECT lang, d AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
heads(level, place, n, d) AS (
    SELECT 0, place, n, subroot FROM subroots
    UNION ALL
    SELECT level + 1, place // 2, (n + 1) // 2, sha256(d || coalesce(lead(d) OVER (ORDER BY place), '')) FROM (SELECT * FROM heads WHERE n > 1) QUALIFY place % 2 = 0
),
ids AS MATERIALIZED (SELECT row_number() OVER () AS id, p.*, s.subroot, s.height FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang),
fold(id, lang, level, place, height, proof, d) AS (
    SELECT id, lang, 0, place, height, '', claimed FROM ids
    UNION ALL
    SELECT f.id, f.lang, f.level + 1, f.place // 2, f.height, f.proof || coalesce(o.d, ''),
        sha256(CASE WHEN f.place % 2 = 1 THEN coalesce(o.d, '') || f.d ELSE f.d || coalesce(o.d, '') END)
    FROM fold f LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM f.lang AND o.level = f.level AND o.place = xor(f.place, 1)
    WHERE f.level < f.height
),
fold_heads(id, level, place, proof, d) AS (
    SELECT f.id, 0, s.place, f.proof, f.d FROM fold f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang WHERE f.level = f.height
    UNION ALL
    SELECT f.id, f.level + 1, f.place // 2, f.proof || coalesce(o.d, ''),
        sha256(CASE WHEN f.place % 2 = 1 THEN coalesce(o.d, '') || f.d ELSE f.d || coalesce(o.d, '') END)
    FROM fold_heads f LEFT JOIN heads o ON o.level = f.level AND o.place = xor(f.place, 1)
    WHERE f.level < (SELECT max(level) FROM heads)
)
SELECT doc_id, leaf, subroot, (SELECT d FROM heads WHERE n = 1) AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = (SELECT d FROM heads WHERE n = 1) AS verified
FROM ids JOIN fold_heads f ON f.id = ids.id WHERE f.level = (SELECT max(level) FROM heads)"""


OP13_SQL = _sql()
