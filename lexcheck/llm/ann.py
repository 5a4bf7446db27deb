"""Approximate nearest neighbours by inner product: one vantage-point tree per shard.

Inner product is turned into Euclidean distance by one more component, sqrt(M^2 - |x|^2) with M the
largest norm, 0 for queries: |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>. An inner node splits its vectors at the
median distance from its vantage point; leaves hold at most ``LEAF`` vectors. For every leaf the tree keeps the
range of distances to every vantage point of the tree, not only to those above it, so the triangle inequality
bounds a leaf's distance from a query by the largest gap over all of them. A query scans the leaves with the
smallest bounds first and then every leaf whose bound, multiplied by ``factor``, is within its present k-th
distance. Factor 1 is exact; a larger factor prunes more.

Rows are dealt to shards of bounded rows and bytes, so trees do not grow with the table. Queries travel to the trees in
blocks: a task holds one tree and streams blocks through it. Every row is indexed; equal vectors of a shard share
one entry that keeps their ``k + 1`` smallest distinct ids, which is all that the ``k`` nearest other rows can use. Scores are
recomputed in double precision on the original vectors; ties go to the smaller id.

Defined cases: null vectors, zero vectors, vectors with null or non-finite components and rows without an id take
no part; vectors of different lengths are searched each among their own; neighbours are
distinct ids, never the query's own: rows that repeat id and vector count once, and an id on several vectors asks with all of them and
is found by its best; fewer candidates than ``k`` give them all; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexcheck.llm.common import materialise, small_batches, table

LEAF = 64
FIRST_LEAVES = 4
SHARD_ROWS, SHARD_BYTES = 16_384, 16 << 20  # whichever is reached first
QUERY_BLOCK = 256
BLOCKS_A_TASK = 64


class VantageTree:
    """Built over ``points`` (n x d, already augmented). ``leaves`` are row ranges, ``near`` and ``far`` the least
    and largest distance of each leaf's rows to each vantage point."""

    def __init__(self, points: np.ndarray, seed: int = 0) -> None:
        self.order = np.arange(len(points))
        rng = np.random.default_rng(seed)
        self.leaves: list[tuple[int, int]] = []
        vantages: list[int] = []

        def build(lo: int, hi: int) -> None:
            if hi - lo <= LEAF:
                self.leaves.append((lo, hi))
                return
            rows = self.order[lo:hi]
            trial = rows[rng.integers(0, len(rows), 5)]
            sample = points[rows[rng.integers(0, len(rows), 64)]]
            spread = [np.linalg.norm(sample - points[t], axis=1).var() for t in trial]
            vantage = int(trial[int(np.argmax(spread))])
            vantages.append(vantage)
            d = np.linalg.norm(points[rows] - points[vantage], axis=1)
            mid = len(rows) // 2
            self.order[lo:hi] = rows[np.argpartition(d, mid)]  # by rank, so equal distances still halve
            build(lo, lo + mid)
            build(lo + mid, hi)

        if len(points):
            build(0, len(points))
        self.points = points[self.order]
        self.vantages = points[vantages] if vantages else points[:1]
        self.near = np.zeros((len(self.leaves), len(self.vantages)))
        self.far = np.zeros_like(self.near)
        for k, (lo, hi) in enumerate(self.leaves):
            d = distances(self.points[lo:hi], self.vantages)
            self.near[k], self.far[k] = d.min(0), d.max(0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, leaf): no row of the leaf is nearer than this."""
        d = distances(queries, self.vantages)
        out = np.zeros((len(queries), len(self.leaves)))
        for k in range(len(self.leaves)):
            out[:, k] = np.maximum(d - self.far[k], self.near[k] - d).max(1)
        return out

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """Row numbers (into the points as given; -1: none) and negative inner products of each query's k
        nearest, ties to smaller rows, and how many (query, row) pairs were scored."""
        n = len(queries)
        found, cost, dist = np.full((n, k), -1, np.int64), np.full((n, k), np.inf), np.full(n, np.inf)
        if not self.leaves or not n:
            return found, cost, 0
        square = (queries * queries).sum(1)
        radius = float((self.points * self.points).sum(1).max())  # all augmented points have this norm
        # an allowance for rounding keeps factor 1 exact
        slack = 1e-7 * (1 + np.sqrt(square.max(initial=0)) + np.sqrt(radius))
        bound = self.bounds(queries)
        scored = 0

        def scan(leaf: int, active: np.ndarray) -> None:
            nonlocal scored
            lo, hi = self.leaves[leaf]
            scored += len(active) * (hi - lo)
            c = -(queries[active] @ self.points[lo:hi].T)
            hit = c.min(1) <= cost[active, -1]
            active, c = active[hit], c[hit]
            if not len(active):
                return
            every_c = np.concatenate([cost[active], c], 1)
            every_i = np.concatenate([found[active], np.broadcast_to(self.order[lo:hi], c.shape)], 1)
            best = np.argpartition(every_c, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(every_c, best, 1)
            tied = np.flatnonzero((every_c <= top.max(1)[:, None]).sum(1) > k)
            for t in tied.tolist():  # more equal ones than places: the smaller rows
                best[t] = np.lexsort((every_i[t], every_c[t]))[:k]
            top[tied] = np.take_along_axis(every_c[tied], best[tied], 1)
            rank = np.argsort(top, 1, kind="stable")
            cost[active] = np.take_along_axis(top, rank, 1)
            found[active] = np.take_along_axis(np.take_along_axis(every_i, best, 1), rank, 1)
            dist[active] = np.sqrt(np.maximum(square[active] + radius + 2 * cost[active, -1], 0))

        first = np.argsort(bound, axis=1, kind="stable")[:, :FIRST_LEAVES]
        for turn in range(first.shape[1]):
            for leaf in np.unique(first[:, turn]).tolist():
                scan(leaf, np.flatnonzero(first[:, turn] == leaf))
        left = np.ones(bound.shape, bool)
        np.put_along_axis(left, first, False, 1)
        for leaf in np.argsort(bound.mean(0), kind="stable").tolist():
            active = np.flatnonzero(left[:, leaf] & (factor * bound[:, leaf] <= dist + slack))
            if len(active):
                scan(leaf, active)
        return found, cost, scored


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def augment(vectors: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(most * most - (vectors * vectors).sum(1), 0))
    return np.concatenate([vectors, rest[:, None]], 1)


class Shard:
    """A shard's distinct vectors, the smallest ids of each, and their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, keep: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        distinct, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        by_id = np.argsort(first)  # rows in the order of their smallest ids
        self.vectors, group = distinct[by_id], np.argsort(by_id)[group.reshape(-1)]
        by = np.argsort(group, kind="stable")
        owners = [np.unique(x) for x in np.split(ids[by], np.cumsum(np.bincount(group))[:-1])]
        self.ids = [x[:keep] for x in owners]
        #: entries that one id may fill
        self.repeats = int(np.unique(np.concatenate(owners), return_counts=True)[1].max())
        self.tree = VantageTree(augment(self.vectors, most))

    def nearest(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> tuple[list, list, list]:
        queries = np.concatenate([vectors, np.zeros((len(vectors), 1))], 1)
        # k other ids are among so many entries, the query's own included
        found, _, self.scored = self.tree.search(queries, min(k * self.repeats + self.repeats, max(1, len(self.vectors))), factor)
        out: tuple[list, list, list] = ([], [], [])
        for q, rows, vector in zip(ids.tolist(), found, vectors, strict=True):
            rows = rows[rows >= 0]
            scores = (self.vectors[rows] * vector).sum(1)
            best: dict[int, float] = {}
            for s, r in zip(scores.tolist(), rows.tolist(), strict=True):
                for i in self.ids[r].tolist():
                    if i != q and s > best.get(i, -np.inf):
                        best[i] = s
            made = sorted((-s, i) for i, s in best.items())[:k]
            out[0].extend([q] * len(made))
            out[1].extend(i for _, i in made)
            out[2].extend(-s for s, _ in made)
        return out


def clean_vectors(table: DataFrame, key: str, column: str) -> DataFrame:
    """id long, v array<double>: the rows that take part."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest_neighbours(
    vectors: DataFrame, k: int = 20, query_every: int = 20, factor: float = 1.0, key: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``query_every``, its ``k``
    nearest other rows by inner product."""
    found = searched(vectors, k, query_every, factor, key, column, shard_rows).filter("vec_id is not null")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # of ids with several vectors
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched(vectors: DataFrame, k: int, query_every: int, factor: float, key: str, column: str, shard_rows: int) -> DataFrame:
    """query_id, vec_id, score: the nearest of each query in each shard, and a row per block of queries and
    shard without ids, whose score is the number of (query, row) pairs that were scored."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = clean_vectors(vectors, key, column).withColumn("d", F.size("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    stats = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"))
    fitting = F.greatest(F.lit(LEAF), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("d")))))
    stats = materialise(stats.select("d", "most", F.ceil(F.col("n") / fitting).cast("int").alias("shards"), F.ceil(F.col("n") / (query_every * QUERY_BLOCK)).cast("int").alias("blocks")))
    deal = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    dealt = rows.join(stats, "d")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids = t.column("id").to_numpy()
        made = pickle.dumps(Shard(ids, _matrix(t.column("v").chunk(0)), float(t.column("most")[0].as_py()), k + 1), protocol=5)
        return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([made], pa.binary())})

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, matrix = t.column("id").to_numpy(), _matrix(t.column("v").chunk(0))
        # a block has all rows of its ids: those that repeat id and vector ask once
        once = np.unique(np.concatenate([ids.astype(np.int64).view(np.float64)[:, None], matrix], 1).view(np.int64), axis=0, return_index=True)[1]
        cells = [key[0].as_py()], [key[1].as_py()], [t.column("shards")[0].as_py()], [ids[once].tobytes()], [np.ascontiguousarray(matrix[once]).tobytes()]
        kinds = pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
        return pa.table([pa.array(c, kind) for c, kind in zip(cells, kinds, strict=True)], ["d", "block", "shards", "ids", "data"])

    trees = materialise(dealt.select("d", deal("shards").alias("shard"), "id", "v", "most").groupBy("d", "shard").applyInArrow(build, "d int, shard int, tree binary"))
    asked = dealt.filter(F.col("id") % query_every == 0).select("d", deal("blocks").alias("block"), "shards", "id", "v")
    packed = asked.groupBy("d", "block").applyInArrow(pack, "d int, block int, shards int, ids binary, data binary")
    # a stated query set against every shard, in blocks: the blocks travel, a tree once for BLOCKS_A_TASK of them
    turn = F.floor(F.col("block") / BLOCKS_A_TASK).cast("int")
    blocks = packed.select("d", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), turn.alias("turn"), "block", "ids", "data")
    turns = stats.select("d", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / BLOCKS_A_TASK).cast("int"))).alias("turn"))
    none = F.lit(None).cast("binary")
    first = trees.join(turns, "d").select("d", "shard", "turn", F.lit(-1).alias("block"), none.alias("ids"), F.col("tree").alias("data"))
    tasks = stats.agg(F.coalesce(F.sum(F.col("shards") * F.ceil(F.col("blocks") / BLOCKS_A_TASK)), F.lit(1)).cast("int")).first()[0]
    lined = first.unionByName(blocks).repartition(max(1, tasks), "d", "shard", "turn").sortWithinPartitions("d", "shard", "turn", "block")

    def search(batches):
        shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, data = batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if block < 0:
                    shard = pickle.loads(data)
                    continue
                ids = np.frombuffer(ids, np.int64)
                q, v, s = shard.nearest(ids, np.frombuffer(data, np.float64).reshape(len(ids), -1), k, factor)
                columns = [pa.array([*q, None], pa.int64()), pa.array([*v, None], pa.int64()), pa.array([*s, float(shard.scored)], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return lined.select("d", "block", "ids", "data").mapInArrow(search, "query_id long, vec_id long, score double")


#: Measured recall and share of scored pairs of the production factor are in the README.
FACTOR = 5.5


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), factor=FACTOR)
