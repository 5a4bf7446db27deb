"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set: its distinct five-word shingles (lower case A-Z), or the whole sequence if shorter. All
documents with the same set form a class; everything below works on classes, so a group of copies costs
one class however large it is.

1.  A class keeps the ``sketch`` smallest hash values of its set. The ``keys`` smallest are posted in
    inverted lists; two sets with Jaccard 0.75 miss each other in all of the first 12 with odds of 0.25**12.
2.  Lists of at most ``hot`` classes are read whole: the union sketch of each pair estimates its Jaccard
    similarity, and a spanning forest of the pairs above ``least_estimate`` (five deviations under the
    threshold) is passed on, not all pairs.
3.  Longer lists come from passages that many documents share. A class with less than ``hot_share`` of its keys
    in them leaves them: what it shares with a similar set cannot be hot alone. The others (groups of very many
    near copies) are compared in blocks, bounded in rows and bytes, with their full sets, each block pair emitting
    a forest of verified links: first in the list of each class's smallest hot key, then, in all other lists
    that still hold several components. Nothing is capped: more members make more blocks.
4.  Forest pairs are verified on full sets, read again from the texts of the classes involved. Components
    are formed; then lists that still hold several components pass on every estimated pair across them,
    which are verified too. After that no pair that passes the estimate is unchecked or unconnected.

All numbers are in ``Search``. ``EXACT`` leaves no odds: the smallest quarter of every set (and one value more)
is posted, of which two sets of Jaccard 0.75 must share one, nobody leaves a list and no pair is estimated away.

Defined cases: texts without words are empty sets, linked with nothing; null texts likewise; rows without an id
get a null component and are all kept; a row is judged by its own text, also where other rows have its id;
extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexcheck.llm.common import discard, materialise, small_batches, table, text_or_empty
from lexcheck.llm.graph import components, with_least
from lexcheck.llm.words import WordArrays, gram_hashes

WORDS = 5
THRESHOLD = 75  # per cent


@dataclass(frozen=True)
class Search:
    """``keys``: posted values (None: the smallest quarter and one more); ``cold_keys`` and ``hot_keys``: how many of
    them are read in short and long lists (None: all); ``block_bytes``: full sets of a block."""

    sketch: int = 64
    keys: int | None = 32
    cold_keys: int | None = 12
    hot_keys: int | None = 10
    hot_share: float = 0.375
    hot: int = 200
    block: int = 1_024
    block_bytes: int = 32 << 20
    least_estimate: float = 0.48


DEFAULT = Search()
EXACT = Search(keys=None, cold_keys=None, hot_keys=None, hot_share=0.0, least_estimate=0.0)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    words = WordArrays([t.encode().lower() for t in texts])
    grams = gram_hashes(words.hashes, WORDS)
    out = []
    for begin, n in zip(words.begin.tolist(), words.lengths.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(grams[begin : begin + n - WORDS + 1]))
        else:  # the whole sequence, told apart by its length
            out.append(gram_hashes(words.hashes[begin : begin + n], n) + np.uint64(n) if n else np.zeros(0, np.uint64))
    return out


def is_link(intersection: int | np.ndarray, union: int | np.ndarray) -> bool | np.ndarray:
    return 100 * intersection >= THRESHOLD * union


def _unpack(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer() or b"", np.uint64)


def _fits(x: np.ndarray) -> list[int]:
    return x.astype(np.int64).tolist()


def sketches(docs: DataFrame, search: Search = DEFAULT) -> DataFrame:
    """doc_id, text_key (``xxhash64`` of the text), n, sig (of the full set), keys (the smallest values), sketch,
    one row per input row."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        for batch in batches:
            n, sig, keys, low = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(_fits(s[: len(s) // 4 + 1 if search.keys is None else search.keys]))
                low.append(s[: search.sketch].tobytes())
            made = [batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip((n, sig, keys, low), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "text_key", "n", "sig", "keys", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n long, sig binary, keys array<long>, sketch binary")


def estimates(sizes: np.ndarray, low: list[np.ndarray]) -> np.ndarray:
    """Estimated Jaccard similarity of all pairs from their union sketches.

    Under the smaller of two sketches' largest values both sketches are complete; the shared values
    over all values there estimate the similarity (a sketch that is the whole set has no limit)."""
    m = len(low)
    top = np.array([s[-1] if n > len(s) else np.uint64(2**64 - 1) for n, s in zip(sizes, low, strict=True)], np.uint64)
    values, place = np.unique(np.concatenate(low), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in low])
    shared = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    x = np.zeros((m, int(shared.sum())), np.float32)
    x[owner[use], column[place[use]]] = 1
    both = x @ x.T
    under = np.stack([np.searchsorted(s, top, "right") for s in low])  # under[i, j]: values of i up to j's limit
    own = np.array([len(s) for s in low])
    counted = np.where(top[:, None] <= top[None, :], own[:, None], under)
    union = counted + counted.T - both
    return both / np.maximum(union, 1)


class Forest:
    """Union-find over the few rows of one list."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _grouped(batches, key: int):
    """Rows of consecutive equal keys, gathered across batches; lists are bounded, so groups are."""
    held, last = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *edges], [*edges, len(keys)], strict=True):
            if lo == hi:
                continue
            if last is not None and keys[lo] != last:
                yield held
                held = []
            last = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def cold_pairs(lists: DataFrame, least_estimate: float = DEFAULT.least_estimate) -> DataFrame:
    """(a, b) from ``lists(v, class_id, n, sketch, component)``.

    While components are null: a spanning forest of the pairs above the estimate. Afterwards: all such
    pairs of different components."""

    def run(batches):
        for held in _grouped(batches, 0):
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows < 2:
                continue
            ids = rows.column("class_id").to_numpy()
            part = rows.column("component")
            again = part.null_count == 0
            if again:
                comp = part.to_numpy()
                if (comp == comp[0]).all():
                    continue
            cells = rows.column("sketch").chunk(0)
            low = [_unpack(c) for c in cells]
            guess = np.triu(estimates(rows.column("n").to_numpy(), low), 1)
            i, j = np.nonzero((guess >= least_estimate) & (guess > 0))
            if again:
                keep = comp[i] != comp[j]
                i, j = i[keep], j[keep]
            else:
                order = np.argsort(-guess[i, j], kind="stable")
                forest = Forest(len(ids))
                keep = [k for k in order.tolist() if forest.join(int(i[k]), int(j[k]))]
                i, j = i[keep], j[keep]
            if len(i):
                a, b = ids[i], ids[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    spread = lists.select("v", "class_id", "n", "sketch", "component").repartition("v").sortWithinPartitions("v")
    return spread.mapInArrow(run, "a long, b long").distinct()


def verified_forest(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Verified links that span the similarity graph of full sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    owner, column = owner[use], column[place[use]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(shared.sum()), 1_024):  # a slab of shingles at a time bounds the matrix
        at = slice(*np.searchsorted(column, [lo, lo + 1_024]))
        x = np.zeros((len(sets), 1_024), np.float32)
        x[owner[at], column[at] - lo] = 1
        both += x @ x.T
    forest, out = Forest(len(ids)), []
    for p in range(len(ids)):
        inter = both[p, p + 1 :].astype(np.int64)
        linked = np.flatnonzero(is_link(inter, sizes[p] + sizes[p + 1 :] - inter) & (inter > 0))
        out += [(int(ids[p]), int(ids[q])) for q in (linked + p + 1).tolist() if forest.join(p, q)]
    return out


def hot_links(docs: DataFrame, lists: DataFrame, search: Search = DEFAULT) -> DataFrame:
    """Verified (a, b) among ``lists(v, class_id, doc_id, sig, n)``, in pairs of blocks. A list is cut into blocks by
    its members and the bytes of their sets; a member goes to the pairs its block is part of."""
    sizes = lists.groupBy("v").agg(F.greatest(F.ceil(F.count(F.lit(1)) / search.block), F.ceil(F.sum("n") * 8 / search.block_bytes)).cast("int").alias("blocks"))
    sets = full_sets(docs, lists.select("class_id", "doc_id", "sig").distinct())
    mine = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    dealt = (
        lists.select("v", "class_id")
        .join(sizes, "v")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("class_id", F.xxhash64("v", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    )

    def run(batches):
        for held in _grouped(batches, 0):
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows < 2:
                continue
            found = verified_forest(rows.column("class_id").to_numpy(), [_unpack(c) for c in rows.column("set").chunk(0)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    spread = dealt.join(sets, "class_id").select("cell", "class_id", "set").repartition("cell").sortWithinPartitions("cell")
    return spread.mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, set (packed sorted hashes) for ``classes(class_id, doc_id, sig)``, read again from the texts of
    their documents; rows that repeat an id with another text do not fit the signature."""

    def run(batches):
        for batch in batches:
            ids, made = [], []
            for i, (values, sig) in enumerate(zip(shingle_sets(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True)):
                s = values.tobytes()
                if hashlib.blake2b(s, digest_size=16).digest() == sig:
                    ids.append(batch.column(0)[i].as_py())
                    made.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], ["class_id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = texts.join(classes.select("class_id", "doc_id", "sig"), "doc_id").select("class_id", "text", "sig").mapInArrow(run, "class_id long, set binary")
    return found.dropDuplicates(["class_id"])


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).distinct()
    sets = materialise(full_sets(docs, classes.select("class_id", "doc_id", "sig").join(ends, "class_id")))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = _unpack(x), _unpack(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(bool(is_link(both, len(s) + len(t) - both)) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("class_id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("class_id").alias("b"), F.col("set").alias("y"))
    links = materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    discard(sets)
    return links


def _first(entries, most: int | None):
    return entries if most is None else F.slice(entries, 1, most)


def judged(docs: DataFrame, search: Search = DEFAULT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept: one row per row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    rows = materialise(sketches(docs, search))
    usable = rows.filter("n > 0 and doc_id is not null")
    by_set = usable.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch"))
    # a class is numbered when it is written: its smallest doc_id may stand on rows of other texts as well
    classes = materialise(by_set.withColumn("class_id", F.monotonically_increasing_id()))
    posted = classes.select("class_id", F.posexplode("keys").alias("at", "v"))
    counts = posted.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    entry = F.struct("at", "v", "df")
    by_class = posted.join(counts, "v").groupBy("class_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # the posted values at most
    cold = _first(F.filter("entries", lambda e: e["df"] <= search.hot), search.cold_keys)
    hot = F.filter("entries", lambda e: e["df"] > search.hot)
    posted_keys = F.col("n") if search.keys is None else F.least("n", F.lit(search.keys))
    chosen = materialise(
        by_class.join(classes.select("class_id", "doc_id", "sig", "n", "sketch"), "class_id").select(
            "class_id", "doc_id", "sig", "n", "sketch",
            cold["v"].alias("cold"),
            F.when(F.size(hot) >= search.hot_share * posted_keys, _first(hot, search.hot_keys)["v"]).otherwise(F.array().cast("array<bigint>")).alias("hot"),
        )
    )
    nothing = F.lit(None).cast("long").alias("component")
    first = materialise(cold_pairs(chosen.select(F.explode("cold").alias("v"), "class_id", "n", "sketch", nothing), search.least_estimate))
    links = verify(docs, first, classes)
    some_hot = chosen.filter(F.size("hot") > 0).select("class_id", "doc_id", "sig", "n", "hot")
    any_hot = not some_hot.isEmpty()
    if any_hot:
        links = materialise(links.unionByName(hot_links(docs, some_hot.withColumn("v", F.get("hot", F.lit(0))).drop("hot"), search)))
    found = components(links)
    if any_hot:
        # the other lists, where they still hold several components
        rest = some_hot.withColumn("v", F.explode("hot")).drop("hot").join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
        rest = materialise(rest.withColumn("component", F.coalesce("component", "class_id")))
        mixed = rest.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("v")
        more = materialise(hot_links(docs, rest.join(mixed, "v").drop("component"), search))
        if not more.isEmpty():
            links = materialise(links.unionByName(more))
            found = components(links)
        discard(rest, more)
    named = chosen.select("class_id", "n", "sketch", F.explode("cold").alias("v")).join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    second = materialise(cold_pairs(named.withColumn("component", F.coalesce("component", "class_id")), search.least_estimate))
    if not second.isEmpty():
        more = verify(docs, second, classes)
        if not more.isEmpty():
            found = components(links.unionByName(more))
        discard(more)
    discard(first, second, links, chosen)
    centre = F.col("component")  # a star's centre has no row of its own
    found = found.unionByName(found.select(centre.alias("node"), "component").distinct())
    linked = found.join(classes.select(F.col("class_id").alias("node"), "doc_id"), "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = with_least(linked, "component", "node", least).select(F.col("node").alias("class_id"), "least")
    of_class = classes.select("sig", "doc_id", "class_id").join(named, "class_id", "left").select("sig", F.coalesce("least", "doc_id").alias("component_id"))
    return (
        rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
        .join(of_class, "sig", "left")
        .select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def near_duplicates(docs: DataFrame, search: Search = DEFAULT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs(doc_id, text)``."""
    return judged(docs, search).drop("text_key")


def without_duplicates(docs: DataFrame, search: Search = DEFAULT) -> DataFrame:
    """The rows of ``docs``, all columns, that are first of their group. Rows without an id all stay. Of rows that
    repeat both id and text one stays, the least by its other columns' values; only such rows are grouped,
    no other text is moved for them."""
    small_batches(docs.sparkSession)
    found = materialise(judged(docs, search).filter("doc_id is not null"))
    ids = found.groupBy("doc_id", "text_key").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    of = ids.filter("not kept or n > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("kept").alias("__kept"))
    same = (docs["doc_id"].cast("long") == F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("__key"))
    gone = docs.join(of.select("__id", "__key"), same, "left_anti")
    again = of.filter("__kept")
    if again.isEmpty():
        return gone
    repeated = docs.join(again, same)
    order = Window.partitionBy("__id", "__key").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])))
    one = repeated.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").select([F.col(f"`{c}`") for c in docs.columns])
    return gone.unionByName(one)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
