"""Best-fit packing of tokenised documents into sequences of a fixed size by a grouping genetic algorithm.

Encoding. Words between ASCII blanks are encoded one by one and memoised; the tokeniser's own rules split
there too, and its special tokens hold no blank, so the ids are those of the whole text (tested), special
tokens written in a text included. The end id is appended; only a document longer
than a sequence is cut, into full pieces and a rest, and full pieces are sequences of their own.

Packing. The other pieces are dealt by hash to blocks of bounded size. A block's individuals are whole
packings; each (block, island) evolves a small population: crossover injects well-filled bins of one
parent into the other, drops the bins that now hold a document twice, and best-fits the displaced
documents, largest first. One island starts from best-fit decreasing, the others from packings around random
halves. An epoch ends when the volume bound is reached, after ``STALL`` generations without a better packing, or
after ``GENERATIONS``; then each island sends its best packing to the next island of its block (a shuffle of
packings). At the bound no packing can be better, so a block that starts there evolves nothing. The best packing of a block wins; bins left poorly filled are dissolved
and their pieces packed again in blocks of blocks, so that blocks cost no more sequences than one.

Defined cases: null or empty texts are the end id alone; null ids are kept; equal rows are pieces of their
own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.llm.bpe import vocabulary
from lexcheck.llm.common import materialise, small_batches, table, text_or_empty, worker_memo

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES = 4_096
ISLANDS, EPOCHS, POPULATION, GENERATIONS, STALL = 3, 2, 8, 40, 6
WELL_FILLED = 0.98  # bins under this share of the capacity are dissolved after the block's turn
MEMO_WORDS = 1_000_000  # about 200 bytes each; a worker's memo is emptied when full

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """word -> its ids as packed little-endian 32-bit numbers, remembered up to a bound.

    Words of Latin letters alone are one unit of the tokeniser; its merges, which join by rank, are run on
    their bytes by tiktoken's merge loop (byte 0xFF, never part of UTF-8, stands for the end of the word).
    All other words go through the tokeniser itself. Tests hold both ways equal."""

    MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # no apostrophe, which can belong to a word, and none of "<|>"
    LAST_LATIN = "\u012f"  # up to here lower-casing and composition go letter by letter

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merge, self.ids = self._merger(json.load(f))

    @staticmethod
    def _merger(spec: dict):
        """The merge loop over ranks and the table from ranks to ids; (None, None) for other tokenisers."""
        model, steps = spec["model"], [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model.get("end_of_word_suffix") != "</w>" or steps != ["NFC", "Replace", "Lowercase"]:
            return None, None
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        letters = {chr(b): b for b in shown}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

        def raw(token: str) -> bytes:
            body = token.removesuffix("</w>")
            return bytes(letters[c] for c in body) + (b"\xff" if len(body) < len(token) else b"")

        ranks, ids = {bytes([b]): b for b in range(256)}, np.zeros(512 + len(model["merges"]), "<u4")
        for letter, b in letters.items():
            ids[b] = model["vocab"][letter]
            if b != 255:
                ranks[bytes([b]) + b"\xff"] = 256 + b
                ids[256 + b] = model["vocab"][letter + "</w>"]
        for k, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            if ranks.setdefault(raw(left) + raw(right), 512 + k) != 512 + k:
                return None, None  # a token is made in two ways: ranks alone would not tell them apart
            ids[512 + k] = model["vocab"][left + right]
        loop = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        return loop._core_bpe.encode_single_piece, ids.tolist()

    def _merged(self, word: bytes) -> bytes | None:
        """Ids of a word of Latin letters; None for others."""
        if word.isalpha():  # of bytes: ASCII letters
            low = word.lower()
        else:
            text = word.decode()
            if not text.isalpha() or max(text) > self.LAST_LATIN:
                return None
            low = text.lower().encode()
        ranks = self.merge(low + b"\xff")
        return struct.pack(f"<{len(ranks)}I", *map(self.ids.__getitem__, ranks))

    def __missing__(self, word: bytes) -> bytes:
        made = self._merged(word) if self.merge else None
        if made is None and self.merge:
            # the tokeniser parts letters from what is none: marks around them are units of their own
            core = word.strip(self.MARKS)
            if core and len(core) < len(word) and (made := self._merged(core)) is not None:
                at = word.index(core)
                made = (self[word[:at]] if at else b"") + made + (self[word[at + len(core) :]] if at + len(core) < len(word) else b"")
        if made is None:
            made = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = made
        return made


class WordEncoder:
    """Ids of a text as packed numbers, word by word."""

    def __init__(self, path: str) -> None:
        self.memo = WordIds(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.memo.__getitem__, t.encode().split())) for t in texts]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; ``row`` numbers the input rows, so that repeated ids stay apart."""
    small_batches(docs.sparkSession)
    name = vocabulary(docs.sparkSession, path)
    names = [x.split()[0] for x in PIECES.split(", ")]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        path = SparkFiles.get(name)
        e = worker_memo(path, lambda: WordEncoder(path))
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids = batch.column(0).to_pylist()
            for doc, row, packed in zip(ids, batch.column(1).to_pylist(), e.encode(batch.column(2).to_pylist()), strict=True):
                packed += end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, row, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, PIECES)


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], room: list[int]) -> None:
    """Put the items, largest first, each into the bin with the least sufficient room; opens bins at need."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    capacity = CAPACITY
    for i in sorted(items, key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            left, b = free.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        room[b] = left - size
        if room[b]:
            bisect.insort(free, (room[b], b))


def fresh_packing(sizes: list[int], rng: random.Random | None) -> list[list[int]]:
    """Best-fit decreasing; with a generator, around a random half of the pieces packed in random order."""
    bins: list[list[int]] = []
    room: list[int] = []
    if rng is None:
        best_fit(list(range(len(sizes))), sizes, bins, room)
        return bins
    head = rng.sample(range(len(sizes)), len(sizes) // 2)
    for i in head:
        if bins and room[-1] >= sizes[i]:
            bins[-1].append(i)
            room[-1] -= sizes[i]
        else:
            bins.append([i])
            room.append(CAPACITY - sizes[i])
    taken = set(head)
    best_fit([i for i in range(len(sizes)) if i not in taken], sizes, bins, room)
    return bins


def filling(bins: list[list[int]], sizes: list[int]) -> list[int]:
    at = sizes.__getitem__
    return [sum(map(at, b)) for b in bins]


def fitness(bins: list[list[int]], sizes: list[int]) -> tuple[int, float]:
    """Fewer bins, then fuller ones (squares reward uneven filling, which frees whole bins)."""
    return -len(bins), sum(f * f for f in filling(bins, sizes)) / CAPACITY**2


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], rng: random.Random) -> list[list[int]]:
    """A child of ``a`` that takes over whole well-filled bins of ``b``: a random part of the better half. Bins of
    ``a`` that hold a piece of them go, as do its two emptiest, and their other pieces are best-fitted."""
    full = filling(b, sizes)
    order = sorted(range(len(b)), key=full.__getitem__, reverse=True)
    share = rng.uniform(0.05, 0.6)
    take = [b[k] for k in order[: max(1, len(b) // 2)] if rng.random() < share]
    inside = {i for x in take for i in x}
    kept, displaced = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in inside]
    fill = filling(kept, sizes)
    for k in sorted(sorted(range(len(kept)), key=fill.__getitem__)[:2], reverse=True):
        displaced += kept.pop(k)
    bins = [list(x) for x in take] + [list(x) for x in kept]
    room = [CAPACITY - f for f in filling(bins, sizes)]
    best_fit(displaced, sizes, bins, room)
    return bins


def evolve(sizes: list[int], elite: list[list[list[int]]], rng: random.Random, island: int = 0, generations: int = GENERATIONS, population: int = POPULATION, stall: int = STALL) -> list[list[int]]:
    """The best packing found from ``elite`` (packings of the epoch before) or, in the first epoch, from the
    island's own start."""
    least = -(-sum(sizes) // CAPACITY)
    best = fresh_packing(sizes, None)
    if not elite and len(best) <= least:
        return best
    score = lambda x: fitness(x, sizes)
    group = [(score(x), x) for x in elite]
    if not group and island == 0:
        group = [(score(best), best)]
    if any(-s[0] <= least for s, _ in group):
        return max(group, key=lambda x: x[0])[1]
    while len(group) < population:
        made = fresh_packing(sizes, rng)
        group.append((score(made), made))
    group.sort(key=lambda x: x[0], reverse=True)
    still = 0
    for _ in range(generations):
        if -group[0][0][0] <= least or still >= stall:
            break
        before = group[0][0][0]
        children = []
        for _ in range(population // 2):  # two tournaments of two choose the parents
            x, y = (min(rng.sample(range(len(group)), 2)) for _ in range(2))
            made = crossover(group[x][1], group[y if y != x else (x + 1) % len(group)][1], sizes, rng)
            children.append((score(made), made))
        # equal scores are one packing in effect: keeping one of them keeps the group diverse
        ranked = sorted(group + children, key=lambda x: x[0], reverse=True)
        distinct = [x for k, x in enumerate(ranked) if not k or x[0] != ranked[k - 1][0]]
        group = (distinct + [x for k, x in enumerate(ranked) if k and x[0] == ranked[k - 1][0]])[:population]
        still = 0 if group[0][0][0] > before else still + 1
    return group[0][1]


def _to_array(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _to_bins(array: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(array.max(initial=-1)) + 1)]
    for i, b in enumerate(array.tolist()):
        bins[b].append(i)
    return [b for b in bins if b]


def pack_blocks(pieces: DataFrame, blocks: int, level: int, well_filled: float) -> DataFrame:
    """row, piece, sequence_id (null if its bin was under ``well_filled`` of the capacity), offset."""
    spark = pieces.sparkSession
    small_batches(spark)
    block = F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(blocks)).cast("int")
    lists = materialise(
        pieces.select(block.alias("block"), "row", "piece", "length")
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("row", "piece", F.col("length").cast("int").alias("length")))).alias("items"))
    )
    state = lists.select("block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.col("items.length").alias("sizes"), F.lit(None).cast("array<binary>").alias("elite"))
    schema = "block int, island int, sizes array<int>, elite array<binary>"

    def epoch(batches):
        for batch in batches:
            made = []
            for b, island, sizes, elite in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rng = random.Random(f"{level}/{b}/{island}/{len(elite or [])}")
                group = [_to_bins(np.frombuffer(e, "<i4")) for e in elite or []]
                made.append((b, island, sizes, [_to_array(evolve(sizes, group, rng, island), len(sizes)).tobytes()]))
            cols = list(zip(*made, strict=True)) if made else [()] * 4
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["block", "island", "sizes", "elite"])

    state = state.repartition(blocks * ISLANDS, "block", "island").mapInArrow(epoch, schema)
    for _ in range(EPOCHS - 1):
        # elite migration: every packing also goes to the next island of its block
        moves = state.select("block", F.explode(F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)).alias("island"), "sizes", "elite")
        state = moves.groupBy("block", "island").agg(F.any_value("sizes").alias("sizes"), F.flatten(F.collect_list("elite")).alias("elite")).mapInArrow(epoch, schema)
    winners = state.groupBy("block").agg(F.collect_list(F.element_at("elite", 1)).alias("elite")).join(lists, "block")
    out = "row long, piece int, sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            for b, elite, items in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sizes = [x["length"] for x in items]
                best = max((_to_bins(np.frombuffer(e, "<i4")) for e in elite), key=lambda x: fitness(x, sizes))
                rows: list[tuple] = []
                for k, members in enumerate(best):
                    full = sum(sizes[i] for i in members) >= well_filled * CAPACITY
                    at = 0
                    for i in members:
                        sequence = ((level << 56) | (b << 24) | k) if full else None
                        rows.append((items[i]["row"], items[i]["piece"], sequence, at))
                        at += sizes[i]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row", "piece", "sequence_id", "offset"])

    return winners.select("block", "elite", "items").mapInArrow(place, out)


def pack_pieces(pieces: DataFrame) -> DataFrame:
    """row, piece, sequence_id, offset for every piece. Each level packs what the one before left over in
    poorly filled bins, in a small fraction of its blocks; the last level has one block or little left."""
    full = pieces.filter(F.col("length") == CAPACITY)
    done = full.select("row", "piece", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.filter(F.col("length") < CAPACITY).select("row", "piece", "length")
    count = left.count()
    level = 0
    while count:
        level += 1
        blocks = -(-count // BLOCK_PIECES)
        packed = materialise(pack_blocks(left, blocks, level, 0.0 if blocks == 1 else WELL_FILLED))
        done = done.unionByName(packed.filter("sequence_id is not null"))
        if blocks == 1:
            break
        rest = packed.filter("sequence_id is null").select("row", "piece").join(left, ["row", "piece"])
        rest = materialise(rest)
        before, count = count, rest.count()
        if count > 0.7 * before:  # no more to gain: these bins stand as they are
            again = materialise(pack_blocks(rest, -(-count // BLOCK_PIECES), level + 1, 0.0))
            return done.unionByName(again)
        left = rest
    return done


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    pieces = materialise(cut_pieces(docs, path))
    return pieces.join(pack_pieces(pieces), ["row", "piece"])


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
