"""Substring dedup: words covered by a 20-word window that also starts earlier in the corpus are removed.

Every removal is an answer of an FM-index search. Filters bring to the indexes only what can repeat:

1.  Every window has an anchor, the least hash among its 15 six-word grams. Blocks of documents post their
    distinct anchors to ranges of the hash space; the ranges answer which ones repeat. Only the
    neighbourhoods of repeating anchors (spans) go on.
2.  In them the same exchange is made for every six-word gram. A window can repeat only inside a run of
    repeating grams, so spans are cut to runs; contexts that differ are gone, which bounds how
    many different pieces a very frequent passage can leave.
3.  A run is cut into pieces, each the windows of one anchor. Patterns are searched once: equal runs are cut
    once, equal pieces are one pattern. Patterns are dealt to shards by their anchor, so all texts that
    hold a window meet in one shard; an anchor with very many different pieces is cut into single windows,
    which are dealt by their words.
4.  A shard builds the FM-index of its patterns, each at the least place it has in the corpus, and streams them
    through it. Where the matching statistic reaches the window's length, the suffix range's window group
    tells the earliest place of that window.
5.  Every place of a pattern is held against these answers: a window whose earliest place is before its own is
    removed. A run that repeats another is removed where the latest of its windows' earliest places is
    before it. Without an answer from the search nothing is removed.
6.  The intervals found are joined to the texts and the covered words are removed.

Exchanges carry packed arrays, a block's answer each: a hash that a third of all documents share costs
every block eight bytes. Blocks, ranges and shards grow in number with the input, not in size.

Words are compared as 64-bit hashes. Defined cases: null and empty texts have no words and hash the
empty string; rows without an id come last in the order and keep a null id; rows that repeat an id
stand at the same place, so neither removes the other; texts under 20 words lose nothing; extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.llm.common import NO_ID, blocks_for, discard, gathered, materialise, small_batches, table, text_or_empty
from lexcheck.llm.fm_index import FMIndex
from lexcheck.llm.words import WordArrays, gram_hashes

WINDOW, GRAM = 20, 6
SPAN = WINDOW - GRAM + 1  # grams of a window
BLOCK_BYTES = 7 << 19  # of text
BLOCKS_A_RANGE = 16  # a range of the hash space answers what so many blocks post: about 10 MB
SHARD_PIECES = 6_000
HOT_ANCHOR = 2_000  # an anchor with more different pieces is cut into single windows

_LOW = np.uint64(1)


class Words(WordArrays):
    """The words of some texts on end, and their six-word grams. ``doc`` is the text of each word."""

    def __init__(self, texts: list[str]) -> None:
        super().__init__([t.encode() for t in texts])
        total = len(self.hashes)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths)
        self.grams = gram_hashes(self.hashes, GRAM) & ~_LOW  # the low bit marks repeats in postings
        n = max(0, total - WINDOW + 1)
        self.whole = self.doc[:n] == self.doc[WINDOW - 1 : WINDOW - 1 + n]  # windows inside one text
        self.gram_whole = self.doc[: len(self.grams)] == self.doc[GRAM - 1 : GRAM - 1 + len(self.grams)]

    def anchors(self) -> np.ndarray:
        """The gram position of every window's least hash, the leftmost on ties: minima over 2, 4, 8 grams
        give those over 15."""
        n = len(self.whole)
        if not n:
            return np.zeros(0, np.int32)
        low, at = self.grams, np.arange(len(self.grams), dtype=np.int32)
        for step in (1, 2, 4, SPAN - 8):
            right = low[step:] < low[:-step]
            low = np.where(right, low[step:], low[:-step])
            at = np.where(right, at[step:], at[:-step])
        return at[:n]

    def chosen(self) -> np.ndarray:
        """The distinct anchor positions of all windows."""
        at = self.anchors()[self.whole]
        return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at


def _post(hashes: np.ndarray, ranges: int) -> list[tuple[int, bytes]]:
    """Distinct hashes by range; the low bit says that the block itself holds the hash twice."""
    values, counts = np.unique(hashes, return_counts=True)
    values |= (counts > 1).astype(np.uint64)
    place = ((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    used, first = np.unique(place, return_index=True)
    cuts = np.append(first, len(values)).tolist()
    return [(p, values[x:y].tobytes()) for p, x, y in zip(used.tolist(), cuts[:-1], cuts[1:], strict=True)]


def _numbers(column: pa.ChunkedArray, kind=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), kind) for chunk in column.chunks for c in chunk]


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(schema, columns, strict=True)})


def _answers(posted: DataFrame) -> DataFrame:
    """(b, blob) of the hashes that repeat, for ``posted(p, b, blob)``."""

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        blocks = rows.column("b").to_pylist()
        lists = _numbers(rows.column("blob"))
        every = np.sort(np.concatenate(lists))
        plain = every & ~_LOW
        again = (every & _LOW).astype(bool)
        again[1:] |= plain[1:] == plain[:-1]
        repeating = np.unique(plain[again])
        out = []
        for b, mine in zip(blocks, lists, strict=True):
            mine = mine & ~_LOW
            at = np.searchsorted(repeating, mine)
            at[at == len(repeating)] = 0
            found = mine[repeating[at] == mine] if len(repeating) else mine[:0]
            if len(found):
                out.append((b, found.tobytes()))
        return _table([("b", pa.int32()), ("blob", pa.binary())], out)

    return posted.select("p", "b", "blob").groupBy("p").applyInArrow(answer, "b int, blob binary")


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _known(replies: pa.Table) -> np.ndarray:
    lists = _numbers(replies.column("blob"))
    return np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)


def _text_key(text: str) -> int:
    """Spark's ``xxhash64(text)``: tells rows that repeat an id apart."""
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).astype(np.int64))


def _runs(flags: np.ndarray, border: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; a run also ends where ``border`` is set."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = flags.copy(), flags.copy()
    starts[1:] &= ~flags[:-1]
    ends[:-1] &= ~flags[1:]
    if border is not None:
        starts |= flags & border[: len(flags)]
        ends |= flags & border[1 : len(flags) + 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


FOUND = [("b", pa.int32()), ("p", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("text", pa.string())]
FOUND_SQL = "b int, p int, blob binary, doc_id long, text_key long, start int, text string"
RUN = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.binary()), ("text", pa.string())]
RUN_SQL = "doc_id long, text_key long, start int, n int, key binary, text string"
PIECE = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.binary()), ("anchor", pa.int64()), ("words", pa.binary()), ("run", pa.binary()), ("run_start", pa.int32())]
PIECE_SQL = "doc_id long, text_key long, start int, n int, key binary, anchor long, words binary, run binary, run_start int"
TAKEN_SQL = "doc_id long, text_key long, start int, stop int, run binary, late_doc long, late_start int"
RESULT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text_key", pa.int64()), ("kept_text", pa.string())]
RESULT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, text_key long, kept_text string"


def _post_anchors(blocked: DataFrame, ranges: int) -> DataFrame:
    def post(key: tuple, rows: pa.Table) -> pa.Table:
        words = Words(rows.column("text").to_pylist())
        b = key[0].as_py()
        return _table([("p", pa.int32()), ("b", pa.int32()), ("blob", pa.binary())], [(p, b, blob) for p, blob in _post(words.grams[words.chosen()], ranges)])

    return blocked.groupBy("b").applyInArrow(post, "p int, b int, blob binary")


def _find_spans(blocked: DataFrame, replies: DataFrame, ranges: int) -> DataFrame:
    """The spans around repeating anchors with their words (p is null) and the posted grams in them."""

    def find(key: tuple, rows: pa.Table, answered: pa.Table) -> pa.Table:
        b, ids, texts = key[0].as_py(), rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        words = Words(texts)
        anchors = words.chosen()
        hits = anchors[_member(words.grams[anchors], _known(answered))]
        near = np.zeros(len(words.hashes) + 1, np.int64)
        begin = words.begin[words.doc[hits]]
        end = begin + words.lengths[words.doc[hits]]
        np.add.at(near, np.maximum(begin, hits - (WINDOW - GRAM)), 1)
        np.add.at(near, np.minimum(end, hits + WINDOW), -1)
        near = np.cumsum(near)[:-1] > 0
        border = np.zeros(len(near) + 1, bool)
        border[words.begin] = True  # a span ends with its text
        lo, hi = _runs(near, border)
        out: list[tuple] = []
        hashed: dict[int, int] = {}
        for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
            k = int(words.doc[x])
            if k not in hashed:
                hashed[k] = _text_key(texts[k])
            first = x - int(words.begin[k])
            out.append((b, None, None, ids[k], hashed[k], first, words.text(x, y)))
        n = len(words.grams)
        inside = words.gram_whole & near[:n] & near[GRAM - 1 : GRAM - 1 + n]
        out.extend((b, p, blob, None, None, None, None) for p, blob in _post(words.grams[inside], ranges))
        return _table(FOUND, out)

    return blocked.groupBy("b").cogroup(replies.groupBy("b")).applyInArrow(find, FOUND_SQL)


def _cut_runs(spans: DataFrame, replies: DataFrame) -> DataFrame:
    """Runs of at least a window in which every gram repeats, keyed by their words."""

    def cut(key: tuple, rows: pa.Table, answered: pa.Table) -> pa.Table:
        words, known = Words(rows.column("text").to_pylist()), _known(answered)
        flags = words.gram_whole.copy()
        at = np.flatnonzero(flags)
        flags[at] = _member(words.grams[at], known)
        border = np.zeros(len(flags) + 1, bool)
        border[words.begin[words.begin <= len(flags)]] = True
        lo, hi = _runs(flags, border)
        long = hi - lo >= SPAN
        ids, keys, starts = (rows.column(c).to_pylist() for c in ("doc_id", "text_key", "start"))
        raw = words.hashes.tobytes()
        out = []
        for x, y in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
            k, y = int(words.doc[x]), y + GRAM - 1
            first = x - int(words.begin[k])
            made = hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest()
            out.append((ids[k], keys[k], starts[k] + first, y - x, made, words.text(x, y)))
        return _table(RUN, out)

    return spans.select("b", "doc_id", "text_key", "start", "text").groupBy("b").cogroup(replies.groupBy("b")).applyInArrow(cut, RUN_SQL)


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _cut_pieces(runs: DataFrame) -> DataFrame:
    """The pieces of runs: the windows of one anchor, keyed by their words."""
    names = [n for n, _ in PIECE]

    def cut(batches):
        for batch in gathered(batches, size=2 << 20):
            words = Words(batch.column(3).to_pylist())
            windows = np.flatnonzero(words.whole)
            anchors = words.anchors()[windows]
            new = np.ones(len(windows), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (windows[1:] != windows[:-1] + 1)
            first = np.flatnonzero(new)
            counts = np.diff(np.concatenate((first, [len(windows)]))).astype(np.int32) + (WINDOW - 1)
            starts = windows[first]
            raw = words.hashes.tobytes()
            parts = [raw[8 * s : 8 * (s + c)] for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]
            run = words.doc[starts]
            begun = batch.column(2).to_numpy()[run]
            place = begun + (starts - words.begin[run])
            made = [pa.array(batch.column(0).to_numpy()[run]), pa.array(batch.column(1).to_numpy()[run]), pa.array(place.astype(np.int32)), pa.array(counts)]
            made += [pa.array([_digest(x) for x in parts], pa.binary()), pa.array(words.grams[anchors[first]].astype(np.int64)), pa.array(parts, pa.binary())]
            made += [batch.column(4).take(pa.array(run)), pa.array(begun.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(made, names)

    return runs.select("doc_id", "text_key", "start", "text", "key").mapInArrow(cut, PIECE_SQL)


def _cut_windows(pieces: DataFrame) -> DataFrame:
    """Single windows of pieces, anchored by their own words."""
    names = [n for n, _ in PIECE]

    def cut(batches):
        for batch in batches:
            at, starts, parts = [], [], []
            for i, (start, n, words) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                for o in range(n - WINDOW + 1):
                    at.append(i)
                    starts.append(start + o)
                    parts.append(words[8 * o : 8 * (o + WINDOW)])
            keys = [_digest(x) for x in parts]
            same = batch.take(pa.array(at, pa.int64()))
            anchors = [int.from_bytes(k[:8], "little", signed=True) for k in keys]
            made = [same.column(0), same.column(1), pa.array(starts, pa.int32()), pa.array([WINDOW] * len(at), pa.int32()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*made, pa.array(anchors, pa.int64()), pa.array(parts, pa.binary()), same.column(7), same.column(8)], names)

    return pieces.select(*names).mapInArrow(cut, PIECE_SQL)


def search_shard(words: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For patterns at their first places: the document and the start (-1: not found) of each window's earliest
    place, all patterns on end, and the number of each one's windows."""
    lengths = np.array([len(w) for w in words], np.int64)
    every = np.concatenate(words)
    owner = np.repeat(np.arange(len(words)), lengths)
    offset = np.arange(len(every)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    begins = offset <= lengths[owner] - WINDOW
    docs, starts = doc[owner], start[owner] + offset
    order = np.lexsort((starts, docs))
    fresh = np.concatenate(([True], (np.diff(docs[order]) != 0) | (np.diff(starts[order]) != 0)))
    rank = np.empty(len(every), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    index = FMIndex(every, lengths, np.where(begins, rank, FMIndex.NOWHERE), WINDOW)
    _, place = index.stream(every, lengths)
    place = place[begins]
    found = place != FMIndex.NOWHERE
    at = order[fresh][np.where(found, place, 0)]  # a word at that place
    return docs[at], np.where(found, starts[at], -1).astype(np.int32), lengths - WINDOW + 1


def _searched(patterns: DataFrame) -> DataFrame:
    """key, docs, starts: the earliest place of each window of each pattern of ``patterns(shard, key, doc_id, start,
    words)``."""

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        doc, start = rows.column("doc_id").to_numpy(), rows.column("start").to_numpy().astype(np.int64)
        docs, starts, counts = search_shard(_numbers(rows.column("words")), doc, start)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (docs, starts)]
        return pa.table({"key": rows.column("key"), "docs": lists[0], "starts": lists[1]})

    return patterns.groupBy("shard").applyInArrow(search, "key binary, docs array<long>, starts array<int>")


def earlier_windows(doc, start, offset: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows, ``offset`` words into a piece at (doc, start), start earlier elsewhere, by the search's
    answers."""
    return (starts >= 0) & ((docs < doc) | ((docs == doc) & (starts < start + offset)))


def take_intervals(doc: np.ndarray, start: np.ndarray, docs: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window, last window) of the runs of windows that start earlier elsewhere, for pieces at (doc,
    start) with the answers of their windows on end."""
    begin = np.cumsum(counts) - counts
    piece = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(piece)) - begin[piece]
    earlier = earlier_windows(doc[piece], start[piece], offset, docs, starts)
    border = np.zeros(len(piece) + 1, bool)
    border[begin] = True
    lo, hi = _runs(earlier, border)
    return piece[lo], offset[lo], offset[hi - 1] if len(hi) else hi


def latest_places(docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the latest of its windows' earliest places, moved back to its run's start, which is ``ahead``
    words before the piece; NO_ID where a window was not found."""
    begin = np.cumsum(counts) - counts
    piece = np.repeat(np.arange(len(counts)), counts)
    docs = np.where(starts < 0, NO_ID, docs)
    moved = starts - (np.arange(len(piece)) - begin[piece]) - ahead[piece]
    last = np.maximum.reduceat(docs, begin)
    return last, np.maximum.reduceat(np.where(docs == last[piece], moved, np.iinfo(np.int32).min), begin)


def _taken(placed: DataFrame) -> DataFrame:
    """The intervals of pieces at their places and, for runs, the latest places of their pieces."""
    names = [x.split()[0] for x in TAKEN_SQL.split(", ")]

    def take(batches):
        for batch in gathered(batches):
            doc, text, start = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy().astype(np.int64)
            counts = np.diff(batch.column(5).offsets.to_numpy()).astype(np.int64)
            docs, starts = batch.column(5).flatten().to_numpy(), batch.column(6).flatten().to_numpy().astype(np.int64)
            piece, lo, hi = take_intervals(doc, start, docs, starts, counts)
            at = pa.array(piece)
            none = lambda kind, n: pa.nulls(n, kind)
            ends = [pa.array((start[piece] + lo).astype(np.int32)), pa.array((start[piece] + hi + WINDOW).astype(np.int32))]
            n = len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(doc[piece]), text.take(at), *ends, none(pa.binary(), n), none(pa.int64(), n), none(pa.int32(), n)], names)
            last, moved = latest_places(docs, starts, counts, start - batch.column(4).to_numpy())
            n = len(counts)
            yield pa.RecordBatch.from_arrays([*(none(k, n) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32())), batch.column(3), pa.array(last), pa.array(moved.astype(np.int32))], names)

    return placed.select("doc_id", "text_key", "start", "run", "run_start", "docs", "starts").mapInArrow(take, TAKEN_SQL)


def _removed(joined: DataFrame, keep_text: bool) -> DataFrame:
    names = [n for n, _ in RESULT]

    def remove(batches):
        for batch in batches:
            out = []
            for doc, text, key, gone in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = text.encode().split()
                n, kept = 0, words
                if gone:
                    edges = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edges, [g["start"] for g in gone], 1)
                    np.add.at(edges, [g["stop"] for g in gone], -1)
                    keep = np.cumsum(edges)[:-1] == 0
                    n = len(words) - int(keep.sum())
                    kept = list(compress(words, keep.tolist()))
                changed = (key, b" ".join(kept).decode()) if keep_text and n else (None, None)
                out.append((doc, len(words), n, hashlib.sha256(b" ".join(kept)).hexdigest(), *changed))
            table = _table(RESULT, out)
            yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], names)

    return joined.mapInArrow(remove, RESULT_SQL)


def repeated_intervals(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, start, stop in words, for ``rows(doc_id, text)`` without nulls."""
    spark = rows.sparkSession
    blocks = blocks_for(rows, BLOCK_BYTES)
    blocked = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("b"), "doc_id", "text")
    ranges = max(48, blocks // BLOCKS_A_RANGE)
    anchors = materialise(_answers(_post_anchors(blocked, ranges)))
    found = materialise(_find_spans(blocked, anchors, ranges))
    discard(anchors)
    grams = _answers(found.filter("p is not null"))
    runs = materialise(_cut_runs(found.filter("p is null"), grams))
    discard(found)
    first_runs = runs.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("at"))
    marked = runs.join(first_runs, "key").withColumn("first", F.struct("doc_id", "start") == F.col("at"))
    pieces = materialise(_cut_pieces(marked.filter("first")))
    patterns = _patterns(pieces)
    hot = materialise(patterns.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ANCHOR).select("anchor"))
    if not hot.isEmpty():
        cut = materialise(pieces.join(hot, "anchor", "left_anti").select(pieces.columns).unionByName(_cut_windows(pieces.join(hot, "anchor", "left_semi"))))
        discard(pieces, patterns)
        pieces, patterns = cut, _patterns(cut)
    shards = max(1, -(-patterns.count() // SHARD_PIECES))
    dealt = patterns.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"), "key", "at.doc_id", "at.start", "words")
    answers = materialise(_searched(dealt))
    taken = materialise(_taken(pieces.drop("words").join(answers, "key")))
    late = F.max(F.struct("late_doc", "late_start")).alias("late")
    by_run = taken.filter("run is not null").groupBy(F.col("run").alias("key")).agg(late)
    later = marked.filter("not first").select("key", "doc_id", "text_key", "start", "n").join(by_run, "key")
    later = later.filter(F.col("late") < F.struct(F.col("doc_id").alias("late_doc"), F.col("start").alias("late_start")))
    columns = ["doc_id", "text_key", "start", "stop"]
    found = taken.filter("run is null").select(columns).unionByName(later.withColumn("stop", F.col("start") + F.col("n")).select(columns))
    intervals = materialise(found)
    discard(runs, pieces, patterns, hot, answers, taken)
    return intervals


def _patterns(pieces: DataFrame) -> DataFrame:
    """key, at (the first place), anchor, words: one row per different piece."""
    place = F.min(F.struct("doc_id", "start")).alias("at")
    return materialise(pieces.groupBy("key").agg(place, F.any_value("anchor").alias("anchor"), F.any_value("words").alias("words")))


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text with text_key, the
    ``xxhash64`` of the text it replaces (both null where nothing was removed)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty().alias("text"))
    by_text = repeated_intervals(rows).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    joined = rows.withColumn("text_key", F.xxhash64("text")).join(by_text.hint("shuffle_hash"), ["doc_id", "text_key"], "left")
    out = _removed(joined.select("doc_id", "text", "text_key", "gone"), keep_text)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, same columns: covered words are gone from ``text`` (what is left is joined by
    single blanks), ``n_chars`` follows, every row stays, texts that nothing covers stay as they are."""
    changed = remove_repeats(docs, keep_text=True).filter("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("kept_text").alias("__kept")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__key"))
    made = docs.join(changed, same, "left").withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("__kept").isNotNull(), F.char_length("__kept").cast("long")).otherwise(F.col("n_chars")))
    return made.select(docs.columns)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
