"""Bounded-space online packing of tokenised documents into sequences of a fixed size.

Encoding. A byte-level tokeniser whose ids are ranks is run by tiktoken on the tokeniser's own vocabulary, whole texts at a
time, special tokens included; that is several times faster than the tokeniser itself, which takes all others. Tests hold the
ids equal to the tokeniser's.

Packing. Every partition keeps ``OPEN`` windows and reads its documents once, in order. Full pieces of a long document are
sequences of their own. What is left of it goes to the window with the least sufficient room; when none fits and
all windows are open, the fullest is filled to the brim with the piece's head and emitted, and the tail goes on as a
piece of its own. So a partition holds ``OPEN`` windows at a time, whatever its size, and emits full sequences only.

Leftovers. What stands in open windows at a partition's end (at most ``OPEN`` windows, ids included) is merged in
groups of ``GROUP`` windows by the same rule, largest window first, until one group is left. Its last windows are joined end
to end; the rest of under one sequence is cut at powers of two, which need no padding. So nothing is padded.

Defined cases: null or empty texts are the end id alone; null ids are kept; equal rows are pieces of their own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.llm.bpe import vocabulary
from lexcheck.llm.common import materialise, small_batches, table, text_or_empty, worker_memo

CAPACITY = 2048
END_ID = 1
OPEN = 32
GROUP = 4_096
ID = 4  # bytes

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, ids binary"
_KINDS = [pa.int64()] * 8 + [pa.binary()]
_NAMES = [x.split()[0] for x in OUT.split(", ")]


class TextIds:
    """Ids of a text as packed little-endian 32-bit numbers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.pieces = self._pieces(spec)
        if self.pieces is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    def _pieces(self, spec: dict):
        """A tiktoken encoding of the same ids; None for tokenisers that are no plain byte-level BPE."""
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or len(self.special) < len(spec["added_tokens"]):
            return None
        vocab = model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(set(merged)):
            return None  # ids are no ranks
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        letters = {chr(b): b for b in shown}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("byte level", pat_str=words, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> bytes:
        if self.pieces is None:
            return b"".join(i.to_bytes(ID, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self.pieces.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


class Windows:
    """Open windows, packed best-fit; a unit is a list of pieces [doc_id, start, ids, doc_tokens] that stay together if they can.

    ``emit`` gets the pieces of each sequence that is done."""

    def __init__(self, emit, most: int = OPEN, capacity: int = CAPACITY) -> None:
        self.emit, self.most, self.capacity = emit, most, capacity
        self.content: list[list[list]] = []
        self.room: list[tuple[int, int]] = []  # (room, window), sorted

    @staticmethod
    def split(unit: list[list], size: int) -> tuple[list[list], list[list]]:
        """The first ``size`` ids of the unit, and the rest."""
        head: list[list] = []
        for k, (doc, start, ids, total) in enumerate(unit):
            n = len(ids) // ID
            if n > size:
                if size:
                    head.append([doc, start, ids[: size * ID], total])
                return head, [[doc, start + size, ids[size * ID :], total], *unit[k + 1 :]]
            head.append(unit[k])
            size -= n
        return head, []

    def add(self, unit: list[list], size: int) -> None:
        """A unit of at most the capacity."""
        while size:
            at = bisect.bisect_left(self.room, (size, -1))
            if at < len(self.room):
                room, k = self.room.pop(at)
                self.content[k] += unit
                self._put(k, room - size)
                return
            if len(self.content) < self.most:
                self.content.append(list(unit))
                self._put(len(self.content) - 1, self.capacity - size)
                return
            room, k = self.room.pop(0)  # the fullest: its rest is taken from the piece
            head, unit = self.split(unit, room)
            self.content[k] += head
            size -= room
            self._put(k, 0)

    def _put(self, k: int, room: int) -> None:
        if not room:
            self.emit(self.content[k])
            self.content[k], room = [], self.capacity
        bisect.insort(self.room, (room, k))

    def left(self) -> list[list[list]]:
        return [c for c in self.content if c]

    def finish(self) -> None:
        """Emit what is left end to end, the last rest in pieces of powers of two."""
        unit = [p for c in self.left() for p in c]
        size = sum(len(p[2]) // ID for p in unit)
        while size:
            take = min(self.capacity, 1 << (size.bit_length() - 1))
            head, unit = self.split(unit, take)
            self.emit(head)
            size -= take


class Rows:
    """Columns of ``OUT``."""

    def __init__(self, first_sequence: int) -> None:
        self.columns: list[list] = [[] for _ in _NAMES]
        self.next = first_sequence

    def sequence(self, pieces: list[list]) -> None:
        self._put(pieces, self.next, None)
        self.next += 1

    def window(self, pieces: list[list], number: int) -> None:
        self._put(pieces, None, number)

    def _put(self, pieces: list[list], sequence: int | None, window: int | None) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // ID
            crc = zlib.crc32(ids) if window is None else None
            for column, value in zip(self.columns, (doc, start, n, crc, total, sequence, at, window, None if window is None else ids), strict=True):
                column.append(value)
            at += n

    def taken(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, _KINDS, strict=True)], _NAMES)
        self.columns = [[] for _ in _NAMES]
        return made


def pack_partitions(docs: DataFrame, path: str, most: int = OPEN, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows of ``OUT``: pieces of full sequences, and pieces of left windows with their ids and no sequence."""
    small_batches(docs.sparkSession)
    name = vocabulary(docs.sparkSession, path)
    end = end_id.to_bytes(ID, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        encoder = worker_memo(f"ids {path}", lambda: TextIds(path))
        part = TaskContext.get().partitionId()
        rows = Rows(part << 32)
        windows = Windows(rows.sequence, most, capacity)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + end
                total = len(ids) // ID
                full = total - total % capacity
                for at in range(0, full, capacity):
                    rows.sequence([[doc, at, ids[at * ID : (at + capacity) * ID], total]])
                windows.add([[doc, full, ids[full * ID :], total]], total - full)
            yield rows.taken()
        for k, pieces in enumerate(windows.left()):
            rows.window(pieces, (part << 32) | k)
        yield rows.taken()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, OUT)


def merge_windows(left: DataFrame, level: int, groups: int, most: int = OPEN, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``OUT`` again: the left windows of each group packed into full sequences; the last group leaves nothing."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        group = key[0].as_py()
        units: dict[int, list[tuple]] = {}
        for doc, start, total, at, window, ids in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "offset", "window", "ids")), strict=True):
            units.setdefault(window, []).append((at, [doc, start, ids, total]))
        made = Rows((level << 58) | (group << 32))
        windows = Windows(made.sequence, most, capacity)
        sized = [(-sum(len(p[2]) // ID for _, p in u), w, [p for _, p in sorted(u, key=lambda x: x[0])]) for w, u in units.items()]
        for size, _, unit in sorted(sized, key=lambda x: x[:2]):
            windows.add(unit, -size)
        if groups == 1:
            windows.finish()
        else:
            for k, pieces in enumerate(windows.left()):
                made.window(pieces, (level << 58) | (group << 32) | k)
        return pa.Table.from_batches([made.taken()])

    group = F.pmod(F.xxhash64("window", F.lit(level)), F.lit(groups)).alias("group")
    return left.select(group, "doc_id", "start", "doc_tokens", "offset", "window", "ids").groupBy("group").applyInArrow(run, OUT)


def pack_online(docs: DataFrame, path: str, most: int = OPEN, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    columns = _NAMES[:7]
    packed = materialise(pack_partitions(docs, path, most, capacity, end_id))
    done = packed.filter("sequence_id is not null").select(*columns)
    level = 0
    while True:
        left = packed.filter("sequence_id is null")
        count = left.select("window").distinct().count()
        if not count:
            return done
        level += 1
        groups = -(-count // max(GROUP, 8 * most))
        packed = materialise(merge_windows(left, level, groups, most, capacity))
        done = done.unionByName(packed.filter("sequence_id is not null").select(*columns))
        if groups == 1:
            return done


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_online(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
