"""Token counts attributed to sections by offset mapping.

A document is encoded once, whole. Each token is mapped to a span of characters: from the character of its
first byte to behind the character of its last byte, so a character that several tokens share belongs to the
span of each. Sections are character spans too (here: lines with their line feed, or given fields joined in
order) and never cut a character. Both lists are sorted, so the interval join is a merge by binary search. A
token inside one section counts there; one that crosses a boundary is allocated by a rule:

``most``   the section holding most of its characters, the earlier one on ties (default);
``first``  the section of its first character;
``split``  each section gets the share of the token's characters it holds.

Counts are whole numbers under ``most`` and ``first``; under every rule they sum to the document's tokens.

Defined cases: null or empty text has one empty section with no tokens; repeated rows are counted each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.llm.bpe import MEMO_BYTES, MEMO_PIECES, Codec, load_ranks, merge_piece, vocabulary
from lexcheck.llm.common import small_batches, table, text_or_empty, worker_memo

RULES = ("most", "first", "split")
SCHEMA = "doc_id long, n_tokens long, n_sections long, section_tokens array<double>, boundary_tokens long"


class OffsetMapper:
    """Token byte lengths of a text, with a bounded memo of pieces (lengths as packed bytes)."""

    def __init__(self, path: str, pattern: str) -> None:
        self.codec = Codec(load_ranks(path), pattern)
        self.memo: dict[str, bytes] = {}

    def _lengths(self, piece: str) -> bytes:
        raw = piece.encode()
        back = self.codec.back
        made = np.array([len(back[i]) for i in merge_piece(raw, self.codec.ranks)], "<u4").tobytes()
        if len(raw) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[piece] = made
        return made

    def token_ends(self, text: str) -> np.ndarray:
        """Byte ends of the tokens."""
        memo = self.memo
        packed = b"".join([memo.get(p) or self._lengths(p) for p in self.codec.split(text)])
        return np.cumsum(np.frombuffer(packed, "<u4"), dtype=np.int64)

    def token_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Character starts and ends of the tokens."""
        ends = self.token_ends(text)
        raw = text.encode()
        if len(raw) == len(text):  # a byte a character
            return np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)], ends
        behind = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
        first = np.concatenate(([0], ends[:-1]))[: len(ends)]
        return behind[first] - 1, behind[ends - 1]


def _mapper(path: str, pattern: str) -> OffsetMapper:
    return worker_memo(f"offsets {path} {pattern}", lambda: OffsetMapper(path, pattern))


def line_ends(text: str) -> np.ndarray:
    """Character ends of the lines, each with its line feed; an empty text is one empty line."""
    sizes = [len(line) + 1 for line in text.split("\n")]
    sizes[-1] -= 1
    ends = np.cumsum(sizes, dtype=np.int64)
    return ends[:-1] if len(ends) > 1 and ends[-1] == ends[-2] else ends


def attribute(spans: tuple[np.ndarray, np.ndarray], section_ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int]:
    """(tokens of each section, number of tokens that cross a boundary). The sections tile the text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    starts, ends = spans
    counts = np.zeros(len(section_ends), np.float64)
    if not len(ends):
        return counts, 0
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, ends, "left")
    inside = first == last
    counts += np.bincount(first[inside], minlength=len(counts))
    crossing = np.flatnonzero(~inside)
    if rule == "first":
        counts += np.bincount(first[crossing], minlength=len(counts))
        return counts, len(crossing)
    for t in crossing.tolist():
        sections = np.arange(first[t], last[t] + 1)
        lo = np.maximum(starts[t], np.where(sections, section_ends[sections - 1], 0))
        share = np.maximum(np.minimum(ends[t], section_ends[sections]) - lo, 0)
        if rule == "most":
            counts[sections[share.argmax()]] += 1
        else:
            counts[sections] += share / share.sum()
    return counts, len(crossing)


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "most") -> DataFrame:
    """Per document: its tokens, its lines, the tokens of each line, and the tokens that crossed lines."""
    small_batches(docs.sparkSession)
    name = vocabulary(docs.sparkSession, path)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        mapper = _mapper(SparkFiles.get(name), pattern)
        for batch in batches:
            total, sections, counts, crossed = [], [], [], []
            for text in batch.column(1).to_pylist():
                spans = mapper.token_spans(text)
                made, n = attribute(spans, line_ends(text), rule)
                total.append(len(spans[0]))
                sections.append(len(made))
                counts.append(made)
                crossed.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(sections, pa.int64()), pa.array(counts, pa.list_(pa.float64())), pa.array(crossed, pa.int64())],
                names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def count_field_tokens(rows: DataFrame, key: str, fields: list[str], path: str, pattern: str, rule: str = "most") -> DataFrame:
    """Tokens of each of ``fields`` when they are joined by line feeds and encoded as one text.

    A field owns its text and the line feed after it. Returns the key, ``n_tokens`` and one
    ``tokens_<field>`` column each; null fields are empty."""
    small_batches(rows.sparkSession)
    name = vocabulary(rows.sparkSession, path)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, " + ", ".join(f"`tokens_{f}` double" for f in fields)

    def run(batches):
        mapper = _mapper(SparkFiles.get(name), pattern)
        for batch in batches:
            texts = [batch.column(1 + i).to_pylist() for i in range(len(fields))]
            made = []
            for parts in zip(*texts, strict=True):
                spans = mapper.token_spans("\n".join(parts))
                sizes = np.array([len(p) + 1 for p in parts], np.int64)
                sizes[-1] -= 1
                made.append((len(spans[0]), *attribute(spans, np.cumsum(sizes), rule)[0].tolist()))
            cols = list(zip(*made, strict=True)) if made else [()] * (1 + len(fields))
            kinds = [pa.int64()] + [pa.float64()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [key, "n_tokens"] + [f"tokens_{f}" for f in fields]
            )

    return rows.select(F.col(f"`{key}`"), *[text_or_empty(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)]).mapInArrow(run, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
