"""Byte-level BPE encoding and decoding.

A piece's bytes are the leaves' left ends: leaf i of a segment tree holds the rank of the pair that
starts at live byte position i, each inner node the leftmost minimum below it. A merge takes the root,
joins the pair, drops its right part and updates two leaves, each in O(log n); a piece of n bytes
costs O(n log n) however long it is.

Pieces repeat, so each Python worker memoises them in a table of bounded size; the text of a document
is encoded whole, every match of the split pattern by itself.

Defined cases: null text is empty and gives no tokens; lone surrogates cannot occur in UTF-8 columns;
repeated rows give equal rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.llm.common import small_batches, table, text_or_empty, worker_memo

MEMO_PIECES = 1_000_000  # entries of a worker's memo; it is emptied when full
MEMO_BYTES = 64  # longer pieces are not kept

NO_RANK = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: repeatedly merge the leftmost pair of lowest rank."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if n == 1:
        raise ValueError("a byte is not in the vocabulary")
    get = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    # node = rank * n + position: one comparison orders by rank, then leftmost
    none = NO_RANK * n
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after = list(range(1, n + 1))  # start of the next live part; n: none
    before = list(range(-1, n - 1))
    while True:
        best = tree[1]
        if best >= none:
            break
        i = best % n
        j = after[i]  # the right part, merged away
        end = after[j]
        after[i] = end
        if end < n:
            before[end] = i
        p = before[i]
        updates = [(j, none)]
        if end < n:
            r = get(piece[i : after[end]])
            updates.append((i, none if r is None else r * n + i))
        else:
            updates.append((i, none))
        if p >= 0:
            r = get(piece[p:end])
            updates.append((p, none if r is None else r * n + p))
        for at, value in updates:
            if at >= n - 1:
                continue
            k = size + at
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a <= b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder over a rank table and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.back = ranks, {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[str, int, bytes]] = {}

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in merge_piece(piece.encode(), self.ranks)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.back.__getitem__, ids))

    def _digest(self, piece: str) -> tuple[str, int, bytes]:
        raw = piece.encode()
        ids = merge_piece(raw, self.ranks)
        made = (",".join(map(str, ids)), len(ids), self.decode(ids))
        if len(raw) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[piece] = made
        return made

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, hash of the joined ids, hash of the decoded bytes), a slice of pieces at a time."""
        pieces, memo = self.split(text), self.memo
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        for k in range(0, len(pieces), 1 << 16):
            made = [memo.get(p) or self._digest(p) for p in pieces[k : k + (1 << 16)]]
            if k:
                ids.update(b",")
            ids.update(",".join([m[0] for m in made]).encode())
            decoded.update(b"".join([m[2] for m in made]))
            n += sum([m[1] for m in made])
        return n, ids.hexdigest(), decoded.hexdigest()


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec."""
    return worker_memo(f"codec {path} {pattern}", lambda: Codec(load_ranks(path), pattern))


def vocabulary(spark: SparkSession, path: str) -> str:
    """Ship a vocabulary file with the job (about 1 MB, fixed size); returns its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded: the general form with the ids themselves."""
    small_batches(docs.sparkSession)
    name = vocabulary(docs.sparkSession, path)

    def run(batches):
        c = codec(SparkFiles.get(name), pattern)
        for batch in batches:
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, computed where the text is: no shuffle."""
    small_batches(docs.sparkSession)
    name = vocabulary(docs.sparkSession, path)

    def run(batches):
        c = codec(SparkFiles.get(name), pattern)
        for batch in batches:
            made = [c.digests(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
