from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexcheck.llm import online_packing as packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a b", "a  b", "a\n b", "a \n b", "a\t b", "it's we'll I'D", "x" * 300_000, "été ß Straße", "漢字 かな", "  a b", "a  b",
    "<|endoftext|>", "a <|endoftext|> b", "<|endof", "1 234 5", "\x1c a \x1c", "é ́", "‍👩‍👩‍👧 👍🏽", "a\r\n b\r\n", "don't can't  won't", " ".join("w%d" % i for i in range(900)),
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def test_ids_equal_the_librarys(tokenizer):
    encoder = packing.TextIds(PATH)
    for text in TEXTS:
        assert encoder.encode(text) == packed(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]) | st.sampled_from(" \n\t'sabé"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_ids_of_any_text(tokenizer, text):
    encoder = packing.worker_memo("test ids", lambda: packing.TextIds(PATH))
    assert encoder.encode(text) == packed(tokenizer.encode(text, add_special_tokens=False).ids)


def check(found: list, want: dict[int, list[list[int]]], capacity: int) -> list[int]:
    """The sequences' lengths; ``want`` has the ids of every row of a document id."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc, rows in want.items():
        assert sum(p[1] for p in pieces[doc]) == sum(map(len, rows))
        if len(rows) == 1:
            at = 0
            for start, length, crc, total in sorted(pieces[doc]):
                assert start == at and length > 0 and total == len(rows[0]) and crc == zlib.crc32(packed(rows[0][at : at + length]))
                at += length
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        lengths.append(at)
    return lengths


@pytest.mark.parametrize(("most", "group", "parts"), [(32, 4096, 3), (2, 16, 24)])
def test_packing_holds_every_id_once_and_pads_nothing(spark, tokenizer, monkeypatch, most, group, parts):
    monkeypatch.setattr(packing, "GROUP", group)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["word", "Straße", "x1", "été"], k=rng.choice([1, 3, 40, 300, 900])))) for i in range(300)]
    docs += [(400 + i, t) for i, t in enumerate(TEXTS)] + [(500, None), (None, "no id"), (7_000, "twice"), (7_000, "twice")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"offset": F.lit(1), "window": F.lit("x"), "ids": F.lit(0)}).repartition(parts)
    want: dict = {}
    for doc, text in docs:
        want.setdefault(doc, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID])
    lengths = check(packing.pack_online(frame, PATH, most=most).collect(), want, packing.CAPACITY)
    odd = [n for n in lengths if n != packing.CAPACITY]
    assert all(n & (n - 1) == 0 for n in odd) and len(set(odd)) == len(odd)  # the binary digits of the rest


def test_windows_are_bounded_and_a_sequence_costs_one_cut_at_most():
    rng = random.Random(1)
    sizes = [rng.randint(20, 900) for _ in range(4_000)]
    done: list = []
    windows = packing.Windows(done.append)
    for i, n in enumerate(sizes):
        windows.add([[i, 0, bytes(4 * n), n]], n)
        assert len(windows.content) <= packing.OPEN
    windows.finish()
    cuts = sum(len(s) for s in done) - len(sizes)
    assert sum(len(p[2]) // 4 for s in done for p in s) == sum(sizes)
    assert cuts < len(done) + 11  # the rest's powers of two; exact fits save cuts


def test_empty_table(spark):
    assert packing.pack_online(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
