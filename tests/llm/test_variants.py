from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexcheck.llm import variants
from lexcheck.llm.variants import Automaton


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(docs: list[tuple]) -> dict[str, tuple]:
    counts: Counter = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            counts[low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: sorted((-n[x], x) for x in n if one_apart(w, x)) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 10 * n[w] else None for w in n}

    def root(w: str) -> str:
        while form[w]:
            w = form[w]
        return w

    return {w: (w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows(frame) -> dict:
    return {r.word: (r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def made_docs(seed: int, letters: str = "abé") -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(6, 10))) for _ in range(60)]
    weights = [rng.choice([1, 1, 2, 30, 400]) for _ in words]
    docs = [(i, " ".join(rng.choices(words, weights, k=150)) + rng.choice(["", "9", "\n"])) for i in range(30)]
    return [*docs, docs[0], docs[0], (77, None), (None, docs[1][1]), (78, ""), (79, "Straßenbahn STRASSENBAHN ÀÀÀÀÀÀÀ àààààà 中文中文中文中文")]


@given(st.sets(st.text("ab", min_size=1, max_size=7), max_size=60), st.integers(0, 7))
@settings(max_examples=200, deadline=None)
def test_automaton_numbers_and_completes(words, exact):
    pool = sorted(words)
    machine = Automaton(pool)
    assert [machine.number(w) for w in pool] == list(range(len(pool)))
    assert machine.number("c") is None
    for w in pool:
        h = min(exact, len(w))
        found = machine.near(w, h)
        assert sorted(found) == [k for k, x in enumerate(pool) if one_apart(w, x) and x[:h] == w[:h]]
        assert len(found) == len(set(found))


def test_automaton_is_minimal():
    """No two states accept the same endings, and no state could be part of an edge."""
    machine = Automaton(sorted({a + b + c for a in ("be", "de", "fe") for b in ("at", "ar") for c in ("", "ing", "ings")}))

    def endings(s):
        final, edges = machine.states[s]
        return frozenset(([""] if final else []) + [letters + e for letters, t, _ in edges.values() for e in endings(t)])

    every = [endings(s) for s in range(len(machine.states))]
    assert len(set(every)) == len(every)
    assert all(final or len(edges) > 1 or s == machine.root for s, (final, edges) in enumerate(machine.states))
    assert len(machine.states) == 5  # the start, behind the first letters, behind the stem, after -ing, the end


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_match_brute_force(spark, seed):
    docs = made_docs(seed)
    want = expected(docs)
    assert any(x[1] for x in want.values())
    frame = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, word string, n int")
    assert rows(variants.variants_of(frame)) == want


def test_hot_halves_and_small_shards_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join("commonhalf" + "".join(rng.choices("ab", k=rng.randint(8, 10))) for _ in range(120))) for i in range(20)]
    monkeypatch.setattr(variants, "SHARD_LETTERS", 900)
    monkeypatch.setattr(variants, "MOST_LETTERS", 1800)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    words = variants.distinct_words(frame)
    dealt = variants._dealt(words)
    assert dealt.filter("shard.key <> -1").count() > dealt.filter("shard.key = -1").count()  # most rows stand in hot halves
    assert dealt.filter("asks").groupBy("shard", "backward").agg({"*": "count"}).count() > 4
    assert rows(variants.variants_of(frame)) == expected(docs)


def test_chains_of_forms_and_ties(spark):
    n = {"aaaaaaa": 20_000, "aaaaaab": 1_500, "aaaaabb": 100, "aaaabbb": 8, "aaaaacb": 8, "zzzzzzz": 20, "yzzzzzz": 20, "xzzzzzz": 2, "wwwwwwwww": 2}
    found = rows(variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert found["aaaabbb"][1:3] == ("aaaaabb", "aaaaaaa")
    assert found["aaaaacb"][1:3] == ("aaaaaab", "aaaaaaa")  # two are near, the more frequent wins
    assert found["xzzzzzz"][1:] == ("yzzzzzz", "yzzzzzz", 2, 2, 20)
    assert found["wwwwwwwww"][1:] == (None, "wwwwwwwww", 2, 0, None)


def test_empty_table_and_very_long_words(spark):
    assert variants.variants_of(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "ab" * 100_000
    frame = spark.createDataFrame([(i, t) for i in range(4) for t in (long, long + "c", long[1:])], "doc_id long, text string").repartition(2)
    counts = variants.distinct_words(frame, drop_every=2**40)  # nothing is left out
    found = {len(r.word): r.n_near for r in variants.group_variants(counts).collect()}
    assert found == {200_000: 2, 200_001: 1, 199_999: 1}
