from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexcheck.llm import fm_index, graph, minhash, substrings


def near_brute(rows):
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeats_brute(rows):
    seen, words = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words[i] = (t or "").encode().split()
        for k in range(len(words[i]) - 19):
            seen.setdefault(tuple(words[i][k : k + 20]), (i, k))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 19):
            if seen[tuple(w[k : k + 20])] < (i, k):
                gone.update(range(k, k + 20))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(
    "search",
    [
        minhash.DEFAULT,
        minhash.Search(hot=3, block=5),  # sends the groups through the blocks of long lists
        minhash.Search(hot=3, block_bytes=4_000),
        minhash.EXACT,
    ],
    ids=["default", "hot", "bytes", "exact"],
)
def test_near_duplicates_equal_brute_force(docs, clashing, search):
    want = near_brute(pairs(docs))
    got = minhash.near_duplicates(clashing, search).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_edges(spark, nothing):
    assert minhash.near_duplicates(nothing).isEmpty() and minhash.without_duplicates(nothing).isEmpty()
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (5, None), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (4, 2, 4, True), (5, 0, 5, True), (None, 0, None, True)], key=str)


def test_an_id_on_rows_of_different_texts(spark):
    """Classes of one smallest id stay apart: each is verified with its own set."""
    word = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    rows = [(1, word("a", 60)), (1, word("b", 60)), (2, word("a", 59)), (3, word("b", 59)), (4, word("c", 60)), (3, word("c", 60))]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True), (4, 3, False)]


def test_duplicates_stage_keeps_one_of_each(docs, clashing):
    want = near_brute(pairs(docs))
    kept = minhash.without_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_duplicates_stage_keeps_what_is_no_copy(spark):
    rows = [(None, "same text", "x"), (None, "same text", "x"), (7, "one text", "z"), (7, "one text", "y"), (7, "one text", "y"), (8, "one text", "w"), (7, "other words", "v"), (9, None, None), (9, None, "u")]
    kept = minhash.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    assert got == sorted([(None, "same text", "x"), (None, "same text", "x"), (7, "one text", "y"), (7, "other words", "v"), (9, None, "u")], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 150)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[102] == 100 and got[200] == 150
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3_000).astype(np.uint64)
    sets = [np.unique(base[:2_000]), np.unique(base[200:2_200]), np.unique(base[1_500:])]
    guess = minhash.estimates(np.array([len(s) for s in sets]), [s[:64] for s in sets])
    assert abs(guess[0, 1] - 1_800 / 2_200) < 0.2 and abs(guess[0, 2] - 500 / 3_000) < 0.2


@pytest.mark.parametrize("hot", [2_000, 1])
def test_substrings_equal_brute_force(docs, clashing, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ANCHOR", hot)  # 1 cuts nearly all pieces into windows
    monkeypatch.setattr(substrings, "SHARD_PIECES", 300)
    want = repeats_brute(pairs(docs))
    got = substrings.remove_repeats(clashing, keep_text=True).collect()
    assert len(got) == docs.count() and sum(r["n_removed"] for r in got) > 500
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
        if r["n_removed"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_substring_edges(spark, nothing):
    assert substrings.remove_repeats(nothing).isEmpty()
    text = " ".join(f"w{i}" for i in range(25))
    rows = spark.createDataFrame([(None, text), (4, text), (9, text), (9, text)], "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in substrings.remove_repeats(rows).collect()), key=str)
    assert got == sorted([(None, 25, 25), (4, 25, 0), (9, 25, 25), (9, 25, 25)], key=str)


def test_substring_stage(docs, clashing):
    want = repeats_brute(pairs(docs))
    out = substrings.without_repeats(clashing)
    assert out.columns == clashing.columns and out.count() == docs.count()
    for r in out.collect():
        n, removed, digest = want[r["doc_id"]]
        assert hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() == digest
        if removed:
            assert r["n_chars"] == len(r["text"])


def collection(seed, letters=4):
    rng = np.random.default_rng(seed)
    lengths = np.array([7, 1, 30, 12, 30, 3])
    words = rng.integers(0, letters, lengths.sum()).astype(np.uint64)
    cuts = np.cumsum(lengths)[:-1]
    return words, lengths, [x.tolist() for x in np.split(words, cuts)]


def holds(text, part):
    return any(text[k : k + len(part)] == part for k in range(len(text) - len(part) + 1))


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_equal_brute_force(seed):
    """Of patterns of the collection, and of others, whose matches fail and are shortened."""
    words, lengths, strings = collection(seed)
    places = np.concatenate([np.where(np.arange(n) <= n - 4, 1_000 * k + np.arange(n), fm_index.FMIndex.NOWHERE) for k, n in enumerate(lengths.tolist())])
    index = fm_index.FMIndex(words, lengths, places, 4)
    assert not hasattr(index, "text") and not hasattr(index, "order")
    rng = np.random.default_rng(seed + 50)
    patterns = [*strings, *(rng.integers(0, 6, n).tolist() for n in (1, 5, 40, 60))]
    matched, place = index.stream(np.concatenate(patterns).astype(np.uint64), np.array([len(p) for p in patterns]))
    at = 0
    for p in patterns:
        for k in range(len(p)):
            longest = max((n for n in range(1, len(p) - k + 1) if any(holds(t, p[k : k + n]) for t in strings)), default=0)
            assert matched[at] == longest
            if longest >= 4:
                want = min(1_000 * i + j for i, t in enumerate(strings) for j in range(len(t) - 3) if t[j : j + 4] == p[k : k + 4])
                assert place[at] == want
            else:
                assert place[at] == fm_index.FMIndex.NOWHERE
            at += 1


def test_common_prefixes():
    words, lengths, _ = collection(3, 2)
    text = np.concatenate([np.append(x, 100 + k) for k, x in enumerate(np.split(words, np.cumsum(lengths)[:-1]))]).astype(np.int64)
    _, dense = np.unique(text, return_inverse=True)
    order, common = fm_index.suffix_array(dense)
    texts = [dense[i:].tolist() for i in order]
    assert texts == sorted(texts)
    for x, y, n in zip(texts, texts[1:], common[1:].tolist(), strict=False):
        assert x[:n] == y[:n] and (len(x) == n or len(y) == n or x[n] != y[n])


def test_nothing_is_removed_without_an_answer_of_the_search(monkeypatch):
    """Windows that the search does not find are never earlier ones, whatever their digests say."""
    rng = np.random.default_rng(9)
    one = rng.integers(0, 2**60, 30).astype(np.uint64)
    words, doc, start = [one, one[5:28], rng.integers(0, 2**60, 20).astype(np.uint64)], np.array([4, 2, 3]), np.array([0, 7, 0])
    docs, starts, counts = substrings.search_shard(words, doc, start)
    assert counts.tolist() == [11, 4, 1]
    first = substrings.earlier_windows(4, 0, np.arange(11), docs[:11], starts[:11])
    assert first.tolist() == [False] * 5 + [True] * 4 + [False] * 2
    assert substrings.earlier_windows(9, 0, np.arange(11), docs[:11], starts[:11]).all()
    monkeypatch.setattr(fm_index.FMIndex, "stream", lambda self, w, n: (np.zeros(len(w), np.int32), np.full(len(w), self.NOWHERE)))
    docs, starts, _ = substrings.search_shard(words, doc, start)
    assert (starts == -1).all() and not substrings.earlier_windows(9, 50, np.arange(11), docs[:11], starts[:11]).any()


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 37, 500)
    wavelet = fm_index.WaveletMatrix(symbols)
    at = rng.integers(0, 501, 300)
    which = rng.integers(0, 37, 300)
    assert wavelet.occurrences(which, at).tolist() == [int((symbols[:i] == s).sum()) for s, i in zip(which, at, strict=True)]


def test_text_key_is_sparks(spark):
    texts = ["", "a", "é" * 100]
    got = [r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()]
    assert got == [substrings._text_key(t) for t in texts]
