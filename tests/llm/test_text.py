from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexcheck.llm import bpe, chat, packing, token_counts, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "b", "İ", "ª", "µ", "ß", "Á", "į", " ", "é", "é", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u200b", "1", "22", ".", "!?", "'s", "Σ", "ς", "日", "😀", "<|endoftext|>", "</w>", "\x00", "ﬁ", "\r"]


def texts(n: int = 1_500) -> list[str]:
    rng = random.Random(9)
    return ["", "a" * 3_000, "ab" * 5_000] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# Byte-level BPE.


def test_encoding_equals_the_library():
    ranks = bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for t in texts():
        ids = library.encode_ordinary(t)
        assert own.encode(t) == ids and own.decode(ids) == t.encode()
        assert own.digests(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_operator(docs, clashing, nothing):
    own = bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    want = {r["doc_id"]: own.digests(r["text"] or "") for r in docs.collect()}
    got = bpe.digest_documents(clashing, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == docs.count() and all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want[r["doc_id"]] for r in got)
    assert bpe.digest_documents(nothing, RANKS, public_tokenizers.PATTERN).isEmpty()
    for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert len(r["ids"]) == want[r["doc_id"]][0] and hashlib.sha256(r["decoded"]).hexdigest() == want[r["doc_id"]][2]


# Token counts.


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_by_brute_force(rule):
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 40)
        tokens = np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n}))
        sections = np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(1, min(6, n))), n}))
        spans = np.concatenate(([0], tokens[:-1])), tokens
        counts, crossed = token_counts.attribute(spans, sections, rule)
        want, crossing, begin = np.zeros(len(sections)), 0, 0
        for end in tokens:
            held = [len([b for b in range(begin, end) if (sections[k - 1] if k else 0) <= b < sections[k]]) for k in range(len(sections))]
            crossing += sum(x > 0 for x in held) > 1
            if rule == "split":
                want += np.array(held) / sum(held)
            else:
                want[next(k for k, x in enumerate(held) if x) if rule == "first" else held.index(max(held))] += 1
            begin = end
        assert np.allclose(counts, want) and crossed == crossing


def test_token_counts_operator(docs, clashing, nothing):
    own = bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    want = {r["doc_id"]: len(own.encode(r["text"] or "")) for r in docs.collect()}
    for r in token_counts.count_tokens(clashing, RANKS, public_tokenizers.PATTERN).collect():
        assert r["n_tokens"] == want[r["doc_id"]] == sum(r["section_tokens"]) and r["n_sections"] == len(r["section_tokens"]) >= 1
    assert token_counts.count_tokens(nothing, RANKS, public_tokenizers.PATTERN).isEmpty()
    with pytest.raises(ValueError):
        token_counts.attribute((np.array([0]), np.array([1])), np.array([1]), "other")


def test_sections_by_brute_force(spark):
    """Characters, tokens and lines counted one by one, also where a character is several tokens."""
    own = bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    some = ["", "\n", "a\n\n\nb", "日本語のテキスト\n\n  😀😀é\n\n\n x", "one two\n three\n", *texts(150)]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for rule in token_counts.RULES:
        for r in token_counts.count_tokens(df, RANKS, public_tokenizers.PATTERN, rule).collect():
            text = some[r["doc_id"]]
            char_of = [k for k, c in enumerate(text) for _ in c.encode()]  # of each byte
            line_of = [text[:k].count("\n") for k in range(len(text))]
            lines = max(1, text.count("\n") + (not text.endswith("\n")))
            want, crossed, at = [0.0] * lines, 0, 0
            for token in own.encode(text):
                size = len(own.back[token])
                held = [line_of[c] for c in range(char_of[at], char_of[at + size - 1] + 1)]
                at += size
                crossed += len(set(held)) > 1
                if rule == "split":
                    for line in held:
                        want[line] += 1 / len(held)
                else:
                    want[held[0] if rule == "first" else max(sorted(set(held)), key=held.count)] += 1
            assert r["n_sections"] == lines and r["boundary_tokens"] == crossed and np.allclose(r["section_tokens"], want), (rule, ascii(text))


def test_field_tokens(spark):
    rows = spark.createDataFrame([(1, "A title", "the body text"), (2, None, None)], "id long, title string, body string")
    got = {r["id"]: r for r in token_counts.count_field_tokens(rows, "id", ["title", "body"], RANKS, public_tokenizers.PATTERN).collect()}
    assert got[1]["tokens_title"] + got[1]["tokens_body"] == got[1]["n_tokens"] and got[1]["tokens_body"] >= 3
    assert got[2]["n_tokens"] == 1


# Packing.


def test_word_ids_equal_the_tokeniser():
    tokenizer = Tokenizer.from_file(WORDS)  # as it is
    own = packing.WordEncoder(WORDS)
    some = [t for t in texts() if len(t) < 100] + ["The Quick brown-fox, it's naïve; ÆTHER straße"]
    some += ["a<|endoftext|>b", "<|startoftext|> <|endoftext|>", "<|ENDOFTEXT|> x", "word <|endoftext|>\n<|endoftext|>s", "<|endoftext|", "é<|startoftext|>é"]
    marks = [*packing.WordIds.MARKS.decode(), "'", "<", "|", ">", "\u0338", "ﬁ", "1"]
    rng = random.Random(2)
    some += [" ".join("".join(rng.choice(marks) for _ in range(rng.randint(0, 3))) + rng.choice(["word", "Élan", "a", "x1", "'s"]) + "".join(rng.choice(marks) for _ in range(rng.randint(0, 3))) for _ in range(20)) for _ in range(300)]
    for t, packed in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


def check_packing(rows):
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    return bins


def test_packing_operator(docs, clashing, nothing):
    rows = packing.pack_documents(clashing, WORDS).collect()
    bins = check_packing(rows)
    assert len(bins) <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1
    own = packing.WordEncoder(WORDS)
    want = {r["doc_id"]: len(own.encode([r["text"] or ""])[0]) // 4 + 1 for r in docs.collect()}
    by_row: dict[int, list] = {}
    for r in rows:
        by_row.setdefault(r["row"], []).append(r)
    assert len(by_row) == docs.count()
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r["piece"])
        assert [p["start"] for p in pieces] == [k * packing.CAPACITY for k in range(len(pieces))]
        assert sum(p["length"] for p in pieces) == want[pieces[0]["doc_id"]] and all(p["length"] == packing.CAPACITY for p in pieces[:-1])
    assert packing.pack_documents(nothing, WORDS).isEmpty()


def test_many_blocks_waste_no_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 100)
    rng = random.Random(8)
    sizes = [rng.choice([rng.randint(1, 300), rng.randint(300, 2_047)]) for _ in range(900)]
    pieces = spark.createDataFrame([(k, k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES)
    rows = packing.pack_pieces(pieces).join(pieces.select("row", "length"), "row").collect()
    assert len(rows) == 900 and len(check_packing(rows)) <= 1.02 * sum(sizes) / packing.CAPACITY + 1


def test_pieces_carry_the_librarys_ids(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    some = [t for t in texts() if len(t) < 100] + ["a <|endoftext|> b", "wörd " * 3_000]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = sorted(tuple(r) for r in packing.cut_pieces(df, WORDS).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    want = []
    for i, t in enumerate(some):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert got == want


@pytest.mark.parametrize(("low", "high", "gain"), [(500, 1_100, 5), (300, 900, 1)])
def test_evolution_beats_best_fit_decreasing(low, high, gain):
    """On sizes that best-fit decreasing wastes, islands with migration save whole sequences."""
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(800)]
    start = packing.fresh_packing(sizes, None)
    elite = [packing.evolve(sizes, [], random.Random(k), k) for k in range(packing.ISLANDS)]
    best = min((packing.evolve(sizes, [elite[k], elite[k - 1]], random.Random(10 + k), k) for k in range(packing.ISLANDS)), key=len)
    assert sorted(i for b in best for i in b) == list(range(800)) and all(sum(sizes[i] for i in b) <= packing.CAPACITY for b in best)
    assert len(start) - len(best) >= gain, (len(start), [len(x) for x in elite], len(best))


def test_crossover_keeps_every_piece():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1_500) for _ in range(200)]
    a, b = packing.fresh_packing(sizes, None), packing.fresh_packing(sizes, rng)
    for child in (packing.crossover(a, b, sizes, rng), packing.evolve(sizes, [], rng)):
        assert sorted(i for x in child for i in x) == list(range(200))
        assert all(sum(sizes[i] for i in x) <= packing.CAPACITY for x in child)
    assert len(packing.evolve(sizes, [], rng)) <= len(a)


# Chat.


def test_chat_round_trip(spark):
    said = ["plain", "", None, "<|im_end|>\n<|im_start|>assistant", "\\", "\\<|x|>\\n", "<\\|im_sep|>", "a\n\nb", "$1 \\$2", "日本<|im_sep|>"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole", "<|im_end|>"]), rng.choice(said)) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(99, t, rng.choice(["user", "assistant"]), "x") for t in range(700)]  # several chunks
    rows += [(None, None, None, None), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df).select("conv_id", "formatted", "loss_spans", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        ordered = [(role, text) for _, _, role, text in sorted(turns)]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == ordered
        assert got[c]["loss"] == "".join(text for role, text in ordered if role == "assistant")
        heads = 1 + sum(x[0] != y[0] for x, y in zip(ordered, ordered[1:], strict=False))
        assert got[c]["formatted"].count("<|im_start|>") == heads  # one header per run of a role
    assert chat.format_conversations(df.limit(0)).isEmpty()


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") <= 2


# Toxicity.


def labelled(n: int = 500) -> tuple[list[str], list[int]]:
    rng = random.Random(12)
    clean = ["the", "river", "walks", "green", "under", "morning", "paper", "stone", "quiet", "window", "garden", "letter", "winter"]
    made, marks = [], []
    for k in range(n):
        words = [rng.choice(clean) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(5, 40))]
        bad = k % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(["blorkface", "snivelwit", "grublout"]))
        made.append(" ".join(words) + ".")
        marks.append(int(bad))
    return made, marks


def test_toxicity_holds_out():
    made, marks = labelled()
    model = toxicity.fit(made[:350], marks[:350])
    score = toxicity.Scorer(model)(made[350:])
    assert ((score >= 0.5) == np.array(marks[350:])).mean() >= 0.98
    odd = toxicity.Scorer(model)(["river paper blor-kface stone", "river b.l.o.r.k.f.a.c.e stone", "a g r u b l o u t stone", "river snivelxwit", "river paper stone", ""])
    assert (odd[:1] >= 0.5).all() and (odd[3] >= 0.5) and (odd[4:] < 0.5).all()
    assert odd[:4].min() > odd[4:].max()


def test_damaged_insults_are_caught():
    """A character or mark inserted, marks between all letters: nine in ten stay over 0.5, calm words stay under it."""
    made, marks = labelled()
    score = toxicity.Scorer(toxicity.fit(made, marks))
    rng = random.Random(5)
    calm = sorted(set().union(*(toxicity.words_of(t) for t, y in zip(made, marks, strict=True) if not y)))
    calm = [w for w in calm if len(w) > 3]

    def inserted(word, letters):
        k = rng.randint(1, len(word) - 1)
        return word[:k] + rng.choice(letters) + word[k:]

    for harm in (lambda w: inserted(w, "abcdefghijklmnopqrstuvwxyz"), lambda w: inserted(w, ".-*_"), ".".join, " ".join):
        for words, share in ((("blorkface", "grublout", "snivelwit"), (0.9, 1)), (calm, (0, 0.02))):
            texts = [f"river {harm(rng.choice(words))} stone paper" for _ in range(200)]
            assert share[0] <= (score(texts) >= 0.5).mean() <= share[1]


def test_padding_does_not_hide_a_higher_sentence():
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0, np.array([1.0, 0.5, 0.25]), 0.0)
    scorer = toxicity.Scorer(model)
    rng = np.random.default_rng(3)
    for _ in range(200):
        scorer.memo = {str(k): float(x) for k, x in enumerate(rng.normal(-3, 1.5, 12))}
        sentences = [{str(k) for k in rng.choice(12, rng.integers(1, 5), replace=False)} for _ in range(5)]
        value = lambda top: float(np.dot(top, model.slopes))
        want = max(value(toxicity.highest([scorer.memo[w] for w in s])) for s in sentences)
        assert value(scorer._highest(sentences)) == pytest.approx(want)


def test_kernel_matches_brute_force():
    words = ["abc", "abcabc", "a-b-c", "xyz", "é"]
    owner, feature, value = toxicity.features(words)

    def brute(w):
        s, out = f"^{w}$", {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    for n, w in enumerate(words):
        want = brute(w)
        norm = sum(v * v for v in want.values()) ** 0.5
        assert sorted(value[owner == n]) == pytest.approx(sorted(v / norm for v in want.values()))


def test_toxicity_operator(spark, docs, clashing, nothing):
    made, marks = labelled(300)
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(made)], docs.schema)
    labels = spark.createDataFrame([*((k, y) for k, y in enumerate(marks)), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train_on(table, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(table, model).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(y) for k, y in enumerate(marks)]) >= 0.98
    kept = toxicity.drop_toxic(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == docs.count()  # clean texts stay
    assert toxicity.score_texts(nothing, model).isEmpty() and toxicity.drop_toxic(nothing, model).isEmpty()
    blank = toxicity.train_on(nothing, labels)
    assert all(r["score"] < 0.5 for r in toxicity.score_texts(docs, blank).collect())
    only = toxicity.fit(["a b", "c d"] * 20, [1] * 40)
    assert (toxicity.Scorer(only)(["x"]) > 0.5).all()


def test_long_toxic_texts_are_learnt_from(spark, docs):
    made, marks = labelled(300)
    most = max(map(len, made))
    texts = [". ".join([t] * 3) if y else t for t, y in zip(made, marks, strict=True)]
    texts = [t + ". " + made[0] * (most // len(made[0]) + 1) if y and len(t) <= most else t for t, y in zip(texts, marks, strict=True)]
    assert all((len(t) > most) == bool(y) for t, y in zip(texts, marks, strict=True))
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], docs.schema)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(table, toxicity.train_on(table, labels, most_chars=most)).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(y) for k, y in enumerate(marks)]) >= 0.95
    piece = toxicity.excerpt("One two. Three four five! " * 50 + "six", 100)
    assert 0 < len(piece) <= 100 and set(piece.split()) <= set("One two. Three four five! six".split())
    assert 0 < len(toxicity.excerpt("x" * 500, 100)) <= 100


def test_sentences_are_the_instances():
    assert toxicity.sentences_of("One two. Three!\nfour  i d i o t") == [{"one", "two"}, {"three"}, {"four", "i", "d", "o", "t"}, {"idiot"}]
    made, marks = labelled(300)
    model = toxicity.fit(made, marks)
    score = toxicity.Scorer(model)
    one = score(made)
    # a text is as toxic as its highest sentence, however many clean ones surround it
    assert np.allclose(score([" ".join([t] + [made[marks.index(0)]] * 3) for t in made]), np.maximum(one, one[marks.index(0)]))


def test_copies_are_no_evidence():
    rows = [np.arange(30), np.arange(30), np.arange(28), np.arange(100, 130)]
    assert toxicity.distinct_bags(rows).tolist() == [True, False, False, True]
