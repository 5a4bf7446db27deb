from __future__ import annotations

from lexcheck.functions import keys
from lexcheck.operators import correct, pieces
from lexcheck.operators.tokenize import Scanner
from lexcheck.plans import check as plan
from lexcheck.sources import settings

CONFIG = settings.build(settings.DEFAULTS)
LIST = ["hello", "world", "there", "e-mail", "co-operate", "well-known", "message", "disable", "python", "a b-there"]
TEXTS = [
    "hello wrld", "Helo\tthere\r\nWORLDD\x0bagain  qqqqzz\n\n", "a mial comes", "E-MAIL, mail; Mail's", "", None, " \n ", "wellknown&&& helloWrld HTTPWorldd x@wrld.com\x1cwrld\xa0helo",
    "lexcheck:disable\nwrld\nlexcheck:enable\nwrld", "lexcheck:disabel\nwrld mesage", "#!/bin/pythn helo\nwrld", "mesage SG.____ abc ABCD zzz éé ther", "mial mial wrld " * 40, "thre mesage", "0a1b2c3d4e5f6a7b wrld wrld/hello https://wrld.com/helo",
]


def frames(spark, texts):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    return rows, spark.createDataFrame([("english", w) for w in LIST], "name string, word string")


def test_one_round_of_pieces_is_one_round_of_words(spark):
    texts, words = frames(spark, TEXTS)
    want = plan.corrected(plan.build(texts, CONFIG, words, offsets=True)).collect()
    got = plan.corrected_once(texts, CONFIG, words).collect()
    assert sorted(map(tuple, got), key=lambda r: int(r[0])) == sorted(map(tuple, want), key=lambda r: int(r[0]))


def test_all_rounds_of_pieces_are_all_rounds_of_words(spark, monkeypatch):
    texts, words = frames(spark, TEXTS)
    errors = lambda rows: plan.build(rows, CONFIG, words, offsets=True).errors
    columns = ["path", "content", "fixed", "unfixed", "rounds", "ended"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()), key=lambda r: int(r[0]))
    want = rows(correct.fixpoint(texts, errors, words, "path", "content"))
    assert {r[5] for r in want} == {"stable", "cycle"}
    assert rows(plan.settled(texts, CONFIG, words)) == want
    monkeypatch.setattr(pieces, "ROUNDS", 1)  # texts that pieces were not followed far enough for are not cut short
    monkeypatch.setattr(pieces, "SHARE_CHARS", 20)
    left = pieces.corrected(texts, CONFIG, words, "path", "content")[1]
    assert {"8", "9", "10"} < {r["path"] for r in left.collect()}  # a marker, one that a correction makes, a changed first line
    assert rows(plan.settled(texts, CONFIG, words)) == want


def test_a_piece_is_scanned_once_however_often_it_stands(spark, monkeypatch):
    scanned = []
    plain = pieces._words
    monkeypatch.setattr(pieces, "_words", lambda rows, *given: scanned.append(rows.count()) or plain(rows, *given))
    texts, words = frames(spark, ["wrld helo mesage"] * 300 + ["helo  there"] * 100)
    out = plan.corrected_once(texts, CONFIG, words)
    assert scanned == [4]
    assert {(r["content"], r["fixed"]) for r in out.collect()} == {("world hello message", 3), ("hello  there", 1)}


def test_simple_pieces_are_read_as_the_scanner_does():
    import regex

    scanner, simple = Scanner(CONFIG, keys.default_model()), regex.compile(pieces.SIMPLE).fullmatch
    some = ["word", "Word,", "(WORD)", "...word&&&", "SG.----------------------.-------------------------------------------", "mailto:-.-", "aaa", "AAA!", "abc", "ABCDE.", "ſs", "éé", "wordß", "a", "Ab'", "'tis'", "It’s"]
    some += ["doinǵ", "ab\xa0cd", "x ", "word\x1c", "日本", "ǅa", "localhost", "Kab", "Abc’", "don't"]
    taken = 0
    for piece in some:
        m = simple(piece)
        if m and (one := pieces.word_of(m)):
            taken += 1
            assert [x for x in [one] if len(x[1]) >= CONFIG.word_minimum_length] == scanner.line(piece)[0], piece
    assert taken > 5
