from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexcheck.functions import keys
from lexcheck.operators.lines import active_lines, line_offsets
from lexcheck.operators.tokenize import Scanner, distinct_terms, normalised, token_counts, tokenize
from lexcheck.sources import settings

CONFIG = settings.build(settings.DEFAULTS)

LINES = [
    ("hello world", [("hello", 0), ("world", 6)]),
    ("ab hello", [("hello", 3)]),
    ("HelloWorld", [("Hello", 0), ("World", 5)]),
    ("#ff0000 color", [("color", 8)]),
    ("visit https://example.com for info", [("visit", 0), ("for", 26), ("info", 30)]),
    ("before lexcheck:disable secret lexcheck:enable after", [("before", 0), ("after", 47)]),
    ("xxxxxxxx hello", [("hello", 9)]),
    ("abcdef hello", [("hello", 7)]),
    ("IOString", [("String", 2)]),
    ("snake_case kebab-case SCREAMING_SNAKE", [("snake", 0), ("case", 6), ("kebab", 11), ("case", 17), ("SCREAMING", 22), ("SNAKE", 32)]),
    ("don't it's WORDN'T WORD'S HTMLs IDsx", [("don't", 0), ("WORDN'T", 11), ("WORD", 19), ("HTML", 26), ("Dsx", 33)]),
    ("can’t Dave’s", [("can’t", 0), ("Dave", 6)]),
    (r"\nnewline \ttab \e[31mred\e[0m", [("newline", 2), ("tab", 12), ("red", 22)]),
    ("100%25 %2Fpath", [("path", 10)]),
    ("john.doe@mail.com x foo.rb/bar baz", [("john", 0), ("baz", 31)]),
    ("see //cdn.site.org/a?b=c&d=e#frag end", [("see", 0), ("end", 34)]),
    ("token be64439e3e49cf46b2d7c90f3602a3d0b907ff done", [("token", 0), ("done", 45)]),
    ("utf8mb4_unicode collation", [("utf", 0), ("unicode", 8), ("collation", 16)]),
    ("abc1def2=== tail", [("tail", 12)]),
    ("GTM-AB12CD3 tag", [("tag", 12)]),
    ("sha1-AAAAAAAAAAAAAAAAAAAAAAAAAAA= sum", [("sum", 34)]),
    ("data:image/png;base64,iVBORw0KGgo= img", [("img", 35)]),
    ("ABCD abcde abacus", [("abacus", 11)]),
    ("日本語 текст Ünïcode", [("日本語", 0), ("текст", 4), ("Ünïcode", 10)]),
    ("étude", [("tude", 2)]),
    ("Customer#000000001", [("Customer", 0)]),
    ("1-URGENT 4-NOT SPECIFIED", [("URGENT", 2), ("NOT", 11), ("SPECIFIED", 15)]),
    ('{"k": 69} <p>Hello&amp;</p>', [("Hello", 13), ("amp", 19)]),
    ("lexcheck:disablelexcheck:enable word", [("word", 32)]),
    ("lexcheck:enable word", [("lexcheck", 0), ("enable", 9), ("word", 16)]),
    ("# rubocop:disable Metrics", [("rubocop", 2), ("disable", 10), ("Metrics", 18)]),
    ("", []),
]


def test_words_and_offsets_of_lines(spark):
    df = spark.createDataFrame(list(enumerate(x for x, _ in LINES)), "id long, text string")
    got: dict[int, list] = {}
    for r in tokenize(df, "id", "text", CONFIG, offsets=True).collect():
        line = LINES[r["id"]][0]
        assert r["byte_offset"] == len(line[: r["char_offset"]].encode())
        got.setdefault(r["id"], []).append((r["char_offset"], r["value"]))
    for i, (line, want) in enumerate(LINES):
        assert [(v, c) for c, v in sorted(got.get(i, []))] == want, line


def test_both_paths_agree(spark):
    rng = random.Random(5)
    parts = ["Hello", "WORLD", "don't", " ", "_", "-", "/", "#", "%2F", "0x1f", "http://a.bc/d?e=f", "\\n", "aaaa", "abc", "é", "日本", "1", "22", "'s", "’", "\n", "x@y.zz", ".", "Ids", "IOs"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = sorted(tuple(r) for r in tokenize(df, "id", "text", CONFIG, offsets=True).select("id", "line_number", "pos", "char_offset", "byte_offset", "value", "start").collect())
    scanner = Scanner(CONFIG, keys.default_model())
    full = sorted((i, n, k, c, b, v, s) for i, t in enumerate(texts) for n, k, v, c, b, s in scanner.text(t))
    assert got == full
    want = [r[:6] for r in full]
    plain = sorted(tuple(r) for r in tokenize(df, "id", "text", CONFIG).select("id", "line_number", "pos", "value").collect())
    assert plain == sorted((i, n, k, v) for i, n, k, _, _, v in want)
    counts = token_counts(df.withColumn("half", F.col("id") % 2), ["half"], "text", CONFIG)
    assert {(r["half"], r["value"]): r["n"] for r in counts.collect()} == Counter((i % 2, v) for i, _, _, _, _, v in want)
    assert {r["value"]: r["n"] for r in token_counts(df, [], "text", CONFIG).collect()} == Counter(v for *_, v in want)


def test_any_key_name_and_empty_tables(spark):
    rows = spark.createDataFrame([("k", "alpha a1b2c3 beta"), (None, "gamma"), ("k", ""), ("z", None)], "line string, __key string")
    got = sorted((str(r["line"]), r["pos"], r["value"]) for r in tokenize(rows, "line", "__key", CONFIG, offsets=True).collect())
    assert got == [("None", 0, "gamma"), ("k", 0, "alpha"), ("k", 1, "beta")]
    assert tokenize(rows.limit(0), "line", "__key", CONFIG).isEmpty() and token_counts(rows.limit(0), [], "__key", CONFIG).isEmpty()
    with pytest.raises(ValueError, match="cannot be called pos"):
        tokenize(rows.withColumnRenamed("line", "pos"), "pos", "__key", CONFIG)


def test_a_long_line_is_scanned_once():
    began = time.time()
    found, _ = Scanner(CONFIG, keys.default_model()).line("function(abc)d1e2f;" * 50_000)
    assert len(found) == 50_000 and time.time() - began < 20


def test_long_url_is_skipped(spark):
    df = spark.createDataFrame([(0, "see https://a.b/" + "x/" * 100_000 + " end"), (1, None)], "id long, text string")
    assert [r["value"] for r in tokenize(df, "id", "text", CONFIG).collect()] == ["see", "end"]


def test_region_state_carries_over_lines(spark):
    text = "alpha\nlexcheck:disable\nbeta\ngamma lexcheck:disable-line lexcheck:enable\ndelta\nlexcheck:enable\nepsilon\nother:disable x"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert sorted(r["value"] for r in tokenize(df, "id", "text", CONFIG).collect()) == ["alpha", "disable", "epsilon", "other"]
    assert sorted(r["line"] for r in active_lines(df, "id", "text").collect()) == ["alpha", "epsilon", "other:disable x"]
    named = tokenize(df, "id", "text", CONFIG, name="lexcheck|other")
    assert sorted(r["value"] for r in named.collect()) == ["alpha", "epsilon"]


def test_line_offsets_and_terms(spark):
    df = spark.createDataFrame([(1, "ab é\r\ncd\n"), (2, ""), (3, None)], "id long, text string")
    rows = sorted(tuple(r) for r in line_offsets(df, "id", "text").collect())
    assert rows == [(1, 1, "ab é\r", 0, 0), (1, 2, "cd", 6, 7)]
    terms = distinct_terms(tokenize(spark.createDataFrame([(1, "Beta alpha BETA")], "id long, text string"), "id", "text", CONFIG), "id")
    assert terms.first()["terms"] == ["alpha", "beta"]


def test_native_path_has_no_python(spark):
    """Python is only on the branch of texts with keys or markers; nothing is shuffled, offsets included."""
    df = spark.range(1).select("id", F.concat(F.lit("plain words "), F.col("id").cast("string")).alias("text"))
    plan = normalised(tokenize(df, "id", "text", CONFIG))._jdf.queryExecution().executedPlan().toString()
    easy, hard = plan.split("MapInArrow", 1)
    assert "Python" not in plan and "Arrow" not in easy and "Exchange" not in plan and "Project" in hard
    placed = tokenize(df, "id", "text", CONFIG, offsets=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in placed and "Window" not in placed


@pytest.mark.parametrize(("word", "least"), [("ab", 2), ("abc", 4)])
def test_minimum_length(spark, word, least):
    config = settings.build(settings.merge(settings.DEFAULTS, {"word_minimum_length": least}))
    df = spark.createDataFrame([(1, f"{word}x zebra")], "id long, text string")
    values = {r["value"] for r in tokenize(df, "id", "text", config).collect()}
    assert ("zebra" in values) and ((word + "x") in values) == (len(word) + 1 >= least)


def test_scans_over_lines_need_no_shuffle_and_carry_over_batches(spark):
    """Texts of more lines than an Arrow batch holds, odd ones between them; starts, offsets and regions by brute force."""
    rng = random.Random(2)
    made = lambda n: "\n".join(rng.choice(["héllo wörld", "", "lexcheck:disable", "x lexcheck:enable", "abc123def tail", "plain text", "skip lexcheck:disable-line"]) for _ in range(n))
    texts = [(0, made(700)), (1, ""), (2, None), (3, made(3)), (4, made(900) + "\n\n"), (5, "one"), (6, "lexcheck:disable"), (7, "still\non")] + [(8 + i, made(rng.randint(0, 9))) for i in range(60)]
    easy = [(100 + i, t.replace("lexcheck:", "").replace("abc123def", "é") if t else t) for i, t in texts]
    df = spark.createDataFrame(texts + easy, "id long, text string").coalesce(1)
    lines = {i: (t or "").split("\n")[: -1 if (t or "").endswith("\n") or not t else None] for i, t in texts + easy}
    want, kept = [], []
    for i, found in lines.items():
        chars = size = 0
        on = True
        for n, line in enumerate(found, 1):
            want.append((i, n, line, chars, size))
            chars, size = chars + len(line) + 1, size + len(line.encode()) + 1
            if "lexcheck:disable-line" in line:
                continue
            if "lexcheck:" in line:
                on = "enable" in line
            elif on:
                kept.append((i, n, line))
    placed, active = line_offsets(df, "id", "text"), active_lines(df, "id", "text")
    assert sorted(tuple(r) for r in placed.collect()) == sorted(want)
    assert sorted(tuple(r) for r in active.collect()) == sorted(kept)
    tokens = tokenize(df, "id", "text", CONFIG, offsets=True)
    whole = dict(texts + easy)
    rows = tokens.collect()
    assert rows and all(whole[r["id"]][r["start"] : r["start"] + len(r["value"])] == r["value"] for r in rows)
    for frame in (placed, active, tokens):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_pieces_equal_lines_and_are_scanned_once(spark):
    """Lines are read by their distinct pieces, and only lines with a possible key are; Python sees no other text."""
    rng = random.Random(7)
    parts = ["abc123def", "Hello", "x-1", "be64439e3e49cf46b2d7c90f3602a3d0b907ff", "don't", "http://a.bc/d?e=f1", "é日本", "a" * 300 + "9z", "tail"]
    lines = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))).replace(" ", rng.choice([" ", "\t", "  "])) for _ in range(400)]
    whole, pieces = Scanner(CONFIG, keys.default_model()), Scanner(CONFIG, keys.default_model())
    assert all(pieces.pieces(line) == whole.line(line)[0] for line in lines)
    seen = sum(line.split().count(parts[7]) for line in lines)  # over the memo's length
    assert pieces.scanned == seen + len({p for line in lines for p in line.split()} - {parts[7]})
    df = spark.createDataFrame([(1, "plain words\nkey abc123def4 here\nmore")], "id long, text string")
    plan = tokenize(df, "id", "text", CONFIG)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan
    for name in ("value", "n"):
        with pytest.raises(ValueError, match="cannot be called"):
            token_counts(df.withColumn(name, F.lit(1)), [name], "text", CONFIG)
