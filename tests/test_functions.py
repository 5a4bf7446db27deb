from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lexcheck import queries
from lexcheck.functions import keys, patterns, similarity, text
from lexcheck.operators import correct, suggest


def test_normalise(spark):
    rows = [("Hello", "hello"), ("  World  ", "world"), ("it’s", "it's"), ("ét", "ét"), ("한", "한"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(text.normalise(F.col("a")).alias("a"), "b")
    assert all(r["a"] == r["b"] for r in df.collect())


def test_case_styles(spark):
    words = ["hello", "HELLO", "Hello", "hELLO", "don't", "日本"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.case_style(F.col("w")).alias("s"), text.apply_case(text.case_style(F.col("w")), F.lit("world")).alias("o"))
    got = {r["w"]: (r["s"], r["o"]) for r in df.collect()}
    assert got == {"hello": ("lowercase", "world"), "HELLO": ("uppercase", "WORLD"), "Hello": ("capitalize", "World"), "hELLO": ("as_is", "world"), "don't": ("lowercase", "world"), "日本": ("as_is", "world")}


def test_upper_case_is_letter_by_letter(spark):
    words = {"straße": "STRAẞE", "ßa": "ẞA", "été": "ÉTÉ", "ŉa": "ŉA", "ǰßx": "ǰẞX", "ᾳa": "ᾼA", "": ""}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.apply_case(F.lit("uppercase"), F.col("w")).alias("u"), text.apply_case(F.lit("capitalize"), F.col("w")).alias("c"))
    got = {r["w"]: (r["u"], r["c"]) for r in df.collect()}
    assert {w: u for w, (u, _) in got.items()} == words
    assert got["ßa"][1] == "ẞa" and got["straße"][1] == "Straße"


def test_display(spark):
    df = spark.createDataFrame([("a.txt", 3, 4, "bad word  ", "word")], "p string, n int, c int, l string, v string")
    row = df.select(text.location(F.col("p"), F.col("n"), F.col("c")).alias("at"), text.highlight(F.col("l"), F.col("c"), F.col("v")).alias("shown"), text.pluralise("file", F.col("n")).alias("n")).first()
    assert tuple(row) == ("a.txt:3:4", "bad \x1b[31mword\x1b[0m", "3 files")


@pytest.mark.parametrize(("s", "kind"), [("ghijkl123", "lower36"), ("GHIJKL123", "upper36"), ("deadbeef", "hex"), ("DEADBEEF", "hex"), ("abc123", "hex"), ("SGVsbG8gV29ybGQ=", "base64"), ("hello world", None)])
def test_character_sets(s, kind):
    assert keys.character_set_of(s) == kind


def test_features():
    row = keys.features_of("aeiou")
    assert row["vowel_consonant_ratio"] == 5.0 and len(row) == 37
    assert keys.features_of("HelloWorld")["title_chunks"] == 2
    assert keys.features_of("abc123def456")["digit_chunks"] == 2


def test_features_as_columns(spark):
    strings = ["abc123def", "utf8mb4_unicode", "AKIA4XQZ9", "SGVsbG8gV29ybGQ=", "a1b2c3", "Title9Case8", "x"]
    df = spark.createDataFrame([(s,) for s in strings], "s string").select("s", keys.character_set(F.col("s")).alias("k"), *[c.alias(f"f{i}") for i, c in enumerate(keys.features(F.col("s")).values())])
    model = keys.default_model()
    judged = df.withColumn("key", keys.is_key_column(F.col("k"), {f: F.col(f"f{i}") for i, f in enumerate(keys.FEATURES)}, model))
    for r in judged.collect():
        want = keys.features_of(r["s"])
        for i, f in enumerate(keys.FEATURES):
            assert r[f"f{i}"] == pytest.approx(want[f], abs=1e-9), (r["s"], f)
        assert r["key"] == keys.classify(r["s"], model)


def test_classifier_and_gates():
    model = keys.default_model()
    for s in ("deadbeef12ab34", "h1h2h3", "abc1def2===", "abc123def", "AKIA4XQZ9"):
        assert keys.classify(s, model), s
    for s in ("utf8mb4_unicode", "ipv4address", "base64encode", "x86_64-linux", "test1test2", "foo1bar2baz3"):
        assert not keys.classify(s, model), s
    assert not keys.is_key("h1h2", model) and keys.is_key("a1" * 101, model) and not keys.is_key("12-34-56", model)


def test_model_file(tmp_path):
    path = tmp_path / "model.yml"
    path.write_text("---\n:feature_set:\n  key_hex:\n    :+:\n      :standard_deviation: 0.5\n      :mean: 1.0\n      :variance: 0.25\n    :equal:\n      :standard_deviation: 0.0\n      :mean: 0.0\n      :variance: 0.0\n")
    assert keys.load_model(str(path)) == {"key_hex": {"+": (1.0, 0.25), "equal": (0.0, 0.0)}}


def test_alphabet_run():
    import regex

    run = regex.compile(patterns.alphabet_run("i")).match
    assert run("abc").group() == "abc" and run("ABCD!").group() == "ABCD" and run("abcdefghijklmnopqrstuvwxyz").end() == 26
    assert run("abacus") is None


def test_jaro_winkler():
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert similarity.jaro_winkler("abxy", "abcd") == pytest.approx(2 / 3)
    assert similarity.jaro_winkler("", "a") == 0.0 and similarity.jaro_winkler("a", "a") == 1.0


def test_pruning_loses_nothing():
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    block = similarity.Words(words)
    t, w = block.candidates(words[:60])
    kept = set(zip(t.tolist(), w.tolist(), strict=True))
    assert all((k, i) in kept for k, term in enumerate(words[:60]) for i, x in enumerate(words) if similarity.jaro_winkler(x, term) >= similarity.threshold(len(term)))


def test_suggestions(spark):
    terms = spark.createDataFrame([("tset",), ("helo",), ("zzzz",)], "term string")
    words = spark.createDataFrame([(w,) for w in ("set", "test", "tset2", "text", "hello", "help", "world")], "word string")
    rows = suggest.suggestions(terms, words, 2).collect()
    by = {t: [r["word"] for r in sorted(rows, key=lambda r: r["rank"]) if r["term"] == t] for t in ("tset", "helo", "zzzz")}
    assert by["helo"] and by["helo"][0] in ("hello", "help") and len(by["tset"]) <= 2 and by["zzzz"] == []


def test_splice(spark):
    kind = f"n int, a string, e array<{correct.EDIT}>, odd string"
    rows = [(1, "Teh cta sat", [(4, 3, "cat"), (0, 3, "The")], "x"), (2, "same", [], None), (3, "é x", [(2, 1, "yy")], "y"), (4, "ab", [(0, 1, ""), (1, 1, "Z")], ""), (5, None, [(0, 1, "q")], ""), (6, "kept", None, "")]
    got = correct.splice(spark.createDataFrame(rows, kind), "a", "e")
    assert got.columns == ["n", "a", "odd"]
    assert [r["a"] for r in sorted(got.collect())] == ["The cat sat", "same", "é yy", "Z", None, "kept"]
    long = "word " * 200_000
    edits = [(5 * k, 4, "w") for k in range(200_000)]
    assert correct.spliced(long, [{"start": s, "length": n, "replacement": r} for s, n, r in edits]) == "w " * 200_000


def test_words_are_composed_in_the_jvm(spark):
    import random
    import unicodedata

    rng = random.Random(4)
    letters = [chr(c) for c in range(0x41, 0x30000) if unicodedata.category(chr(c))[0] == "L"]
    meeting = [chr(c) for r in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3), (0xAC00, 0xAC60)) for c in range(*r)]
    texts = rng.sample(letters, 8_000) + ["".join(rng.choice(rng.choice([meeting, letters])) for _ in range(rng.randint(2, 8))) for _ in range(4_000)] + ["it’s", "ﬁn", "\u0958"]
    df = spark.createDataFrame([(x,) for x in texts], "value string")
    made = df.select("value", text.compose_letters(F.col("value")).alias("nfc"), text.normalise_word(F.lower("value")).alias("norm"), F.lower("value").alias("low"))
    for r in made.collect():
        assert r["nfc"] == unicodedata.normalize("NFC", r["value"])
        assert r["norm"] == unicodedata.normalize("NFC", r["low"]).replace("\u2018", "'").replace("\u2019", "'")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_model_of_a_table_equals_the_loop(spark):
    examples = {"key_hex": ["deadbeef01", "0123456789abcdef", "a0-b1"], "not_key_lower36": ["item12name", "x1", "x1", "abc"], "key_base64": ["aB3+/x==", "Zz9_k-Q"]}
    table = spark.createDataFrame([*((k, s, 0) for k, texts in examples.items() for s in texts), (None, "a1", 0), ("key_hex", None, 0)], "of string, text string, kind int").repartition(5)
    got, want = keys.fit_table(table, "of", "text"), keys.fit_model(examples)
    assert got.keys() == want.keys()
    for name, stats in want.items():
        for f, pair in stats.items():
            assert got[name][f] == pytest.approx(pair, abs=1e-9), (name, f)
    assert keys.fit_table(table.limit(0), "of", "text") == {}


def test_runs_of_key_characters():
    text = "plain a1b2 é--9_x/é 77 7- =abc-12= x1y\n0" + "-" * 50 + "_z " + "no" * 2_000 + "\t1é2a"
    split = [r for r in re.split(r"[^A-Za-z0-9+/\-_=]+", text) if re.search(patterns.MAYBE_KEY.replace(r"\p{Nd}", "[0-9]"), r)]
    assert list(keys.runs_of(text)) == split and len(split) == 5
    assert list(keys.runs_of("")) == list(keys.runs_of("12 34-")) == []


def test_features_and_classes_in_batches_equal_columns(spark):
    strings = ["a1b2c3", "deadbeef01", "ABC1DEF", "fooBar12baz_", "x/y-9+Q==", "be64439e3e49cf46b2d7c90f3602a3d0b907ff", "a" * 90 + "1b"]
    df, names = spark.createDataFrame([(s,) for s in strings], "s string"), {f: f"f{i}" for i, f in enumerate(keys.FEATURES)}
    columns = df.select("s", keys.character_set(F.col("s")).alias("kind"), *[c.alias(names[f]) for f, c in keys.features(F.col("s")).items()])
    want, got = ({r["s"]: r for r in rows.collect()} for rows in (columns, keys.featured(df, names)))
    assert set(got) == set(want)
    for s, r in got.items():
        assert r["kind"] == want[s]["kind"] and [r[n] for n in names.values()] == pytest.approx([want[s][n] for n in names.values()], abs=1e-9)
    model = keys.default_model()
    flags = columns.select("s", keys.is_key_column(F.col("kind"), {f: F.col(n) for f, n in names.items()}, model).alias("is_key"))
    assert sorted(keys.classified(df, model).collect()) == sorted(flags.collect())


def test_work_on_candidates_is_dealt(spark):
    """Candidates are few bytes but much work: Spark must not join their partitions."""
    rows = queries.QUERIES["key_features"](spark, "/root/testdata/sf0.01").select(F.spark_partition_id().alias("p"))
    assert 1 < rows.distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
