from __future__ import annotations

import io
import re

import pytest
from pyspark.sql import functions as F

from lexcheck.operators.languages import addable_of, languages_of
from lexcheck.plans import check as plan
from lexcheck.sources import files, settings, wordlists
from lexcheck.sources.globs import any_of, exclude_globs, glob_regex, include_globs, python_regex

CONFIG = settings.build(settings.DEFAULTS)


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("*.rb", "app/models/user.rb", True), ("*.rb", "script.py", False), ("Gemfile", "Gemfile", True), ("**/Gemfile", "a/b/Gemfile", True), ("**/Gemfile", "Gemfile", True), ("Gemfile", "Gemfile.lock", False), ("a/{b,c}.t?t", "a/c.txt", True), ("[ab]x", "bx", True), ("[!ab]x", "bx", False), ("spec/**", "spec/a/b", True)],
)
def test_globs(glob, path, hit):
    assert bool(re.match(python_regex(glob_regex(glob)), path)) == hit


def test_exclude_rules():
    rules = re.compile(python_regex(any_of([g for p in ("*.png", "Gemfile.lock", ".git/") for g in exclude_globs(p)])))
    assert rules.match("a/b.png") and rules.match("Gemfile.lock") and not rules.match("a/Gemfile.lock") and rules.match(".git/config") and rules.match(".git")
    assert include_globs("spec/") == ["spec/**", "**/spec/**"]


def test_settings_merge(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("word_minimum_length: 4\nexcludes: ['*.zzz', '*.png']\nincludes: ['src/*']\nlanguages:\n  lisp:\n    includes: ['*.el']\n    key: L\n  ruby:\n    includes: ['*.ru']\n    addable: false\n  english:\n    locale: [US, CA]\n")
    got = settings.load(str(path))
    assert got.word_minimum_length == 4 and got.key_minimum_length == 6
    assert got.excludes[-1] == "*.zzz" and got.excludes.count("*.png") == 1 and got.includes == ("src/*",)
    by = {x.name: x for x in got.languages}
    assert by["lisp"].key == "L" and by["rust"].key == "r" and not by["ruby"].addable and by["ruby"].includes[-1] == "*.ru" and by["ruby"].includes[0] == "*.rb"
    assert by["english"].locales == ("US", "CA")
    with pytest.raises(OSError):
        settings.load(str(tmp_path / "none.yml"))


def test_languages(spark):
    df = spark.createDataFrame([("a/x.rb", "puts"), ("bin/r", "#!/usr/bin/env ruby"), ("n", None), ("d/Dockerfile", "")], "path string, first_line string")
    got = {r["path"]: r["languages"] for r in languages_of(df, list(CONFIG.languages)).collect()}
    assert got == {"a/x.rb": ["english", "lexcheck", "ruby", "html"], "bin/r": ["english", "lexcheck", "ruby"], "n": ["english", "lexcheck"], "d/Dockerfile": ["english", "lexcheck", "shell", "dockerfile"]}
    addable = {r["path"]: [tuple(x) for x in r["addable"]] for r in addable_of(df, list(CONFIG.languages)).collect()}
    assert addable["bin/r"] == [("e", "english"), ("r", "ruby")]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "words").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src" / "a.rb").write_text("hello wurld\nHelo there\n")
    (tmp_path / "src" / "b.txt").write_text("hello there\n")
    (tmp_path / "src" / "c.png").write_bytes(b"\x89PNG")
    (tmp_path / "src" / "skip.tmp").write_text("ignoredword\n")
    (tmp_path / ".gitignore").write_text("# rules\n*.tmp\nwords/\n")
    (tmp_path / ".git" / "config").write_text("hiddenword")
    (tmp_path / "words" / "english.txt").write_text("hello\n\nthere\nworld\nhello\n")
    return tmp_path


def test_file_rules(spark, tree):
    found = lambda *a, **k: sorted(r["path"] for r in files.file_list(spark, list(a), CONFIG, str(tree), **k).select("path").collect())
    assert found() == ["src/a.rb", "src/b.txt"]
    assert found("src/*.rb") == ["src/a.rb"] and found("src") == ["src/a.rb", "src/b.txt"]
    assert "src/c.png" in found(suppress_file_rules=True) and "src/skip.tmp" in found(suppress_file_rules=True)


def test_whole_check(spark, tree):
    def run(mode, **given):
        out, err = io.StringIO(), io.StringIO()
        code = plan.run(spark, [], CONFIG, mode, str(tree), bundled=str(tree / "words"), out=out, err=err, **given)
        return code, out.getvalue(), err.getvalue()

    assert run("wordlist")[:2] == (1, "helo\nwurld\n")
    code, _, err = run("default")
    assert code == 1 and "src/a.rb:1:6 hello \x1b[31mwurld\x1b[0m" in err and "2 files checked" in err and "2 errors found" in err
    assert run("quiet") == (1, "", "")
    (tree / "src" / "d.txt").write_text("hello qqqqzz\n")
    code, _, err = run("autocorrect", output=str(tree / "out"))
    assert code == 1 and "src/d.txt:1:6" in err and err.endswith("2 fixed, 1 unfixed\n") and "(no suggestion)" in err
    assert (tree / "out" / "src" / "a.rb").read_text() == "hello world\nHello there\n" and not (tree / "out" / "src" / "b.txt").exists()
    assert sorted(p.name for p in (tree / "out" / "src").iterdir()) == ["a.rb"] and (tree / "src" / "a.rb").read_text().startswith("hello wurld")


def test_no_word_list_is_an_error(spark, tree):
    err = io.StringIO()
    assert plan.run(spark, [], CONFIG, "quiet", str(tree), bundled=str(tree / "nowhere"), err=err) == 1 and "no word list found" in err.getvalue()
    assert wordlists.bundled_list(spark, "rust", bundled=str(tree / "words")) is None
    assert wordlists.bundled_list(spark, "english", bundled=str(tree / "words")).count() == 3


def test_decided_check(spark, tree):
    (tree / "src" / "e.rb").write_text("Helo again\n")
    path = tree / "words" / "decisions.csv"
    path.write_text("action,path,norm,value,replacement,letter\nskip,src/e.rb,helo,,,\nreplace,,,wurld,world,\nadd,src/e.rb,again,,,r\nadd,src/b.txt,there,,,x\n")
    err = io.StringIO()
    code = plan.run(spark, [], CONFIG, "decisions", str(tree), bundled=str(tree / "words"), project=str(tree / "mine"), err=err, output=str(tree / "out"), decisions=str(path))
    assert code == 1 and "src/b.txt: no list takes there" in err.getvalue() and err.getvalue().endswith("1 skipped, 1 replaced, 1 added, 1 left\n")
    assert (tree / "mine" / "ruby.txt").read_text() == "again\n" and (tree / "out" / "src" / "a.rb").read_text() == "hello world\nHelo there\n"


def test_ignore_files(spark, tmp_path):
    for path, text in {
        "a.log": "", "keep.log": "", "b.txt": "", "sub/x.log": "", "sub/x.txt": "", "sub/deep/y.txt": "", "sub/deep/z.md": "", "build/out.txt": "", "top.md": "", "docs/top.md": "",
        ".gitignore": "*.log\n!keep.log\nbuild/\n/top.md\n# note\n", "sub/.gitignore": "!x.log\ndeep/*.txt\n", "sub/deep/.ignore": "!y.txt\n", "build/.gitignore": "!out.txt\n", ".git/info/exclude": "b.txt\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text or "x")
    scan = files.file_list(spark, [], CONFIG, str(tmp_path)).select("path")
    assert sorted(r["path"] for r in scan.collect()) == ["docs/top.md", "keep.log", "sub/deep/y.txt", "sub/deep/z.md", "sub/x.log", "sub/x.txt"]
    twice = files.file_list(spark, ["sub", "sub/deep", "."], CONFIG, str(tmp_path)).select("path")
    assert twice.count() == 6


def test_autocorrected_text_has_nothing_left_to_fix(spark, tree):
    texts = files.read_files(spark, [], CONFIG, str(tree))
    words = wordlists.of_languages(spark, list(CONFIG.languages), str(tree / "words"))
    fixed = plan.corrected(plan.build(texts, CONFIG, words, offsets=True)).cache()
    got = {r["path"]: r["content"] for r in fixed.collect()}
    assert got == {"src/a.rb": "hello world\nHello there\n", "src/b.txt": "hello there\n"}
    again = plan.build(fixed.select("path", "content"), CONFIG, words)
    assert again.errors.isEmpty()


def test_first_line(spark):
    df = spark.createDataFrame([("#!x\r\ny",), ("",), (None,), ("\nq",)], "c string").select(files.first_line(F.col("c")).alias("f"))
    assert [r["f"] for r in df.collect()] == ["#!x", None, None, ""]


def test_wordlists(spark, tree):
    words = wordlists.read(spark, str(tree / "words"), "english")
    assert sorted(r["word"] for r in words.collect()) == ["hello", "there", "world"]
    assert wordlists.read(spark, str(tree), "missing").isEmpty()
    pushed = wordlists.push(words, spark.createDataFrame([("english", " New’s ")], wordlists.SCHEMA))
    assert sorted(r["word"] for r in pushed.collect()) == ["hello", "new's", "there", "world"]
    wordlists.write(pushed, str(tree / "out"))
    back = spark.read.text(str(tree / "out"))
    assert [r["value"] for r in back.collect()] == ["hello", "new's", "there", "world"]
    terms = spark.createDataFrame([("HELLO",), ("nope",)], "word string")
    assert [r["word"] for r in wordlists.contains(words, terms).collect()] == ["HELLO"]


def test_wordlist_handle(spark, tree):
    found = wordlists.Wordlist(spark, str(tree / "words"), "english")
    assert found.exists() and found.count() == 3 and not found.is_empty() and found.contains(" HELLO") and not found.contains("wurld")
    found.add("Wurld")
    assert found.contains("wurld") and (tree / "words" / "english.txt").read_text() == "hello\nthere\nworld\nwurld\n"
    none = wordlists.Wordlist(spark, str(tree / "words"), "rust")
    assert not none.exists() and none.is_empty()
    none.add("crate")
    assert none.exists() and none.count() == 1


def test_decisions_add_words(spark, tree):
    words = wordlists.read(spark, str(tree / "words"), "english")
    decided = spark.createDataFrame([("add", "english", "Wurld"), ("skip", None, "Helo")], "action string, name string, value string")
    assert sorted(r["word"] for r in plan.add_words(words, decided).collect()) == ["hello", "there", "world", "wurld"]


def test_lines_that_are_no_text(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"good line\nbad \xff\xfe line\nlast h\xc3\xa9\n")
    got = files.read_files(spark, [], CONFIG, str(tmp_path)).first()["content"]
    assert got.split("\n")[0] == "good line" and got.split("\n")[1].strip() == "" and got.split("\n")[2] == "last hé"
