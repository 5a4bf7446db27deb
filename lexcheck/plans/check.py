"""The whole check: files, languages, dictionaries, tokens, unknown words, a report, an exit code.

    python -m lexcheck.plans.check [-w | -q | -a | -i FILE] [-d] [-f] [-c FILE] [--words DIR] [--output DIR] [files ...]

Corrected files are written to a new folder, never over the checked ones. Prompts of an interactive check are
replaced by a file of decisions: a CSV with the columns action (skip, replace, add), path, norm, value,
replacement, letter.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.functions import keys
from lexcheck.functions.patterns import OWN_NAME
from lexcheck.operators import check, correct, pieces
from lexcheck.operators.languages import addable_of, languages_of
from lexcheck.operators.lines import explode_lines
from lexcheck.operators.tokenize import normalised, tokenize
from lexcheck.sources import files, settings, wordlists
from lexcheck.storage import materialise

MODES = ("default", "wordlist", "quiet", "autocorrect", "decisions")
DECISIONS = "action string, path string, norm string, value string, replacement string, letter string"


@dataclass
class Check:
    """The frames of a check, all lazy: the checked files, their tokens, the unknown ones."""

    files: DataFrame
    tokens: DataFrame
    errors: DataFrame
    words: DataFrame

    def summary(self) -> DataFrame:
        return check.summary(self.files, self.errors, "path")


def build(texts: DataFrame, config: settings.Settings, words: DataFrame, model: keys.Model | None = None, offsets: bool = False, markers: str = OWN_NAME) -> Check:
    """``texts(path, content)`` and ``words(name, word)`` to a check; ``markers`` is the name (a pattern) in front of
    ``:disable``, ``:enable`` and ``:disable-line``."""
    found = texts.withColumn("first_line", files.first_line(F.col("content")))
    known = languages_of(found, list(config.languages))
    keyed = known.select(F.struct("path", check.language_set(F.col("languages"))).alias("of"), "content")
    tokens = normalised(tokenize(keyed, "of", "content", config, model, offsets, markers))
    tokens = tokens.select("of.path", f"of.{check.SET}", *[c for c in tokens.columns if c != "of"])
    errors = check.unknown_by_language(tokens, words)
    return Check(known, tokens, errors, words)


def _show(errors: DataFrame, made: Check, out, note: str = "") -> None:
    lines = explode_lines(made.files, "path", "content")
    for r in check.error_lines(errors, lines, "path").orderBy("path", "line_number", "char_offset").toLocalIterator():
        print(r["shown"] + note, file=out)


def run(spark: SparkSession, patterns: list[str], config: settings.Settings, mode: str = "default", folder: str = ".", bundled: str | None = None, project: str | None = None, suppress_file_rules: bool = False, model: keys.Model | None = None, out=sys.stdout, err=sys.stderr, output: str | None = None, decisions: str | None = None, markers: str = OWN_NAME) -> int:
    """Runs a check and prints its report; 0 if clean, else 1 (also when everything was corrected).

    ``output`` is the folder that corrected texts are written to; ``decisions`` the file of a decided check."""
    texts = files.read_files(spark, patterns, config, folder, suppress_file_rules)
    languages = list(config.languages)
    if not any(wordlists.paths_for(spark, x, bundled, project) for x in languages):
        print(f"no word list found in {bundled or 'the package'} or {project or 'the project'}: give their folder with --words", file=err)
        return 1
    words = wordlists.of_languages(spark, languages, bundled, project)
    made = build(texts, config, words, model, offsets=mode not in ("wordlist", "quiet"), markers=markers)
    if mode == "quiet":
        return int(check.any_error(made.errors))
    if mode == "wordlist":
        rows = check.word_report(made.errors).toLocalIterator()
        n = 0
        for r in rows:
            print(r["norm"], file=out)
            n += 1
        return int(n > 0)
    if mode == "autocorrect":
        fixed = materialise(settled(texts, config, words, model, markers))
        rest = build(fixed.filter("unfixed > 0").select("path", "content"), config, words, model, offsets=True, markers=markers)
        _show(rest.errors, rest, err, " (no suggestion)")
        totals = fixed.agg(F.coalesce(F.sum("fixed"), F.lit(0)).alias("fixed"), F.coalesce(F.sum("unfixed"), F.lit(0)).alias("unfixed")).first()
        print(f"{totals['fixed']} fixed, {totals['unfixed']} unfixed", file=err)
        if output:
            files.write_files(fixed.filter("fixed > 0"), output)
        return int(totals["fixed"] + totals["unfixed"] > 0)
    if mode == "decisions":
        return _decided(spark, made, config, decisions, project, output, err)
    made.errors = materialise(made.errors)  # the listing and the counts are of one pass
    _show(made.errors, made, err)
    report = materialise(made.summary())
    row = check.summary_lines(report).first()
    print("\n" + " checked\n".join(row["lines"]) + " found", file=err)
    return report.first()["exit_code"]


def _decided(spark: SparkSession, made: Check, config: settings.Settings, path: str, project: str | None, output: str | None, err) -> int:
    """Applies a file of decisions: words are added to the project's lists, replacements written to ``output``, what
    no decision covers is reported."""
    given = spark.read.csv(path, header=True, schema=DECISIONS)
    takes = addable_of(made.files, list(config.languages))
    known = correct.with_lists(given, takes, "path")
    for r in known.filter("action = 'refused'").select("path", "norm").orderBy("path", "norm").toLocalIterator():
        print(f"{r['path']}: no list takes {r['norm']}", file=err)
    rows = materialise(correct.decide(made.errors, known, "path"))
    _show(rows.filter("action = 'report'").select(made.errors.columns), made, err)
    for r in rows.filter("action = 'add'").select("name").distinct().collect():  # a handful of languages
        wordlists.store(add_words(made.words, rows).filter(F.col("name") == r["name"]), project or ".", r["name"])
    if output:
        edit = F.struct(F.col("start").cast("int").alias("start"), F.char_length("value").alias("length"), "replacement")
        edits = rows.filter("action = 'replace'").groupBy("path").agg(F.collect_list(edit).alias("_edits"))
        files.write_files(correct.splice(made.files.select("path", "content").join(edits, "path"), "content", "_edits"), output)
    counts = correct.action_counts(rows).first()
    print(f"{counts['skip']} skipped, {counts['replace']} replaced, {counts['add']} added, {counts['report']} left", file=err)
    return int(sum(counts) > 0)


def corrected(made: Check) -> DataFrame:
    """path, content, fixed, unfixed for every file after one pass, to be written to a new place."""
    return correct.autocorrect(made.files, made.errors, made.words, "path", "content").drop("mark")


def settled(texts: DataFrame, config: settings.Settings, words: DataFrame, model: keys.Model | None = None, markers: str = OWN_NAME) -> DataFrame:
    """path, content, fixed, unfixed, rounds, ended for every file: corrected until nothing changes, by distinct pieces; texts that are
    not the sum of their pieces word by word."""
    done, left = pieces.corrected(texts, config, words, "path", "content", model, markers)
    if left.isEmpty():
        return done
    errors = lambda rows: build(rows, config, words, model, offsets=True, markers=markers).errors
    return done.unionByName(correct.fixpoint(left, errors, words, "path", "content"))


def corrected_once(texts: DataFrame, config: settings.Settings, words: DataFrame, model: keys.Model | None = None, markers: str = OWN_NAME) -> DataFrame:
    """``corrected`` by distinct pieces; texts with a region marker word by word."""
    done, left = pieces.corrected(texts, config, words, "path", "content", model, markers, once=True)
    done = done.select("path", "content", "fixed", "unfixed")
    return done if left.isEmpty() else done.unionByName(corrected(build(left, config, words, model, offsets=True, markers=markers)))


def add_words(words: DataFrame, decided: DataFrame) -> DataFrame:
    """The lists with the words that decisions add."""
    return wordlists.push(words, decided.filter("action = 'add'").select("name", F.col("value").alias("word")).distinct())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexcheck")
    mode = parser.add_mutually_exclusive_group()
    mode.add_argument("-w", "--wordlist", dest="mode", action="store_const", const="wordlist", help="print the unknown words")
    mode.add_argument("-q", "--quiet", dest="mode", action="store_const", const="quiet", help="exit code only")
    mode.add_argument("-a", "--autocorrect", dest="mode", action="store_const", const="autocorrect", help="correct what has a suggestion")
    mode.add_argument("-i", "--interactive", dest="decisions", metavar="FILE", help="apply the decisions of a CSV file")
    parser.add_argument("-d", "--dry-run", action="store_true", help="list the files")
    parser.add_argument("-f", "--suppress-file-rules", action="store_true")
    parser.add_argument("-c", "--config")
    parser.add_argument("--parallel", action=argparse.BooleanOptionalAction, default=True, help="accepted for compatibility: Spark's master decides")
    parser.add_argument("--words", help="folder of word lists: <language>.txt and <language>/<locale>.txt")
    parser.add_argument("--output", help="folder for corrected files")
    parser.add_argument("--project-words", default=".lexcheck_wordlists")
    parser.add_argument("--markers", default=OWN_NAME, help="name of the markers in files; several as a pattern: one|other")
    parser.add_argument("--key-model", help="YAML file of the key classifier")
    parser.add_argument("files", nargs="*")
    args = parser.parse_args(argv)
    try:
        config = settings.load(args.config)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("lexcheck").getOrCreate()
    if args.dry_run:
        for r in files.file_list(spark, args.files, config, suppress_file_rules=args.suppress_file_rules).select("path").orderBy("path").toLocalIterator():
            print(r["path"])
        return 0
    model = keys.load_model(args.key_model) if args.key_model else None
    mode = "decisions" if args.decisions else args.mode or "default"
    return run(spark, args.files, config, mode, ".", args.words, args.project_words, args.suppress_file_rules, model, output=args.output, decisions=args.decisions, markers=args.markers)


if __name__ == "__main__":
    sys.exit(main())
