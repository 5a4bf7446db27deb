"""Corrections: replacements spliced into texts, and a user's decisions as a table."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcheck.operators.suggest import nearest, recased
from lexcheck.storage import discard, materialise, small_batches, tasks_for


EDIT = "struct<start:int,length:int,replacement:string>"


def spliced(content: str, edits: list[dict]) -> str:
    """The text with the edits (start from 0, length, replacement; no overlaps, any order) applied."""
    pieces, at = [], 0
    for e in sorted(edits, key=lambda e: e["start"]):
        pieces += [content[at : e["start"]], e["replacement"]]
        at = e["start"] + e["length"]
    return "".join([*pieces, content[at:]])


def splice(rows: DataFrame, content: str, edits: str) -> DataFrame:
    """``rows`` with ``content`` edited and without the ``edits`` column (array of EDIT, or null).

    Rows without edits stay in the JVM. The others are cut and joined in Python, one pass a text: Spark's
    substr walks the text from its start for every edit, which is quadratic for long texts."""
    small_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c != edits]
    place, at = kept.index(content), len(kept)
    some = F.coalesce(F.size(edits), F.lit(0)) > 0

    def run(batches):
        for batch in batches:
            made = pa.array([spliced(t, e) for t, e in zip(batch.column(place).to_pylist(), batch.column(at).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([made if i == place else batch.column(i) for i in range(at)], kept)

    plain = rows.filter(~some | F.col(content).isNull()).select(kept)
    return plain.unionByName(rows.filter(some & F.col(content).isNotNull()).select(*kept, edits).mapInArrow(run, plain.schema))


def planned(errors: DataFrame, words: DataFrame) -> DataFrame:
    """Errors with ``suggestion``, their best one, re-cased, or null."""
    return suggested(errors, best_words(errors.select(F.col("norm").alias("term")), words))


def best_words(terms: DataFrame, words: DataFrame) -> DataFrame:
    """norm, word: the best suggestion of each term that has one."""
    return nearest(terms, words).select(F.col("term").alias("norm"), "word")


def suggested(errors: DataFrame, best: DataFrame) -> DataFrame:
    """``errors`` with the words of ``best(norm, word)`` in the errors' case, or null."""
    return recased(errors.join(best, "norm", "left"))


def autocorrect(texts: DataFrame, errors: DataFrame, words: DataFrame, key: str, content: str) -> DataFrame:
    """key, content, fixed, unfixed after one pass. ``errors`` need absolute char offsets (``start``). Each error is counted and
    replaced once. A suggestion of several words may bring errors of its own: ``fixpoint`` passes until there are none."""
    return applied(texts, planned(errors, words), key, content)


def applied(texts: DataFrame, rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, content, fixed, unfixed, mark after the corrections of ``rows``, errors with suggestions."""
    return splice(materialise(with_edits(texts, rows, key, content)), content, "_edits")


def with_edits(texts: DataFrame, rows: DataFrame, key: str, content: str, *kept: str) -> DataFrame:
    """key, content, the texts' ``kept`` columns, fixed, unfixed, ``mark`` (a hash of the text's replaced words in order) and ``_edits`` for ``splice``."""
    edit = F.struct(F.col("start").cast("int").alias("start"), F.char_length("value").alias("length"), F.col("suggestion").alias("replacement"))
    replaced = F.when(F.col("suggestion").isNotNull(), F.struct("start", "norm"))
    edits = rows.groupBy(key).agg(
        F.collect_list(F.when(F.col("suggestion").isNotNull(), edit)).alias("_edits"),
        F.xxhash64(F.transform(F.array_sort(F.collect_list(replaced)), lambda r: r["norm"])).alias("mark"),
        F.count_if(F.col("suggestion").isNotNull()).alias("fixed"),
        F.count_if(F.col("suggestion").isNull()).alias("unfixed"),
    )
    joined = texts.select(key, content, *kept).join(edits, key, "left")
    return joined.select(key, content, *kept, F.coalesce("fixed", F.lit(0)).alias("fixed"), F.coalesce("unfixed", F.lit(0)).alias("unfixed"), "mark", F.col("_edits"))


def fixpoint(texts: DataFrame, errors_of: Callable[[DataFrame], DataFrame], words: DataFrame, key: str, content: str) -> DataFrame:
    """key, content, fixed, unfixed, rounds, ended: texts corrected until nothing changes.

    ``errors_of(texts)`` gives a frame of texts' errors with ``start``. A round corrects all errors that have a suggestion. Only
    texts that it changed are scanned again, and only words not met before are looked up, so the work falls from
    round to round. A text whose round would replace the same words in the same order as an earlier one (a list's ``e-mail`` read
    as ``mail``, and ``mail`` corrected to ``e-mail``) would go on for ever: it ends there, as ``cycle``, its content left as the
    rounds before made it; what that round would have replaced counts as unfixed. Other texts end ``stable``.
    ``fixed`` sums over rounds, ``unfixed`` is what is left. Rounds are written as tables, so none is computed twice."""
    dealt = materialise(texts.select(key, content).repartition(tasks_for(texts), key))  # a file of one row group is one task, for every round
    now = dealt.withColumns({"rounds": F.lit(0), "sum": F.lit(0).cast("long"), "seen": F.array().cast("array<bigint>")})
    best: DataFrame | None = None
    tried: DataFrame | None = None
    done: DataFrame | None = None
    before = [dealt]
    while True:
        errors = materialise(errors_of(now.select(key, content)).select(key, "norm", "value", "start"))
        terms = errors.select(F.col("norm").alias("term")).distinct()
        terms = materialise(terms if tried is None else terms.join(tried, "term", "left_anti"))
        if best is None:
            best, tried = materialise(best_words(terms, words)), terms
        elif not terms.isEmpty():  # later rounds mostly meet no new word: nothing is looked up
            best, tried = best.unionByName(materialise(best_words(terms, words))), tried.unionByName(terms)
        else:
            discard(terms)
        edits = with_edits(now, suggested(errors, best), key, content, "rounds", "sum", "seen").withColumn("_made", F.col(content))
        again = F.coalesce(F.array_contains("seen", F.col("mark")), F.lit(False))
        ended = F.when(F.col("fixed") == 0, "stable").when(again, "cycle")
        # a text that ends keeps its content: what it would become is neither made nor written
        edits = edits.withColumn("ended", ended).withColumn("_edits", F.when(F.col("ended").isNull(), F.col("_edits"))).withColumn("_made", F.when(F.col("ended").isNull(), F.col("_made")))
        edits = edits.withColumn(content, F.when(F.col("ended").isNotNull(), F.col(content)))
        edits = materialise(edits)
        rows = materialise(splice(edits, "_made", "_edits"))
        over = rows.filter("ended is not null").select(
            key, content, F.col("sum").alias("fixed"), F.when(F.col("ended") == "cycle", F.col("fixed") + F.col("unfixed")).otherwise(F.col("unfixed")).alias("unfixed"), "rounds", "ended"
        )
        over = materialise(over)
        done = over if done is None else done.unionByName(over)
        going = rows.filter("ended is null")
        discard(errors, edits, *before)  # what nothing reads any more: at any time two rounds' texts are kept
        before = [rows]
        if going.isEmpty():
            discard(rows)
            return done
        now = going.select(
            key, F.col("_made").alias(content), (F.col("rounds") + 1).alias("rounds"), (F.col("sum") + F.col("fixed")).alias("sum"), F.concat("seen", F.array("mark")).alias("seen")
        )


def decide(errors: DataFrame, decisions: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Errors with an ``action``: skip (this text's word), replace (this exact value everywhere), add (to a list),
    else report. ``decisions(action, <key>, norm, value, replacement, name)``: unused fields are null. ``parts``: into how many
    partitions errors are dealt for each join (``storage.tasks_for``); without it, as many as the session has."""
    dealt = lambda rows, *by: rows.repartition(parts, *by) if parts else rows  # noqa: E731 - both sides, else Spark deals them as the session says
    skip = dealt(decisions.filter("action = 'skip'").select(F.col(key).alias("_key"), F.col("norm").alias("_norm"), F.lit(True).alias("_skip")).distinct(), "_key", "_norm")
    add = dealt(decisions.filter("action = 'add'").groupBy(F.col("norm").alias("_added")).agg(F.min("name").alias("_name")), "_added")
    swap = dealt(decisions.filter("action = 'replace'").groupBy(F.col("value").alias("_value")).agg(F.min("replacement").alias("_replacement")), "_value")
    rows = dealt(errors, key, "norm").join(skip, (F.col(key) == F.col("_key")) & (F.col("norm") == F.col("_norm")), "left")
    rows = dealt(rows, "norm").join(add, F.col("norm") == F.col("_added"), "left")
    rows = dealt(rows, "value").join(swap, F.col("value") == F.col("_value"), "left")
    action = F.when(F.col("_skip"), "skip").when(F.col("_name").isNotNull(), "add").when(F.col("_replacement").isNotNull(), "replace").otherwise("report")
    return rows.select(*errors.columns, action.alias("action"), F.col("_replacement").alias("replacement"), F.col("_name").alias("name"))


def list_for(addable: Column, letter: Column) -> Column:
    """The list a word is added to: that of the first addable language of the file (as ``addable_of`` gives them)
    with this letter; null if there is none."""
    return F.get(F.filter(addable, lambda x: x["key"] == letter), 0)["name"]


def with_lists(decisions: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Decisions to add a word, ``decisions(action, <key>, letter, ...)``, with the ``name`` of the list of the file
    they were made in; those that no list of the file takes become ``refused``, which ``decide`` leaves reported."""
    takes = files.select(F.col(key).alias("_key"), "addable")
    rows = decisions.join(takes, decisions[key] == F.col("_key"), "left")
    name = F.when(F.col("action") == "add", list_for(F.col("addable"), F.col("letter")))
    action = F.when((F.col("action") == "add") & name.isNull(), "refused").otherwise(F.col("action"))
    kept = [c for c in decisions.columns if c not in ("action", "letter", "name")]
    return rows.select(action.alias("action"), *kept, name.alias("name"))


def action_counts(decided: DataFrame, n: Column | None = None) -> DataFrame:
    """How many errors each action has; ``n``: how many a row stands for."""
    n = F.lit(1).cast("long") if n is None else n
    return decided.agg(*[F.coalesce(F.sum(F.when(F.col("action") == a, n)), F.lit(0).cast("long")).alias(a) for a in ("skip", "replace", "add", "report")])
