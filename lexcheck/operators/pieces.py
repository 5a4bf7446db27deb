"""Corrections by distinct pieces: what a text becomes is what its blank-separated pieces become.

No pattern looks past a blank, so each distinct piece of all texts is scanned, looked up and corrected once, and so is, round by
round, what became of it. Texts are dealt into shares of bounded size; a share meets the distinct pieces it holds, and its
texts are put together from them, round by round, in one pass. No word of a text is shuffled, only a share's distinct pieces.

Not all texts are the sum of their pieces: those with a region marker, those in which a correction makes a marker or changes
the first line that names their languages, and those that want more rounds than pieces were followed for (``ROUNDS``). They
are left over, unchanged, for ``correct.fixpoint``.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcheck.functions import keys, patterns
from lexcheck.operators import check, correct
from lexcheck.operators.languages import languages_of
from lexcheck.operators.suggest import recased
from lexcheck.operators.tokenize import Scanner, normalised
from lexcheck.shipping import ship
from lexcheck.sources.files import first_line
from lexcheck.sources.settings import Settings
from lexcheck.storage import discard, materialise, small_batches, tasks_for

SET = check.SET
SHARE_CHARS = 4 << 20  # of texts that are put together at a time
ROUNDS = 12  # that pieces are followed for
BLANKS = re.compile(r"([ \t\n\x0B\f\r]+)")
ODD_BLANKS = re.compile(r"[\t\x0B\f\r]")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: One word between marks that no other pattern begins with.
SIMPLE = r"([^\p{L}\p{Nd}/%#@\\]*+)(\p{Lu}?\p{Ll}+|\p{Lu}+)[^\p{L}\p{Nd}/%#@\\]*+"
NOT_SIMPLE = {"SG", "mailto"}  # words that begin another pattern without a digit, a letter or one of these marks behind them


def word_of(found) -> tuple[int, str] | None:
    """(offset, word) of a match of ``SIMPLE``; None if the scanner has to look: a repeated letter, the alphabet."""
    word = found.group(2)
    if word in NOT_SIMPLE or word.count(word[0]) == len(word) or ALPHABET.startswith(word.casefold()):
        return None
    return found.start(2), word


def _words(rows: DataFrame, settings: Settings, model: keys.Model, name: str) -> DataFrame:
    """SET, piece, start, value: the words of ``rows(SET, piece, text)``."""
    least = settings.word_minimum_length

    def run(batches):
        import regex

        scanner, simple = Scanner(settings, model, name=name), regex.compile(SIMPLE).fullmatch
        for batch in batches:
            row, starts, values = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                m = simple(text)
                if m and (one := word_of(m)):
                    if len(one[1]) >= least:
                        row.append(i)
                        starts.append(one[0])
                        values.append(one[1])
                    continue
                for start, value in scanner.line(text)[0]:
                    row.append(i)
                    starts.append(start)
                    values.append(value)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()), pa.array(values, pa.string())], [SET, "piece", "start", "value"])

    return rows.select(SET, "piece", "text").mapInArrow(run, f"{SET} string, piece string, start int, value string")


def _edited(rows: DataFrame) -> DataFrame:
    """SET, piece and what ``one_step`` makes (norms: the replaced words in order, each ended by a NUL) of ``rows(SET, piece, text, errors)``."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(3).flatten()
            words, at, made, fixed, unfixed, replaced = list(zip(*(flat.field(k).to_pylist() for k in range(4)), strict=True)), 0, [], [], [], []
            for text, size in zip(batch.column(2).to_pylist(), sizes.tolist(), strict=True):
                mine = words[at : at + size]
                step = one_step(text, mine if size == 1 else sorted(mine, key=itemgetter(0)))
                at += size
                made.append(step["made"])
                fixed.append(step["fixed"])
                unfixed.append(step["unfixed"])
                replaced.append(step["norms"])
            columns = [pa.array(made, pa.string()), pa.array(fixed, pa.int32()), pa.array(unfixed, pa.int32()), pa.array(replaced, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [SET, "piece", "made", "fixed", "unfixed", "norms"])

    return rows.select(SET, "piece", "text", "errors").mapInArrow(run, f"{SET} string, piece string, made string, fixed int, unfixed int, norms string")


@dataclass
class Speller:
    """Corrects pieces; what it has looked up it does not look up again."""

    settings: Settings
    words: DataFrame
    model: keys.Model
    name: str
    best: DataFrame | None = None
    tried: DataFrame | None = None

    def _look_up(self, errors: DataFrame) -> None:
        terms = errors.select(F.col("norm").alias("term")).distinct()
        terms = materialise(terms if self.tried is None else terms.join(self.tried, "term", "left_anti"))
        if self.best is None:
            self.best, self.tried = materialise(correct.best_words(terms, self.words)), terms
        elif not terms.isEmpty():
            self.best, self.tried = self.best.unionByName(materialise(correct.best_words(terms, self.words))), self.tried.unionByName(terms)

    def _wrong(self, found: DataFrame) -> DataFrame:
        """SET, piece, start, value, norm, suggestion of the errors among words."""
        rows = normalised(found).withColumn("_set", F.col(SET))
        errors = materialise(check.unknown_by_language(rows, self.words).select(F.col("_set").alias(SET), "piece", "start", "value", "norm"))
        self._look_up(errors)
        return recased(errors.join(self.best, "norm", "left"))

    def found(self, rows: DataFrame) -> DataFrame:
        return _words(rows, self.settings, self.model, self.name)

    def edits(self, pieces: DataFrame) -> DataFrame:
        """What becomes of ``pieces(SET, piece)`` in one round, for those that have errors."""
        wrong = self._wrong(self.found(pieces.withColumn("text", F.col("piece"))))
        grouped = wrong.groupBy(SET, "piece").agg(F.collect_list(F.struct("start", "value", "norm", "suggestion")).alias("errors"))
        return materialise(_edited(grouped.withColumn("text", F.col("piece"))))

    def read(self, rows: DataFrame) -> DataFrame:
        """SET, piece, words (``WORDS``) of ``rows(SET, piece, text)``: each word of the text, what it is corrected to; ``norm`` is null if it is
        no error."""
        found = materialise(self.found(rows))
        told = found.join(self._wrong(found).select(SET, "piece", "start", "norm", "suggestion"), [SET, "piece", "start"], "left")
        return told.groupBy(SET, "piece").agg(F.collect_set(F.struct("value", "norm", "suggestion")).alias("words"))


WORDS = "array<struct<value:string,norm:string,suggestion:string>>"
STEPS = "array<struct<made:string,fixed:int,unfixed:int,norms:string>>"


def _followed(speller: Speller, first: DataFrame) -> DataFrame:
    """SET, made, tail: for each string that ``first`` made, what further rounds do to it, as JSON: (made, fixed, unfixed, norms) of each. The
    last one is the first that fixes nothing or makes a string met before, else the last of ``ROUNDS``. Strings without errors are left out.

    A string is followed as long as its words have been met in its own earlier forms; others are looked up together, for all strings."""
    settings, model, name = speller.settings, speller.model, speller.name

    def run(batches):
        scanner = Scanner(settings, model, name=name)
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            for piece, text, steps, old, new in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                words = {w["value"]: (w["norm"], w["suggestion"]) for w in old + new}
                on, met = len(steps) < ROUNDS, {piece, *(x["made"] for x in steps)}
                while on:
                    found = scanner.line(text)[0]
                    if any(v not in words for _, v in found):
                        break
                    step = one_step(text, [(at, v, *words[v]) for at, v in found])
                    text, on = step["made"], step["fixed"] > 0 and step["made"] not in met and len(steps) + 1 < ROUNDS
                    met.add(text)
                    steps.append(step)
                for column, value in zip(columns, (text, steps, [{"value": v, "norm": n, "suggestion": x} for v, (n, x) in words.items()], on), strict=True):
                    column.append(value)
            made = [pa.array(c, f.type) for c, f in zip(columns, (batch.schema.field(2), batch.schema.field(3), batch.schema.field(4)), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made, pa.array(columns[3], pa.bool_())], [SET, "piece", "text", "steps", "words", "_on"])

    rows = first.filter("fixed > 0").select(SET, F.col("made").alias("piece")).distinct()
    rows = materialise(rows.select(SET, "piece", F.col("piece").alias("text"), F.array().cast(STEPS).alias("steps"), F.array().cast(WORDS).alias("words")))
    ended: DataFrame | None = None
    while True:
        read = speller.read(rows).withColumnRenamed("words", "_new")
        joined = rows.join(read, [SET, "piece"], "left").select(SET, "piece", "text", "steps", "words", F.coalesce("_new", F.array().cast(WORDS)).alias("_new"))
        # the strings are few, the work on them is not
        after = joined.repartition(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "piece")
        after = materialise(after.mapInArrow(run, f"{SET} string, piece string, text string, steps {STEPS}, words {WORDS}, _on boolean"))
        over = after.filter("not _on").select(SET, "piece", "steps")
        ended = over if ended is None else ended.unionByName(over)
        rows = after.filter("_on").drop("_on")
        if rows.isEmpty():
            break
    ended = ended.filter((F.size("steps") > 1) | (F.col("steps")[0]["fixed"] > 0) | (F.col("steps")[0]["unfixed"] > 0))
    return materialise(ended.select(SET, F.col("piece").alias("made"), F.to_json("steps").alias("tail")))


def one_step(text: str, words: list[tuple[int, str, str | None, str | None]]) -> dict:
    """What a round does to a text of these words (start, value, norm, suggestion), in order; ``norm`` is null if the word is no error."""
    out, last, norms, unfixed = [], 0, [], 0
    for start, value, norm, suggestion in words:
        if norm is None:
            continue
        if suggestion is None:
            unfixed += 1
            continue
        out += [text[last:start], suggestion]
        last = start + len(value)
        norms.append(norm + "\0")
    return {"made": "".join([*out, text[last:]]), "fixed": len(norms), "unfixed": unfixed, "norms": "".join(norms)}


class Orbit:
    """What rounds after the first do to what it made: ``states[k]`` before round k + 1, ``steps[k]`` what that round does: (fixed, unfixed,
    norms). After the last step it is as before step ``back``; None: not known."""

    __slots__ = ("back", "states", "steps")

    def __init__(self, made: str, tail: list[dict]) -> None:
        self.steps = [(s["fixed"], s["unfixed"], s["norms"]) for s in tail]
        self.states = [made, *(s["made"] for s in tail)]
        last = self.states[-1]
        self.back = len(tail) - 1 if not self.steps[-1][0] else self.states.index(last) if last in self.states[:-1] else None

    def at(self, r: int) -> int:
        """The place of round r among the steps; past them if it is not known."""
        k, n = r - 1, len(self.steps)
        return k if k < n else n if self.back is None else self.back + (k - self.back) % (n - self.back)

    def over(self, k: int) -> bool:
        """Nothing changes from step k on."""
        return not self.steps[k][0]


WIDE = 40  # bits of a count


class Known:
    """What one round makes of pieces, and what further rounds do to that. ``counts`` holds three numbers in one: how many errors are fixed,
    how many are not, and how many are not in a piece that stays as it is."""

    def __init__(self) -> None:
        self.made: dict[str, str] = {"": "", "\n": "\n"}
        self.counts: dict[str, int] = {"": 0, "\n": 0}
        self.norms: dict[str, str] = {"": "", "\n": ""}
        self.orbits: dict[str, Orbit] = {}

    def add(self, piece: str, made: str | None, fixed: int | None, unfixed: int | None) -> None:
        self.made[piece] = piece if made is None else made
        self.counts[piece] = 0 if made is None else fixed | (unfixed << WIDE) | ((0 if fixed else unfixed) << 2 * WIDE)

    def counted(self, pieces: list[str]) -> tuple[int, int, int]:
        n, mask = sum(map(self.counts.__getitem__, pieces)), (1 << WIDE) - 1
        return n & mask, (n >> WIDE) & mask, n >> 2 * WIDE


def cut(text: str) -> tuple[list[str], Callable[[Iterable[str]], str]]:
    """The pieces of a text, line feeds and empty ones among them, and what joins others in their places."""
    if ODD_BLANKS.search(text):
        parts = BLANKS.split(text)

        def joined(pieces: Iterable[str]) -> str:
            parts[::2] = pieces
            return "".join(parts)

        return parts[::2], joined
    # every line feed between two blanks more, which go again
    return text.replace("\n", " \n ").split(" "), lambda made: " ".join(made).replace(" \n ", "\n")


def one_round(text: str, known: Known) -> tuple[str, int, int]:
    """(content, fixed, unfixed) after one round."""
    pieces, joined = cut(text)
    fixed, unfixed, _ = known.counted(pieces)
    if not fixed:
        return text, 0, unfixed
    return joined(map(known.made.__getitem__, pieces)), fixed, unfixed


def all_rounds(text: str, known: Known, changed: Callable[[str], bool]) -> tuple[str, int, int, int, str] | None:
    """(content, fixed, unfixed, rounds, ended) of a text; None if it is not known. ``changed(content)``: the text is no longer the sum
    of its pieces. A round that would replace the same words in the same order as an earlier one ends the text as it is."""
    pieces, joined = cut(text)
    total, unfixed, still = known.counted(pieces)
    if not total:
        return text, 0, unfixed, 0, "stable"
    digest = lambda norms: hashlib.blake2b("".join(norms).encode(), digest_size=16).digest()
    seen = {digest(map(known.norms.__getitem__, pieces))}
    now = list(map(known.made.__getitem__, pieces))
    content = joined(now)
    if changed(content):
        return None
    orbit = known.orbits.get
    moving = [(k, o) for k, p in enumerate(pieces) if (o := orbit(p))]
    r = 1
    while True:
        steps = [o.steps[o.at(r)] for _, o in moving]
        fixed, unfixed = sum(s[0] for s in steps), still + sum(s[1] for s in steps)
        if not fixed:
            return content, total, unfixed, r, "stable"
        mark = digest(s[2] for s in steps)
        if mark in seen:
            return content, total, fixed + unfixed, r, "cycle"
        seen.add(mark)
        total, r, on = total + fixed, r + 1, []
        for place, o in moving:
            at = o.at(r)
            if at == len(o.steps):
                return None
            now[place] = o.states[at]
            if o.over(at):
                still += o.steps[at][1]
            else:
                on.append((place, o))
        moving, content = on, joined(now)
        if changed(content):
            return None


def _put_together(dealt: DataFrame, pieces: DataFrame, key: str, content: str, name: str, once: bool) -> DataFrame:
    """key, content, fixed, unfixed, rounds, ended (null: left over, the content as it was)."""
    kind = dealt.schema[key].dataType.simpleString()

    def together(texts: pa.Table, told: pa.Table) -> pa.Table:
        import regex

        marker = regex.compile(patterns.any_marker(name)).search
        counts = {"fixed", "unfixed"}
        values = lambda c: (told.column(c).fill_null(0) if c in counts else told.column(c)).to_numpy().tolist()  # noqa: E731 - faster than to_pylist
        known: dict[str, Known] = {group: Known() for group in pc.unique(texts.column(SET)).to_pylist()}
        for group, piece, made, fixed, unfixed in zip(*map(values, (SET, "piece", "made", "fixed", "unfixed")), strict=True):
            known[group].add(piece, made, fixed, unfixed)
        if not once:
            orbits: dict[str, Orbit] = {}
            for group, piece, made, norms, tail in zip(*map(values, (SET, "piece", "made", "norms", "tail")), strict=True):
                known[group].norms[piece] = norms or ""
                if tail is not None:
                    o = orbits.get(tail)
                    if o is None or o.states[0] != made:
                        o = orbits[tail] = Orbit(made, json.loads(tail))
                    known[group].orbits[piece] = o
        columns: list[list] = [[] for _ in range(5)]
        for text, group in zip(texts.column(content).to_pylist(), texts.column(SET).to_pylist(), strict=True):
            if text is None:
                got = None, 0, 0, 0, "stable"
            elif once:
                got = *one_round(text, known[group]), 0, "stable"
            else:
                first = text.split("\n", 1)[0] if text.startswith("#!") else None
                changed = lambda t: bool(marker(t)) or ((first is not None or t.startswith("#!")) and t.split("\n", 1)[0] != first)  # noqa: B023, E731
                got = all_rounds(text, known[group], changed) or (text, 0, 0, 0, None)
            for column, value in zip(columns, got, strict=True):
                column.append(value)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.Table.from_arrays([texts.column(key), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [key, content, "fixed", "unfixed", "rounds", "ended"])

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        gc.disable()  # a share's dictionaries hold no cycles, and are gone through again and again while they grow
        try:
            return together(texts, told)
        finally:
            gc.enable()

    schema = f"`{key}` {kind}, `{content}` string, fixed long, unfixed long, rounds int, ended string"
    return dealt.groupBy("_share").cogroup(pieces.groupBy("_share")).applyInArrow(run, schema)


def _dealt(rows: DataFrame, key: str, content: str, parts: int) -> DataFrame:
    """``rows(key, content, SET, _marked)`` with ``_share``, of about ``SHARE_CHARS`` characters each."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        share, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            shares = []
            for size in pc.utf8_length(batch.column(1)).to_pylist():
                if held and held + (size or 0) > SHARE_CHARS:
                    share, held = share + 1, 0
                held += size or 0
                shares.append(share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shares, pa.int64())], [key, content, SET, "_marked", "_share"])

    dealt = rows.select(key, content, SET, "_marked").repartition(parts, F.xxhash64(key, content))
    return materialise(dealt.mapInArrow(run, f"`{key}` {kind}, `{content}` string, {SET} string, _marked boolean, _share long"))


def _pieces(dealt: DataFrame, content: str) -> DataFrame:
    """_share, SET, piece: the pieces of each share, once for each time that its texts are read together."""

    def run(batches):
        held: dict[tuple[int, str], set[bytes]] = {}

        def out():
            for (share, group), found in held.items():
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, share)), pa.array([group] * n, pa.string()), pa.array(list(found), pa.binary()).cast(pa.string())], ["_share", SET, "piece"])
            held.clear()

        for batch in batches:
            for text, group, share in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (share, group) not in held and next(iter(held))[0] != share:
                    yield from out()
                held.setdefault((share, group), set()).update((text or b"").split())  # of bytes: at the blanks of ASCII
        yield from out()

    return dealt.select(content, SET, "_share").mapInArrow(run, f"_share long, {SET} string, piece string")


def corrected(texts: DataFrame, settings: Settings, words: DataFrame, key: str, content: str, model: keys.Model | None = None, name: str = patterns.OWN_NAME, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(key, content, fixed, unfixed, rounds, ended of the texts that are the sum of their pieces; key, content of those left over).

    ``once``: one round, after which texts are as it left them; ``unfixed`` then counts what it had no suggestion for."""
    spark = texts.sparkSession
    ship(spark)
    small_batches(spark)
    model = model or keys.default_model()
    marked = F.coalesce(F.col(content).rlike(patterns.any_marker(name)), F.lit(False))
    known = languages_of(texts.withColumn("first_line", first_line(F.col(content))), list(settings.languages), key)
    parts = tasks_for(texts)
    every = _dealt(known.select(key, content, check.language_set(F.col("languages")), marked.alias("_marked")), key, content, parts)
    left, dealt = materialise(every.filter("_marked").select(key, content)), every.filter("not _marked")
    held = materialise(_pieces(dealt, content))
    distinct = held.select(SET, "piece").repartition(max(parts, tasks_for(held, 2 << 20)), SET, "piece").distinct()
    speller = Speller(settings, words, model, name)
    made = speller.edits(distinct)
    if once:
        made = made.withColumn("tail", F.lit(None).cast("string"))
    else:
        made = made.join(_followed(speller, made), [SET, "made"], "left")
    told = held.join(made, [SET, "piece"], "left")
    # more tasks than partitions of the session: shares are few, the work on them is not
    together = lambda rows: rows.repartition(2 * parts, "_share")
    out = materialise(_put_together(together(dealt), together(told), key, content, name, once))
    discard(every, held)
    rest = out.filter("ended is null").select(key, content)
    return out.filter("ended is not null"), left.unionByName(rest)
