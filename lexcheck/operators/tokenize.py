"""Words of texts with their positions.

Most lines take the built-in path: one regular expression tiles each line, its second group being the
words. A rejected key resumes inside itself, so lines that hold a possible key go through a scanner in Python (Arrow batches);
no pattern looks past a blank, so it reads their blank-separated pieces, each distinct piece once, and puts
the words back by the pieces' places. Only texts with a region marker, which carries state from line to line, are
scanned whole. All paths give the same rows (``pos`` numbers the words of a line), and none shuffles; where offsets are
asked for, the lengths of the built-in path's tiles are summed over Arrow columns. The paths are
branches of a union over the same scan; the test that tells them apart is a literal or digit search, cheap
beside the tiling, so the text column is read more than once and tiled once.

Counting needs less: outside marked texts no pattern looks past a blank, so words can be counted from the
distinct blank-separated pieces (``token_counts``), which are far fewer than the pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcheck.functions import keys, patterns
from lexcheck.functions.text import normalise_word
from lexcheck.operators.lines import KEY, split_lines
from lexcheck.shipping import ship
from lexcheck.sources.settings import Settings

TOKENS = ["line_number", "pos", "value", "char_offset", "byte_offset", "start"]
#: Blanks no pattern crosses.
BLANKS = r"[ \t\n\x0B\f\r]+"
PIECE = re.compile(r"[^ \t\n\x0B\f\r]+")
MEMO_PIECES, MEMO_CHARS = 100_000, 200  # what a task's scanner remembers: so many pieces, none longer


def _bytes_before(line: str, found: list[tuple[int, str]]) -> list[int]:
    """The byte offsets of words at these characters."""
    if line.isascii():
        return [at for at, _ in found]
    out, chars, size = [], 0, 0
    for at, _ in found:
        size, chars = size + len(line[chars:at].encode()), at
        out.append(size)
    return out


class Scanner:
    """The sequential scanner: skips, keys, leftovers, markers, words, one character at a time otherwise.

    Look-behinds of the patterns stay inside their match, so matching at a position is matching the rest of
    the line: one pass, whatever the line's length."""

    def __init__(self, settings: Settings, model: keys.Model, skip_keys: bool = True, name: str = patterns.OWN_NAME) -> None:
        import regex

        compiled = lambda p: regex.compile(p).match
        self.skip, self.after, self.term = compiled(patterns.skips()), compiled(patterns.after_key("i")), compiled(patterns.TERM)
        self.key = compiled(patterns.POSSIBLE_KEY) if skip_keys else None
        self.enable, self.disable = compiled(patterns.marker("enable", name)), compiled(patterns.marker("disable", name))
        self.line_off = regex.compile(patterns.line_marker(name)).search
        self.settings, self.model = settings, model
        self.memo: dict[str, list[tuple[int, str]]] = {}
        self.scanned = 0

    def _is_key(self, found: str) -> bool:
        s = self.settings
        return keys.is_key(found, self.model, s.key_heuristic_weight, s.key_minimum_length, s.word_minimum_length)

    def line(self, line: str, disabled: bool = False) -> tuple[list[tuple[int, str]], bool]:
        """(offset, word) of one line, and whether the region is disabled after it."""
        out, pos = [], 0
        while pos < len(line):
            m = self.skip(line, pos)
            if not m and self.key and (m := self.key(line, pos)) and not self._is_key(m.group()):
                m = None
            m = m or self.after(line, pos)
            if m:
                pos = m.end()
                continue
            m = (self.enable if disabled else self.disable)(line, pos)
            if m:
                disabled, pos = not disabled, m.end()
                continue
            m = self.term(line, pos)
            if m:
                if not disabled and m.end() - pos >= self.settings.word_minimum_length:
                    out.append((pos, m.group()))
                pos = m.end()
            else:
                pos += 1
        return out, disabled

    def pieces(self, line: str) -> list[tuple[int, str]]:
        """(offset, word) of a line without region markers, by its blank-separated pieces; what a piece holds is remembered."""
        out: list[tuple[int, str]] = []
        for m in PIECE.finditer(line):
            piece, at = m.group(), m.start()
            found = self.memo.get(piece)
            if found is None:
                found = self.line(piece)[0]
                if len(piece) <= MEMO_CHARS:
                    if len(self.memo) >= MEMO_PIECES:
                        self.memo.clear()
                    self.memo[piece] = found
                self.scanned += 1
            out += [(at + o, w) for o, w in found]
        return out

    def text(self, content: str) -> Iterator[tuple[int, int, str, int, int, int]]:
        """line_number, pos (of the word in its line), value, char_offset, byte_offset (both in the line), start (in the text)."""
        disabled, after = False, 0
        lines = content.split("\n")
        if lines and lines[-1] == "":
            lines.pop()
        for number, line in enumerate(lines, 1):
            begin, after = after, after + len(line) + 1
            if self.line_off(line):
                continue
            found, disabled = self.line(line, disabled)
            for k, ((at, word), size) in enumerate(zip(found, _bytes_before(line, found), strict=True)):
                yield number, k, word, at, size, begin + at


def _scanned(rows: DataFrame, settings: Settings, model: keys.Model, name: str) -> DataFrame:
    """The scanner over ``rows(KEY, content)``."""
    ship(rows.sparkSession)
    kind = rows.schema[KEY].dataType.simpleString()

    def run(batches):
        scanner = Scanner(settings, model, name=name)
        for batch in batches:
            for i in range(batch.num_rows):  # a text at a time: memory holds one text's words
                found = list(scanner.text(batch.column(1)[i].as_py()))
                if found:
                    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
                    made = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                    key = batch.column(0).take(pa.array([i] * len(found), pa.int64()))
                    yield pa.RecordBatch.from_arrays([key, *made], [KEY, *TOKENS])

    return rows.mapInArrow(run, f"`{KEY}` {kind}, line_number int, pos int, value string, char_offset int, byte_offset int, start long")


def _pieced(lines: DataFrame, settings: Settings, model: keys.Model) -> DataFrame:
    """KEY, line_number, pos, value of ``lines(KEY, line_number, line)`` that hold possible keys."""
    ship(lines.sparkSession)
    kind = lines.schema[KEY].dataType.simpleString()

    def run(batches):
        scanner = Scanner(settings, model)
        for batch in batches:
            found = [scanner.pieces(x) for x in batch.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            pos = pa.array([k for f in found for k in range(len(f))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pos, pa.array([w for f in found for _, w in f], pa.string())], [KEY, *TOKENS[:3]])

    return lines.select(KEY, "line_number", "line").mapInArrow(run, f"`{KEY}` {kind}, line_number int, pos int, value string")


def _placed(lines: DataFrame, settings: Settings, model: keys.Model) -> DataFrame:
    """The words of ``lines(KEY, line_number, line, hard)`` with their offsets: running sums over the tiles' lengths,
    taken over whole Arrow columns, a line's sums starting from its first tile, a text's from its first line. What a
    text has before a batch is carried over; its lines come together and in order. A hard line is one tile, and its words
    come from the scanner of pieces."""
    ship(lines.sparkSession)
    kind = lines.schema[KEY].dataType.simpleString()
    least = max(1, settings.word_minimum_length)

    def of_pieces(scanner: Scanner, batch: pa.RecordBatch, before: np.ndarray) -> pa.RecordBatch | None:
        """The words of the batch's hard lines, given what stands in the text before each line."""
        columns: list[list] = [[] for _ in range(6)]
        for i in np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False)).tolist():
            line = batch.column(4)[i].as_py()
            found = scanner.pieces(line)
            for k, ((at, word), size) in enumerate(zip(found, _bytes_before(line, found), strict=True)):
                for column, value in zip(columns, (i, k, word, at, size, int(before[i]) + at), strict=True):
                    column.append(value)
        row = pa.array(columns[0], pa.int64())
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
        made = [pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *made], [KEY, *TOKENS])

    def run(batches):
        scanner = Scanner(settings, model)
        carried = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            begun = np.maximum.accumulate(np.where(batch.column(1).to_numpy() == 1, np.arange(batch.num_rows), -1))
            tiles, words = batch.column(3), batch.column(2).flatten()
            sizes = pc.list_value_length(tiles).to_numpy(zero_copy_only=False)
            flat = tiles.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            keep = pc.utf8_length(words).to_numpy(zero_copy_only=False) >= least
            offsets = []
            for length in (pc.utf8_length(flat), pc.binary_length(flat)):
                ahead = np.concatenate(([0], np.cumsum(length.to_numpy(zero_copy_only=False), dtype=np.int64)))
                first = ahead[np.cumsum(sizes) - sizes]
                offsets.append((ahead[:-1] - first[row])[keep])
                if len(offsets) == 1:  # in characters: a line is its tiles and a line feed
                    starts = first + np.arange(len(sizes))
                    base = np.where(begun >= 0, starts[begun], -carried)
                    before = starts - base
                    carried = int(ahead[-1] + len(sizes) - base[-1])
            row = row[keep]
            pos = np.arange(len(row)) - np.searchsorted(row, row, "left")
            picked = pa.array(row)
            placed = [pa.array(o, pa.int32()) for o in offsets] + [pa.array(before[row] + offsets[0], pa.int64())]
            columns = [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(pos, pa.int32()), words.filter(pa.array(keep)), *placed]
            yield pa.RecordBatch.from_arrays(columns, [KEY, *TOKENS])
            if batch.column(4).null_count < batch.num_rows:
                yield of_pieces(scanner, batch, before)

    whole = lambda group: F.when(F.col("hard"), F.array(F.lit("") if group == 2 else F.col("line"))).otherwise(F.regexp_extract_all("line", F.lit(patterns.tiles()), F.lit(group)))
    rows = lines.select(KEY, "line_number", whole(2).alias("words"), whole(0).alias("tiles"), F.when(F.col("hard"), F.col("line")).alias("line"))
    return rows.mapInArrow(run, f"`{KEY}` {kind}, line_number int, pos int, value string, char_offset int, byte_offset int, start long")


def line_words(df: DataFrame, key: str, content: str, settings: Settings, model: keys.Model | None = None, name: str = patterns.OWN_NAME) -> DataFrame:
    """key, line_number, line, words (array of value, char_offset): lines that hold words, with them, so that nothing is joined
    to show a word in its line. The words are those of ``tokenize``."""
    ship(df.sparkSession)
    model = model or keys.default_model()
    rows = df.select(F.col(f"`{key}`").alias(KEY), F.col(f"`{content}`").alias("content")).filter("content is not null")
    kind = rows.schema[KEY].dataType.simpleString()
    marked = F.col("content").rlike(patterns.any_marker(name))
    schema = f"`{KEY}` {kind}, line_number int, line string, words array<struct<value:string,char_offset:int>>"
    least = max(1, settings.word_minimum_length)

    def nested(before: list[pa.Array], row: np.ndarray, values: pa.Array, chars: pa.Array) -> pa.RecordBatch:
        """The lines with words among ``before``, given each word's row in ascending order."""
        sizes = np.bincount(row, minlength=len(before[0]))
        some = pa.array(np.flatnonzero(sizes))
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes[sizes > 0]))), pa.int32())
        words = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([values, chars], ["value", "char_offset"]))
        return pa.RecordBatch.from_arrays([*[c.take(some) for c in before], words], [KEY, "line_number", "line", "words"])

    def listed(before: list[pa.Array], found: list[list[tuple[int, str]]]) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return nested(before, row, pa.array([w for f in found for _, w in f], pa.string()), pa.array([at for f in found for at, _ in f], pa.int32()))

    def tiled(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles, words = batch.column(4), batch.column(3).flatten()
            sizes = pc.list_value_length(tiles).to_numpy(zero_copy_only=False)
            keep = pc.utf8_length(words).to_numpy(zero_copy_only=False) >= least
            ahead = np.concatenate(([0], np.cumsum(pc.utf8_length(tiles.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)))
            row = np.repeat(np.arange(len(sizes)), sizes)
            chars = (ahead[:-1] - ahead[np.cumsum(sizes) - sizes][row])[keep]
            yield nested(list(batch.columns[:3]), row[keep], words.filter(pa.array(keep)), pa.array(chars, pa.int32()))

    def pieced(batches):
        scanner = Scanner(settings, model)
        for batch in batches:
            yield listed(list(batch.columns), [scanner.pieces(x) for x in batch.column(2).to_pylist()])

    def whole(batches):
        scanner = Scanner(settings, model, name=name)
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                lines = text.split("\n")
                found: list[list[tuple[int, str]]] = [[] for _ in lines]
                for number, _, word, at, _, _ in scanner.text(text):
                    found[number - 1].append((at, word))
                key = batch.column(0).take(pa.array([i] * len(lines), pa.int64()))
                yield listed([key, pa.array(range(1, len(lines) + 1), pa.int32()), pa.array(lines, pa.string())], found)

    lines = rows.filter(~marked).select(KEY, F.posexplode_outer(split_lines(F.col("content"))).alias("at", "line")).filter("line is not null").select(KEY, (F.col("at") + 1).alias("line_number"), "line")
    hard = F.col("line").rlike(patterns.MAYBE_KEY) & F.col("line").rlike(patterns.POSSIBLE_KEY)
    group = lambda g: F.regexp_extract_all("line", F.lit(patterns.tiles()), F.lit(g))
    made = lines.filter(~hard).select(KEY, "line_number", "line", group(2).alias("words"), group(0).alias("tiles")).mapInArrow(tiled, schema)
    made = made.unionByName(lines.filter(hard).mapInArrow(pieced, schema)).unionByName(rows.filter(marked).mapInArrow(whole, schema))
    return made.withColumnRenamed(KEY, key)


def tokenize(df: DataFrame, key: str, content: str, settings: Settings, model: keys.Model | None = None, offsets: bool = False, name: str = patterns.OWN_NAME) -> DataFrame:
    """key, line_number, pos, value and, with ``offsets``, char_offset and byte_offset in the line and start in the text.

    ``pos`` numbers the words of a line from 0. Nothing is shuffled. Null and empty texts have no words; rows
    that repeat a key give their words each; the key may have any name but those of the result's columns."""
    if key in TOKENS:
        raise ValueError(f"a key column cannot be called {key}: the result has a column of that name")
    rows = df.select(F.col(f"`{key}`").alias(KEY), F.col(f"`{content}`").alias("content")).filter("content is not null")
    marked = F.col("content").rlike(patterns.any_marker(name))
    model = model or keys.default_model()
    least = max(1, settings.word_minimum_length)
    # outer generators: for plain ones Spark adds a size filter below, which would tile every line once more
    lines = rows.filter(~marked).select(KEY, F.posexplode_outer(split_lines(F.col("content"))).alias("at", "line")).filter("line is not null").select(KEY, (F.col("at") + 1).alias("line_number"), "line")
    hard = F.col("line").rlike(patterns.MAYBE_KEY) & F.col("line").rlike(patterns.POSSIBLE_KEY)
    if offsets:
        made = _placed(lines.withColumn("hard", hard), settings, model)
    else:
        words = F.filter(F.regexp_extract_all("line", F.lit(patterns.tiles()), F.lit(2)), lambda w: F.char_length(w) >= least)
        made = lines.filter(~hard).select(KEY, "line_number", F.posexplode_outer(words).alias("pos", "value")).filter("pos is not null")
        made = made.unionByName(_pieced(lines.filter(hard), settings, model))
    scanned = _scanned(rows.filter(marked), settings, model, name)
    return made.unionByName(scanned.select(made.columns)).withColumnRenamed(KEY, key)


def token_counts(df: DataFrame, groups: list[str], content: str, settings: Settings, model: keys.Model | None = None, name: str = patterns.OWN_NAME) -> DataFrame:
    """``groups``, value, n: how often each word stands in the texts of each group.

    Texts without a region marker are split at blanks and the pieces counted by group (partial sums before
    the shuffle); only distinct pieces are scanned. Marked texts are scanned whole. No group may be called ``value`` or ``n``."""
    if {"value", "n"} & set(groups):
        raise ValueError("a group cannot be called value or n: the result has columns of these names")
    rows = df.select(F.struct(*[F.col(f"`{g}`") for g in groups] or [F.lit(0).alias("all")]).alias("group"), F.col(f"`{content}`").alias("content")).filter("content is not null")
    marked = F.col("content").rlike(patterns.any_marker(name))
    pieces = rows.filter(~marked).select("group", F.explode_outer(F.split("content", BLANKS)).alias("piece")).filter("piece != ''")
    counted = pieces.groupBy("group", "piece").agg(F.count(F.lit(1)).alias("n")).select(F.struct("group", "n").alias("of"), "piece")
    whole = rows.filter(marked).select(F.struct("group", F.lit(1).cast("long").alias("n")).alias("of"), F.col("content").alias("piece"))
    found = tokenize(counted, "of", "piece", settings, model, name=name).unionByName(tokenize(whole, "of", "piece", settings, model, name=name))
    return found.groupBy(*[F.col(f"of.group.{g}").alias(g) for g in groups], "value").agg(F.sum("of.n").alias("n"))


def normalised(tokens: DataFrame) -> DataFrame:
    """Adds ``norm``. The lower-case form is a column of its own, so that it is made once."""
    return tokens.withColumn("_low", F.lower("value")).withColumn("norm", normalise_word(F.col("_low"))).drop("_low")


def distinct_terms(tokens: DataFrame, key: str) -> DataFrame:
    """The sorted distinct normal forms of each text."""
    return normalised(tokens).groupBy(key).agg(F.array_sort(F.collect_set("norm")).alias("terms"))
