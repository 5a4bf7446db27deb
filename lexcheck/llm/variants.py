"""Spelling variants: words within one inserted, deleted or replaced code point of each other, by two minimal acyclic automata.

An edit leaves a word's first half or its second half as it is. So a word's near words are found by matching its first half
exactly in an automaton of the words and completing the rest with one error, and by matching its second half,
backwards, in an automaton of the reversed words. Both find a word whose error lies between the halves; the pairs
are made distinct.

Automata are minimal, acyclic and compact: they are built from sorted words, a state once its words are over, equal
states are one, and an edge carries all letters up to the next branching or final state. Each edge knows how many words come
before it, so a path adds up to its word's number in sorted order (a perfect hash), which finds the word and its count.

Words are dealt to shards by the half that is matched exactly, so a word meets all its near words in one shard of each
direction: as a query under its own half, to be found under the halves of words one shorter to one longer (at most two).
A half that over ``MOST_LETTERS`` letters of words share is dealt on: its words to parts, its queries to blocks, every block
to every part. Shards are bounded in letters.

Defined cases: null texts have no words and a null id is empty in the hashed string; repeated rows count each; a word without
near words is its own root; of near words equally frequent the smallest in code-point order is the form;
empty tables give no rows; extra columns are ignored; a word of any length is one word.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.llm.common import materialise, only, small_batches, table, text_or_empty
from lexcheck.shipping import ship

RUN = r"[a-zA-ZÀ-ÿ]+"
DROP_EVERY = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10  # a form is at least so many times as frequent
SHARD_LETTERS = 400_000
MOST_LETTERS = 800_000
SALTS = 16
#: Chains of forms: a form is TIMES times as frequent, so a chain has under 20 steps, and each doubling halves them.
DOUBLINGS = 5


class Automaton:
    """Minimal acyclic automaton of sorted distinct words, compact and numbered.

    ``states[s]`` is (is final, {first letter: (letters of the edge, target, words before)}); state words are counted from 0."""

    def __init__(self, words: list[str]) -> None:
        self.states: list[tuple[bool, dict[str, tuple[str, int, int]]]] = []
        self.sizes: list[int] = []
        self._known: dict[tuple, int] = {}
        # nodes of the path to the last word: [depth, is final, edges made so far]
        path: list[list] = [[0, False, []]]
        last = ""
        for word in words:
            shared = self._common(last, word)
            last = self._close(path, last, shared)
            if len(word) == path[-1][0]:  # the empty word
                path[-1][1] = True
            else:
                path.append([len(word), True, []])
            last = word
        self._close(path, last, 0)
        self.root = self._state(path[0][1], path[0][2])
        del self._known

    @staticmethod
    def _common(a: str, b: str) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        lo, hi = 0, n  # a[:lo] equals b[:lo], a[:hi] does not
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                hi = mid
        return lo

    def _close(self, path: list[list], last: str, depth: int) -> str:
        """Finish the path's nodes below ``depth``; a node stands there afterwards."""
        while path[-1][0] > depth:
            at, final, edges = path.pop()
            state = self._state(final, edges)
            if path[-1][0] < depth:
                path.append([depth, False, []])
            path[-1][2].append((last[path[-1][0] : at], state))
        return last

    def _state(self, final: bool, edges: list[tuple[str, int]]) -> int:
        key = (final, *edges)
        if key not in self._known:
            before, out = int(final), {}
            for letters, target in edges:
                out[letters[0]] = (letters, target, before)
                before += self.sizes[target]
            self._known[key] = len(self.states)
            self.states.append((final, out))
            self.sizes.append(before)
        return self._known[key]

    def number(self, word: str) -> int | None:
        """The word's place in sorted order; None for others."""
        return self._exact("", self.root, 0, word)

    def _exact(self, edge: str, state: int, number: int, rest: str) -> int | None:
        """The number of the word that ends the open edge and then reads ``rest``, both exactly."""
        states = self.states
        while rest.startswith(edge):
            rest = rest[len(edge) :]
            final, edges = states[state]
            if not rest:
                return number if final else None
            step = edges.get(rest[0])
            if step is None:
                return None
            edge, state, before = step
            number += before
        return None

    def near(self, word: str, exact: int) -> list[int]:
        """Numbers of the words that agree on the first ``exact`` letters and differ by one inserted, deleted or
        replaced letter behind them, each once: the error is taken at the first difference."""
        states, found = self.states, []
        state, number, edge, at = self.root, 0, "", 0
        while True:  # the exact part: ends inside an edge or at a state
            if at == exact:
                break
            step = states[state][1].get(word[at])
            if step is None:
                return found
            letters, target, before = step
            n = min(len(letters), exact - at)
            if letters[:n] != word[at : at + n]:
                return found
            number += before
            state, edge = target, letters[n:]
            at += n
        exactly = self._exact
        while True:
            n = self._common(edge, word[at:])
            at += n
            if n < len(edge):  # the edge's next letter is the error, or the word's
                left, rest = edge[n:], word[at:]
                tries = [(left[1:], rest), (left[1:], rest[1:]), (left, rest[1:])] if rest else [(left[1:], rest)]
                found += [m for a, b in tries if (m := exactly(a, state, number, b)) is not None]
                return found
            final, edges = states[state]
            rest = word[at:]
            if final and len(rest) == 1:
                found.append(number)
            ahead = None
            for first, (letters, target, before) in edges.items():
                if rest and first == rest[0]:
                    ahead = (letters, target, number + before)
                    continue
                left, here = letters[1:], number + before
                tries = [(left, rest), (left, rest[1:]), (letters, rest[1:])] if rest else [(left, rest)]
                found += [m for a, b in tries if (m := exactly(a, target, here, b)) is not None]
            if ahead is None:
                return found
            edge, state, number = ahead


def distinct_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased, one letter left out where the occurrence's hash says so; long and
    frequent enough. A run under the least length stays under it, so it is left out at once."""
    text = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.filter(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.char_length(r) >= least_length)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    seen = only(docs, "doc_id", "text").select(key.alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % drop_every == 0, without).otherwise(F.col("run"))
    words = seen.withColumn("h", h).select(word.alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _keyed(words: DataFrame) -> DataFrame:
    """word, n, backward, half (letters matched exactly), part of the word (the half), asks (whether the word searches here)."""
    size = F.char_length("word")

    def halves(backward: bool) -> Column:
        text = F.reverse("word") if backward else F.col("word")
        half = lambda n: F.floor((n + 1) / 2 if backward else n / 2).cast("int")
        made = lambda n: F.struct(F.lit(backward).alias("backward"), half(n).alias("half"), F.substring(text, F.lit(1), half(n)).alias("part"), (half(n) == half(size)).alias("asks"))
        return F.array(made(size - 1), made(size + 1))

    both = F.concat(halves(False), halves(True))
    return words.select("word", "n", F.explode(both).alias("at")).select("word", "n", "at.*")


def _dealt(words: DataFrame) -> DataFrame:
    """shard, backward, half, word, n, asks, holds: every row where it asks, is held to be found, or both."""
    rows = _keyed(words).withColumn("size", F.char_length("word"))
    keys = ["backward", "half", "part"]
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = int(total // SHARD_LETTERS + 1)
    sizes = materialise(rows.groupBy(*keys).agg(F.sum("size").alias("letters")).filter(F.col("letters") > MOST_LETTERS).withColumn("parts", F.ceil(F.col("letters") / SHARD_LETTERS).cast("int")).drop("letters"))
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left")
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")
    upto = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    # a hot half: (part, block) pairs; a word is held in its part of every block and asks in its block of every part
    held = F.transform(upto, lambda b: F.struct(F.col("own").alias("p"), b.alias("b"), F.lit(True).alias("holds"), (F.col("asks") & (b == F.col("own"))).alias("asking")))
    asking = F.transform(F.filter(upto, lambda p: F.col("asks") & (p != F.col("own"))), lambda p: F.struct(p.alias("p"), F.col("own").alias("b"), F.lit(False).alias("holds"), F.lit(True).alias("asking")))
    rows = rows.withColumn("own", own).withColumn("cell", F.explode(F.concat(held, asking)))
    cold = F.struct(F.lit(-1).cast("long").alias("key"), F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int").alias("p"), F.lit(0).alias("b"))
    hot = F.struct(F.xxhash64(*keys).alias("key"), F.col("cell.p").alias("p"), F.col("cell.b").alias("b"))
    return rows.select(F.when(F.col("parts").isNull(), cold).otherwise(hot).alias("shard"), "backward", "half", "word", "n", F.col("cell.asking").alias("asks"), F.col("cell.holds").alias("holds"))


def _search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's pairs of one direction: its automaton, and every word that asks."""
    backward = bool(key[1])
    held = rows[rows["holds"]].drop_duplicates("word")
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    pool = sorted(zip(map(turn, held["word"]), held["n"].tolist(), strict=True))
    machine = Automaton([w for w, _ in pool])
    out: list[tuple[str, str, int]] = []
    asks = rows[rows["asks"]].drop_duplicates("word")
    for word, half in zip(asks["word"], asks["half"].tolist(), strict=True):
        out += [(word, turn(pool[m][0]), pool[m][1]) for m in machine.near(turn(word), half)]
    return pd.DataFrame(out, columns=["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n for ``words(word, n)``, pairs in both orders; a pair is twice here where both directions find it."""
    ship(words.sparkSession)
    small_batches(words.sparkSession)
    return _dealt(words).groupBy("shard", "backward").applyInPandas(_search, "word string, near string, near_n long")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n. A word has few near words (its places times the letters in use), so they are
    gathered."""
    best = F.struct((-F.col("near_n")).alias("less"), F.col("near"))
    pairs = near_words(words).groupBy("word").agg(F.collect_set(best).alias("near")).select("word", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("best"))
    known = words.join(pairs, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    forms = materialise(
        known.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    )
    links = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = materialise(links.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        links = further.drop("moved")
        if further.filter("moved").isEmpty():
            break
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_of(docs: DataFrame) -> DataFrame:
    return group_variants(materialise(distinct_words(docs)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants_of(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH RECURSIVE bits(i, step, v) AS (
    SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
    UNION ALL
    SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8
),
crc_of AS (SELECT i, v FROM bits WHERE step = 8),
runs AS (
    SELECT id, run, count(*) AS times
    FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{RUN}')) AS run FROM documents)
    WHERE length(run) >= {LEAST_LENGTH} GROUP BY id, run
),
hashing(id, run, times, bytes, step, c) AS (
    SELECT id, run, times, hex(encode(id || ':' || run)), 0, CAST(4294967295 AS BIGINT) FROM runs
    UNION ALL
    SELECT id, run, times, bytes, step + 1, xor(c >> 8, v) FROM hashing
    JOIN crc_of ON i = xor(c, (instr('0123456789ABCDEF', bytes[2 * step + 1]) - 1) * 16 + instr('0123456789ABCDEF', bytes[2 * step + 2]) - 1) & 255
    WHERE 2 * step < length(bytes)
),
hashed AS (SELECT run, times, xor(c, 4294967295) AS h FROM hashing WHERE 2 * step = length(bytes)),
words AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
    WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}
),
shorter AS (SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.place = b.place AND a.less = b.less AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.less = b.word
),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
),
chain(word, here, step) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL
    SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON c.here = f.word WHERE f.form IS NOT NULL
),
roots AS (SELECT word, here AS root FROM chain QUALIFY row_number() OVER (PARTITION BY word ORDER BY step DESC) = 1)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN roots r ON f.word = r.word"""
