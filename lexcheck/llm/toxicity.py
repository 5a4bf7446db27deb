"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks.

Kernel. A word (lower case, edge punctuation off, ``^`` and ``$`` added) maps to its subsequences of three
characters within ``SPAN`` characters, each weighted ``DECAY ** span`` and summed over its places; the
kernel is the normalised inner product. Gapped and inserted characters only lower a match's weight.

Training. Instances are sentences; a label says that some sentence of the text is toxic (multiple-instance
learning), and a sentence is as toxic as its highest words: the machine is fitted on these words, each with damaged
copies (a character inserted or left out), so that what damage leaves of an insult still counts. Start from the mean log-odds of the subsequences in
toxic against clean texts, choose each toxic text's witness sentence and its best words, fit, choose the
witnesses again, add the clean sentences' words that score highest, repeat. Words are compared with
``landmarks`` only; the Nystroem map turns that into a linear problem (squared hinge). A logistic fit makes a
probability of a sentence's three highest word scores, of each text as it is and with its highest word damaged; a text's
score is that of its highest sentence. Labels are doubted on both sides, see ``fit``.

Scoring. Landmark expansions are linear in the subsequence features, so the fitted machine folds into one
weight per subsequence: the kernel expansion is evaluated exactly, at a cost that does not depend on the
number of landmarks. Runs of single characters between blanks are also read as one word, a sentence of its own;
a word with marks inside is also read without them.

The model is fitted on a bounded sample (``most_texts`` per class, of longer texts whole sentences of at most
``most_chars``, both parameters; a round trains on at most ``most_words`` witness words and one and a half times as
many others, a random choice of more); scoring covers every row and the whole text and shuffles nothing.

Defined cases: null and empty texts have no word and count as words of value ``NO_WORD``; with one class
only, every score is the class's smoothed rate; null labels are ignored; equal texts get equal scores;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.llm.common import forget, release_memory, small_batches, table, text_or_empty

SPAN, DECAY = 5, 0.6
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
ALPHABET = 128
MEMO_WORDS = 400_000
NO_WORD = -2.0
TOP = 3
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
SPACED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
MARKS = re.compile(r"[\W_]+")
#: Damaged copies of every training word, of witnesses and of others, and the marks that damage inserts beside letters.
WITNESS_COPIES, OTHER_COPIES, INSERTED = 3, 1, ".*-_"
#: Labels can be wrong on either side. A word can witness toxicity if toxic texts use it this many times as often
#: as clean ones, and in more than this many of them once a clean text has it.
TIMES_AS_OFTEN, MORE_THAN = 5, 2
#: A toxic text whose best word reaches this share of the median text's best is believed at once; a third of it
#: is enough for a first witness.
BELIEVED = 0.4
#: Half the margin: later rounds take every word over it as a witness.
SURE_SCORE = 0.5


def sentences_of(text: str) -> list[set[str]]:
    """The words of each sentence that has any, and of each word spelled out in single characters."""
    text = text.lower()
    found = [{w.strip(EDGE) for w in part.split()} for part in SENTENCE.split(text)]
    found += [{"".join(m.group().split())} for m in SPACED.finditer(text)]
    for words in found:
        words.update([MARKS.sub("", w) for w in words if not w.isalnum()])
        words.discard("")
    return [words for words in found if words]


def words_of(text: str) -> set[str]:
    return set().union(*sentences_of(text))


def damaged(words: list[str], copies: int, rng: np.random.Generator) -> list[str]:
    """``copies`` of each word in turn, each with one character inserted inside (a letter of these words or a mark) or, one in
    four, left out."""
    letters = sorted(set().union(*words) | set(INSERTED)) if words else []
    out = []
    for word in words:
        for kind, place, letter in zip(rng.integers(0, 4, copies), rng.random(copies), rng.integers(0, max(1, len(letters)), copies), strict=True):
            k = 1 + int(place * max(1, len(word) - 1))
            out.append(word[: k - 1] + word[k:] if kind == 0 and len(word) > 4 else word[:k] + letters[letter] + word[k:])
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, padded and separated, as small numbers, and the word of each character."""
    gap = "\x7f" * SPAN
    chars = np.frombuffer(gap.join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    latin = (chars >= 0xDF) & (chars <= 0xFF)
    small = np.where(chars < ALPHABET, chars, np.where(latin, chars - 0xDF, chars % (ALPHABET - 1)))
    lengths = np.array([len(w) + 2 + SPAN for w in words])
    return small, np.repeat(np.arange(len(words)), lengths)[: len(small)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) triples, normalised so that each word has length one."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    chars, word = _codes(words)
    end = ALPHABET - 1
    keys, weights = [], []
    for a, b in OFFSETS:
        if len(chars) <= b:
            continue
        c0, c1, c2 = chars[: len(chars) - b], chars[a : len(chars) - b + a], chars[b:]
        ok = np.flatnonzero((c0 != end) & (c1 != end) & (c2 != end) & (word[: len(c0)] == word[b:]))
        keys.append((word[ok] * ALPHABET + c0[ok]) * ALPHABET * ALPHABET + c1[ok] * ALPHABET + c2[ok])
        weights.append(np.full(len(ok), DECAY ** (b + 1)))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(place, np.concatenate(weights), minlength=len(key))
    owner, feature = np.divmod(key, ALPHABET**3)
    norm = np.sqrt(np.bincount(owner, value * value, minlength=len(words)))
    return owner, feature, value / norm[owner]


@dataclass
class Model:
    """Folded weights: subsequence codes (sorted), their weights, the offset and the logistic fit."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def table(self) -> np.ndarray:
        out = np.zeros(ALPHABET**3)
        out[self.codes] = self.weights
        return out

    def raw(self, words: list[str], table: np.ndarray | None = None) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(words), NO_WORD)
        owner, feature, value = features(words)
        table = self.table() if table is None else table
        return np.bincount(owner, table[feature] * value, minlength=len(words)) + self.bias

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top @ self.slopes + self.shift, -50, 50)))


def highest(scores) -> list[float]:
    """The TOP highest word scores of a sentence, padded with NO_WORD."""
    return (heapq.nlargest(TOP, scores) + [NO_WORD] * TOP)[:TOP]


class Scorer:
    """Probabilities of whole texts; remembers words up to a bound."""

    def __init__(self, model: Model) -> None:
        forget()
        self.model, self.weights = model, model.table()
        self.memo: dict[str, float] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [sentences_of(t) for t in texts]
        every = set().union(*(words for sentences in found for words in sentences))
        fresh = list(every - self.memo.keys())
        if len(self.memo) + len(fresh) > MEMO_WORDS:
            self.memo.clear()
            fresh = list(every)
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            self.memo.update(zip(part, self.model.raw(part, self.weights).tolist(), strict=True))
        return self.model.probability(np.array([self._highest(sentences) for sentences in found]).reshape(-1, TOP))

    def _highest(self, sentences: list[set[str]]) -> list[float]:
        """The highest word scores of the text's highest sentence. No sentence is higher than one whose other words all
        have its best word's score (or what stands for no word, if that is higher), so few are looked at more closely."""
        get, slopes = self.memo.__getitem__, self.model.slopes.tolist()
        others, best, bound = sum(slopes[1:]), [NO_WORD] * TOP, -math.inf
        ranked = sorted(((max(map(get, words)), k) for k, words in enumerate(sentences)), reverse=True)
        for first, k in ranked:
            if first * slopes[0] + max(first, NO_WORD) * others <= bound:
                break
            top = highest(map(get, sentences[k]))
            value = sum(x * slope for x, slope in zip(top, slopes, strict=True))
            if value > bound:
                best, bound = top, value
        return best


def _dense(words: list[str], columns: np.ndarray) -> np.ndarray:
    """Rows of words over the given subsequences (sorted codes)."""
    owner, feature, value = features(words)
    at = np.minimum(np.searchsorted(columns, feature), len(columns) - 1)
    out = np.zeros((len(words), len(columns)))
    ok = columns[at] == feature
    out[owner[ok], at[ok]] = value[ok]
    return out


def _compact(words: list[str], step: int = 4_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of many words in 12 bytes a triple, made in slabs so that the driver stays small."""
    parts = [features(words[k : k + step]) for k in range(0, len(words), step)]
    owner = np.concatenate([p[0].astype(np.int32) + np.int32(k * step) for k, p in enumerate(parts)])
    return owner, np.concatenate([p[1].astype(np.int32) for p in parts]), np.concatenate([p[2].astype(np.float32) for p in parts])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machine by Newton steps on its active set."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w)) / c
    ridge[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(30):
        a = x1[active] * weight[active, None]
        w = np.linalg.solve(x1[active].T @ a + ridge, a.T @ y[active])
        now = y * (x1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _logistic(top: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift by damped Newton steps with Platt's smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.concatenate([top, np.ones((len(top), 1))], 1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * 0.1
    ridge[-1, -1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + w @ ridge @ w / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (target - p) - ridge @ w)
        before, size = loss(w), 1.0
        while loss(w + size * step) > before and size > 1e-6:  # as far as it helps
            size /= 2
        w = w + size * step
        if size * abs(step).max() < 1e-6:
            break
    return np.maximum(w[:-1], 0), float(w[-1])


def distinct_bags(rows: list[np.ndarray], share: float = 0.3) -> np.ndarray:
    """False for bags that share at least ``share`` of their words with one earlier bag beyond what common
    words explain: copies would make chance words look like evidence."""
    often = np.bincount(np.concatenate(rows)) if rows and sum(map(len, rows)) else np.zeros(1, np.int64)
    most = max(20, len(rows) // 50)
    places: dict[int, list[int]] = {}
    out = np.ones(len(rows), bool)
    for k, r in enumerate(rows):
        rare = r[often[r] <= most].tolist()
        met = Counter(j for w in rare for j in places.get(w, ()))
        if rare and met and max(met.values()) >= max(2, share * len(rare)):
            out[k] = False
            continue
        for w in rare:
            places.setdefault(w, []).append(k)
    return out


def fit(texts: list[str], labels: list[int], landmarks: int = 256, most_words: int = 3_000, rounds: int = 4, c: float = 10.0, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 2)  # nothing known: not toxic
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, np.zeros(TOP), float(np.log(rate / (1 - rate))))
    found = [sentences_of(t) for t in texts]
    vocabulary = sorted(set().union(*(words for sentences in found for words in sentences)))
    index = {w: i for i, w in enumerate(vocabulary)}
    instances = [[np.array(sorted(index[w] for w in words), np.int64) for words in sentences] for sentences in found]
    rows = [np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64) for parts in instances]
    clean = np.zeros(len(vocabulary), np.int64)
    toxic = np.zeros(len(vocabulary), np.int64)
    single = distinct_bags(rows)
    for r, label, first in zip(rows, y, single, strict=True):
        if first:
            (toxic if label else clean)[r] += 1
    owner, feature, value = _compact(vocabulary)
    every = ALPHABET**3

    cuts = [slice(k, k + 500_000) for k in range(0, len(owner), 500_000)]  # bounds what sums need at a time

    def scored(weights: np.ndarray, power: int = 1) -> np.ndarray:
        return sum(np.bincount(owner[x], weights[feature[x]] * value[x] ** power, minlength=len(vocabulary)) for x in cuts)

    def seen_in(counts: np.ndarray) -> np.ndarray:
        return sum(np.bincount(feature[x], value[x] * counts[owner[x]], minlength=every) for x in cuts)

    # start: mean log-odds of a word's subsequences by the texts they are seen in, one text of either kind added
    ratio = (single & (y == 1)).sum() / max(1, (single & (y == 0)).sum())
    score = scored(np.log((seen_in(toxic) + 1) / (seen_in(clean) * ratio + 1)), 2)
    eligible = toxic > TIMES_AS_OFTEN * ratio * clean + MORE_THAN * (clean > 0)
    never = np.flatnonzero((clean > 0) & ~eligible)
    # toxic texts as their sentences' words that can be witnesses
    own = [[r for r in (part[eligible[part]] for part in parts) if len(r)] for parts, label in zip(instances, y, strict=True) if label]
    own = [parts for parts in own if parts]
    witness_of = lambda parts: max(parts, key=lambda r: score[r].max())  # noqa: E731  the highest sentence
    best = [score[witness_of(parts)].max() for parts in own]
    # texts in which no word stands out are doubted: they give no witness and do not calibrate
    least = BELIEVED * float(np.median(best)) if own else 0.0
    sure = np.zeros(len(vocabulary), bool)
    for parts in own:
        r = witness_of(parts)
        sure[r[score[r] >= least]] = True
    hard = np.zeros(0, np.int64)
    weights, bias = np.zeros(every), 0.0
    for turn in range(rounds):
        witness = set(np.flatnonzero(sure).tolist())
        for parts in own:
            r = witness_of(parts)
            if turn:
                witness.update(r[score[r] >= SURE_SCORE].tolist())
            # texts without a sure word put their best forward, if it stands out a little
            if not any(sure[x].any() for x in parts) and score[r].max() >= (0 if turn else least / 3):
                witness.add(int(r[score[r].argmax()]))
        chosen = np.array(sorted(witness), np.int64)
        if len(chosen) > most_words:
            chosen = rng.choice(chosen, most_words, replace=False)
        negative = rng.choice(never, min(len(never), most_words), replace=False) if len(never) else never
        negative = np.setdiff1d(np.union1d(negative, hard), chosen)
        if not len(chosen) or not len(negative):
            break
        marks = np.concatenate([rng.choice(chosen, min(len(chosen), landmarks // 2), replace=False), rng.choice(negative, min(len(negative), landmarks - landmarks // 2), replace=False)])
        mark_words = [vocabulary[i] for i in marks]
        columns = np.unique(features(mark_words)[1])
        m = _dense(mark_words, columns)
        values, vectors = np.linalg.eigh(m @ m.T)
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        sides = []
        for numbers, copies in ((chosen, WITNESS_COPIES), (negative, OTHER_COPIES)):
            plain = [vocabulary[i] for i in numbers]
            sides.append(plain + damaged(plain, copies, rng))
        train = sides[0] + sides[1]
        slabs = [_dense(train[k : k + 1_000], columns) @ m.T for k in range(0, len(train), 1_000)]
        phi = np.concatenate(slabs) @ root
        sign = np.repeat([1.0, -1.0], [len(x) for x in sides])
        balance = np.concatenate([np.full(len(x), 0.5 / len(x)) for x in sides]) * len(train)
        w, bias = _svm(phi, sign, balance, c)
        folded = m.T @ (root @ w)
        weights = np.zeros(every)
        weights[columns] = folded
        score = scored(weights) + bias
        hard = never[np.argsort(-score[never], kind="stable")[: most_words // 2]]
    used = np.flatnonzero(weights)
    top = np.array([max((highest(score[r].tolist()) for r in parts), default=[NO_WORD] * TOP) for parts in instances])
    # labels are doubted on both sides: of toxic texts without a word that stands out, and of clean texts with a word as high as
    # half of the toxic texts' best
    held = np.array([bool(sure[r].any()) for r in rows])
    peak = np.array([score[r].max() if len(r) else NO_WORD for r in rows])
    typical = float(np.median(peak[held & (y == 1)])) if (held & (y == 1)).any() else math.inf
    certain = np.where(y == 0, peak < typical, held | (peak >= SURE_SCORE))
    # every text that calibrates does so twice: as it is, and with its highest word damaged
    highest_words = [vocabulary[r[score[r].argmax()]] if len(r) else "" for r in rows]
    machine = Model(used, weights[used], bias, np.zeros(TOP), 0.0)
    worse = top.copy()
    worse[:, 0] = np.where([bool(w) for w in highest_words], machine.raw(damaged(highest_words, 1, rng)), NO_WORD)
    worse = -np.sort(-worse, axis=1)
    slopes, shift = _logistic(np.concatenate([top[certain], worse[certain]]), np.concatenate([y[certain]] * 2))
    return Model(used, weights[used], bias, slopes, shift)


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """The key and ``score`` of every row; the model (some thousand weights) travels with the code."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        score = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()), pa.float64())], [key, "score"])
        score.memo.clear()
        release_memory()

    return docs.select(F.col(f"`{key}`"), text_or_empty().alias("text")).mapInArrow(run, f"`{key}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns, judged where they are: no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        score = Scorer(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(score(texts) < threshold, pa.bool_()))
        score.memo.clear()
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def excerpt(text: str, most: int) -> str:
    """Whole sentences of a longer text, at most ``most`` characters, picked by a hash so that they come from all
    over the text; blank-separated words if no sentence fits."""
    for pieces in (re.findall(r"[^.!?\n]+[.!?\n]*", text), text.split()):
        room, kept = most, []
        for k in sorted(range(len(pieces)), key=lambda k: (zlib.crc32(f"{k} {pieces[k]}".encode("utf-8", "replace")), k)):
            if len(pieces[k]) + 1 <= room:
                room -= len(pieces[k]) + 1
                kept.append(k)
        if kept:
            return " ".join(pieces[k] for k in sorted(kept))
    return text[:most]


def train_on(docs: DataFrame, labels: DataFrame, most_texts: int = 2_000, most_chars: int = 4_000) -> Model:
    """Fit on at most ``most_texts`` labelled ids per class that have a text, none of them held out: those with a
    text of at most ``most_chars`` characters first, by a hash of the ids, then longer ones, of which whole
    sentences of that size are taken. The picked ids (a fixed number) are broadcast, so only ids and lengths
    are shuffled; the sample itself is bounded by the two parameters and goes to one task, which returns
    the folded model, some kilobytes."""
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    use = use.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter(F.char_length("text") > 0).withColumn("long", F.char_length("text") > most_chars)
    known = use.join(rows.groupBy("doc_id").agg(F.min("long").alias("long")), "doc_id")
    picked = [known.filter(F.col("toxic") == label).orderBy("long", F.xxhash64("doc_id"), "doc_id").limit(most_texts) for label in (0, 1)]
    found = rows.join(F.broadcast(picked[0].unionByName(picked[1])), ["doc_id", "long"]).select("doc_id", "toxic", "text")

    def shorten(batches):
        for batch in batches:
            texts = [t if len(t) <= most_chars else excerpt(t, most_chars) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "toxic", "text"])

    short = found.mapInArrow(shorten, "doc_id long, toxic int, text string")
    sample = short.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    small_batches(docs.sparkSession)

    def run(batches):
        found = sorted(row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        forget()
        model = pickle.dumps(fit([t for _, _, t in found], [y for _, y, _ in found]))
        found.clear()
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    made = sample.select("doc_id", "toxic", "text").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], [])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train_on(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
