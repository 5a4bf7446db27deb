"""Telling random keys from words: 37 features and a Gaussian naive-Bayes model over eight classes.

Features and class scores are column expressions; the same in plain Python serve the exact scanner. A
string's character set picks the two classes that can be non-zero, so two products are compared instead of
eight; a tie (also when both are zero) is a key. Strings of no character set are keys.

The model is data: ``load_model`` reads one from a YAML file (class -> feature -> standard_deviation, mean,
variance; a leading colon of names is ignored). Without a file, ``default_model`` fits one on strings made
by a fixed rule.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcheck.functions.patterns import min_alpha
from lexcheck.shipping import ship
from lexcheck.storage import small_batches

# The tracked characters, the counted alphabet, the character sets and their sizes.
TRACKED = "+-_/AzZqQXx"
VOWELS = "aeiouAEIOU"
CONSONANTS = "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ"
ALPHABET = VOWELS + CONSONANTS + "0123456789-_+/="
SETS = {"hex": (r"[a-fA-F0-9-]*", 16), "lower36": (r"[a-z0-9]*", 36), "upper36": (r"[A-Z0-9]*", 36), "base64": (r"[A-Za-z0-9\-_+/]*={0,2}", 64)}
CHUNKS = {"title": "[A-Z][a-z]+", "lower": "[a-z]+", "upper": "[A-Z]+", "alpha": "[A-Za-z]+", "alnum": "[A-Za-z0-9]+", "digit": "[0-9]+"}
FEATURES = (
    *TRACKED, "equal", "length", *SETS,
    "mean_title_chunk_size", "variance_title_chunk_size", "max_title_chunk_size",
    *(f"{stat}_{kind}_chunk_size" for kind in ("lower", "upper", "alpha", "alnum", "digit") for stat in ("mean", "variance")),
    "vowel_consonant_ratio", "alpha_chunks", "alnum_chunks", "digit_chunks", "title_chunks",
    "mean_letter_frequency_difference", "variance_letter_frequency_difference",
)
LONGEST = 200

Model = dict[str, dict[str, tuple[float, float]]]  # class -> feature -> (mean, variance)


def character_set_of(s: str) -> str | None:
    return next((name for name, (pattern, _) in SETS.items() if re.fullmatch(pattern, s)), None)


def features_of(s: str) -> dict[str, float]:
    """The feature map of one string."""
    kind = character_set_of(s)
    ideal = len(s) / SETS[kind][1] if kind else 0.0
    letters = sorted(set(ALPHABET) | set(s))
    gap = {c: abs((s.count(c) / len(s) if s else 0.0) - ideal) for c in letters}
    out = {c: gap[c] for c in TRACKED}
    out |= {"equal": float(s.count("=")), "length": float(len(s))} | {name: float(name == kind) for name in SETS}
    for name, pattern in CHUNKS.items():
        sizes = [len(x) for x in re.findall(pattern, s)]
        mean = sum(sizes) / len(sizes) if sizes else 0.0
        out[f"mean_{name}_chunk_size"] = mean
        out[f"variance_{name}_chunk_size"] = sum((x - mean) ** 2 for x in sizes) / len(sizes) if sizes else 0.0
        out[f"max_{name}_chunk_size"] = float(max(sizes, default=0))
        out[f"{name}_chunks"] = float(len(sizes))
    out["vowel_consonant_ratio"] = sum(map(s.count, VOWELS)) / max(1, sum(map(s.count, CONSONANTS)))
    out["mean_letter_frequency_difference"] = sum(gap.values()) / len(gap)
    out["variance_letter_frequency_difference"] = max(gap.values(), default=0.0)  # the largest, by definition
    return {f: out[f] for f in FEATURES}


def load_model(path: str) -> Model:
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    plain = lambda k: str(k).removeprefix(":")
    classes = {plain(k): v for k, v in raw.items()}["feature_set"]
    out: Model = {}
    for name, stats in classes.items():
        rows = {plain(f): {plain(k): float(v) for k, v in row.items()} for f, row in stats.items()}
        out[plain(name)] = {f: (r["mean"], 0.0 if r["standard_deviation"] == 0 else r["variance"]) for f, r in rows.items()}
    return out


def fit_model(examples: dict[str, list[str]]) -> Model:
    """Mean and population variance of every feature by class."""
    out: Model = {}
    for name, strings in examples.items():
        rows = [features_of(s) for s in strings]
        stats = {}
        for f in FEATURES:
            values = [r[f] for r in rows]
            mean = sum(values) / len(values)
            stats[f] = (mean, sum((v - mean) ** 2 for v in values) / len(values))
        out[name] = stats
    return out


@lru_cache
def default_model(size: int = 600, seed: int = 11) -> Model:
    """Fitted on strings made by a rule per class. Words of letters and short numbers take turns in what is no key:
    identifiers, constants, paths. Keys are draws from a character set: codes of a letter pair, a digit and a
    letter pair in capitals, short and long codes in lower case, digests and group-wise identifiers in hex, long
    base-64 strings. Lengths vary widely, as those of found strings do."""
    rng = random.Random(seed)
    hexa, low, up = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    both = low + up[:26]

    def length(mean: float, spread: float, least: int, most: int = LONGEST) -> int:
        return min(most, max(least, round(rng.gauss(0, 1) * spread + mean)))

    def word(mean: float = 4.5, spread: float = 2.2) -> str:
        """Consonants and vowels in turn, some vowels left out, as in abbreviations."""
        n = length(mean, spread, 1)
        return "".join(rng.choice("bcdfglmnprst" if (k % 2 == 0 or rng.random() < 0.45) else "aeiou") for k in range(n))

    def number() -> str:
        return str(rng.randint(0, 10 ** rng.choice([1, 1, 1, 2, 2, 2, 3]) - 1))

    def name() -> str:
        """Words and numbers in turn, a word first and mostly last."""
        out = word() + number() + word()
        while rng.random() < 0.3:
            out += number() + word()
        return out + (number() if rng.random() < 0.5 else "")

    def path() -> str:
        """Names with separators and letter case of their own, or short words in camel case around a number."""
        if rng.random() < 0.45:
            parts = [word(3.2, 1.5).title() for _ in range(length(3, 1.5, 2, 7))]
            parts.insert(rng.randint(1, len(parts) - 1), number())
            return "".join(parts)
        parts = [rng.choice([str.title, str.title, str, str, str.upper])(rng.choice([word, word, word, name])()) for _ in range(length(3.5, 2.5, 1, 12))]
        parts.insert(rng.randint(0, len(parts)), name())
        return rng.choice("_-/-_+").join(parts)

    def drawn(letters: str, n: int) -> str:
        return "".join(rng.choice(letters) for _ in range(n))

    def code() -> str:
        pair = lambda: drawn(up[:26], length(2.5, 1.2, 1, 14))
        return pair() + str(rng.randint(0, 9)) + pair()

    def digest() -> str:
        n = rng.choice([8, 12, 16, 24, 32, 32, 40, 40, 64])
        text = drawn(hexa.upper() if rng.random() < 0.2 else hexa, n)
        return "-".join((text[:8], text[8:12], text[12:16], text[16:20], text[20:])) if n == 32 and rng.random() < 0.4 else text

    def secret() -> str:
        return "".join(drawn(both, length(24, 16, 2)) + rng.choice("+/-_") for _ in range(rng.choice([1, 1, 2, 3])))[:-1] + rng.choice(["", "", "", "", "=", "=="])

    examples = {
        "not_key_lower36": [name() for _ in range(size)],
        "not_key_base64": [path() for _ in range(size)],
        "not_key_hex": [drawn("abcdef", length(5.5, 2, 3)) + rng.choice(["", "-" + number(), number()]) for _ in range(size)],
        "not_key_upper36": [(word(4.7, 1.8) + str(rng.randint(0, 9)) + word(4.7, 1.8)).upper() for _ in range(size)],
        "key_base64": [secret() for _ in range(size)],
        "key_hex": [digest() for _ in range(size)],
        "key_lower36": [drawn(low + low[26:] * 2, length(rng.choice([10, 12, 16, 24, 32]), 6, 7)) for _ in range(size)],
        "key_upper36": [code() for _ in range(size)],
    }
    kinds = {name: name.removeprefix("not_").removeprefix("key_") for name in examples}
    return fit_model({name: [s for s in strings if character_set_of(s) == kinds[name]] or strings for name, strings in examples.items()})


def density(value: float, mean: float, variance: float) -> float:
    if variance == 0.0:
        return 1.0 if value == mean else 0.0
    return math.exp(-((value - mean) ** 2) / (2 * variance)) / math.sqrt(2 * math.pi * variance)


def is_key(s: str, model: Model, weight: int = 5, least: int = 6, min_word: int = 3) -> bool:
    """The gates, then the classifier."""
    if len(s) < least:
        return False
    if len(s) > LONGEST:
        return True
    if not re.search(min_alpha(min_word), s):
        return False
    return classify(s, model, weight)


def classify(s: str, model: Model, weight: int = 5) -> bool:
    kind = character_set_of(s)
    if kind is None:
        return True
    row = features_of(s)
    score = {}
    for name in (f"key_{kind}", f"not_key_{kind}"):
        product = 1.0
        for f in FEATURES:
            product *= density(row[f], *model[name][f])
        score[name] = product / len(model)
    return score[f"key_{kind}"] * 10.0**weight >= score[f"not_key_{kind}"]


# Runs of key characters, features and classes of many strings, in Arrow batches. The same features as column expressions (below) are
# some thousand calls per string and compile for longer than small tables take.

RUN = re.compile(r"[A-Za-z0-9+/\-_=]*")
RUN_LETTERS = frozenset(ALPHABET)
DIGIT_THEN_LETTER = re.compile(r"[0-9][\-_/+]*[A-Za-z]")


def runs_of(text: str) -> Iterator[str]:
    """The maximal runs of key characters that hold a digit, perhaps separators, and a letter in this order. Digits are
    searched for, so prose is passed over at the speed of a search."""
    at = 0
    while m := DIGIT_THEN_LETTER.search(text, at):
        begin = m.start()
        while begin > at and text[begin - 1] in RUN_LETTERS:
            begin -= 1
        at = RUN.match(text, m.end()).end()
        yield text[begin:at]


def runs(texts: DataFrame) -> DataFrame:
    """s: the runs of ``texts(text)``, each once a batch."""
    ship(texts.sparkSession)
    small_batches(texts.sparkSession)

    def run(batches):
        for batch in batches:
            found = {s for text in batch.column(0) if text.is_valid for s in runs_of(text.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["s"])

    return texts.select("text").mapInArrow(run, "s string")


def featured(strings: DataFrame, names: dict[str, str]) -> DataFrame:
    """s, kind and the features under their ``names`` of ``strings(s)``."""
    ship(strings.sparkSession)

    def run(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            rows = [features_of(s) for s in found]
            kinds = pa.array([character_set_of(s) for s in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), kinds, *[pa.array([r[f] for r in rows], pa.float64()) for f in names]], ["s", "kind", *names.values()])

    return strings.select("s").mapInArrow(run, "s string, kind string, " + ", ".join(f"{n} double" for n in names.values()))


def classified(strings: DataFrame, model: Model, weight: int = 5) -> DataFrame:
    """s, is_key of ``strings(s)``: the classifier without the gates."""
    ship(strings.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([classify(s, model, weight) for s in batch.column(0).to_pylist()], pa.bool_())], ["s", "is_key"])

    return strings.select("s").mapInArrow(run, "s string, is_key boolean")


# The same as columns.


def character_set(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(SETS.items()):
        out = F.when(s.rlike(rf"\A(?:{pattern})\z"), name).otherwise(out)
    return out


def _count(s: Column, letters: str) -> Column:
    return (F.char_length(s) - F.char_length(F.translate(s, letters, ""))).cast("double")


def _squares(values: Column, mean: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))


def features(s: Column) -> dict[str, Column]:
    """One column per feature, for strings over the counted alphabet (others have no character set)."""
    n, kind = F.char_length(s).cast("double"), character_set(s)
    size = F.lit(0.0)
    for name, (_, total) in SETS.items():
        size = F.when(kind == name, F.lit(float(total))).otherwise(size)
    ideal = F.when(size > 0, n / size).otherwise(0.0)
    gap = lambda c: F.abs(F.when(n > 0, _count(s, c) / n).otherwise(0.0) - ideal)
    gaps = F.array(*[gap(c) for c in ALPHABET])
    out: dict[str, Column] = {c: gap(c) for c in TRACKED}
    out |= {"equal": _count(s, "="), "length": n} | {name: (kind.eqNullSafe(F.lit(name))).cast("double") for name in SETS}
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    for name, pattern in CHUNKS.items():
        sizes = F.transform(F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.char_length(x).cast("double"))
        count = F.size(sizes).cast("double")
        mean = F.when(count > 0, total(sizes) / count).otherwise(0.0)
        out[f"mean_{name}_chunk_size"] = mean
        out[f"variance_{name}_chunk_size"] = F.when(count > 0, _squares(sizes, mean) / count).otherwise(0.0)
        out[f"max_{name}_chunk_size"] = F.coalesce(F.array_max(sizes), F.lit(0.0))
        out[f"{name}_chunks"] = count
    out["vowel_consonant_ratio"] = _count(s, VOWELS) / F.greatest(F.lit(1.0), _count(s, CONSONANTS))
    out["mean_letter_frequency_difference"] = total(gaps) / len(ALPHABET)
    out["variance_letter_frequency_difference"] = F.array_max(gaps)
    return {f: out[f] for f in FEATURES}


def fit_table(strings: DataFrame, kind: str, text: str) -> Model:
    """``fit_model`` of a table of labelled strings: mean and population variance are partial aggregates that Spark merges, so only
    one row a class is shuffled and returned. Rows without class or text are left out; an empty table gives an empty model."""
    rows = strings.select(F.col(f"`{kind}`").alias("kind"), F.col(f"`{text}`").alias("text")).filter("kind is not null and text is not null")
    row = F.struct(*[value.cast("double").alias(f"f{k}") for k, value in enumerate(features(F.col("text")).values())])
    moments = [m(f"row.f{k}").alias(f"{name}{k}") for k in range(len(FEATURES)) for name, m in (("mean", F.avg), ("variance", F.var_pop))]
    found = rows.select("kind", row.alias("row")).groupBy("kind").agg(*moments).collect()
    return {r["kind"]: {f: (r[f"mean{k}"], r[f"variance{k}"]) for k, f in enumerate(FEATURES)} for r in found}


def class_score(row: dict[str, Column], stats: dict[str, tuple[float, float]], classes: int) -> Column:
    product = F.lit(1.0)
    for f in FEATURES:
        mean, variance = stats[f]
        if variance == 0.0:
            product = product * F.when(row[f] == mean, 1.0).otherwise(0.0)
        else:
            d = row[f] - F.lit(mean)
            product = product * (F.exp(-(d * d) / F.lit(2 * variance)) / F.lit(math.sqrt(2 * math.pi * variance)))
    return product / classes


def is_key_column(kind: Column, row: dict[str, Column], model: Model, weight: int = 5) -> Column:
    """The classifier over feature columns (make them real columns first: they are used many times)."""
    out = F.lit(True)
    for name in SETS:
        key, word = (class_score(row, model[f"{p}key_{name}"], len(model)) for p in ("", "not_"))
        out = F.when(kind == name, key * F.lit(10.0**weight) >= word).otherwise(out)
    return out
