from __future__ import annotations

from lexcheck import queries
from lexcheck.functions import keys, similarity
from lexcheck.functions.text import normalise_text
from lexcheck.operators.tokenize import Scanner
from lexcheck.plans import check as plan
from lexcheck.sources import settings

CONFIG = settings.build(settings.DEFAULTS)
LIST = ["hello", "world", "there", "e-mail", "co-operate", "operate", "well-known", "known", "message"]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best(term: str) -> str | None:
    near = [(round(similarity.jaro_winkler(w, term), 12), w) for w in LIST]
    near = [(s, w) for s, w in near if s >= similarity.threshold(len(term))]
    n = len(term)
    for tier in (lambda w, s: levenshtein(w, term) <= (n - 1) // 4, lambda w, s: levenshtein(w, term) < max(n - 1, 0), lambda w, s: s >= 0.98 * max(x for x, _ in near)):
        kept = [(-s, w) for s, w in near if tier(w, s)]
        if kept:
            return min(kept)[1]
    return None


def recased(value: str, word: str) -> str:
    return word.upper() if value.isupper() else word.capitalize() if value[0].isupper() and value[1:].islower() else word


def one_by_one(text: str, most: int = 60) -> tuple[str, int, int] | None:
    """Replace the first error that has a suggestion and read again; None if that does not end."""
    scanner, fixed = Scanner(CONFIG, keys.default_model()), 0
    for _ in range(most):
        errors = [(v, s) for _, _, v, _, _, s in scanner.text(text) if normalise_text(v) not in LIST]
        first = next(((v, s, w) for v, s in errors if (w := best(normalise_text(v)))), None)
        if first is None:
            return text, fixed, len(errors)
        value, start, word = first
        text, fixed = text[:start] + recased(value, word) + text[start + len(value) :], fixed + 1
    return None


TEXTS = [
    "hello wrld", "Helo there\nWORLDD again qqqqzz", "cooperate with mesage", "wellknown and knwn", "a mial comes", "E-MAIL", "plain hello world", "", None, "co-operat wellknwn\n\nhelo",
    "lexcheck:disable\nwrld\nlexcheck:enable\nwrld",
]


def test_corrected_until_stable(spark):
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "path string, content string")
    words = spark.createDataFrame([("english", w) for w in LIST], "name string, word string")
    got = {int(r["path"]): r for r in plan.settled(texts, CONFIG, words).collect()}
    assert set(got) == set(range(len(TEXTS)))
    cycles = 0
    for i, text in enumerate(TEXTS):
        want = one_by_one(text or "")
        if want is None:
            assert got[i]["ended"] == "cycle" and got[i]["unfixed"] > 0 and got[i]["rounds"] > 0
            cycles += 1
            continue
        assert (got[i]["content"] or "", got[i]["fixed"], got[i]["unfixed"], got[i]["ended"]) == (*want, "stable"), text
    assert cycles >= 1 and max(r["rounds"] for r in got.values()) >= 2
    assert got[6]["rounds"] == 0 and got[0]["rounds"] == 1
    assert plan.settled(texts.limit(0), CONFIG, words).isEmpty()


def test_words_are_looked_up_once_and_texts_dealt(spark, tmp_path, monkeypatch):
    """Later rounds that meet no new word start no look-up, and texts of one row group are scanned by more than one task."""
    from lexcheck.operators import correct

    looked, tasks = [], []
    plain = correct.best_words
    monkeypatch.setattr(correct, "best_words", lambda terms, words: looked.append(terms.count()) or plain(terms, words))
    spark.createDataFrame([(f"{k}-{i}", t) for k in range(4) for i, t in enumerate(TEXTS)], "path string, content string").coalesce(1).write.parquet(f"{tmp_path}/t")
    words = spark.createDataFrame([("english", w) for w in LIST], "name string, word string")

    def errors(rows):
        tasks.append(len(rows.inputFiles()))
        return plan.build(rows, CONFIG, words, offsets=True).errors

    out = correct.fixpoint(spark.read.parquet(f"{tmp_path}/t"), errors, words, "path", "content")
    assert max(r["rounds"] for r in out.collect()) >= 2 and len(tasks) > len(looked)
    assert tasks[0] > 1 and all(looked)


def test_rounds_over_a_table_leave_nothing_to_correct(spark):
    rows = queries.QUERIES["autocorrect_rounds"](spark, "/root/testdata/sf0.001")
    kinds = {r["ended"]: r["n"] for r in rows.groupBy("ended").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert sum(kinds.values()) == 200 and set(kinds) <= {"stable", "cycle"} and kinds["stable"] > 0
