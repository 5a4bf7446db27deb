"""The queries against the Python scanner on a small fixture, region markers and odd letters included."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
import regex

from lexcheck import queries
from lexcheck.functions import keys, patterns, similarity
from lexcheck.functions.text import normalise_text
from lexcheck.operators import correct
from lexcheck.operators.tokenize import Scanner, line_words, tokenize
from lexcheck.storage import tasks_for

DOCUMENTS = [
    (1, "lonely wordx 1", "en"),
    (2, "plain prose\nsee https://a.bc/d for 50% of Fooo", "en"),
    (3, "token be64439e3e49cf46b2d7c90f3602a3d0b907ff Döne", "de"),
    (4, "alpha\nlexcheck:disable\nsecrett 9\nlexcheck:enable\nomegaa #1", "de"),
    (5, "WORLD don't abc1def2=== tail\\nback", "fr"),
    (6, "", "fr"),
    (7, None, "fr"),
]
BENCHMARK = [(1, "plain prose of tail 2"), (2, "lonely\nworld and alpha"), (3, "see 3 back"), (4, "Döner #4 日本語")]
CONVERSATIONS = [(1, 0, "lonly wörld 7"), (1, 1, "dönr alfa 日本"), (2, 0, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    for name, rows, schema in [
        ("documents", DOCUMENTS, "doc_id long, text string, lang string"),
        ("conversations", CONVERSATIONS, "conv_id long, turn int, text string"),
        ("benchmark", BENCHMARK, "item_id long, text string"),
        ("labels", [(i, i % 2, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int"),
        ("nation", [(1, "Atlantis")], "n_nationkey int, n_name string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def words(rows):
    scanner = Scanner(queries.CONFIG, keys.default_model())
    return [(r[0], w) for r in rows if r[1] is not None for _, _, w, *_ in scanner.text(r[1])]


def run(spark, tables, name):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, tables).collect())


def test_whole_words(spark, tables):
    found = words(DOCUMENTS)
    assert {i for i, _ in found} == {1, 2, 3, 4, 5} and (4, "secrett") not in found
    per = Counter(i for i, _ in found)
    assert run(spark, tables, "tokens_per_doc") == sorted((i, n, len({w for j, w in found if j == i})) for i, n in per.items())
    assert run(spark, tables, "token_lengths") == sorted(Counter(len(w) for _, w in found).items())
    assert run(spark, tables, "normalised_terms") == sorted(Counter(normalise_text(w) for _, w in found).items())
    assert run(spark, tables, "distinct_terms_per_doc") == sorted((i, " ".join(sorted({normalise_text(w) for j, w in found if j == i}))) for i in per)
    assert sum(n for _, n in run(spark, tables, "case_styles")) == len(found)
    assert {r[0] for r in run(spark, tables, "apply_case_styles")} == {w for _, w in found}
    lengths = defaultdict(list)
    for i, w in found:
        lengths[{d[0]: d[2] for d in DOCUMENTS}[i]].append(len(w))
    means = {k: round(sum(v) / len(v), 6) for k, v in lengths.items()}
    assert [(r[0], r[1], r[3]) for r in run(spark, tables, "token_length_stats")] == sorted((k, means[k], max(v)) for k, v in lengths.items())


def test_whole_errors(spark, tables):
    known = {normalise_text(w) for _, w in words(BENCHMARK)}
    assert {"tail", "back", "plain"} <= known  # on lines with digits only
    found = words(DOCUMENTS)
    errors = [(i, normalise_text(w)) for i, w in found if normalise_text(w) not in known]
    assert {"wordx", "fooo", "döne", "omegaa"} <= {w for _, w in errors}
    lang = {d[0]: d[2] for d in DOCUMENTS}
    by_lang = defaultdict(list)
    for i, w in errors:
        by_lang[lang[i]].append(w)
    assert run(spark, tables, "unknown_counts") == sorted((k, len(v), len(set(v))) for k, v in by_lang.items())
    assert run(spark, tables, "unknown_words") == sorted({(w,) for _, w in errors})
    assert run(spark, tables, "check_summary") == [(len(DOCUMENTS), len({i for i, _ in errors}), len(errors), 1)]
    assert run(spark, tables, "errors_per_doc") == sorted(Counter(i for i, _ in errors).items())
    assert run(spark, tables, "errors_by_label") == sorted((q, 0, sum(i % 2 == q for i, _ in errors), len({i for i, _ in errors if i % 2 == q})) for q in {i % 2 for i, _ in errors})
    assert run(spark, tables, "known_per_doc") == sorted(Counter(i for i, w in found if normalise_text(w) in known).items())
    assert run(spark, tables, "dictionary_union") == sorted((w,) for w in known | {"atlantis"})
    assert sorted((r[0], normalise_text(r[3])) for r in run(spark, tables, "error_listing")) == sorted(errors)


def test_listing_joins_no_lines_and_shuffles_no_words(spark, tables):
    plan = queries.QUERIES["error_listing"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_words_in_their_lines(spark, tables):
    docs = spark.createDataFrame([*DOCUMENTS, (8, "one1two3 tail\n\n\n" + "wörd abc1def2 " * 300 + "\nlast\n", "de")], "doc_id long, text string, lang string")
    rows = line_words(docs, "doc_id", "text", queries.CONFIG).collect()
    lines = {(i, k): line for i, t, _ in docs.collect() for k, line in enumerate((t or "").split("\n"), 1)}
    assert len({(r["doc_id"], r["line_number"]) for r in rows}) == len(rows) and all(r["line"] == lines[r["doc_id"], r["line_number"]] and r["words"] for r in rows)
    want = sorted((r["doc_id"], r["line_number"], r["char_offset"], r["value"]) for r in tokenize(docs, "doc_id", "text", queries.CONFIG, offsets=True).collect())
    assert sorted((r["doc_id"], r["line_number"], w["char_offset"], w["value"]) for r in rows for w in r["words"]) == want


def test_decisions_scan_once_and_are_dealt(spark, tables):
    """Errors come from one written table, each document's once; joins have as many partitions as the input asks for."""
    decided = queries._decided(spark, tables)
    assert not any("documents.parquet" in f for f in decided.inputFiles())
    rows = decided.collect()
    assert len({(r["doc_id"], r["value"]) for r in rows}) == len(rows) and sum(r["n"] for r in rows) == sum(r["errors"] for r in queries.QUERIES["errors_per_doc"](spark, tables).collect())
    errors = spark.createDataFrame([(1, "a", "A"), (2, "a", "a"), (2, "b", "B")], "doc_id long, norm string, value string")
    given = spark.createDataFrame([("skip", 1, "a", None, None, None), ("replace", None, None, "B", "x", None)], "action string, doc_id long, norm string, value string, replacement string, name string")
    out = correct.decide(errors, given, "doc_id", 37)
    assert sorted((r["doc_id"], r["value"], r["action"]) for r in out.collect()) == [(1, "A", "skip"), (2, "B", "replace"), (2, "a", "report")]
    assert "hashpartitioning(value" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 37)" in plan
    assert tasks_for(queries._table(spark, tables, "documents"), 64) > 4


def test_whole_suggestions(spark, tables):
    known = {normalise_text(w) for _, w in words(BENCHMARK)}
    terms = {normalise_text(w) for _, w in [*words(DOCUMENTS), *words([((i, k), t) for i, k, t in CONVERSATIONS])]} - known
    assert {"döne", "dönr", "wordx"} <= terms
    want = defaultdict(list)
    for t in terms:
        for w in known:
            if (score := similarity.jaro_winkler(w, t)) >= similarity.threshold(len(t)):
                want[t].append((-round(score, 12), w))
    assert "döner" in {w for _, w in want["dönr"]}
    assert run(spark, tables, "suggest_similar") == sorted((t, len(v), -min(v)[0]) for t, v in want.items())
    best = {r[0]: (-r[3], r[2]) for r in run(spark, tables, "suggest_top1")}
    assert best["dönr"][1] == "döner" and set(best) <= set(want) and all(v in want[t] for t, v in best.items())
    top = run(spark, tables, "suggest_top5")
    assert {r[0] for r in top} == set(best) and sum(r[2] for r in run(spark, tables, "suggest_tiers")) == len(best)


def test_block_scores_equal_single_ones():
    rng = random.Random(8)
    found = ["".join(rng.choice("abcdéß日") for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 30, 70)))) for _ in range(400)]
    terms = [*found[:80], "x", "abcdx日"]
    for block in (similarity.Words([w for w in found if len(w) < 64]), similarity.Words(found)):
        t, w, score = block.matches(terms)
        got = dict(zip(zip(t.tolist(), w.tolist(), strict=True), score.tolist(), strict=True))
        for k, term in enumerate(terms):
            for i, word in enumerate(block.words):
                one = similarity.jaro_winkler(word, term)
                assert got[k, i] == one if (k, i) in got else one < similarity.threshold(len(term))


def test_whole_skip_counts(spark, tmp_path):
    html = "see https://a.bc/d and //e.fg/h abc zzz #ff0000 data:image/png;base64,iVBORw0KGgo= end"
    spark.createDataFrame([(1, html), (2, "plain")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    one, two = sorted(queries.QUERIES["skip_counts"](spark, str(tmp_path)).collect())
    assert [one[c] for c in ("key_literal_5", "urls", "alphabet", "repeated", "colour_hex")] == [1, len(regex.findall(patterns.url(), html)), len(regex.findall(patterns.alphabet_run("i"), html)), len(regex.findall(patterns.REPEATED_LETTER, html)), 1]
    assert one["urls"] >= 2 and one["alphabet"] >= 1 and two["key_literal_5"] == two["urls"] == 0


def test_skip_sequences(spark, tables):
    want = [(i, *(None if t is None else len(regex.findall(p, t)) for p in (patterns.REPEATED_LETTER, patterns.HEX))) for i, t, _ in DOCUMENTS]
    assert run(spark, tables, "skip_sequences") == sorted(want)


def test_the_signature_index_loses_no_pair_and_names_few():
    rng = random.Random(4)
    stems = ["".join(rng.choices("etaoinshrdlucmfw", k=rng.randint(4, 11))) for _ in range(3_000)]
    index = similarity.Words(sorted(set(stems)))
    terms = [s[:2] + rng.choice("xqz") + s[3:] for s in stems[:300]]
    t, w, _ = index.matches(terms)
    assert index.scored < 0.05 * len(terms) * index.size
    found = set(zip(t.tolist(), w.tolist(), strict=True))
    assert found == {(k, i) for k, term in enumerate(terms[:60]) for i, word in enumerate(index.words) if similarity.jaro_winkler(word, term) >= similarity.threshold(len(term))} | {p for p in found if p[0] >= 60}
    long = similarity.Words(["a" * 70_000, "ab" * 35_000, "abc"])
    assert long.candidates(["a" * 69_999])[1].tolist() == [0]
