"""Registered queries of the checking engine and their SQL.

All of them run over whole tables and whole texts. The dictionary is derived from data: the normal forms of
``benchmark.text``. The SQL of queries over words holds a second scanner (``lexcheck.scan_sql``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck import scan_sql
from lexcheck.functions import keys, patterns
from lexcheck.functions.text import apply_case, case_style, normalise
from lexcheck.operators import check, correct, suggest
from lexcheck.operators.languages import addable_of, languages_of
from lexcheck.operators.lines import active_lines, explode_lines, line_offsets, split_lines, without_disabled_lines
from lexcheck.operators.tokenize import distinct_terms, line_words, normalised, token_counts, tokenize
from lexcheck.plans.check import build, corrected_once, settled
from lexcheck.sources import files, settings, wordlists
from lexcheck.storage import materialise, tasks_for

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CONFIG = settings.build(settings.DEFAULTS)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return tokenize(_table(spark, sf_dir, name), key, text, CONFIG)


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, so that its size is known when joins are planned: tokens are not shuffled to meet a small dictionary."""
    found = token_counts(_table(spark, sf_dir, "benchmark"), [], "text", CONFIG)
    return materialise(normalised(found).select(F.lit("benchmark").alias("name"), F.col("norm").alias("word")).distinct())


NORM = "regexp_replace(nfc_normalize(lower(value)), '[\u2018\u2019]', chr(39), 'g')"
DOCUMENTS = {"t": ("documents", "doc_id", "text")}
BOTH = DOCUMENTS | {"b": ("benchmark", "item_id", "text")}
TOKENS_SQL = f"WITH RECURSIVE {scan_sql.scan(DOCUMENTS)}"
KNOWN_SQL = f"WITH RECURSIVE {scan_sql.scan(BOTH)},\nd AS MATERIALIZED (SELECT DISTINCT {NORM} AS word FROM b)"
ERRORS_SQL = f"{KNOWN_SQL},\ne AS MATERIALIZED (SELECT n.* FROM (SELECT *, {NORM} AS norm FROM t) n ANTI JOIN d ON d.word = n.norm)"
STYLE = """CASE WHEN regexp_full_match(letters, '\\p{Ll}*') THEN 'lowercase' WHEN regexp_full_match(letters, '\\p{Lu}*') THEN 'uppercase'
  WHEN regexp_full_match(letters, '\\p{Lu}\\p{Ll}*') THEN 'capitalize' ELSE 'as_is' END"""


LEXICON = "'lexicon'"


def _recased(style: str, word: str) -> str:
    return f"CASE {style} WHEN 'lowercase' THEN lower({word}) WHEN 'uppercase' THEN upper({word}) WHEN 'capitalize' THEN upper({word}[1]) || lower(substr({word}, 2)) ELSE {word} END"


# Lines and positions.


@query("SELECT lang, sum(len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END)::BIGINT AS lines FROM (SELECT lang, str_split(coalesce(text, ''), chr(10)) AS l FROM documents) GROUP BY lang")
def lines_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("key", F.struct("doc_id", "lang"))
    return explode_lines(docs, "key", "text").groupBy(F.col("key.lang").alias("lang")).agg(F.count(F.lit(1)).alias("lines"))


@query("""
WITH l AS (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END) AS line, generate_subscripts(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, 1) AS line_number FROM l)
SELECT doc_id, line_number::INT AS line_number,
  coalesce(sum(length(line) + 1) OVER w, 0)::BIGINT AS line_char_offset, coalesce(sum(strlen(line) + 1) OVER w, 0)::BIGINT AS line_byte_offset
FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_offsets(_table(spark, sf_dir, "documents"), "doc_id", "text").drop("line")


@query(f"{TOKENS_SQL} SELECT doc_id, line_number, (row_number() OVER (PARTITION BY line_id ORDER BY char_offset) - 1)::INT AS pos, value, char_offset, byte_offset FROM t")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(_table(spark, sf_dir, "documents"), "doc_id", "text", CONFIG, offsets=True).drop("start")


# Words.


@query(f"{TOKENS_SQL} SELECT lang, count(*)::BIGINT AS tokens FROM t JOIN documents USING (doc_id) GROUP BY lang")
def tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), ["lang"], "text", CONFIG).groupBy("lang").agg(F.sum("n").alias("tokens"))


@query(f"{TOKENS_SQL} SELECT doc_id, count(*)::BIGINT AS tokens, count(DISTINCT value)::BIGINT AS distinct_tokens FROM t GROUP BY doc_id")
def tokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("value").alias("distinct_tokens"))


@query(f"{TOKENS_SQL} SELECT length(value)::INT AS chars, count(*)::BIGINT AS tokens FROM t GROUP BY 1")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).groupBy(F.char_length("value").alias("chars")).agg(F.count(F.lit(1)).alias("tokens"))


@query(f"{TOKENS_SQL} SELECT {STYLE} AS style, count(*)::BIGINT AS tokens FROM (SELECT regexp_replace(value, '[^\\p{{L}}]', '', 'g') AS letters FROM t) GROUP BY 1")
def case_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).groupBy(case_style(F.col("value")).alias("style")).agg(F.count(F.lit(1)).alias("tokens"))


@query(f"{TOKENS_SQL}, v AS (SELECT DISTINCT value, regexp_replace(value, '[^\\p{{L}}]', '', 'g') AS letters FROM t) SELECT value, {_recased(STYLE, LEXICON)} AS recased FROM v")
def apply_case_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(_table(spark, sf_dir, "documents"), [], "text", CONFIG).select("value")
    return found.select("value", apply_case(case_style(F.col("value")), F.lit("lexicon")).alias("recased"))


@query(f"{TOKENS_SQL} SELECT {NORM} AS norm, count(*)::BIGINT AS n FROM t GROUP BY 1")
def normalised_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(token_counts(_table(spark, sf_dir, "documents"), [], "text", CONFIG)).groupBy("norm").agg(F.sum("n").alias("n"))


@query(f"{TOKENS_SQL}, n AS (SELECT DISTINCT doc_id, {NORM} AS norm FROM t) SELECT doc_id, string_agg(norm, ' ' ORDER BY norm) AS terms FROM n GROUP BY doc_id")
def distinct_terms_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_terms(_tokens(spark, sf_dir), "doc_id").select("doc_id", F.array_join("terms", " ").alias("terms"))


@query(f"{TOKENS_SQL} SELECT lang, round(avg(length(value)), 6) AS mean, round(var_pop(length(value)), 6) AS variance, max(length(value))::INT AS longest FROM t JOIN documents USING (doc_id) GROUP BY lang")
def token_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("key", F.struct("doc_id", "lang"))
    n = F.char_length("value")
    return tokenize(docs, "key", "text", CONFIG).groupBy(F.col("key.lang").alias("lang")).agg(F.round(F.avg(n), 6).alias("mean"), F.round(F.var_pop(n), 6).alias("variance"), F.max(n).alias("longest"))


@query(f"WITH RECURSIVE {scan_sql.scan({'t': ('pages', 'page_id', 'html')})} SELECT page_id, count(*)::BIGINT AS tokens, count(DISTINCT value)::BIGINT AS distinct_tokens FROM t GROUP BY page_id")
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "pages", "page_id", "html").groupBy("page_id").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("value").alias("distinct_tokens"))


@query(f"WITH RECURSIVE {scan_sql.scan({'t': ('conversations', 'conv_id, turn, role', 'text')})} SELECT role, count(*)::BIGINT AS tokens FROM t GROUP BY role")
def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "conversations"), ["role"], "text", CONFIG).groupBy("role").agg(F.sum("n").alias("tokens"))


@query("""SELECT o_orderkey, unnest(list_filter(regexp_extract_all(o_orderpriority, '[A-Z]+'), lambda w: length(w) >= 3)) AS value FROM orders""")
def order_priority_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", "value")


@query(f"WITH RECURSIVE {scan_sql.scan({'t': ('customer', 'c_custkey', 'c_name')})} SELECT c_custkey, value, char_offset, byte_offset FROM t")
def customer_name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(_table(spark, sf_dir, "customer"), "c_custkey", "c_name", CONFIG, offsets=True).select("c_custkey", "value", "char_offset", "byte_offset")


# Unknown words and reports.


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in tasks of a bounded share: a file of one row group, however large, is else one task."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.repartition(tasks_for(docs), "doc_id")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.unknown(normalised(tokenize(_dealt(spark, sf_dir), "doc_id", "text", CONFIG)), _dictionary(spark, sf_dir))


def _error_counts(spark: SparkSession, sf_dir: str, groups: list[str]) -> DataFrame:
    """Unknown words by group, each form once with its number of places."""
    counts = normalised(token_counts(_table(spark, sf_dir, "documents"), groups, "text", CONFIG)).groupBy(*groups, "norm").agg(F.sum("n").alias("n"))
    return check.unknown(counts, _dictionary(spark, sf_dir))


@query(f"{ERRORS_SQL} SELECT lang, count(*)::BIGINT AS errors, count(DISTINCT norm)::BIGINT AS words FROM e JOIN documents USING (doc_id) GROUP BY lang")
def unknown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _error_counts(spark, sf_dir, ["lang"]).groupBy("lang").agg(F.sum("n").alias("errors"), F.count(F.lit(1)).alias("words"))


@query(f"{ERRORS_SQL} SELECT DISTINCT norm FROM e")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.word_report(_error_counts(spark, sf_dir, []))


@query(f"{ERRORS_SQL} SELECT (SELECT count(DISTINCT doc_id) FROM documents)::BIGINT AS files, count(DISTINCT doc_id)::BIGINT AS files_with_errors, count(*)::BIGINT AS errors, (count(*) > 0)::INT AS exit_code FROM e")
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.summary(_table(spark, sf_dir, "documents").select("doc_id"), _errors(spark, sf_dir), "doc_id")


@query(f"{ERRORS_SQL} SELECT doc_id, count(*)::BIGINT AS errors FROM e GROUP BY doc_id")
def errors_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("errors"))


@query(f"{ERRORS_SQL} SELECT quality, toxic, count(*)::BIGINT AS errors, count(DISTINCT doc_id)::BIGINT AS docs FROM e JOIN labels USING (doc_id) GROUP BY quality, toxic")
def errors_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = errors_per_doc(spark, sf_dir)  # counted before they meet the labels
    return per_doc.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.sum("errors").alias("errors"), F.countDistinct("doc_id").alias("docs"))


@query(f"{KNOWN_SQL} SELECT doc_id, count(*)::BIGINT AS known FROM t SEMI JOIN d ON d.word = {NORM} GROUP BY doc_id")
def known_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.known(normalised(_tokens(spark, sf_dir)), _dictionary(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("known"))


@query(f"""{ERRORS_SQL} SELECT doc_id, e.line_number, char_offset, value,
  doc_id || ':' || e.line_number || ':' || char_offset || ' ' || left(line, char_offset) || chr(27) || '[31m' || value || chr(27) || '[0m' || rtrim(substr(line, char_offset + length(value) + 1)) AS shown
FROM e JOIN t_tiles USING (line_id, doc_id)""")
def error_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_words(_dealt(spark, sf_dir), "doc_id", "text", CONFIG).select("doc_id", "line_number", "line", F.explode("words").alias("word"))
    tokens = normalised(found.select("doc_id", "line_number", "line", "word.char_offset", "word.value"))
    return check.shown_lines(check.unknown(tokens, _dictionary(spark, sf_dir)), "doc_id")


# Dictionaries.


@query(f"WITH RECURSIVE {scan_sql.scan({'b': ('benchmark', 'item_id', 'text')})} SELECT DISTINCT {NORM} AS word FROM b UNION SELECT lower(n_name) FROM nation")
def dictionary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "nation").select(F.lit("all").alias("name"), normalise(F.col("n_name")).alias("word"))
    return wordlists.merge(_dictionary(spark, sf_dir).withColumn("name", F.lit("all")), names).select("word")


@query("SELECT DISTINCT lower(trim(r_name)) AS word FROM region")
def dictionary_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], wordlists.SCHEMA)
    return wordlists.push(empty, _table(spark, sf_dir, "region").select(F.lit("regions").alias("name"), F.col("r_name").alias("word"))).select("word")


@query("SELECT p_partkey, p_name FROM part WHERE lower(trim(p_name)) IN (SELECT DISTINCT lower(trim(p_name)) FROM part WHERE p_size <= 10)")
def dictionary_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    words = part.filter("p_size <= 10").select(F.lit("small").alias("name"), normalise(F.col("p_name")).alias("word"))
    return wordlists.contains(words, part, "p_name").select("p_partkey", "p_name")


# Languages.

EXTENSIONS = {"src0": ".rb", "src1": ".js", "src2": ".css", "src3": ".xml", "src4": ".sh", "src5": ".rs", "src6": ".html", "src7": "/Dockerfile", "src8": "/Gemfile.lock", "src9": ".rb.txt"}


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    end: Column = F.lit(".txt")
    for source, value in EXTENSIONS.items():
        end = F.when(F.col("source") == source, value).otherwise(end)
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), end).alias("path"), files.first_line(F.col("text")).alias("first_line"))


def _language_sql() -> str:
    ends = " ".join(f"WHEN '{s}' THEN '{e}'" for s, e in EXTENSIONS.items())
    tests = []
    for x in CONFIG.languages:
        parts = [f"ends_with(path, '{g[1:]}')" if g.startswith("*") else f"(path = '{g}' OR ends_with(path, '/{g}'))" for g in x.includes]
        parts += [f"(starts_with(line, '#!') AND contains(line, '{h}'))" for h in x.hashbangs]
        tests.append(f"CASE WHEN {' OR '.join(parts) or 'TRUE'} THEN '{x.name}' END")
    return f"""WITH p AS (SELECT doc_id, 'src/' || doc_id || CASE source {ends} ELSE '.txt' END AS path, coalesce(split_part(text, chr(10), 1), '') AS line FROM documents)
SELECT doc_id, path, concat_ws(',', {', '.join(tests)}) AS languages FROM p"""


@query(_language_sql())
def language_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of(_paths(spark, sf_dir), list(CONFIG.languages)).select("doc_id", "path", F.array_join("languages", ",").alias("languages"))


#: Lines that name an interpreter, by a rule on the document's number; the others begin as the text does.
BANGS = ("#!/usr/bin/env ruby", "#!/bin/bash -e", "#!/usr/bin/fish", "#!/usr/bin/env python", "bash is great")


@query(f"""WITH p AS (SELECT doc_id, CASE doc_id % 6 {' '.join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BANGS))} ELSE coalesce(split_part(text, chr(10), 1), '') END AS line FROM documents)
SELECT doc_id, concat_ws(',', 'english', 'lexcheck', CASE WHEN starts_with(line, '#!') AND contains(line, 'ruby') THEN 'ruby' END, CASE WHEN starts_with(line, '#!') AND (contains(line, 'bash') OR contains(line, 'sh')) THEN 'shell' END) AS languages FROM p""")
def hashbang_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = files.first_line(F.col("text"))
    for i, bang in enumerate(BANGS):
        line = F.when(F.col("doc_id") % 6 == i, bang).otherwise(line)
    probes = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("bin/"), F.col("doc_id").cast("string")).alias("path"), line.alias("first_line"))
    return languages_of(probes, list(CONFIG.languages)).select("doc_id", F.array_join("languages", ",").alias("languages"))


LETTERS = ("e", "r", "c", "q")


def _choice_sql() -> str:
    ends = " ".join(f"WHEN '{s}' THEN '{e}'" for s, e in EXTENSIONS.items())
    chosen = []
    for letter in LETTERS:
        cases = []
        for x in CONFIG.languages:
            if x.addable and x.key == letter:
                parts = [f"ends_with(path, '{g[1:]}')" if g.startswith("*") else f"(path = '{g}' OR ends_with(path, '/{g}'))" for g in x.includes]
                parts += [f"(starts_with(line, '#!') AND contains(line, '{h}'))" for h in x.hashbangs]
                cases.append(f"WHEN {' OR '.join(parts) or 'TRUE'} THEN '{x.name}'")
        chosen.append(f"{'CASE ' + ' '.join(cases) + ' END' if cases else 'NULL::VARCHAR'} AS list_{letter}")
    return f"""WITH p AS (SELECT doc_id, 'src/' || doc_id || CASE source {ends} ELSE '.txt' END AS path, coalesce(split_part(text, chr(10), 1), '') AS line FROM documents)
SELECT doc_id, {', '.join(chosen)} FROM p"""


@query(_choice_sql())
def list_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list a word would be added to, by the letter that is pressed; null: no list takes it."""
    rows = addable_of(_paths(spark, sf_dir), list(CONFIG.languages))
    return rows.select("doc_id", *[correct.list_for(F.col("addable"), F.lit(x)).alias(f"list_{x}") for x in LETTERS])


# Disabled lines and regions: markers are put into the documents by a rule on line numbers.

MARKED_SQL = """l AS (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END) AS plain, generate_subscripts(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, 1)::INT AS line_number FROM l),
marked AS (SELECT doc_id, line_number, CASE line_number % 7 WHEN 3 THEN 'lexcheck:disable' WHEN 5 THEN 'lexcheck:enable' ELSE plain || CASE WHEN line_number % 11 = 0 THEN ' lexcheck:disable-line' ELSE '' END END AS line FROM x)"""


def _mark(line: Column, number: Column) -> Column:
    end = F.when(number % 11 == 0, " lexcheck:disable-line").otherwise("")
    return F.when(number % 7 == 3, "lexcheck:disable").when(number % 7 == 5, "lexcheck:enable").otherwise(F.concat(line, end))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(split_lines(F.coalesce("text", F.lit(""))), lambda line, i: _mark(line, i + 1))
    text = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return _table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"WITH {MARKED_SQL} SELECT * FROM marked WHERE NOT regexp_matches(line, 'lexcheck:disable[-:]line')")
def line_disable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_disabled_lines(explode_lines(_marked(spark, sf_dir), "doc_id", "text"))


@query(f"""WITH {MARKED_SQL}, u AS (SELECT *, nullif(regexp_extract(line, 'lexcheck:(disable|enable)', 1), '') AS m FROM marked WHERE NOT regexp_matches(line, 'lexcheck:disable[-:]line')),
s AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM u)
SELECT doc_id, line_number, line FROM s WHERE coalesce(state, 'enable') = 'enable' AND m IS NULL""")
def region_disable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_lines(_marked(spark, sf_dir), "doc_id", "text")


@query(f"{TOKENS_SQL} SELECT doc_id, count(*)::BIGINT AS tokens FROM t WHERE line_number % 7 NOT IN (3, 4, 5) AND line_number % 11 <> 0 GROUP BY doc_id")
def marked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside disabled regions and lines."""
    return tokenize(_marked(spark, sf_dir), "doc_id", "text", CONFIG).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"))


# Skipped text.


@query(f"SELECT page_id, regexp_full_match(url, '{scan_sql.re2(patterns.url())}') AS skipped FROM pages")
def skip_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike(rf"\A(?:{patterns.url()})\z").alias("skipped"))


#: Patterns without a look-ahead or back-reference, which RE2 can count.
PLAIN_SKIPS = {"non_words": patterns.NON_WORDS, "percent": patterns.PERCENT_ENCODED, "escapes": patterns.BACKSLASH_ESCAPE, "colours": patterns.SHELL_COLOUR, "urls": patterns.url()} | {f"key_literal_{i}": p for i, p in enumerate(patterns.KEY_LITERALS[:5])}
OTHER_SKIPS = {"key_literal_5": patterns.KEY_LITERALS[5], "colour_hex": patterns.HEX, "repeated": patterns.REPEATED_LETTER, "alphabet": patterns.alphabet_run("iu")}


@query("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '{scan_sql.re2(p)}'))::INT AS {n}" for n, p in PLAIN_SKIPS.items()) + " FROM pages")
def skip_counts_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", *[F.regexp_count("html", F.lit(p)).alias(n) for n, p in PLAIN_SKIPS.items()])


@query()
def skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns of skipped text, those with a look-ahead too."""
    return _table(spark, sf_dir, "pages").select("page_id", *[F.regexp_count("html", F.lit(p)).alias(n) for n, p in (PLAIN_SKIPS | OTHER_SKIPS).items()])


@query()
def skip_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.regexp_count("text", F.lit(patterns.REPEATED_LETTER)).alias("repeated"), F.regexp_count("text", F.lit(patterns.HEX)).alias("hex"))


# Keys: every run of key characters in documents, pages and customers that has the form of a key.

KEY_TEXTS = (("documents", "text"), ("pages", "html"), ("pages", "url"), ("customer", "c_name"), ("supplier", "s_name"), ("conversations", "text"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [_table(spark, sf_dir, table).select(F.col(column).alias("text")) for table, column in KEY_TEXTS]
    every = texts[0]
    for other in texts[1:]:
        every = every.unionByName(other)
    # a rejected key resumes inside itself, so a candidate may begin at any place of a run
    begun = keys.runs(every).distinct().select("s", F.explode(F.sequence(F.lit(1), F.char_length("s"))).alias("i"))
    found = begun.select(F.regexp_extract(F.substr("s", F.col("i")), rf"\A({scan_sql.CANDIDATE})(?![A-Za-z0-9])", 1).alias("s")).filter("s != ''")
    # a number of tasks that Spark does not join again: their rows are few, the work on them is not
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s").distinct()


CANDIDATES_SQL = (
    "r AS (SELECT DISTINCT s FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9+/\\-_=]+')) AS s FROM (" + " UNION ALL ".join(f"SELECT {column} AS text FROM {table}" for table, column in KEY_TEXTS) + ")) WHERE regexp_matches(s, '[0-9][\\-_/+]*[A-Za-z]')), "
    f"c AS (SELECT DISTINCT s FROM (SELECT regexp_extract(substr(s, i::BIGINT), '^({scan_sql.re2(scan_sql.CANDIDATE)})(?:[^A-Za-z0-9]|$)', 1) AS s FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM r)) WHERE s <> '')"
)
NAMED = scan_sql.NAMED
FEATURES_SQL = f"WITH {CANDIDATES_SQL}, {scan_sql.features('c')}"


@query(f"WITH {CANDIDATES_SQL} SELECT s, {scan_sql.KIND} FROM c")
def key_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("s", keys.character_set(F.col("s")).alias("kind"))


@query(f"{FEATURES_SQL} SELECT s, kind, {', '.join(f'round({n}, 6) AS {n}' for n in NAMED.values())} FROM f")
def key_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.featured(_candidates(spark, sf_dir), NAMED).select("s", "kind", *[F.round(n, 6).alias(n) for n in NAMED.values()])


@query(f"{FEATURES_SQL} SELECT s, {scan_sql.classified()} AS is_key FROM f")
def key_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.classified(_candidates(spark, sf_dir), keys.default_model())


@query("SELECT p_partkey, " + ", ".join(f"(length(p_name) - length(replace(p_name, '{c}', '')))::INT AS {c}" for c in "aeioust") + " FROM part")
def letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", *[(F.char_length("p_name") - F.char_length(F.translate("p_name", c, ""))).alias(c) for c in "aeioust"])


# Suggestions and corrections, of all unknown words of documents and conversations. DuckDB's similarity and
# distance work on bytes, so the SQL first maps the letters beyond ASCII to unused ASCII characters.


def _unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "documents").select("text").unionByName(_table(spark, sf_dir, "conversations").select("text"))
    words = normalised(token_counts(texts, [], "text", CONFIG)).select("norm").distinct()
    return check.unknown(words, _dictionary(spark, sf_dir)).select(F.col("norm").alias("term"))


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.similar(_unknown_terms(spark, sf_dir), _dictionary(spark, sf_dir))


def _suggest_sql(terms: str) -> str:
    """CTEs over ``d(word)``: ``p`` (pairs), ``y`` (with their tiers), ``z`` (ranked) for the query ``terms``."""
    return f"""q0 AS MATERIALIZED ({terms}),
letters AS (SELECT string_agg(c, '' ORDER BY c) AS odd, string_agg(chr(free::INT), '' ORDER BY c) AS even FROM (
  SELECT c, CASE WHEN n <= 38 THEN n ELSE n + 25 END AS free FROM (SELECT c, row_number() OVER (ORDER BY c) AS n FROM (
    SELECT DISTINCT unnest(regexp_extract_all(word, '[^\\x00-\\x7f]')) AS c FROM (SELECT term AS word FROM q0 UNION ALL SELECT word FROM d))))),
mapped AS MATERIALIZED (SELECT term, translate(term, coalesce(odd, ''), coalesce(even, '')) AS m FROM q0, letters),
listed AS MATERIALIZED (SELECT word, translate(word, coalesce(odd, ''), coalesce(even, '')) AS m FROM d, letters),
p AS MATERIALIZED (SELECT term, word, round(jw, 12) AS jw, levenshtein(w, m)::INT AS lev FROM (
  SELECT term, word, mapped.m AS m, listed.m AS w, jaro_winkler_similarity(listed.m, mapped.m) AS jw FROM mapped CROSS JOIN listed) WHERE jw >= CASE WHEN length(term) > 4 THEN 0.834 ELSE 0.77 END),
x AS (SELECT *, CASE WHEN lev <= floor((length(term) - 1) * 0.25) THEN 0 WHEN lev < greatest(length(term) - 1, 0) THEN 1
      WHEN jw >= 0.98 * max(jw) OVER (PARTITION BY term) THEN 2 END AS tier FROM p),
y AS (SELECT *, min(tier) OVER (PARTITION BY term) AS first FROM x WHERE tier IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY jw DESC, word) AS rank FROM y WHERE tier = first)"""


SUGGEST_SQL = f"WITH RECURSIVE {scan_sql.scan(BOTH | {'v': ('conversations', 'conv_id, turn', 'text')})},\nd AS MATERIALIZED (SELECT DISTINCT {NORM} AS word FROM b),\n" + _suggest_sql(f"SELECT DISTINCT term FROM (SELECT {NORM} AS term FROM (SELECT value FROM t UNION ALL SELECT value FROM v)) ANTI JOIN d ON d.word = term")
TIER_SQL = "CASE tier WHEN 0 THEN 'mistype' WHEN 1 THEN 'misspell' ELSE 'wild' END AS tier"


@query(f"{SUGGEST_SQL} SELECT term, count(*)::BIGINT AS n, max(jw) AS best FROM p GROUP BY term")
def suggest_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("jw").alias("best"))


@query(f"{SUGGEST_SQL} SELECT {TIER_SQL}, count(*)::BIGINT AS n, count(DISTINCT term)::BIGINT AS terms FROM y WHERE tier = first GROUP BY 1")
def suggest_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suggest.tiers(_similar(spark, sf_dir))
    return rows.groupBy(F.element_at(F.array(*map(F.lit, suggest.TIERS)), F.col("tier") + 1).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms"))


@query(f"{SUGGEST_SQL} SELECT term, rank::INT AS rank, word, jw, lev, {TIER_SQL} FROM z WHERE rank <= 1")
def suggest_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggestions(_unknown_terms(spark, sf_dir), _dictionary(spark, sf_dir), 1)


@query(f"{SUGGEST_SQL} SELECT term, rank::INT AS rank, word, jw, lev, {TIER_SQL} FROM z WHERE rank <= 5")
def suggest_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggestions(_unknown_terms(spark, sf_dir), _dictionary(spark, sf_dir), 5)


def _corrected_sql() -> str:
    """Errors with their best suggestion in the error's case, then each text's pieces on end."""
    style = STYLE.replace("letters", "regexp_replace(value, '[^\\p{L}]', '', 'g')")
    return f"""{ERRORS_SQL},
{_suggest_sql("SELECT DISTINCT norm AS term FROM e")},
lines AS (SELECT doc_id, line_id, line_number, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t_tiles),
fixes AS (SELECT e.doc_id, (before + char_offset)::BIGINT AS start, value, CASE WHEN word IS NULL THEN NULL ELSE {_recased(style, 'word')} END AS made
  FROM e JOIN lines USING (line_id, doc_id) LEFT JOIN (SELECT term, word FROM z WHERE rank = 1) z ON z.term = e.norm),
cuts AS (SELECT doc_id, start, value, made, coalesce(lag(start + length(value)) OVER (PARTITION BY doc_id ORDER BY start), 0) AS after FROM fixes),
joined AS (SELECT doc_id, string_agg(substr(text, after + 1, start - after) || coalesce(made, value), '' ORDER BY start) AS head, max(start + length(value)) AS stop, count(made) AS fixed, count(*) - count(made) AS unfixed
  FROM cuts JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id::VARCHAR AS path, CASE WHEN head IS NULL THEN text ELSE head || substr(text, stop + 1) END AS content, coalesce(fixed, 0)::BIGINT AS fixed, coalesce(unfixed, 0)::BIGINT AS unfixed FROM documents LEFT JOIN joined USING (doc_id)"""


@query(_corrected_sql())
def autocorrect_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its unknown words replaced by their best suggestions."""
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return corrected_once(texts, CONFIG, _dictionary(spark, sf_dir).withColumn("name", F.lit("english")))


@query()
def autocorrect_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document corrected until nothing changes, and how many rounds it took. A third of the dictionary's words stand
    in it as two joined by a hyphen, which the scanner reads apart."""
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    word = F.col("word")
    words = _dictionary(spark, sf_dir).select(F.lit("english").alias("name"), F.when(F.char_length(word) % 3 == 0, F.concat(F.left(word, F.lit(2)), F.lit("-"), F.substr(word, F.lit(3)))).otherwise(word).alias("word"))
    return settled(texts, CONFIG, words).select(F.col("path").cast("long").alias("doc_id"), "content", "fixed", "unfixed", "rounds", "ended")


# Decisions, made by rules on the lengths of the unknown words themselves.

DECIDED_SQL = f"""{ERRORS_SQL}, decided AS (SELECT doc_id, norm, value, CASE WHEN doc_id % 2 = 0 AND length(norm) % 5 = 0 THEN 'skip' WHEN length(norm) % 7 = 0 THEN 'add' WHEN length(value) % 11 = 0 THEN 'replace' ELSE 'report' END AS action,
  CASE WHEN length(value) % 11 = 0 THEN 'x' || value END AS replacement, CASE WHEN length(norm) % 7 = 0 THEN 'english' END AS name FROM e)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's errors once, with their number of places ``n``, and what is decided on them. The texts are scanned
    once: decisions and errors are read from one written table."""
    parts = tasks_for(_table(spark, sf_dir, "documents"))
    counted = _errors(spark, sf_dir).select("doc_id", "value").repartition(parts, "doc_id").groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))
    errors = normalised(materialise(counted)).select("doc_id", "norm", "value", "n")
    none = F.lit(None).cast("string")
    one = lambda rows, action, **given: rows.distinct().select(
        F.lit(action).alias("action"), *[given.get(c, none.cast("long") if c == "doc_id" else none).alias(c) for c in ("doc_id", "norm", "value", "replacement", "name")]
    )
    skip = one(errors.filter("doc_id % 2 = 0 and length(norm) % 5 = 0").select("doc_id", "norm"), "skip", doc_id=F.col("doc_id"), norm=F.col("norm"))
    add = one(errors.filter("length(norm) % 7 = 0").select("norm"), "add", norm=F.col("norm"), name=F.lit("english"))
    swap = one(errors.filter("length(value) % 11 = 0").select("value"), "replace", value=F.col("value"), replacement=F.concat(F.lit("x"), "value"))
    return correct.decide(errors, skip.unionByName(add).unionByName(swap), "doc_id", parts)


@query(f"{DECIDED_SQL} SELECT doc_id, value, action, replacement, name, count(*)::BIGINT AS n FROM decided GROUP BY ALL")
def decisions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("doc_id", "value", "action", "replacement", "name", "n")


@query(f"{DECIDED_SQL} SELECT count(*) FILTER (action = 'skip')::BIGINT AS skip, count(*) FILTER (action = 'replace')::BIGINT AS replace, count(*) FILTER (action = 'add')::BIGINT AS add, count(*) FILTER (action = 'report')::BIGINT AS report FROM decided")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.action_counts(_decided(spark, sf_dir), F.col("n"))
