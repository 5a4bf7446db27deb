"""The scanner once more, in SQL, for the registered queries' oracles.

No pattern looks past a blank, so texts are cut at blanks and only distinct pieces are scanned. A piece that
is one plain word between punctuation is answered at once; all others go through a recursive query that
takes one match a step. RE2 has no look-around and no back-references: a look-ahead at the end of a pattern is
said by matching the next character after the group that counts, a look-behind by listing what may stand
there, a repeated letter by trimming. Region markers, which carry state over blanks, are not said here; the
tables hold none.
"""

from __future__ import annotations

import re

from lexcheck.functions import keys, patterns

BLANKS = r"[ \t\n\x0B\f\r]"
AP = "['\u2018\u2019]"
NO_LETTER = r"(?:\P{L}|$)"


def re2(pattern: str) -> str:
    """Possessive groups as plain ones (the languages matched are the same here), quoted for SQL."""
    return pattern.replace("++", "+").replace("*+", "*").replace("'", "''")


def _without_look_ahead(pattern: str) -> str:
    return re.sub(r"\(\?![^)]*\)$", "", pattern)


def _skip() -> str:
    plain = "|".join((patterns.NON_WORDS, patterns.SHELL_COLOUR, patterns.BACKSLASH_ESCAPE, patterns.PERCENT_ENCODED))
    fixed = "|".join((patterns.url(), *patterns.KEY_LITERALS[:5]))
    return rf"^(?:({plain})|({_without_look_ahead(patterns.HEX)})(?:[^A-Za-z]|$)|({fixed})|({_without_look_ahead(patterns.KEY_LITERALS[5])})(?:[^A-Za-z0-9]|$))"


def _term() -> str:
    low = rf"\p{{Ll}}+(?:{AP}(?:\p{{Ll}}{{2,}}|[^\P{{Ll}}s]))*"
    up = rf"\p{{Lu}}+(?:{AP}(?:\p{{Lu}}{{2,}}|[^\P{{Lu}}sS]))*"
    return rf"^(?:(\p{{Lu}}{low})|({up})(?:\P{{Ll}}|s(?:\P{{Ll}}|$)|$)|({low}|[\p{{Lm}}\p{{Lo}}\p{{Lt}}]+))"


def _alphabet() -> str:
    inner = "yz?"
    for letter in reversed("bcdefghijklmnopqrstuvwx"):
        inner = f"{letter}(?:{inner})?"
    return rf"^((?i:a(?:{inner})?)){NO_LETTER}"


CANDIDATE = _without_look_ahead(patterns.POSSIBLE_KEY)
KIND = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{n}'" for n, (p, _) in keys.SETS.items()) + " END AS kind"
NAMED = {f: f"f{i}" for i, f in enumerate(keys.FEATURES)}


def _features() -> dict[str, str]:
    count = lambda letters: f"(length(s) - length(translate(s, '{letters}', '')))::DOUBLE"
    total = "CASE kind WHEN 'hex' THEN 16.0 WHEN 'lower36' THEN 36.0 WHEN 'upper36' THEN 36.0 WHEN 'base64' THEN 64.0 END"
    gap = lambda c: f"abs({count(c)} / length(s) - coalesce(length(s) / ({total}), 0))"
    gaps = "[" + ", ".join(gap(c) for c in keys.ALPHABET) + "]"
    out = {c: gap(c) for c in keys.TRACKED} | {"equal": count("="), "length": "length(s)::DOUBLE"} | {k: f"(kind IS NOT DISTINCT FROM '{k}')::INT::DOUBLE" for k in keys.SETS}
    for name, pattern in keys.CHUNKS.items():
        sizes = f"list_transform(regexp_extract_all(s, '{pattern}'), lambda x: length(x)::DOUBLE)"
        out[f"mean_{name}_chunk_size"] = f"coalesce(list_avg({sizes}), 0.0)"
        out[f"variance_{name}_chunk_size"] = f"coalesce(list_var_pop({sizes}), 0.0)"
        out[f"max_{name}_chunk_size"] = f"coalesce(list_max({sizes}), 0.0)"
        out[f"{name}_chunks"] = f"len({sizes})::DOUBLE"
    out["vowel_consonant_ratio"] = f"{count(keys.VOWELS)} / greatest(1, {count(keys.CONSONANTS)})"
    out["mean_letter_frequency_difference"] = f"list_avg({gaps})"
    out["variance_letter_frequency_difference"] = f"list_max({gaps})"
    return {f: out[f] for f in keys.FEATURES}


def features(source: str, prefix: str = "") -> str:
    """CTEs ``<prefix>k(s, kind)`` and ``<prefix>f(s, kind, f0, f1, ...)`` over ``source(s)``."""
    return f"{prefix}k AS (SELECT s, {KIND} FROM {source}), {prefix}f AS (SELECT s, kind, " + ", ".join(f"{x} AS {NAMED[n]}" for n, x in _features().items()) + f" FROM {prefix}k)"


def _score(name: str, model: keys.Model) -> str:
    parts = []
    for f in keys.FEATURES:
        mean, variance = model[name][f]
        parts.append(f"CASE WHEN {NAMED[f]} = {mean!r}::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" if variance == 0 else f"exp(-(({NAMED[f]} - {mean!r}::DOUBLE) * ({NAMED[f]} - {mean!r}::DOUBLE)) / {2 * variance!r}::DOUBLE) / sqrt(2 * pi() * {variance!r}::DOUBLE)")
    return " * ".join(parts)


def classified(weight: int = 5) -> str:
    """Whether a row of features is a key's, by the default model."""
    model = keys.default_model()
    cases = " ".join(f"WHEN '{n}' THEN ({_score(f'key_{n}', model)}) * {10.0**weight!r} >= ({_score(f'not_key_{n}', model)})" for n in keys.SETS)
    return f"CASE kind {cases} ELSE TRUE END"


def scan(sources: dict[str, tuple[str, str, str]]) -> str:
    """CTEs ``<name>(<key>, value, place)`` with the words of at least three letters of each source's texts
    (``name: (table, key columns, text column)``); ``place`` is where in its piece a word starts. Goes behind
    ``WITH RECURSIVE``. ``<name>_pieces(<key>, line_number, c, char_at, byte_at)`` has the pieces themselves."""
    parts = []
    for name, (table, key, text) in sources.items():
        first = re.split(r"\s*,\s*", key)
        kept = ", ".join(first)
        parts.append(f"""{name}_lines AS (SELECT {kept}, unnest(str_split({text}, chr(10))) AS line, generate_subscripts(str_split({text}, chr(10)), 1) AS line_number FROM {table} WHERE {text} IS NOT NULL),
{name}_tiles AS (SELECT row_number() OVER () AS line_id, * FROM {name}_lines),
{name}_cut AS (SELECT line_id, {kept}, line_number, unnest(regexp_extract_all(line, '{BLANKS}+|[^{BLANKS[1:]}+')) AS c, generate_subscripts(regexp_extract_all(line, '{BLANKS}+|[^{BLANKS[1:]}+'), 1) AS nth FROM {name}_tiles),
{name}_placed AS (SELECT line_id, {kept}, line_number, c, coalesce(sum(length(c)) OVER w, 0)::INT AS char_at, coalesce(sum(strlen(c)) OVER w, 0)::INT AS byte_at FROM {name}_cut WINDOW w AS (PARTITION BY line_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_pieces AS MATERIALIZED (SELECT * FROM {name}_placed WHERE NOT regexp_full_match(c, '{BLANKS}+'))""")
    every = " UNION ALL ".join(f"SELECT c FROM {name}_pieces" for name in sources)
    edge = r"[^\p{L}\p{Nd}/%#\\@" + "''\u2018\u2019]*"
    plain = rf"{edge}(\p{{Lu}}?\p{{Ll}}+|\p{{Lu}}+){edge}"
    parts.append(f"""u AS MATERIALIZED (SELECT DISTINCT c FROM ({every})),
plain AS MATERIALIZED (SELECT c, regexp_extract(c, '^{plain}$', 1) AS w FROM u WHERE regexp_full_match(c, '{plain}')),
hard AS MATERIALIZED (SELECT c FROM u WHERE NOT regexp_full_match(c, '{plain}')),
cand AS MATERIALIZED (SELECT DISTINCT regexp_extract(substr(c, i::BIGINT), '^({re2(CANDIDATE)})(?:[^A-Za-z0-9]|$)', 1) AS s FROM (SELECT c, unnest(range(1, length(c) + 1)) AS i FROM hard WHERE regexp_matches(c, '\\p{{Nd}}[\\-_/+]*[A-Za-z]'))),
gated AS (SELECT s FROM cand WHERE s <> '' AND length(s) BETWEEN 6 AND 200 AND regexp_matches(s, '{patterns.min_alpha(3)}')),
{features("gated", "g")},
found_keys AS MATERIALIZED (SELECT s FROM gf WHERE {classified()} UNION SELECT s FROM cand WHERE length(s) > 200),
steps(c, rest, done, words) AS (
  SELECT c, c, 0, []::STRUCT(place INT, value VARCHAR)[] FROM hard
  UNION ALL
  SELECT c, substr(rest, n + 1), done + n, CASE WHEN is_word AND n >= 3 THEN list_append(words, {{'place': done, 'value': left(rest, n)}}) ELSE words END
  FROM (SELECT c, rest, done, words,
      CASE WHEN skip <> '' THEN length(skip) WHEN key IS NOT NULL THEN length(key) WHEN leftover <> '' THEN length(leftover)
           WHEN repeated THEN run WHEN alphabet <> '' THEN length(alphabet) WHEN term <> '' THEN length(term) ELSE 1 END::INT AS n,
      skip = '' AND key IS NULL AND leftover = '' AND NOT repeated AND alphabet = '' AND term <> '' AS is_word
    FROM (SELECT q.*, found_keys.s AS key, run >= 2 AND regexp_matches(rest, '^\\p{{L}}') AND NOT regexp_matches(substr(rest, run + 1), '^\\p{{L}}') AS repeated
      FROM (SELECT c, rest, done, words, a.a || a.b || a.c || a.d AS skip, regexp_extract(rest, '^({re2(CANDIDATE)})(?:[^A-Za-z0-9]|$)', 1) AS maybe,
          regexp_extract(rest, '^({re2(patterns.LEFTOVER)})', 1) AS leftover, (length(rest) - length(ltrim(rest, left(rest, 1))))::INT AS run,
          regexp_extract(rest, '{_alphabet()}', 1) AS alphabet, t.a || t.b || t.c AS term
        FROM (SELECT c, rest, done, words, regexp_extract(rest, '{re2(_skip())}', ['a', 'b', 'c', 'd']) AS a, regexp_extract(rest, '{re2(_term())}', ['a', 'b', 'c']) AS t FROM steps WHERE rest <> '')) q
      LEFT JOIN found_keys ON found_keys.s = q.maybe))),
scanned AS MATERIALIZED (
  SELECT c, x.place AS place, x.value AS value FROM (SELECT c, unnest(words) AS x FROM steps WHERE rest = '')
  UNION ALL SELECT c, strpos(c, w)::INT - 1, w FROM plain WHERE length(w) >= 3 AND replace(w, w[1], '') <> '' AND NOT starts_with('abcdefghijklmnopqrstuvwxyz', lower(w)))""")
    for name, (_, key, _) in sources.items():
        parts.append(f"{name} AS (SELECT line_id, {key}, line_number::INT AS line_number, value, char_at + place AS char_offset, (byte_at + strlen(left(c, place)))::INT AS byte_offset FROM {name}_pieces JOIN scanned USING (c))")
    return ",\n".join(parts)
