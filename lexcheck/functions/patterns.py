"""The scanner's patterns, composed from named pieces.

Every piece is valid in Java (Spark) and in Python's ``regex`` module; only the case-insensitive group
differs. Unbounded groups whose continuation cannot start inside them are possessive, so long inputs
neither backtrack nor recurse.
"""

from __future__ import annotations

from functools import lru_cache

# What a word is and which text holds no words.
APOSTROPHE = "[\u2018\u2019']"
TITLE = rf"\p{{Lu}}\p{{Ll}}+(?:{APOSTROPHE}\p{{Ll}}+(?<!{APOSTROPHE}s))*"
UPPER = rf"\p{{Lu}}+(?:{APOSTROPHE}\p{{Lu}}+(?<!{APOSTROPHE}[Ss]))*(?:(?!\p{{Ll}})|(?=s(?!\p{{Ll}})))"
LOWER = rf"\p{{Ll}}+(?:{APOSTROPHE}\p{{Ll}}+(?<!{APOSTROPHE}s))*"
# Letters that are neither lower nor upper case; said with a look-ahead because Java and Python write the
# intersection of classes differently.
OTHER_CASE = r"(?:(?![\p{Ll}\p{Lu}])\p{L})+"

NON_WORDS = r"[^\p{L}/%#0-9\\]+"
SHELL_COLOUR = r"\\(?:e|0?33)\[\p{Nd}+(?:;\p{Nd}+)*m"
BACKSLASH_ESCAPE = r"\\[a-zA-Z]"
PERCENT_ENCODED = r"%[0-8A-F]{2}"
HEX = r"(?:#(?:[0-9a-fA-F]{6}|[0-9a-fA-F]{3})|0x[0-9a-fA-F]+)(?![A-Za-z])"

SCHEME = r"(?://|https?://|s?ftp://|mailto:)"
USER = r"[A-Za-z0-9]+(?::[A-Za-z0-9]+)?@"
HOST = r"(?:[A-Za-z0-9\-\\]+(?:\.[A-Za-z0-9\-\\]+)++|localhost|\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3})"
PORT = r":\p{Nd}+"
PATH = r"/(?:[A-Za-z0-9=@!$&~\-/._\\]++|%[0-9a-fA-F]{2})*+"
QUERY_PART = r"(?:[A-Za-z0-9=!$\-/._\\]++|%[0-9a-fA-F]{2})++"
FRAGMENT = r"#(?:[A-Za-z0-9=!$&\-/.\\]++|%[0-9a-fA-F]{2})++"

KEY_LITERALS = (
    r"SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}",
    r"prg-[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"GTM-[A-Z0-9]{7}",
    r"sha1-[A-Za-z0-9=+/]{28}",
    r"sha512-[A-Za-z0-9=;+/]{88}",
    r"data:[a-z/;0-9\-]+;base64,[A-Za-z0-9+/]+=*(?![A-Za-z0-9])",
)
LEFTOVER = r"[/%#\\]|\p{Nd}+"
REPEATED_LETTER = r"(?:(\p{L})\1+)(?!\p{L})"
ALPHA_CHUNK = r"[A-Za-z][A-Za-z\-_/+]*"
DIGIT_CHUNK = r"\p{Nd}[\p{Nd}\-_/+]*"
POSSIBLE_KEY = rf"(?:{ALPHA_CHUNK}{DIGIT_CHUNK}{ALPHA_CHUNK}|{DIGIT_CHUNK}{ALPHA_CHUNK}{DIGIT_CHUNK})[A-Za-z0-9+/\-_]*=*(?![A-Za-z0-9])"

#: Name in front of ``:disable``, ``:enable`` and ``:disable-line``: this tool's own. Another name, or several
#: as a pattern (``lexcheck|othertool``), can be given; markers of other tools are words.
OWN_NAME = "lexcheck"

TERM = f"{TITLE}|{UPPER}|{LOWER}|{OTHER_CASE}"


def marker(word: str, name: str = OWN_NAME) -> str:
    return f"(?:{name}):{word}"


def line_marker(name: str = OWN_NAME) -> str:
    return rf"(?:{name}):disable[-:]line"


@lru_cache
def alphabet_run(case: str) -> str:
    """``a``, ``ab``, ``abc`` ... in either case, not followed by a letter; built from the inside out."""
    inner = "yz?"
    for letter in reversed("bcdefghijklmnopqrstuvwx"):
        inner = f"{letter}(?:{inner})?"
    return rf"(?{case}:a(?:{inner})?(?!\p{{L}}))"


def url() -> str:
    rest = rf"(?:\?{QUERY_PART}(?:&{QUERY_PART})*+)?(?:{FRAGMENT})?"
    with_scheme = f"{SCHEME}(?:{USER})?{HOST}(?:{PORT})?(?:{PATH})?{rest}"
    with_user = f"{USER}{HOST}(?:{PORT})?(?:{PATH})?{rest}"
    with_path = f"{HOST}(?:{PORT})?{PATH}{rest}"
    return f"{with_scheme}|{with_user}|{with_path}"


def skips() -> str:
    return "|".join((NON_WORDS, SHELL_COLOUR, BACKSLASH_ESCAPE, PERCENT_ENCODED, HEX, url(), *KEY_LITERALS))


def after_key(case: str = "iu") -> str:
    return "|".join((LEFTOVER, REPEATED_LETTER, alphabet_run(case)))


@lru_cache
def tiles() -> str:
    """One alternation whose matches tile a line; group 2 is a word (group 1 is the repeated letter's).

    For lines without possible keys and region markers this is the whole scanner: Java tries alternatives
    in order, as the scanner does."""
    return rf"(?:{skips()}|{after_key()})|({TERM})|[\s\S]"


def min_alpha(n: int) -> str:
    return f"[A-Z][a-z]{{{max(n - 1, 0)}}}|[a-z]{{{n}}}|[A-Z]{{{n}}}"


#: Every possible key has a digit, perhaps separators, and a letter in this order; cheap to search for.
MAYBE_KEY = r"\p{Nd}[\-_/+]*[A-Za-z]"


def any_marker(name: str = OWN_NAME) -> str:
    return rf"(?:{name}):(?:disable|enable)"
