"""Settings: packaged defaults, an optional YAML file on top."""

from __future__ import annotations

import copy
import os
from dataclasses import dataclass, field

# The default settings.
DEFAULTS = {
    "word_minimum_length": 3,
    "key_heuristic_weight": 5,
    "key_minimum_length": 6,
    "includes": [],
    "excludes": [".git/", ".lexcheck_wordlists/", ".DS_Store", "Gemfile.lock", ".rspec_status", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", ".gitkeep", ".keep", "*.svg", "*.eot", "*.ttf", "*.woff", "*.woff2", "*.zip", "*.pdf", "*.xlsx", "*.gz"],
    "languages": {
        "english": {"locale": "US"},
        "lexcheck": {"addable": False},
        "ruby": {"includes": ["*.rb", "*.rake", "*.gemspec", "*.erb", "*.haml", "*.jbuilder", "*.builder", "Gemfile", "Rakefile", "config.ru", "Capfile", ".simplecov"], "hashbangs": ["ruby"]},
        "rust": {"includes": ["*.rs", "Cargo.toml"]},
        "html": {"includes": ["*.html", "*.hml", "*.jsx", "*.tsx", "*.js", "*.ts", "*.jsx.snap", "*.tsx.snap", "*.coffee", "*.haml", "*.erb", "*.rb", "*.builder", "*.css", "*.scss", "*.sass", "*.less"]},
        "javascript": {"includes": ["*.html", "*.hml", "*.jsx", "*.tsx", "*.js", "*.ts", "*.jsx.snap", "*.tsx.snap", "*.coffee", "*.haml", "*.erb", "*.json"]},
        "shell": {"includes": ["*.sh", "Dockerfile"], "hashbangs": ["bash", "sh"]},
        "dockerfile": {"includes": ["Dockerfile"]},
        "css": {"includes": ["*.css", "*.sass", "*.scss", "*.less"]},
        "xml": {"includes": ["*.xml", "*.html", "*.haml", "*.hml", "*.svg"]},
    },
}
LOCAL_FILE = ".lexcheck.yml"
LISTS = ("includes", "hashbangs")


@dataclass(frozen=True)
class Language:
    """``key`` is the letter that stands for the language when a word is added; no includes and no hashbangs
    means every file."""

    name: str
    key: str
    addable: bool = True
    includes: tuple[str, ...] = ()
    hashbangs: tuple[str, ...] = ()
    locales: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    word_minimum_length: int = 3
    key_heuristic_weight: int = 5
    key_minimum_length: int = 6
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    languages: tuple[Language, ...] = field(default_factory=tuple)


def union(old: list, new: list) -> list:
    return old + [x for x in new if x not in old]


def merge(base: dict, user: dict) -> dict:
    """Numbers: the user's; lists: the union, defaults first; languages: merged one by one, in order."""
    out = copy.deepcopy(base)
    for name, value in (user or {}).items():
        if name == "languages":
            for language, own in (value or {}).items():
                mine = out["languages"].setdefault(language, {})
                for k, v in (own or {}).items():
                    mine[k] = union(mine.get(k, []), v) if k in LISTS else v
        elif name in ("includes", "excludes"):
            out[name] = union(out[name], value or [])
        elif name in out:
            out[name] = value
    return out


def build(raw: dict) -> Settings:
    languages = []
    for name, own in raw["languages"].items():
        own = own or {}
        locale = own.get("locale")
        locales = [locale] if isinstance(locale, str) else [x for x in locale or [] if isinstance(x, str)]
        languages.append(Language(name, own.get("key") or name[:1] or "?", own.get("addable", True), tuple(own.get("includes", ())), tuple(own.get("hashbangs", ())), tuple(locales)))
    numbers = {k: raw[k] for k in ("word_minimum_length", "key_heuristic_weight", "key_minimum_length")}
    return Settings(**numbers, includes=tuple(raw["includes"]), excludes=tuple(raw["excludes"]), languages=tuple(languages))


def load(path: str | None = None, folder: str = ".") -> Settings:
    """The named file, else ``.lexcheck.yml`` in the folder, else the defaults."""
    local = os.path.join(folder, LOCAL_FILE)
    chosen = path or (local if os.path.exists(local) else None)
    user = {}
    if chosen:
        import yaml

        with open(chosen, encoding="utf-8") as f:
            user = yaml.safe_load(f) or {}
    return build(merge(DEFAULTS, user))
