"""Globs as regular expressions, usable by Java and Python alike."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """Anchored pattern of one glob. ``*`` and ``?`` cross ``/``; ``**/`` is any depth, none included;
    ``[...]`` and ``{a,b}`` are classes and alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return rf"\A(?s:{out})\z"


def python_regex(pattern: str) -> str:
    return pattern.replace(r"\z", r"\Z")


def include_globs(pattern: str) -> list[str]:
    """``dir/`` is the directory's content at any depth, a bare name any depth, a path stays anchored."""
    if pattern.endswith("/"):
        return [f"{pattern}**", f"**/{pattern}**"]
    return [pattern] if "/" in pattern else [f"**/{pattern}", pattern]


def exclude_globs(pattern: str) -> list[str]:
    """As written, without any-depth prefix; ``dir/`` is the directory and what is in it."""
    return [pattern[:-1], f"{pattern}**"] if pattern.endswith("/") else [pattern]


def any_of(globs: list[str]) -> str:
    return "|".join(glob_regex(g) for g in globs) or r"\A(?!)"
