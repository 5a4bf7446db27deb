"""Ignore rules of a folder tree, with negations.

Later rules win over earlier ones, deeper files over shallower ones, ``.ignore`` over ``.gitignore``; the
repository's own exclude file and the user's global one come first. What lies in an ignored folder stays
ignored whatever later rules say, so ignored and hidden folders are not searched for ignore files.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lexcheck.sources.globs import python_regex
from lexcheck.storage import exists, join, read_small_file

NAMES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class Rule:
    """``pattern`` fits paths relative to the checked folder; folders end with a slash."""

    pattern: str
    ignores: bool


def _body(glob: str) -> str:
    """A rule's glob: stars and question marks stay inside a path's part, ``**`` does not."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i) and i + 2 == len(glob) and i and glob[i - 1] == "/":
            out, i = out + ".+", i + 2
            continue
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def parse(text: str, folder: str = "") -> list[Rule]:
    """Rules of an ignore file that lies in ``folder`` (relative, with its last slash, or empty)."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        ignores = not line.startswith("!")
        body = line.removeprefix("!")
        only_folders, body = body.endswith("/"), body.rstrip("/")
        if not body:
            continue
        anywhere = "" if "/" in body else "(?:.*/)?"
        out.append(Rule(rf"\A(?s:{re.escape(folder)}{anywhere}{_body(body.removeprefix('/'))}){'/' if only_folders else '/?'}\z", ignores))
    return out


def fits(rules: list[Rule], path: str) -> bool:
    """What the last rule that fits says of one path (a folder's ends with a slash)."""
    return next((r.ignores for r in reversed(rules) if re.search(python_regex(r.pattern), path)), False)


def global_rules() -> list[Rule]:
    """The user's own ignore file for all repositories, where this process runs."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    path = os.path.join(home, "git", "ignore")
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8", errors="replace") as f:
        return parse(f.read())


def first_rules(spark: SparkSession, folder: str) -> list[Rule]:
    """The weakest rules of a tree: the user's global ones, then the repository's own exclude file."""
    own = join(folder, ".git/info/exclude")
    return global_rules() + (parse(read_small_file(spark, own)) if exists(spark, own) else [])
