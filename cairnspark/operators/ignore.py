"""Ignore patterns as one regular expression for each folder that has them; matching is a Catalyst predicate."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name of files with patterns; each rules the folder it lies in.
IGNORE_FILE = ".cairnignore"
#: What is ignored everywhere, before the patterns of the root.
DEFAULTS = (".git/", ".svn/", ".hg/", ".DS_Store", "Thumbs.db", "node_modules/", "target/", "*.tmp", "*.swp", IGNORE_FILE)


def to_regex(pattern: str, scope: str = "") -> str | None:
    """A pattern (gitignore syntax, without negation) as a regular expression on whole paths; None for blanks and comments.

    It fits a path if it fits the path or any folder above it. A pattern with a slash before its end is anchored to its scope.
    """
    p = pattern.strip()
    if not p or p.startswith("#"):
        return None
    only_dir = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, k = "", 0
    while k < len(p):
        if p.startswith("**/", k):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif p.startswith("/**", k) and k + 3 == len(p):
            out, k = out + "/.*", k + 3
        elif p.startswith("**", k):
            out, k = out + ".*", k + 2
        elif p[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif p[k] == "?":
            out, k = out + "[^/]", k + 1
        elif p[k] == "[" and (end := p.find("]", k + 2)) > 0:
            inner = p[k + 1 : end]
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, k = out + re.sub(r"([^\w/-])", r"\\\1", p[k]), k + 1
    base = re.sub(r"([^\w/-])", r"\\\1", scope.rstrip("/")) + "/" if scope else ""
    return f"^{base}{'' if anchored else '(?:[^/]+/)*'}{out}{'/' if only_dir else '(?:/|$)'}"


@dataclass(frozen=True)
class Matcher:
    """Patterns by folder. A path is ignored if any folder's patterns ignore it; within a folder the last that fits decides, and `!` takes back."""

    scopes: tuple[tuple[tuple[str, bool], ...], ...]

    @classmethod
    def of(cls, patterns: dict[str, list[str]], defaults: bool = True) -> "Matcher":
        scopes = []
        for scope, lines in ({"": []} | patterns).items():
            lines = [*(DEFAULTS if defaults and not scope.strip("/") else ()), *lines]
            rules = [(to_regex(p.strip().removeprefix("!"), scope), not p.strip().startswith("!")) for p in lines]
            scopes.append([r for r in rules if r[0]])
        return cls(tuple(tuple(s) for s in scopes if s))

    @classmethod
    def from_tree(cls, folder: str, name: str = IGNORE_FILE, defaults: bool = True) -> "Matcher":
        """The patterns of all files called `name` under a folder, each for its own folder."""
        from cairnspark.sources.folders import listed, read_one

        patterns = {}
        for path, _, _ in listed(folder):
            if path.rsplit("/", 1)[-1] == name:
                patterns[path.removesuffix(name).rstrip("/")] = read_one(folder, path).decode(errors="replace").splitlines()
        return cls.of(patterns, defaults)

    def ignores(self, path: str) -> bool:
        """As `matches`, for one path."""
        for rules in self.scopes:
            hit = False
            for regex, ignored in rules:
                if re.search(regex, path):
                    hit = ignored
            if hit:
                return True
        return False

    def matches(self, path: Column) -> Column:
        out = F.lit(False)
        for rules in self.scopes:
            hit = F.lit(False)
            for regex, ignored in rules:
                hit = F.when(path.rlike(regex), F.lit(ignored)).otherwise(hit)
            out = out | hit
        return out
