"""Many regexes over lines in one pass: an Aho-Corasick automaton over the literals they require.

Every match of a pattern holds one of a few literals that can be read off the pattern. One automaton over
the literals of all patterns reads each text once; a pattern is tried on a line only if one of its literals
is there. Patterns without a literal of two characters or more are tried on every line.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from re import _parser as regex
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.session import ship

#: The shortest literal worth looking for.
SHORTEST = 2


class Rule(NamedTuple):
    """A pattern of a family, its number there (from 1) and the pattern of lines that don't count."""

    family: str
    number: int
    pattern: str
    benign: str | None = None


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """The set whose shortest literal is longer; of equal ones the smaller set."""
    def worth(s):
        return (min(map(len, s)), -len(s)) if s else (0, 0)
    return a if worth(a) >= worth(b) else b


def _required(items) -> frozenset | None:
    """Literals, lower-cased, of which every match of the items holds one; None if there are none."""
    best, run = None, ""
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            if value < 128:
                run += chr(value).lower()
                continue
            found = None  # other letters have case rules of their own
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue  # these take no characters, so literals around them touch
        elif name == "SUBPATTERN":
            inner = list(value[3])
            if all(str(o) == "LITERAL" and v < 128 for o, v in inner):
                run += "".join(chr(v).lower() for _, v in inner)
                continue
            found = _required(inner)
        elif name == "BRANCH":
            parts = [_required(p) for p in value[1]]
            found = frozenset().union(*parts) if all(parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            found = _required(value[2]) if value[0] > 0 else None
        elif name == "ATOMIC_GROUP":
            found = _required(value)
        else:
            found = None
        best = _better(_better(best, frozenset([run]) if run else None), found)
        run = ""
    return _better(best, frozenset([run]) if run else None)


def required_literals(pattern: str) -> frozenset:
    """Lower-case literals of which every match of a pattern holds one; empty if none of use is known."""
    found = _required(regex.parse(pattern))
    # lines are told apart by line feeds, so a literal across two lines is none
    return found if found and min(map(len, found)) >= SHORTEST and not any("\n" in x for x in found) else frozenset()


class Matcher:
    """All rules of a table, ready to be searched for."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        import ahocorasick

        self.rules = rules
        self.tests = [(re.compile(r.pattern, re.ASCII), re.compile(r.benign, re.ASCII) if r.benign else None)
                      for r in rules]
        literals: dict[str, set[int]] = {}
        self.always = []
        for i, r in enumerate(rules):
            if not (found := required_literals(r.pattern)):
                self.always.append(i)
            for literal in found:
                literals.setdefault(literal, set()).add(i)
        self.automaton = None
        if literals:
            self.automaton = ahocorasick.Automaton()
            for literal, of in literals.items():
                self.automaton.add_word(literal, tuple(of))
            self.automaton.make_automaton()

    def lines(self, raw: bytes) -> Iterator[tuple[int, str, list[int]]]:
        """Lines of UTF-8 text worth a look: number (from 0), trimmed line and the rules to try, in order.

        Lines end at line feeds, with or without a carriage return; blanks around them go, and blank
        lines and comments (#) are left out.
        """
        # one character per byte, lower-cased A-Z, so places in it are places in the text
        low = raw.lower().decode("latin-1")
        at, number, end, tried = 0, 0, -1, set(self.always)

        def line() -> tuple[int, str, list[int]] | None:
            text = raw[at:end].decode("utf-8", "replace").removesuffix("\r").strip(" ")
            return (number, text, sorted(tried)) if tried and text and text[0] != "#" else None

        def next_end(start: int) -> int:
            found = low.find("\n", start)
            return found if found >= 0 else len(low)

        end = next_end(0)
        for place, of in self.automaton.iter(low) if self.automaton else ():
            while place > end:  # a literal holds no line feed, so it lies in the line of its end
                if found := line():
                    yield found
                if self.always:
                    at, number, end = end + 1, number + 1, next_end(end + 1)
                else:
                    start = low.rfind("\n", end, place) + 1
                    number += low.count("\n", at, start)
                    at, end = start, next_end(place)
                tried = set(self.always)
            tried.update(of)
        while True:
            if found := line():
                yield found
            if not self.always or end >= len(low):
                return
            at, number, end, tried = end + 1, number + 1, next_end(end + 1), set(self.always)

    def fires(self, rule: int, line: str) -> bool:
        test, benign = self.tests[rule]
        return test.search(line) is not None and not (benign and benign.search(line))

    def families(self, line: str, tried: list[int]) -> list[str]:
        """Families with a hit in a line, in the order of the rules."""
        found: dict[str, None] = {}
        for i in tried:
            if self.rules[i].family not in found and self.fires(i, line):
                found[self.rules[i].family] = None
        return list(found)

    def matches(self, line: str, tried: list[int]) -> Iterator[tuple[int, int, int]]:
        """Rule, start and end of every match in a line."""
        for i in tried:
            test, benign = self.tests[i]
            if not (benign and benign.search(line)):
                for m in test.finditer(line):
                    yield i, m.start(), m.end()


@functools.lru_cache(16)
def matcher(rules: tuple[Rule, ...]) -> Matcher:
    """The matcher of a rule table, built once per worker."""
    return Matcher(rules)


def rules_of(families: dict, context: str | None = None, flags: str = "") -> tuple[Rule, ...]:
    """Rules from family -> patterns, or -> (pattern, contexts, benign pattern) of which one context is used."""
    out = []
    for family, patterns in families.items():
        for number, p in enumerate(patterns, 1):
            pattern, contexts, benign = (p, None, None) if isinstance(p, str) else p
            if context is None or contexts is None or context in contexts:
                out.append(Rule(family, number, flags + pattern, benign))
    return tuple(out)


def line_families(rows: DataFrame, line: str, rules: tuple[Rule, ...]) -> Column:
    """The families with a hit in a line, as an array; a null line has none."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<string>")
    def found(lines: pd.Series) -> pd.Series:
        search, out = matcher(rules), []
        for raw in lines:
            names: dict[str, None] = {}
            low = bytes(raw or b"").lower().decode("latin-1")
            tried = set(search.always)
            for _, of in search.automaton.iter(low) if search.automaton else ():
                tried.update(of)
            if tried and raw is not None:
                names = search.families(bytes(raw).decode("utf-8", "replace"), sorted(tried))
            out.append(list(names))
        return pd.Series(out)

    return found(F.col(line).cast("binary"))


def text_families(rows: DataFrame, rules: tuple[Rule, ...], text: str = "text", keep=()) -> DataFrame:
    """One row per line with a hit and family: the kept columns, line_no, line and family.

    Texts are searched whole, and only lines with hits become rows. Null texts have no lines.
    """
    ship(rows.sparkSession)

    @F.pandas_udf("array<struct<line_no: bigint, line: string, families: array<string>>>")
    def found(texts: pd.Series) -> pd.Series:
        search, out = matcher(rules), []
        for raw in texts:
            hits = []
            for number, line, tried in search.lines(bytes(raw or b"")):
                if names := search.families(line, tried):
                    hits.append({"line_no": number, "line": line, "families": names})
            out.append(hits)
        return pd.Series(out)

    hits = rows.select(*keep, F.explode_outer(found(F.col(text).cast("binary"))).alias("_hit")).filter(
        F.col("_hit").isNotNull())
    return hits.select(*keep, "_hit.line_no", "_hit.line", F.explode("_hit.families").alias("family"))


def text_matches(rows: DataFrame, rules: tuple[Rule, ...], text: str = "text", keep=(), around: int = 16) -> DataFrame:
    """Every match: the kept columns, family, pattern (its number), line_no, start (in the line) and snippet.

    A snippet is the match with `around` characters of its line on either side, trimmed of blanks.
    """
    ship(rows.sparkSession)
    kind = "array<struct<family: string, pattern: int, line_no: bigint, start: int, snippet: string>>"

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.Series:
        search, out = matcher(rules), []
        for raw in texts:
            hits = []
            for number, line, tried in search.lines(bytes(raw or b"")):
                for i, start, end in search.matches(line, tried):
                    hits.append({"family": rules[i].family, "pattern": rules[i].number, "line_no": number, "start": start,
                                 "snippet": line[max(0, start - around):end + around].strip(" ")})
            out.append(hits)
        return pd.Series(out)

    return rows.select(*keep, F.explode_outer(found(F.col(text).cast("binary"))).alias("_hit")).filter(
        F.col("_hit").isNotNull()).select(*keep, "_hit.*")
