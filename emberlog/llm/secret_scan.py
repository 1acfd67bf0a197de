"""Secret scans by one deterministic automaton for all rules.

Each rule's regex becomes a nondeterministic automaton over bytes. Subset construction turns it into a
deterministic one that searches: a state is the list of threads by the place they began, earliest first,
and a match of the earliest ends all later ones. So a rule's accepting states mark its leftmost longest
matches, one after another. The rules' minimal automata are combined into one whose states are tuples of
theirs, again minimised and written into one transition array over classes of bytes. A text is read once,
byte by byte, for all rules; where a rule stops accepting a match has ended, and its start is found by
reading back along the reversed rule, never past the previous match.

That is exact for rules whose match, once there, either goes on matching or is over, and in which no
later match comes up while an earlier start is still open. `compiled` checks both over all states and
refuses other rules, as well as rules that match fewer than two bytes.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from re import _parser as regex

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import only
from emberlog.session import ship


@dataclass(frozen=True)
class Rule:
    """A kind of secret, the regex that finds it and one that whole matches must fit (or they fail)."""

    kind: str
    pattern: str
    keep: str | None = None


KEYWORD = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
#: Rules that `spans` always holds, in the order of kinds; runs and lengths as the pattern says.
BASE = (Rule("assign", KEYWORD + "+)", KEYWORD + "{6,})"),
        Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}"),
        Rule("hex", r"[0-9a-f]{24,}"))
#: Further rules: private keys' first lines, signed web tokens, tokens of source and chat services.
MORE = (Rule("private_key", r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----"),
        Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
        Rule("source_token", r"gh[opsru]_[A-Za-z0-9]{36,}"),
        Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"))


class Nfa:
    """Thread automaton of a regex over bytes: sets of bytes between numbered states, and empty steps.

    Takes literals, classes, groups, alternatives, repeats and (?i:...); a byte stands for itself, so
    classes hold ASCII only.
    """

    def __init__(self, pattern: str) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[set[int]] = []
        self.start = self._state()
        self.end = self._items(regex.parse(pattern), self.start, 0)

    def _state(self) -> int:
        self.moves.append([])
        self.empty.append(set())
        return len(self.moves) - 1

    def _bytes(self, found: set[int], at: int, flags: int) -> int:
        if max(found, default=0) > 127:
            raise ValueError("rules hold ASCII only")
        if flags & re.IGNORECASE:
            found = {ord(c) for x in found for c in (chr(x).lower(), chr(x).upper())}
        to = self._state()
        self.moves[at].append((frozenset(found), to))
        return to

    def _items(self, items, at: int, flags: int) -> int:
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                at = self._bytes({value}, at, flags)
            elif name == "IN":
                found: set[int] = set()
                for kind, x in value:
                    if str(kind) not in ("LITERAL", "RANGE"):
                        raise ValueError(f"classes with {kind} are not taken")
                    found |= {x} if str(kind) == "LITERAL" else set(range(x[0], x[1] + 1))
                at = self._bytes(found, at, flags)
            elif name == "SUBPATTERN":
                _, add, _, inner = value
                at = self._items(inner, at, flags | add)
            elif name == "BRANCH":
                ends = [self._items(inner, at, flags) for inner in value[1]]
                at = self._state()
                for end in ends:
                    self.empty[end].add(at)
            elif name == "MAX_REPEAT":
                least, most, inner = value
                for _ in range(least):
                    at = self._items(inner, at, flags)
                if str(most) == "MAXREPEAT":
                    loop = self._state()
                    self.empty[at].add(loop)
                    self.empty[self._items(inner, loop, flags)].add(loop)
                    at = loop
                else:
                    skips = [at]
                    for _ in range(most - least):
                        at = self._items(inner, at, flags)
                        skips.append(at)
                    at = self._state()
                    for skip in skips:
                        self.empty[skip].add(at)
            else:
                raise ValueError(f"{name} is not taken")
        return at

    def reversed(self) -> Nfa:
        """The automaton of the rule's texts read backwards."""
        other = object.__new__(Nfa)
        other.moves, other.empty = [[] for _ in self.moves], [set() for _ in self.empty]
        for at, moves in enumerate(self.moves):
            for symbols, to in moves:
                other.moves[to].append((symbols, at))
            for to in self.empty[at]:
                other.empty[to].add(at)
        other.start, other.end = self.end, self.start
        return other

    def closure(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def step(self, states: frozenset, byte: int) -> frozenset:
        return self.closure({to for s in states for symbols, to in self.moves[s] if byte in symbols})

    def classes(self) -> np.ndarray:
        """For each byte the number of its class; bytes of a class are alike to all moves."""
        sets = sorted({tuple(sorted(symbols)) for moves in self.moves for symbols, _ in moves})
        table = np.array([[b in s for s in sets] for b in range(256)], dtype=np.int64).reshape(256, -1)
        return np.unique(table, axis=0, return_inverse=True)[1].reshape(256)


@dataclass(frozen=True)
class Dfa:
    """classes of bytes, next state by state and class, and a mark per state; it starts in state 0."""

    classes: np.ndarray
    next: np.ndarray
    marks: np.ndarray


def minimal(dfa: Dfa) -> Dfa:
    """The least automaton with the same marks: states are split until equal ones have equal next ones."""
    group = np.unique(dfa.marks, return_inverse=True)[1]
    while True:
        rows = np.column_stack([group, group[dfa.next]])
        split = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        if split.max() == group.max():
            break
        group = split
    _, first, number = np.unique(group, return_index=True, return_inverse=True)
    # number the groups by their first state, so that state 0 stays the start
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    keep = np.sort(first)
    return Dfa(dfa.classes, rank[number][dfa.next[keep]], dfa.marks[keep])


def _built(nfa: Nfa, start, step, mark) -> Dfa:
    """Subset construction from a start state, its step by byte and its mark."""
    classes = nfa.classes()
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
    numbers, states, following = {start: 0}, [start], []
    for state in states:
        row = []
        for byte in sample:
            to = step(state, byte)
            if to not in numbers:
                numbers[to] = len(states)
                states.append(to)
            row.append(numbers[to])
        following.append(row)
    return minimal(Dfa(classes, np.array(following), np.array([mark(s) for s in states])))


def searching(rule: Rule) -> Dfa:
    """The automaton that finds the leftmost longest matches of a rule; mark 1: a match ends here so far."""
    nfa = Nfa(rule.pattern)
    fresh = nfa.closure({nfa.start})
    if nfa.end in fresh or any(nfa.end in nfa.step(fresh, b) for b in range(256)):
        raise ValueError(f"rule {rule.kind} matches fewer than two bytes")

    def step(threads: tuple[frozenset, ...], byte: int) -> tuple[frozenset, ...]:
        matched = bool(threads) and nfa.end in threads[0]
        out: list[frozenset] = []
        seen: set[int] = set()
        for thread in threads:
            moved = nfa.step(thread, byte) - seen
            if moved:
                out.append(moved)
                seen |= moved
        if matched and out:
            if nfa.end not in out[0]:
                raise ValueError(f"a match of rule {rule.kind} can go on without matching")
            return (out[0],)
        begun = nfa.step(fresh, byte) - seen
        if begun:
            out.append(begun)
        if any(nfa.end in thread for thread in out[1:]):
            raise ValueError(f"a later match of rule {rule.kind} can come up before an earlier one")
        return (out[0],) if out and nfa.end in out[0] else tuple(out)

    return _built(nfa, (), step, lambda threads: int(bool(threads) and nfa.end in threads[0]))


def whole(pattern: str, backwards: bool = False) -> Dfa:
    """The automaton of whole texts; mark 1: it matches, 2: no further byte can make it match."""
    nfa = Nfa(pattern).reversed() if backwards else Nfa(pattern)
    return _built(nfa, nfa.closure({nfa.start}), nfa.step,
                  lambda states: 2 if not states else int(nfa.end in states))


def combined(parts: list[Dfa]) -> Dfa:
    """One automaton for all; bit i of a state's mark is the mark of part i."""
    both, inverse = np.unique(np.column_stack([p.classes for p in parts]), axis=0, return_inverse=True)
    sizes = [len(p.next) for p in parts]
    scale = np.cumprod([1, *sizes[:-1]], dtype=np.int64)
    known, frontier, following = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), {}
    while len(frontier):
        to = sum(p.next[frontier // s % n][:, both[:, i]] * s
                 for i, (p, s, n) in enumerate(zip(parts, scale, sizes)))
        following.update(zip(frontier.tolist(), to))
        frontier = np.setdiff1d(np.unique(to), known)
        known = np.union1d(known, frontier)
    nexts = np.searchsorted(known, np.array([following[k] for k in known.tolist()]))
    marks = sum((p.marks[known // s % n] > 0).astype(np.int64) << i
                for i, (p, s, n) in enumerate(zip(parts, scale, sizes)))
    return minimal(Dfa(inverse.reshape(256), nexts, marks))


class Scanner:
    """Finds all matches of all rules in one pass over the bytes of a text."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        if len({r.kind for r in rules}) != len(rules):
            raise ValueError("each rule needs a kind of its own")
        self.kinds = [r.kind for r in rules]
        dfa = combined([searching(r) for r in rules])
        # states without a match come first, so one comparison per byte tells that nothing is to be done
        order = np.argsort(dfa.marks > 0, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        width = dfa.next.shape[1]
        self.states = len(order)
        self.width, self.start = width, int(place[0]) * width
        self.letters = bytes(dfa.classes.astype(np.uint8))
        self.table = array("i", (place[dfa.next[order]] * width).ravel().tolist())
        self.marks = dfa.marks[order].tolist()
        self.quiet = int((dfa.marks == 0).sum()) * width
        self.back = [self._walker(whole(r.pattern, True)) for r in rules]
        self.keep = [self._walker(whole(r.keep)) if r.keep else None for r in rules]

    @staticmethod
    def _walker(dfa: Dfa) -> tuple[bytes, list[list[int]], list[int]]:
        return bytes(dfa.classes.astype(np.uint8)), dfa.next.tolist(), dfa.marks.tolist()

    def _began(self, k: int, data: bytes, end: int, least: int) -> int:
        """The earliest start from `least` of a match of rule k that ends before `end`."""
        letters, following, marks = self.back[k]
        state, began = 0, end
        for at in range(end - 1, least - 1, -1):
            state = following[state][letters[data[at]]]
            if marks[state] == 2:
                break
            if marks[state]:
                began = at
        return began

    def _kept(self, k: int, data: bytes) -> bool:
        if self.keep[k] is None:
            return True
        letters, following, marks = self.keep[k]
        state = 0
        for byte in data:
            state = following[state][letters[byte]]
        return marks[state] == 1

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, number of the rule) of the matches that are kept, in bytes, by start and rule."""
        found: list[tuple[int, int, int]] = []
        table, quiet, state, on = self.table, self.quiet, self.start, 0
        last = [0] * len(self.kinds)  # where the previous match of each rule ended

        def ended(gone: int, end: int) -> None:
            k = 0
            while gone >> k:
                if gone >> k & 1:
                    start = self._began(k, data, end, last[k])
                    last[k] = end
                    if self._kept(k, data[start:end]):
                        found.append((start, end, k))
                k += 1

        for at, letter in enumerate(data.translate(self.letters)):
            state = table[state + letter]
            if state >= quiet or on:
                now = self.marks[state // self.width]
                if on & ~now:
                    ended(on & ~now, at)
                on = now
        if on:
            ended(on, len(data))
        return sorted(found, key=lambda m: (m[0], m[2]))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text") -> DataFrame:
    """All columns of the documents and secrets: an array of (kind, start, end, value) per document.

    Spans are in code points, end exclusive, by start and then by the order of the rules; of each kind
    they are the leftmost longest matches that don't overlap, without those that fail the rule's `keep`.
    Null and empty texts have none; a document's whole text is read; repeated rows get the same answer
    each; an empty table gives no rows; a column of the name `secrets` is replaced.
    """
    ship(docs.sparkSession)
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # its size depends on the rules only
    kind = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"

    @F.pandas_udf(kind)
    def secrets(texts: pd.Series) -> pd.Series:
        machine, out = scanner.value, []
        for raw in texts:
            raw = bytes(raw or b"")
            hits = machine.scan(raw)
            if hits and not raw.isascii():
                begins = np.cumsum(np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80)  # code points up to each byte
                places = [(int(begins[s]) - 1, int(begins[e - 1])) for s, e, _ in hits]
            else:
                places = [(s, e) for s, e, _ in hits]
            out.append([{"kind": machine.kinds[k], "start": a, "end": b, "value": raw[s:e].decode("utf-8", "replace")}
                        for (a, b), (s, e, k) in zip(places, hits)])
        return pd.Series(out)

    return docs.withColumn("secrets", secrets(F.col(f"`{text}`").cast("binary")))


def digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document."""
    rows = scanned(only(docs, id, text).toDF("doc_id", "text"), text="text").select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return rows.select("doc_id", *[number(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                       joined(F.col("secrets")).alias("spans"))
