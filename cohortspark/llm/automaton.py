"""Regular expressions compiled into one deterministic automaton that scans bytes.

Each rule is read into positions (one per byte class of its expression, with first, last and follow
sets). The subset construction runs over all rules at once: a state holds, for every rule, its live
threads as sets of positions ordered by where they began. A thread that began earlier wins a position
it shares; the first match cuts the later threads; when the matching thread ends, the transition says
so ("this rule's match ended before this byte") and the rule starts anew at that byte. This gives
each rule's leftmost-longest, non-overlapping matches in one pass. Equivalent states are merged by
partition refinement, and the result is a transition array over byte classes.

Where a match began is found by running the rule's reversed positions back from its end, to the
longest match that does not reach into the rule's match before.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Positions(NamedTuple):
    masks: list[frozenset[int]]  # the bytes of each position
    first: frozenset[int]
    last: frozenset[int]
    follow: list[frozenset[int]]


def fold_case(pattern: str) -> str:
    """Every plain letter of ``pattern`` (outside classes and escapes) in either case."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            size = 4 if pattern[i + 1] == "x" else 2
            out.append(pattern[i:i + size])
            i += size
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(f"[{c.upper()}{c.lower()}]" if c.isalpha() and not inside else c)
        i += 1
    return "".join(out)


class _Reader:
    """Literals, ``\\xHH`` and escaped bytes, classes with ranges, groups, ``|``, ``? * +`` and ``{m,n}``."""

    def __init__(self, pattern: str):
        self.src, self.at = pattern, 0
        self.masks: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def peek(self) -> str:
        return self.src[self.at] if self.at < len(self.src) else ""

    def take(self) -> str:
        self.at += 1
        return self.src[self.at - 1]

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            if ord(c) > 127:
                raise ValueError(f"only ASCII in {self.src!r}")
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.src[self.at - 2:self.at], 16)
        if c.isalnum():
            raise ValueError(f"escape \\{c} in {self.src!r}")
        return ord(c)

    def leaf(self, mask: frozenset[int]):
        self.masks.append(mask)
        self.follow.append(set())
        p = frozenset([len(self.masks) - 1])
        return False, p, p

    def char_class(self) -> frozenset[int]:
        negated, out = self.peek() == "^", set()
        if negated:
            self.take()
        while self.peek() != "]":
            low = high = self.byte()
            if self.peek() == "-" and self.src[self.at + 1] != "]":
                self.take()
                high = self.byte()
            out.update(range(low, high + 1))
        self.take()
        return frozenset(range(256)) - out if negated else frozenset(out)

    def join(self, a, b):
        for p in a[2]:
            self.follow[p] |= b[1]
        return a[0] and b[0], a[1] | (b[1] if a[0] else frozenset()), b[2] | (a[2] if b[0] else frozenset())

    def either(self):
        node = self.sequence()
        while self.peek() == "|":
            self.take()
            other = self.sequence()
            node = node[0] or other[0], node[1] | other[1], node[2] | other[2]
        return node

    def sequence(self):
        node = True, frozenset(), frozenset()
        while self.peek() not in ("", "|", ")"):
            node = self.join(node, self.repeated())
        return node

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            if self.src[self.at:self.at + 2] == "?:":
                self.at += 2
            node = self.either()
            self.take()
            return node
        if c == "[":
            self.take()
            return self.leaf(self.char_class())
        return self.leaf(frozenset([self.byte()]))

    def loop(self, node):
        for p in node[2]:
            self.follow[p] |= node[1]
        return node

    def repeated(self):
        begin = self.at
        node = self.atom()
        end, c = self.at, self.peek()
        if c in ("?", "*", "+") and c:
            self.take()
            return (node[0] or c != "+", *(node if c == "?" else self.loop(node))[1:])
        if c != "{":
            return node
        close = self.src.index("}", self.at)
        low, _, high = self.src[self.at + 1:close].partition(",")
        least, most = int(low), int(high) if high else None if "," in self.src[self.at:close] else int(low)

        def copy():
            self.at = begin
            return self.atom()

        if least < 1 or self.src[begin:end] == "":
            raise ValueError(f"repeat of {self.src!r}")
        for _ in range(least - 1):
            last = copy()
            node = self.join(node, last)
        if most is None:
            tail = self.loop(last) if least > 1 else self.loop(node)
            node = (node[0], node[1], node[2] | tail[2]) if least > 1 else tail
        else:
            for _ in range(most - least):
                more = copy()
                node = self.join(node, (True, *more[1:]))
        self.at = close + 1
        return node


def positions(pattern: str) -> Positions:
    r = _Reader(pattern)
    nullable, first, last = r.either()
    if r.at != len(pattern):
        raise ValueError(f"unbalanced {pattern!r}")
    if nullable:
        raise ValueError(f"{pattern!r} matches the empty text")
    return Positions(r.masks, first, last, [frozenset(f) for f in r.follow])


class Table(NamedTuple):
    """``step[state, class]``: next state; ``ended[state, class]``: bit r set where rule r's match ended
    before this byte; ``open[state]``: bits of the rules whose match lasts to here; ``classes``: the
    class of each byte. State 0 is the start."""

    step: np.ndarray
    ended: np.ndarray
    open: np.ndarray
    classes: np.ndarray


def byte_classes(rules: list[Positions]) -> tuple[np.ndarray, list[int]]:
    """The class of each byte, and one byte of each class: bytes that every position treats alike."""
    masks = sorted({tuple(sorted(m)) for r in rules for m in r.masks})
    seen: dict[tuple, int] = {}
    sets = [frozenset(m) for m in masks]
    classes = np.array([seen.setdefault(tuple(b in m for m in sets), len(seen)) for b in range(256)], np.uint8)
    return classes, [int(np.flatnonzero(classes == c)[0]) for c in range(len(seen))]


def _advance(rule: Positions, threads: tuple, byte: int) -> tuple[tuple, bool]:
    """The rule's threads after ``byte``, and whether its match ended before it."""
    matched = bool(threads) and bool(threads[0] & rule.last)
    out, taken = [], set()

    def add(reached):
        new = frozenset(p for p in reached if byte in rule.masks[p]) - taken
        if new:
            out.append(new)
            taken.update(new)

    for t in threads:
        add(frozenset().union(*(rule.follow[p] for p in t)))
    ended = matched and not out
    if ended or not matched:
        add(rule.first)
    hits = [k for k, t in enumerate(out) if t & rule.last]
    if hits and hits[0] > 0:
        raise ValueError("a later match would end before an earlier one: the rule needs more than one pass")
    if matched and not ended and not hits:
        raise ValueError("a match must stay one until it ends: the rule needs more than one pass")
    return (tuple(out[:1]) if hits else tuple(out)), ended


class _Threads:
    """One rule's own automaton: its thread lists numbered as they are reached, each step computed once."""

    def __init__(self, rule: Positions, samples: list[int]):
        self.rule, self.samples = rule, samples
        self.number: dict[tuple, int] = {(): 0}
        self.threads: list[tuple] = [()]
        self.rows: dict[int, list[tuple[int, bool]]] = {}

    def row(self, at: int) -> list[tuple[int, bool]]:
        """(next thread list, match ended before) for each byte class."""
        if at not in self.rows:
            out = []
            for b in self.samples:
                new, ended = _advance(self.rule, self.threads[at], b)
                if new not in self.number:
                    self.number[new] = len(self.threads)
                    self.threads.append(new)
                out.append((self.number[new], ended))
            self.rows[at] = out
        return self.rows[at]

    def lasts(self, at: int) -> bool:
        t = self.threads[at]
        return bool(t) and bool(t[0] & self.rule.last)


def compile_rules(patterns: list[str]) -> Table:
    """The combined minimal automaton of ``patterns``."""
    rules = [positions(p) for p in patterns]
    classes, samples = byte_classes(rules)
    own = [_Threads(r, samples) for r in rules]
    start = (0,) * len(rules)
    number, todo, step, ended = {start: 0}, [start], [], []
    for state in todo:  # grows while states are found
        nexts, ends = [], []
        for moved in zip(*(o.row(t) for o, t in zip(own, state))):
            new = tuple(t for t, _ in moved)
            if new not in number:
                number[new] = len(number)
                todo.append(new)
            nexts.append(number[new])
            ends.append(sum(1 << k for k, (_, e) in enumerate(moved) if e))
        step.append(nexts)
        ended.append(ends)
    lasting = np.array([sum(1 << k for k, (o, t) in enumerate(zip(own, s)) if o.lasts(t)) for s in todo], np.int64)
    return minimal(np.array(step, np.int64), np.array(ended, np.int64), lasting, classes)


def minimal(step: np.ndarray, ended: np.ndarray, lasting: np.ndarray, classes: np.ndarray) -> Table:
    """Merge states that no text can tell apart (partition refinement)."""
    _, block = np.unique(np.column_stack([lasting, ended]), axis=0, return_inverse=True)
    block = block.reshape(-1)
    while True:
        _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1, np.int64)  # blocks by their first state, so that the start is 0
    rep = np.unique(block, return_index=True)[1]
    order[block[np.sort(rep)]] = np.arange(len(rep))
    rep = np.sort(rep)
    return Table(order[block[step[rep]]].astype(np.int32), ended[rep], lasting[rep], classes)


class Backwards:
    """The reversed positions of one rule; its states are built as texts need them."""

    def __init__(self, pattern: str):
        self.rule = positions(pattern)
        before: list[set[int]] = [set() for _ in self.rule.masks]
        for p, f in enumerate(self.rule.follow):
            for q in f:
                before[q].add(p)
        self.before = before
        self.known: dict[tuple[frozenset, int], tuple[frozenset, bool]] = {}

    def start(self, data: bytes, end: int, low: int) -> int:
        """The smallest start >= ``low`` of a match of data[start:end]."""
        reach, found, known = frozenset(self.rule.last), -1, self.known
        for at in range(end - 1, low - 1, -1):
            key = reach, data[at]
            if key not in known:
                here = frozenset(p for p in reach if data[at] in self.rule.masks[p])
                known[key] = frozenset(q for p in here for q in self.before[p]), bool(here & self.rule.first)
            reach, begins = known[key]
            if begins:
                found = at
            if not reach:
                break
        return found


class Scanner:
    """All rules' matches of a text in one pass over its bytes."""

    def __init__(self, patterns: list[str], table: Table):
        self.back = [Backwards(p) for p in patterns]
        bytes_step = table.step[:, table.classes].tolist()
        bytes_end = table.ended[:, table.classes].tolist()
        # one row per state, and one more per (state, ended rules) that a transition reports
        rows: dict[tuple[int, int], list] = {}
        for s in range(len(bytes_step)):
            rows[s, 0] = []
        for nexts, ends in zip(bytes_step, bytes_end):
            for key in zip(nexts, ends):
                rows.setdefault(key, [])
        for (s, mask), row in rows.items():
            row.extend(rows[key] for key in zip(bytes_step[s], bytes_end[s]))
            row.append(mask)
            row.append(int(table.open[s]))
        self.begin = rows[0, 0]

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by the end."""
        out, row, low = [], self.begin, [0] * len(self.back)

        def report(mask, end):
            while mask:
                r = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                out.append((r, self.back[r].start(data, end, low[r]), end))
                low[r] = end

        for at, b in enumerate(data):
            row = row[b]
            if row[256]:
                report(row[256], at)
        report(row[257], len(data))
        return out
