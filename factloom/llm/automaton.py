"""Byte automata: rule regexes compiled by subset construction and minimisation.

Rules use a small syntax: literals, ``\\xHH``, classes in brackets, groups with ``|``, and the
repeats ``? * + {n} {n,} {n,m}``. Everything else is a literal byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ByteSet = frozenset[int]


class _Parser:
    """A recursive-descent reader that adds states to a nondeterministic automaton."""

    def __init__(self, fold: bool):
        self.fold = fold
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[ByteSet, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def compile(self, pattern: str) -> tuple[int, int]:
        self.pattern, self.at = pattern, 0
        tree = self._choice()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} in {pattern!r}")
        return self._build(tree)

    def _peek(self) -> str:
        return self.pattern[self.at] if self.at < len(self.pattern) else ""

    def _choice(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            options.append(self._sequence())
        return ("choice", options)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeat())
        return ("sequence", parts)

    def _repeat(self):
        atom = self._atom()
        while (mark := self._peek()) and mark in "?*+{":
            self.at += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(mark, (0, 0))
            if mark == "{":
                end = self.pattern.index("}", self.at)
                low_text, comma, high_text = self.pattern[self.at : end].partition(",")
                self.at = end + 1
                low, high = int(low_text), int(high_text or 0) or (None if comma else int(low_text))
            atom = ("repeat", atom, low, high)
        return atom

    def _byte(self) -> int:
        char = self.pattern[self.at]
        self.at += 1
        if char == "\\":
            escaped = self.pattern[self.at]
            self.at += 1
            if escaped == "x":
                self.at += 2
                return int(self.pattern[self.at - 2 : self.at], 16)
            return ord(escaped)
        return ord(char)

    def _folded(self, found: set[int]) -> tuple[str, ByteSet]:
        if self.fold:
            found |= {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return ("bytes", frozenset(found))

    def _atom(self):
        char = self._peek()
        if char == "(":
            self.at += 1
            inside = self._choice()
            self.at += 1
            return inside
        if char == "[":
            self.at += 1
            inverse = self._peek() == "^"
            self.at += inverse
            found: set[int] = set()
            while self._peek() != "]":
                low = self._byte()
                if self._peek() == "-" and self.pattern[self.at + 1] != "]":
                    self.at += 1
                    found |= set(range(low, self._byte() + 1))
                else:
                    found.add(low)
            self.at += 1
            return self._folded(set(range(256)) - found if inverse else found)
        return self._folded({self._byte()})

    def _build(self, tree) -> tuple[int, int]:
        kind = tree[0]
        if kind == "bytes":
            start, end = self.state(), self.state()
            self.moves[start].append((tree[1], end))
            return start, end
        if kind == "choice":
            start, end = self.state(), self.state()
            for option in tree[1]:
                first, last = self._build(option)
                self.empty[start].append(first)
                self.empty[last].append(end)
            return start, end
        if kind == "sequence":
            start = end = self.state()
            for part in tree[1]:
                first, last = self._build(part)
                self.empty[end].append(first)
                end = last
            return start, end
        _, part, low, high = tree
        start = end = self.state()
        for _ in range(low):
            first, last = self._build(part)
            self.empty[end].append(first)
            end = last
        if high is None:
            first, last = self._build(part)
            self.empty[end].append(first)
            self.empty[last].append(first)
            out = self.state()
            self.empty[end].append(out)
            self.empty[last].append(out)
            return start, out
        out = self.state()
        self.empty[end].append(out)
        for _ in range(high - low):
            first, last = self._build(part)
            self.empty[end].append(first)
            self.empty[last].append(out)
            end = last
        return start, out


@dataclass(frozen=True)
class Automaton:
    """``step[state * 256 + byte]`` is the next state; ``accepts[state]`` has a bit per rule."""

    step: np.ndarray
    accepts: np.ndarray
    start: int
    dead: int


def compile_rules(patterns: list[tuple[str, bool]], search: bool) -> Automaton:
    """One minimal automaton for (pattern, fold case) rules.

    ``search`` puts any bytes before the match, so a single pass from the start of a text meets the
    end of every match; without it the automaton follows one match from its first byte and ends in
    the dead state, from which nothing is accepted.
    """
    parser = _Parser(False)
    ends, firsts = {}, []
    for rule, (pattern, fold) in enumerate(patterns):
        parser.fold = fold
        first, last = parser.compile(pattern)
        firsts.append(first)
        ends[last] = 1 << rule

    def closure(states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for more in parser.empty[todo.pop()]:
                if more not in found:
                    found.add(more)
                    todo.append(more)
        return frozenset(found)

    initial = closure(set(firsts))
    known: dict[frozenset[int], int] = {initial: 0}
    if not search:
        known[frozenset()] = 1
    order, rows = list(known), []
    for subset in order:
        targets: list[set[int]] = [set(initial) if search else set() for _ in range(256)]
        for s in subset:
            for allowed, target in parser.moves[s]:
                for b in allowed:
                    targets[b].add(target)
        row, seen = np.empty(256, np.int64), {}
        for b, target in enumerate(targets):
            plain = frozenset(target)
            if plain not in seen:
                closed = closure(target)
                if closed not in known:
                    known[closed] = len(order)
                    order.append(closed)
                seen[plain] = known[closed]
            row[b] = seen[plain]
        rows.append(row)
    accepts = np.array([sum({ends[s] for s in subset if s in ends}) for subset in order], np.int64)
    return _minimised(np.array(rows), accepts, search)


def _minimised(rows: np.ndarray, accepts: np.ndarray, search: bool) -> Automaton:
    """Moore's partition refinement: states stay together while all their moves do."""
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[rows]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    _, first = np.unique(group, return_index=True)
    return Automaton(
        group[rows[first]].astype(np.int32).ravel(), accepts[first], int(group[0]), -1 if search else int(group[1])
    )


def reset_bytes(automaton: Automaton) -> np.ndarray:
    """Whether a byte leads to the start state from every state: scans may begin anew after it."""
    return (automaton.step.reshape(-1, 256) == automaton.start).all(axis=0)


def hits(automaton: Automaton, data: np.ndarray, resets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of ``data`` between reset bytes that hold a match.

    The stretches advance side by side, one byte at a time, so every byte is looked up once.
    """
    cuts = np.flatnonzero(resets[data])
    starts = np.concatenate([[0], cuts + 1])
    ends = np.concatenate([cuts, [len(data)]])
    long_enough = ends > starts
    starts, ends = starts[long_enough], ends[long_enough]
    order = np.argsort(starts - ends, kind="stable")  # longest first, so those still running are a prefix
    begin, size = starts[order], (ends - starts)[order]
    state = np.full(len(begin), automaton.start, np.int32)
    found = np.zeros(len(begin), bool)
    accepting = automaton.accepts != 0
    running = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for offset, n in enumerate(running):
        state[:n] = automaton.step[state[:n] * 256 + data[begin[:n] + offset]]
        found[:n] |= accepting[state[:n]]
    return begin[found], begin[found] + size[found]
