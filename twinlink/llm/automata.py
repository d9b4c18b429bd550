"""Deterministic automata of byte regexes: Thompson construction, subset construction, minimisation.

Regexes are ASCII: literals, ``\\xHH``, escapes, classes, groups, ``|`` and the repeats
``? * + {m} {m,} {m,n}``; ``(?i:...)`` ignores the case of A-Z.  An automaton is one
array ``next[state, class of byte]`` with an accept bit set per state; state 0 is dead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """Regex text to a tree of ('set', bytes) / ('cat', list) / ('alt', list) / ('rep', node, m, n)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.peek(s):
            self.at += len(s)
            return True
        return False

    def alternatives(self, fold: bool):
        out = [self.sequence(fold)]
        while self.take("|"):
            out.append(self.sequence(fold))
        return ("alt", out)

    def sequence(self, fold: bool):
        out = []
        while self.at < len(self.text) and not self.peek("|") and not self.peek(")"):
            out.append(self.repeated(self.atom(fold)))
        return ("cat", out)

    def repeated(self, node):
        while self.at < len(self.text):
            if self.take("?"):
                node = ("rep", node, 0, 1)
            elif self.take("*"):
                node = ("rep", node, 0, None)
            elif self.take("+"):
                node = ("rep", node, 1, None)
            elif self.take("{"):
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at:end].partition(",")
                self.at = end + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                break
        return node

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2:self.at], 16)
        return ord(c)

    def atom(self, fold: bool):
        if self.take("(?i:"):
            node = self.alternatives(True)
        elif self.take("("):
            node = self.alternatives(fold)
        elif self.take("["):
            invert, members = self.take("^"), set()
            while not self.peek("]"):
                low = self.char()
                high = low
                if self.peek("-") and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self.char()
                members.update(range(low, high + 1))
            self.at += 1
            return ("set", frozenset(set(range(256)) - members if invert else members))
        else:
            c = self.char()
            return ("set", frozenset({ord(x) for x in (chr(c).lower(), chr(c).upper())} if fold else {c}))
        if not self.take(")"):
            raise ValueError(f"unclosed group in {self.text!r}")
        return node


class _Nfa:
    def __init__(self, backward: bool):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []
        self.backward = backward

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Adds ``node`` from ``start``; the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
        elif kind == "cat":
            end = start
            for part in node[1][::-1] if self.backward else node[1]:
                end = self.add(part, end)
        elif kind == "alt":
            end = self.state()
            for part in node[1]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(part, own)].append(end)
        else:
            _, part, low, high = node
            end = start
            for _ in range(low):
                end = self.add(part, end)
            if high is None:
                loop = self.state()
                self.empty[end].append(loop)
                self.empty[self.add(part, loop)].append(loop)
                end = loop
            else:
                ends = [end]
                for _ in range(high - low):
                    ends.append(self.add(part, ends[-1]))
                end = self.state()
                for e in ends:
                    self.empty[e].append(end)
        return end

    def closure(self, states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)


@dataclass
class Dfa:
    """``next``: (states, classes) array; ``classes``: class of each byte; ``accepts``: rule bits of each state."""
    next: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray
    start: int

    def synchronising(self) -> np.ndarray:
        """Flag per byte: from all states that are ever left it leads to the same state as from the start."""
        open_states = (self.next != np.arange(len(self.next))[:, None]).any(axis=1)
        same = (self.next[open_states] == self.next[self.start]).all(axis=0) & (self.next[self.start] == self.start)
        return same[self.classes]

    def shortest(self) -> int:
        """Bytes that the shortest accepted string has."""
        seen, n = {self.start}, 0
        while not any(self.accepts[s] for s in seen):
            seen, n = {int(t) for s in seen for t in self.next[s]}, n + 1
        return n


def compile_rules(rules: list[str], backward: bool = False) -> Dfa:
    """One automaton for all rules; accept bit k belongs to rule k.

    With ``backward`` it reads a text from its end, and after a byte its state holds the bits of all
    rules of which a match starts at that byte."""
    nfa = _Nfa(backward)
    start = nfa.state()
    finals = {}
    for k, rule in enumerate(rules):
        parser = _Parser(rule)
        own = nfa.state()
        nfa.empty[start].append(own)
        finals[nfa.add(parser.alternatives(False), own)] = k
        if parser.at < len(rule):
            raise ValueError(f"cannot read {rule!r} from {parser.at}")
    if backward:
        nfa.moves[start].append((frozenset(range(256)), start))
    kinds: dict[tuple, int] = {}
    sets = [s for own in nfa.moves for s, _ in own]
    distinct = list(dict.fromkeys(sets))
    classes = np.array([kinds.setdefault(tuple(b in s for s in distinct), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]

    def bits(states) -> int:
        return sum({1 << finals[s] for s in states if s in finals})

    first = nfa.closure([start])
    number, todo, rows, accepts = {frozenset(): 0, first: 1}, [first], {0: [0] * len(sample)}, {0: 0, 1: bits(first)}
    while todo:
        states = todo.pop()
        k = number[states]
        row = []
        for b in sample:
            to = nfa.closure({t for s in states for own, t in nfa.moves[s] if b in own})
            if to not in number:
                number[to] = len(number)
                accepts[number[to]] = bits(to)
                todo.append(to)
            row.append(number[to])
        rows[k] = row
    table = np.array([rows[k] for k in range(len(number))], dtype=np.int64)
    return _minimal(table, classes, np.array([accepts[k] for k in range(len(number))], dtype=np.int64))


def _minimal(table, classes, accepts) -> Dfa:
    """States with the same future put together: blocks are split until their moves agree."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        rows = np.column_stack([block, block[table]])
        finer = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # the dead state first, then by first appearance
    order = list(dict.fromkeys(block.tolist()))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    block = place[block]
    first = np.array([np.flatnonzero(block == b)[0] for b in range(len(order))])
    return Dfa(block[table[first]].astype(np.int32), classes, accepts[first], int(block[1]))


def longest(dfa: Dfa):
    """Function ``(bytes, start, end) -> end`` of the longest match from ``start`` on, or -1."""
    moves = (dfa.next[:, dfa.classes]).astype(np.int64).tolist()
    accepts = (dfa.accepts > 0).tolist()

    def match(raw: bytes, at: int, end: int) -> int:
        state, found = dfa.start, -1
        while at < end:
            state = moves[state][raw[at]]
            if not state:
                break
            at += 1
            if accepts[state]:
                found = at
        return found
    return match
