"""Rule regexes to one minimal deterministic automaton.

A small regex dialect (literals, classes, ``|``, groups, ``? * + {m,} {m,n}``)
is parsed into a tree, turned into an epsilon automaton over bytes, made
deterministic by subset construction and minimised by partition refinement.
Tables are flat arrays: ``table[state + byte]`` with states in steps of 256,
accepting states last.

A combined automaton of several rules also has a reset letter a rule: the state
in which all that the rule has read is forgotten and the other rules' progress
stays. After a match, the reset makes the next one begin where it ended.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "0": "\0"}


class _Parser:
    """Recursive descent over the pattern; trees are nested tuples."""

    def __init__(self, pattern: str) -> None:
        self.s, self.i = pattern, 0

    def parse(self) -> tuple:
        tree = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return tree

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        c = self.peek()
        self.i += 1
        return c

    def alternatives(self) -> tuple:
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("or", *found)

    def sequence(self) -> tuple:
        found = []
        while self.peek() not in ("", "|", ")"):
            found.append(self.repeated())
        return ("then", *found)

    def repeated(self) -> tuple:
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                body = self.s[self.i : self.s.index("}", self.i)]
                self.i += len(body) + 1
                a, comma, b = body.partition(",")
                low, high = int(a), int(b) if b else (None if comma else int(a))
            tree = ("times", tree, low, high)
        return tree

    def escaped(self) -> str:
        c = self.take()
        if c == "x":
            self.i += 2
            return chr(int(self.s[self.i - 2 : self.i], 16))
        return _ESCAPES.get(c, c)

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"missing ) in {self.s!r}")
            return tree
        if c == "[":
            return self.char_class()
        if c == "\\":
            c = self.escaped()
        return ("bytes", frozenset([ord(c)]))

    def char_class(self) -> tuple:
        negated = self.peek() == "^"
        self.i += negated
        chosen: set[int] = set()
        while (c := self.take()) != "]":
            low = ord(self.escaped() if c == "\\" else c)
            high = low
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] != "]":
                self.take()
                c = self.take()
                high = ord(self.escaped() if c == "\\" else c)
            chosen |= set(range(low, high + 1))
        return ("bytes", frozenset(range(256)) - chosen if negated else frozenset(chosen))


def reverse(tree: tuple) -> tuple:
    """The tree of the mirrored language."""
    if tree[0] == "bytes":
        return tree
    if tree[0] == "times":
        return ("times", reverse(tree[1]), *tree[2:])
    parts = [reverse(t) for t in tree[1:]]
    return (tree[0], *(parts[::-1] if tree[0] == "then" else parts))


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def node(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def build(self, tree: tuple, start: int) -> int:
        """Add the tree behind ``start``; the node where it ends."""
        kind = tree[0]
        if kind == "bytes":
            end = self.node()
            mid = self.node()
            self.free[start].append(mid)
            self.step[mid] = (tree[1], end)
            return end
        if kind == "then":
            for t in tree[1:]:
                start = self.build(t, start)
            return start
        end = self.node()
        if kind == "or":
            for t in tree[1:]:
                self.free[self.build(t, start)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop = self.node()
            self.free[start].append(loop)
            self.free[self.build(inner, loop)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[start].append(end)
            for _ in range(high - low):
                start = self.build(inner, start)
                self.free[start].append(end)
        return end

    def closure(self, nodes: set[int]) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(n for n in seen if self.step[n] is not None or not self.free[n])


@dataclass
class Dfa:
    """table: flat transitions in steps of 256; states at or over ``first`` accept
    the rules in ``accepts[state]``; ``start`` is where a scan begins; ``dead`` is
    the state without return, or -1; ``resets[rule][state // 256]`` is the state
    that forgets a rule which ``state`` accepts."""

    table: list[int]
    start: int
    first: int
    accepts: dict[int, tuple[int, ...]]
    dead: int
    resets: list[list[int]]


def _minimise(trans: np.ndarray, marks: list[tuple[int, ...]]) -> np.ndarray:
    """The class of each state: refined until no byte tells two of a class apart."""
    names = {m: i for i, m in enumerate(sorted(set(marks)))}
    group = np.array([names[m] for m in marks])
    count = len(names)
    while True:
        keys = np.column_stack([group, group[trans]])
        _, group = np.unique(keys, axis=0, return_inverse=True)
        group = group.ravel()
        if (now := int(group.max()) + 1) == count:
            return group
        count = now


def compile_rules(patterns: list[str], anchored: bool = False, mirrored: bool = False, resets: bool = False) -> Dfa:
    """One automaton of all patterns, with reset letters if asked for.

    Not anchored, it finds matches that begin anywhere: after each byte, an
    accepting state names the rules of which some match ends there.
    """
    nfa = _Nfa()
    root = nfa.node()
    ends: dict[int, int] = {}
    own: list[tuple[int, int, frozenset]] = []
    for k, p in enumerate(patterns):
        tree = _Parser(p).parse()
        first = nfa.node()
        nfa.free[root].append(first)
        end = nfa.build(reverse(tree) if mirrored else tree, first)
        last = nfa.node()
        nfa.free[end].append(last)
        ends[last] = k
        own.append((first, last, nfa.closure({first})))
    # Bytes that no class tells apart share a column.
    signature = [tuple(i for i, s in enumerate(nfa.step) if s and b in s[0]) for b in range(256)]
    columns = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    column_of = [columns[s] for s in signature]
    movers = [set(s) for s in columns]
    begin = nfa.closure({root})
    states, todo, rows = {begin: 0}, [begin], []
    for now in todo:
        row = []
        for movable in movers:
            there = {nfa.step[n][1] for n in now if n in movable}
            reached = nfa.closure(there | ({root} if not anchored else set()))
            if reached not in states:
                states[reached] = len(states)
                todo.append(reached)
            row.append(states[reached])
        for first, last, fresh in own if resets else ():
            # Only where the rule accepts can a match of it have ended.
            reached = frozenset(n for n in now if not first <= n <= last) | fresh if last in now else now
            if reached not in states:
                states[reached] = len(states)
                todo.append(reached)
            row.append(states[reached])
        rows.append(row)
    marks = [tuple(sorted(ends[n] for n in s if n in ends)) for s in states]
    trans = np.array(rows)
    group = _minimise(trans, marks)
    count = int(group.max()) + 1
    pick = np.zeros(count, int)
    pick[group] = np.arange(len(group))
    order = sorted(range(count), key=lambda g: (bool(marks[pick[g]]), g))
    place = {g: i for i, g in enumerate(order)}
    table = [0] * (count * 256)
    for g in order:
        row = trans[pick[g]]
        for b in range(256):
            table[place[g] * 256 + b] = place[group[row[column_of[b]]]] * 256
    accepts = {place[g] * 256: marks[pick[g]] for g in order if marks[pick[g]]}
    dead = [s for s in range(0, count * 256, 256) if s not in accepts and all(table[s + b] == s for b in range(256))]
    forget = [[0] * count for _ in (own if resets else ())]
    for k, at in enumerate(forget):
        for g in order:
            at[place[g]] = place[group[trans[pick[g]][len(movers) + k]]] * 256
    return Dfa(table, place[group[0]] * 256, (count - len(accepts)) * 256, accepts, dead[0] if dead and anchored else -1, forget)


def longest(dfa: Dfa, data: bytes, at: int) -> int:
    """End of the longest match of an anchored automaton at a place, or -1."""
    table, state, first, dead, end = dfa.table, dfa.start, dfa.first, dfa.dead, -1
    for i in range(at, len(data)):
        state = table[state + data[i]]
        if state >= first:
            end = i + 1
        elif state == dead:
            break
    return end


def earliest(mirrored: Dfa, data: bytes, end: int, floor: int) -> int:
    """Smallest start at or over ``floor`` of a match that ends at ``end``, or -1."""
    table, state, first, dead, start = mirrored.table, mirrored.start, mirrored.first, mirrored.dead, -1
    for i in range(end - 1, floor - 1, -1):
        state = table[state + data[i]]
        if state >= first:
            start = i
        elif state == dead:
            break
    return start


def self_check(patterns: list[str], samples: list[bytes]) -> bool:
    """Anchored automata agree with the re module on the samples' longest matches."""
    for p in patterns:
        dfa, plain = compile_rules([p], anchored=True), re.compile(p.encode("latin-1"))
        for s in samples:
            m = plain.match(s)
            if longest(dfa, s, 0) != (m.end() if m and m.end() else -1):
                return False
    return True
