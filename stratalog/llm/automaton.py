"""Regular expressions to one minimal transition table.

A small expression language (literals, classes, groups, ``|``, ``? * +``, ``{m}`` ``{m,}``) is
parsed to an NFA.  For each rule the subset construction builds a machine that finds its leftmost,
longest, non-overlapping matches in one pass: a state lists the live starts, earliest first, as sets
of NFA states; once the earliest start matches, later ones go.  The machines run side by side as one
product, which is minimised by partition refinement.  Rules whose matches cannot be decided without
looking back (a match that goes on without matching, or a later start that matches first) are refused.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

EVERY = frozenset(range(256))


class Nfa:
    def __init__(self) -> None:
        self.arcs: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def move(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({t for s in states for members, t in self.arcs[s] if byte in members})


class Parser:
    """Recursive descent; a node is ("set", bytes), ("cat", nodes), ("alt", nodes) or ("rep", node, least, most or None)."""

    def __init__(self, pattern: str) -> None:
        self.s, self.i = pattern, 0

    def parse(self) -> tuple:
        node = self.alternatives()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i}")
        return node

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def alternatives(self) -> tuple:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self) -> tuple:
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                body, self.i = self.s[self.i : self.s.index("}", self.i)], self.s.index("}", self.i) + 1
                low, comma, high = body.partition(",")
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self) -> tuple:
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            node = self.alternatives()
            if self.peek() != ")":
                raise ValueError("missing )")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.members())
        return ("set", frozenset([self.code()]))

    def code(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def members(self) -> frozenset[int]:
        self.i += 1
        negated = self.peek() == "^"
        self.i += negated
        out: set[int] = set()
        while self.peek() != "]":
            low = high = self.code()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                high = self.code()
            out |= set(range(low, high + 1))
        self.i += 1
        return EVERY - out if negated else frozenset(out)


def any_case(word: str) -> str:
    """word as classes that take ASCII letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def build(node: tuple, nfa: Nfa, backwards: bool = False) -> tuple[int, int]:
    kind = node[0]
    start = nfa.state()
    if kind == "set":
        end = nfa.state()
        nfa.arcs[start].append((node[1], end))
        return start, end
    if kind == "cat":
        at = start
        for part in reversed(node[1]) if backwards else node[1]:
            a, b = build(part, nfa, backwards)
            nfa.free[at].append(a)
            at = b
        return start, at
    if kind == "alt":
        end = nfa.state()
        for part in node[1]:
            a, b = build(part, nfa, backwards)
            nfa.free[start].append(a)
            nfa.free[b].append(end)
        return start, end
    _, inner, least, most = node
    at = start
    for _ in range(least):
        a, b = build(inner, nfa, backwards)
        nfa.free[at].append(a)
        at = b
    if most is None:
        a, b = build(inner, nfa, backwards)
        nfa.free[at].append(a)
        nfa.free[b].append(at)
        return start, at
    end = nfa.state()
    nfa.free[at].append(end)
    for _ in range(most - least):
        a, b = build(inner, nfa, backwards)
        nfa.free[at].append(a)
        nfa.free[b].append(end)
        at = b
    return start, end


def byte_classes(sets: list[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """The class of each byte (bytes that no set tells apart share one), and a byte of each class."""
    known: dict[tuple[bool, ...], int] = {}
    table, sample = np.zeros(256, dtype=np.uint8), []
    for b in range(256):
        key = tuple(b in s for s in sets)
        if key not in known:
            known[key] = len(known)
            sample.append(b)
        table[b] = known[key]
    return table, sample


class Finder:
    """One rule's machine.  A state: (live starts as sets of NFA states, whether a match has just ended)."""

    def __init__(self, pattern: str) -> None:
        node = Parser(pattern).parse()
        self.nfa = Nfa()
        first, self.end = build(node, self.nfa)
        self.first = self.nfa.closure({first})
        if self.end in self.first:
            raise ValueError(f"{pattern!r} matches nothing at all")
        self.initial: tuple = ((), False)
        self.sets = list({members for arcs in self.nfa.arcs for members, _ in arcs})
        self.back = Backwards(node)

    def matching(self, state: tuple) -> bool:
        return bool(state[0]) and self.end in state[0][0]

    def step(self, state: tuple, byte: int) -> tuple:
        groups, ended = state[0], False
        if self.matching(state):
            longer = self.nfa.move(groups[0], byte)
            if longer:
                if self.end not in longer:
                    raise ValueError("a match that goes on without matching")
                return (longer,), False
            groups, ended = (), True
        out: list[frozenset[int]] = []
        seen: set[int] = set()
        for group in (*groups, self.first):
            moved = self.nfa.move(group, byte) - seen
            if not moved:
                continue
            seen |= moved
            out.append(moved)
            if self.end in moved:
                if len(out) > 1:
                    raise ValueError("a later start matches first")
                break
        return tuple(out), ended


class Backwards:
    """Finds the start of a match from its end: the farthest place back from which the rule matches up to the end."""

    def __init__(self, node: tuple) -> None:
        nfa = Nfa()
        first, end = build(node, nfa, backwards=True)
        table, sample = byte_classes(list({members for arcs in nfa.arcs for members, _ in arcs}))
        states = {nfa.closure({first}): 0}
        todo, rows = list(states), []
        for s in todo:
            row = []
            for b in sample:
                t = nfa.move(s, b)
                if t not in states:
                    states[t] = len(states)
                    todo.append(t)
                row.append(states[t] if t else -1)
            rows.append(row)
        self.rows = [[row[c] for c in table] for row in rows]
        self.accepts = [end in s for s in states]

    def start(self, data: bytes, end: int, floor: int) -> int:
        found, s = end, 0
        for i in range(end - 1, floor - 1, -1):
            s = self.rows[s][data[i]]
            if s < 0:
                break
            if self.accepts[s]:
                found = i
        return found


class Machine(NamedTuple):
    """rows[s][b]: the next state.  States from first_ending on: a match of ending[s]'s rules ended before the byte.  final[s]: rules whose match ends with the text."""

    names: list[str]
    rows: list[list[int]]
    initial: int
    first_ending: int
    ending: dict[int, tuple[int, ...]]
    final: list[tuple[int, ...]]
    back: list[Backwards]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of all matches in bytes, by end."""
        rows, s, border = self.rows, self.initial, self.first_ending
        ends = []
        for i, b in enumerate(data):
            s = rows[s][b]
            if s >= border:
                ends.append((i, s))
        found = [(k, i) for i, t in ends for k in self.ending[t]] + [(k, len(data)) for k in self.final[s]]
        last, out = [0] * len(self.names), []
        for k, end in found:
            out.append((k, self.back[k].start(data, end, last[k]), end))
            last[k] = end
        return out


def compile_rules(rules: dict[str, str]) -> Machine:
    """All rules in one table: product of their finders, minimised, the states that report matches last."""
    finders = [Finder(p) for p in rules.values()]
    table, sample = byte_classes([s for f in finders for s in f.sets])
    numbers: list[dict[tuple, int]] = [{f.initial: 0} for f in finders]
    orders = [[f.initial] for f in finders]
    memo: list[dict[tuple[int, int], int]] = [{} for _ in finders]

    def step(k: int, s: int, c: int) -> int:
        if (t := memo[k].get((s, c))) is None:
            to = finders[k].step(orders[k][s], sample[c])
            t = numbers[k].setdefault(to, len(orders[k]))
            if t == len(orders[k]):
                orders[k].append(to)
            memo[k][s, c] = t
        return t

    states, todo, moves = {(0,) * len(finders): 0}, [(0,) * len(finders)], []
    for state in todo:
        row = []
        for c in range(len(sample)):
            to = tuple(step(k, s, c) for k, s in enumerate(state))
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
        moves.append(row)
    ending = [tuple(k for k, s in enumerate(state) if orders[k][s][1]) for state in todo]
    final = [tuple(k for k, s in enumerate(state) if finders[k].matching(orders[k][s])) for state in todo]
    block = minimal(np.array(moves), [hash_key(e, f) for e, f in zip(ending, final, strict=True)])
    count = int(block.max()) + 1
    head = np.zeros(count, dtype=np.int64)
    head[block[::-1]] = np.arange(len(block))[::-1]
    order = np.argsort([bool(ending[h]) for h in head], kind="stable")
    place = np.empty(count, dtype=np.int64)
    place[order] = np.arange(count)
    rows = place[block[np.array(moves)[head[order]]]][:, table]
    quiet = int(sum(not ending[h] for h in head))
    return Machine(
        list(rules),
        rows.tolist(),
        int(place[block[0]]),
        quiet,
        {i: ending[head[b]] for i, b in enumerate(order) if i >= quiet},
        [final[head[b]] for b in order],
        [f.back for f in finders],
    )


def hash_key(*parts: tuple[int, ...]) -> str:
    return repr(parts)


def minimal(moves: np.ndarray, labels: list[str]) -> np.ndarray:
    """The coarsest partition of states with one label that all bytes keep (Moore's refinement)."""
    _, block = np.unique(np.array(labels), return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            return finer
        block = finer
