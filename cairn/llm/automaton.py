"""Regular expressions over bytes compiled to minimal deterministic automata.

The expressions have literals, ``.``-free classes ``[...]``, escapes (``\\.``, ``\\xNN``),
groups, ``|`` and the repeats ``? * + {m} {m,} {m,n}``.  Parsing gives a small tree, the tree
(or its mirror image) a non-deterministic automaton, subset construction a deterministic one
whose states carry a bit mask of the rules they accept, and partition refinement the
smallest equivalent one.  Transitions are one array: ``table[state, class of byte]``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A byte that UTF-8 never uses: it parts documents and resets every automaton.
BREAK = 0xFF


class _Parser:
    def __init__(self, text: str, fold: bool):
        self.s, self.at, self.fold = text, 0, fold

    def parse(self):
        tree = self.either()
        if self.at != len(self.s):
            raise ValueError(f"unexpected {self.s[self.at]!r} in {self.s!r}")
        return tree

    def either(self):
        parts = [self.sequence()]
        while self.at < len(self.s) and self.s[self.at] == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.at < len(self.s) and self.s[self.at] not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("seq", parts)

    def repeated(self, tree):
        while self.at < len(self.s) and self.s[self.at] in "?*+{":
            c = self.s[self.at]
            self.at += 1
            if c == "{":
                end = self.s.index("}", self.at)
                low, comma, high = self.s[self.at : end].partition(",")
                self.at = end + 1
                least, most = int(low), (None if comma and not high else int(high or low))
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tail = [("star", tree)] if most is None else [("or", [tree, ("seq", [])])] * (most - least)
            tree = ("seq", [tree] * least + tail)
        return tree

    def char(self) -> int:
        c = self.s[self.at]
        self.at += 1
        if c == "\\":
            c = self.s[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.s[self.at - 2 : self.at], 16)
            c = {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)
        return ord(c)

    def atom(self):
        c = self.s[self.at]
        if c == "(":
            self.at += 3 if self.s.startswith("(?:", self.at) else 1
            tree = self.either()
            if self.s[self.at : self.at + 1] != ")":
                raise ValueError(f"missing ) in {self.s!r}")
            self.at += 1
            return tree
        if c == "[":
            self.at += 1
            chars: set[int] = set()
            while self.s[self.at] != "]":
                low = high = self.char()
                if self.s[self.at] == "-" and self.s[self.at + 1] != "]":
                    self.at += 1
                    high = self.char()
                chars |= set(range(low, high + 1))
            self.at += 1
            return self.set(chars)
        return self.set({self.char()})

    def set(self, chars: set[int]):
        if self.fold:
            chars = {ord(x) for c in chars for x in (chr(c).lower(), chr(c).upper())}
        if max(chars, default=0) >= 0x80:
            raise ValueError("rules are over ASCII")
        return ("set", frozenset(chars))


def parse(pattern: str, fold: bool = False):
    return _Parser(pattern, fold).parse()


def mirrored(tree):
    """The tree of the reversed words."""
    kind, arg = tree
    if kind == "seq":
        return (kind, [mirrored(x) for x in reversed(arg)])
    if kind == "or":
        return (kind, [mirrored(x) for x in arg])
    return (kind, mirrored(arg)) if kind == "star" else tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """The end state of the tree's part from start."""
        kind, arg = tree
        if kind == "seq":
            for x in arg:
                start = self.add(x, start)
            return start
        end = self.state()
        if kind == "set":
            mid = self.state()
            self.empty[start].append(mid)
            self.moves[mid] = (arg, end)
        elif kind == "or":
            for x in arg:
                self.empty[self.add(x, start)].append(end)
        else:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(arg, loop)].append(loop)
            self.empty[loop].append(end)
        return end


@dataclass
class Dfa:
    classes: np.ndarray  # byte -> class
    table: np.ndarray  # [state, class] -> state
    accept: np.ndarray  # state -> bit mask of rules
    start: int
    dead: int  # -1 if there is none


def _classes(trees) -> tuple[np.ndarray, list[int]]:
    sets: list[frozenset[int]] = []

    def walk(t):
        kind, arg = t
        if kind == "set":
            sets.append(arg)
        elif kind == "star":
            walk(arg)
        else:
            for x in arg:
                walk(x)

    for t in trees:
        walk(t)
    sets = list(dict.fromkeys(sets))
    sign = [(b == BREAK, *(b in s for s in sets)) for b in range(256)]
    number = {s: i for i, s in enumerate(dict.fromkeys(sign))}
    first = {}
    for b, s in enumerate(sign):
        first.setdefault(number[s], b)
    return np.array([number[s] for s in sign], np.uint8), [first[i] for i in range(len(number))]


def compile_rules(trees: list, search: bool) -> Dfa:
    """One minimal automaton for all rules; with ``search`` a match may start anywhere."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for i, t in enumerate(trees):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        ends[nfa.add(t, begin)] = 1 << i

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.moves[x] is not None or x in ends)

    classes, samples = _classes(trees)
    start = closure([root])
    number, todo, table, accept = {start: 0}, [start], [], []
    closed: dict[int, frozenset[int]] = {}
    while todo:
        here = todo.pop(0)
        mask = 0
        for x in here:
            mask |= ends.get(x, 0)
        accept.append(mask)
        row = []
        for b in samples:
            if b == BREAK:
                to = start
            else:
                out = set(start) if search else set()
                for x in here:
                    if nfa.moves[x] is not None and b in nfa.moves[x][0]:
                        goal = nfa.moves[x][1]
                        if goal not in closed:
                            closed[goal] = closure([goal])
                        out |= closed[goal]
                to = frozenset(out)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    return _minimal(classes, np.array(table), np.array(accept, np.int64))


def _minimal(classes: np.ndarray, table: np.ndarray, accept: np.ndarray) -> Dfa:
    """Split groups of states until equal groups have equal successors."""
    _, group = np.unique(accept, return_inverse=True)
    while True:
        _, new = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == group.max():
            break
        group = new
    first = np.unique(group, return_index=True)[1]
    small = group[table[first]].astype(np.int32)
    mask = accept[first]
    dead = [s for s in range(len(small)) if not mask[s] and (np.delete(small[s], classes[BREAK]) == s).all()]
    return Dfa(classes, small, mask, int(group[0]), dead[0] if dead and dead[0] != group[0] else -1)


CHUNK = 512
WARM = 32


def run_backward(dfa: Dfa, data: np.ndarray) -> np.ndarray:
    """The state after each byte when the bytes are read from the last to the first.

    The bytes are cut into chunks which are read side by side.  Each chunk's entry state is
    guessed by reading the bytes just after it, checked against the exit state of the next
    chunk, and chunks with a wrong guess are read again until none is left: the result is
    that of one sequential pass.
    """
    n = len(data)
    lanes = -(-n // CHUNK) or 1
    width = dfa.table.shape[1]
    flat = (dfa.table.astype(np.int32) * width).ravel()
    cls = np.full(lanes * CHUNK, dfa.classes[BREAK], np.uint8)
    cls[:n] = dfa.classes[data]
    grid = np.ascontiguousarray(cls.reshape(lanes, CHUNK).T)
    states = np.empty((CHUNK, lanes), np.int32)
    entry = np.full(lanes, dfa.start * width, np.int32)
    for i in range(WARM - 1, -1, -1):
        entry[:-1] = flat[entry[:-1] + grid[i, 1:]]
    s = entry
    for i in range(CHUNK - 1, -1, -1):
        s = flat[s + grid[i]]
        states[i] = s
    todo = np.flatnonzero(entry[:-1] != states[0, 1:])
    while len(todo):
        s = entry[todo] = states[0, todo + 1]
        for i in range(CHUNK - 1, -1, -1):
            s = flat[s + grid[i, todo]]
            states[i, todo] = s
        before = todo[todo > 0] - 1
        todo = before[entry[before] != states[0, before + 1]]
    return np.ascontiguousarray(states.T).ravel()[:n] // width


def longest(dfa: Dfa, data: bytes, start: int) -> int:
    """The end of the longest match from start (-1: none)."""
    table, classes, accept = _lists(dfa)
    s, end = dfa.start, -1
    for i in range(start, len(data)):
        s = table[s][classes[data[i]]]
        if s == dfa.dead or data[i] == BREAK:
            break
        if accept[s]:
            end = i + 1
    return end


def _lists(dfa: Dfa):
    if not hasattr(dfa, "_as_lists"):
        dfa._as_lists = (dfa.table.tolist(), dfa.classes.tolist(), dfa.accept.tolist())
    return dfa._as_lists
