"""Regular expressions over bytes to one minimal deterministic automaton in a flat transition array.

Syntax: literals, escapes (`\\xHH`, `\\.`), classes with ranges, groups `( )` and `(?i: )` (letters in either
case), `|`, `?`, `*`, `+`, `{n}`, `{n,}`, `{n,m}`.  Everything a pattern names is ASCII, so bytes of other
characters only ever end a match.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np


def parse(pattern: str):
    """Tree of ("set", bytes), ("cat", parts), ("alt", parts) and ("rep", part, least, most or None)."""
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def escaped() -> str:
        nonlocal at
        c = take()
        if c == "x":
            at += 2
            return chr(int(pattern[at - 2:at], 16))
        return c

    def either(fold: bool):
        parts = [sequence(fold)]
        while peek() == "|":
            take()
            parts.append(sequence(fold))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(fold: bool):
        parts = []
        while peek() not in ("", "|", ")"):
            parts.append(repeated(atom(fold)))
        return ("cat", parts)

    def one(chars: Iterable[str], fold: bool):
        found = {x for c in chars for x in ((c.lower(), c.upper()) if fold else (c,))}
        return ("set", frozenset(ord(x) for x in found))

    def atom(fold: bool):
        nonlocal at
        c = take()
        if c == "(":
            if pattern.startswith("?i:", at) or pattern.startswith("?:", at):
                fold = fold or pattern[at + 1] == "i"
                at = pattern.index(":", at) + 1
            inner = either(fold)
            take()
            return inner
        if c == "[":
            chars: list[str] = []
            while peek() != "]":
                c = take()
                c = escaped() if c == "\\" else c
                if peek() == "-" and pattern[at + 1] != "]":
                    take()
                    last = take()
                    last = escaped() if last == "\\" else last
                    chars += [chr(x) for x in range(ord(c), ord(last) + 1)]
                else:
                    chars.append(c)
            take()
            return one(chars, fold)
        return one([escaped() if c == "\\" else c], fold)

    def repeated(part):
        nonlocal at
        while peek() and peek() in "?*+{":
            c = take()
            if c == "{":
                end = pattern.index("}", at)
                lo, _, hi = pattern[at:end].partition(",")
                part = ("rep", part, int(lo), int(hi) if hi else (None if "," in pattern[at:end] else int(lo)))
                at = end + 1
            else:
                part = ("rep", part, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return part

    return either(False)


class Nfa:
    """States with byte-set edges and empty moves; `reverse` builds the mirror image of each tree."""

    def __init__(self, reverse: bool):
        self.reverse, self.edges, self.empty = reverse, [], []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int) -> int:
        """Append the tree after `start`; the state it ends in."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.edges[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in reversed(tree[1]) if self.reverse else tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "alt":
            for part in tree[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(part, start)
                self.empty[start].append(end)
        return end


class Automaton(NamedTuple):
    """`table[state * width + classes[byte]]` is the next state, also times `width`; 0 is the start.

    Accepting states stand last, from `first` (times width) on; `accepted[state]` is a bit mask of rules.
    `dead` (times width) is the state without a way out, -1 if there is none.
    """

    table: list[int]
    classes: bytes
    width: int
    accepted: list[int]
    first: int
    dead: int


def compiled(patterns: list[str], reverse: bool = False, anywhere: bool = False) -> Automaton:
    """All patterns in one automaton.  `anywhere` starts every rule anew at each byte.
    Subset construction over classes of like bytes, then partition refinement.
    """
    nfa = Nfa(reverse)
    first, ends = nfa.state(), {}
    for k, pattern in enumerate(patterns):
        start = nfa.state()
        nfa.empty[first].append(start)
        ends[nfa.add(parse(pattern), start)] = k

    def closure(states: Iterable[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    sets = {s for e in nfa.edges for s, _ in e}
    like: dict[tuple, list[int]] = {}
    for byte in range(256):
        like.setdefault(tuple(byte in s for s in sets), []).append(byte)
    classes = list(like.values())
    begin = closure([first])
    number, todo, table = {begin: 0}, [begin], []
    while todo:
        states = todo.pop(0)
        row = []
        for bytes_ in classes:
            to = {t for s in states for chars, t in nfa.edges[s] if bytes_[0] in chars}
            to = closure(to | ({first} if anywhere else set()))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    found = [sum(1 << ends[s] for s in states if s in ends) for states in number]

    # States are alike when they accept the same rules and step into like states.
    block = np.unique(found, return_inverse=True)[1]
    steps = np.array(table)
    while True:
        finer = np.unique(np.column_stack([block, block[steps]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    sample = {b: s for s, b in reversed(list(enumerate(block.tolist())))}
    order = sorted(sample, key=lambda b: (found[sample[b]] > 0, b != block[0], b))
    if found[0]:
        raise ValueError("a pattern matches the empty text")
    rank = {b: k for k, b in enumerate(order)}
    class_of = np.empty(256, np.uint8)
    for k, bytes_ in enumerate(classes):
        class_of[bytes_] = k
    width = len(classes)
    table = np.array([[rank[block[t]] * width for t in steps[sample[b]]] for b in order])
    accepted = [found[sample[b]] for b in order]
    first = next((k for k, m in enumerate(accepted) if m), len(accepted))
    stuck = [k * width for k in range(first) if (table[k] == k * width).all()]
    return Automaton(table.ravel().tolist(), class_of.tobytes(), width, accepted, first * width, stuck[0] if stuck else -1)
