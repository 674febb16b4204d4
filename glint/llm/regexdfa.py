"""Regular expressions to one minimal automaton over bytes: parse, subset construction, partition refinement.

The syntax is what the rules need: bytes, escapes (``\\.``, ``\\x20``), classes, groups, ``|`` and the quantifiers
``? * + {n} {n,} {n,m}``. There are no anchors, back references or look-arounds.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

ALL = frozenset(range(256))


class _Nfa:
    """States are numbers; ``eps[s]`` and ``step[s]`` (byte set, target) are its edges."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append([])
        return len(self.eps) - 1


class _Parser:
    """Recursive descent to nested tuples: ('set', bytes), ('cat', [..]), ('alt', [..]), ('rep', node, low, high)."""

    def __init__(self, text: str, fold: bool):
        self.t, self.i, self.fold = text, 0, fold

    def parse(self):
        node = self.alt()
        if self.i != len(self.t):
            raise ValueError(f"unexpected {self.t[self.i]!r} at {self.i} in {self.t!r}")
        return node

    def alt(self):
        parts = [self.cat()]
        while self.t[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self):
        parts = []
        while self.i < len(self.t) and self.t[self.i] not in "|)":
            parts.append(self.quantified())
        return ("cat", parts)

    def quantified(self):
        node = self.atom()
        while self.i < len(self.t) and self.t[self.i] in "?*+{":
            c = self.t[self.i]
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                body, _, _ = self.t[self.i :].partition("}")
                self.i += len(body) + 1
                a, comma, b = body.partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
            node = ("rep", node, low, high)
        return node

    def literal(self) -> int:
        c = self.t[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.t[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.t[self.i - 2 : self.i], 16)
        return ord(c)

    def folded(self, bytes_: set[int]) -> frozenset[int]:
        if self.fold:
            bytes_ |= {b ^ 32 for b in bytes_ if 65 <= (b & 0xDF) <= 90}
        return frozenset(bytes_)

    def atom(self):
        c = self.t[self.i]
        if c == "(":
            self.i += 1
            node = self.alt()
            self.i += 1
            return node
        if c != "[":
            return ("set", self.folded({self.literal()}))
        self.i += 1
        negated = self.t[self.i] == "^"
        self.i += negated
        got: set[int] = set()
        while self.t[self.i] != "]":
            low = high = self.literal()
            if self.t[self.i] == "-" and self.t[self.i + 1] != "]":
                self.i += 1
                high = self.literal()
            got |= set(range(low, high + 1))
        self.i += 1
        return ("set", self.folded(got) if not negated else ALL - self.folded(got))


def _build(nfa: _Nfa, node, at: int, backward: bool) -> int:
    kind = node[0]
    if kind == "set":
        out = nfa.state()
        nfa.step[at].append((node[1], out))
        return out
    if kind == "cat":
        for part in reversed(node[1]) if backward else node[1]:
            at = _build(nfa, part, at, backward)
        return at
    if kind == "alt":
        out = nfa.state()
        for part in node[1]:
            begin = nfa.state()
            nfa.eps[at].append(begin)
            nfa.eps[_build(nfa, part, begin, backward)].append(out)
        return out
    _, inner, low, high = node
    for _ in range(low):
        at = _build(nfa, inner, at, backward)
    if high is None:
        loop = nfa.state()
        nfa.eps[at].append(loop)
        nfa.eps[_build(nfa, inner, loop, backward)].append(loop)
        return loop
    out = nfa.state()
    nfa.eps[at].append(out)
    for _ in range(high - low):
        at = _build(nfa, inner, at, backward)
        nfa.eps[at].append(out)
    return out


@dataclass
class Dfa:
    """``next[s]`` has 256 entries. States from ``first_final`` on accept, and ``rules[s]`` says which rules.

    State ``dead`` (if any) leads nowhere.
    """

    next: list[list[int]]
    rules: list[frozenset[int]]
    start: int
    first_final: int
    dead: int = field(default=-1)


def compile_rules(patterns: list[str], fold: list[bool], search: bool, backward: bool = False) -> Dfa:
    """All patterns in one minimal automaton. ``search``: a match may begin at any byte, not at the first only."""
    nfa = _Nfa()
    root = nfa.state()
    final: dict[int, int] = {}
    for k, (p, f) in enumerate(zip(patterns, fold, strict=True)):
        begin = nfa.state()
        nfa.eps[root].append(begin)
        final[_build(nfa, _Parser(p, f).parse(), begin, backward)] = k

    def closure(states) -> frozenset[int]:
        todo, got = list(states), set(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in got:
                    got.add(t)
                    todo.append(t)
        return frozenset(s for s in got if nfa.step[s] or s in final)

    begin = closure([root])
    number, order, table = {begin: 0}, [begin], []
    for here in order:  # grows as states are found
        moves: list[set[int]] = [set() for _ in range(256)]
        for s in here:
            for bytes_, t in nfa.step[s]:
                for b in bytes_:
                    moves[b].add(t)
        row, by_target = [], {}
        for b in range(256):
            key = frozenset(moves[b])
            if key not in by_target:
                there = closure(key)
                there = there | begin if search else there
                if there not in number:
                    number[there] = len(order)
                    order.append(there)
                by_target[key] = number[there]
            row.append(by_target[key])
        table.append(row)
    rules = [frozenset(final[s] for s in here if s in final) for here in order]
    return _minimal(table, rules)


def _minimal(table: list[list[int]], rules: list[frozenset[int]]) -> Dfa:
    """Merge states that no input tells apart (partition refinement by the classes of all successors)."""
    kinds = {r: i for i, r in enumerate(dict.fromkeys(rules))}
    part, n = [kinds[r] for r in rules], len(kinds)
    while True:
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((part[s], *(part[t] for t in row)), len(seen)) for s, row in enumerate(table)]
        part, same, n = new, len(seen) == n, len(seen)
        if same:
            break
    one = defaultdict(list)
    for s, c in enumerate(part):
        one[c].append(s)
    classes = sorted(one, key=lambda c: (bool(rules[one[c][0]]), c))
    rank = {c: i for i, c in enumerate(classes)}
    out = [[rank[part[t]] for t in table[one[c][0]]] for c in classes]
    accept = [rules[one[c][0]] for c in classes]
    first = next((i for i, r in enumerate(accept) if r), len(accept))
    dead = next((i for i, row in enumerate(out) if not accept[i] and all(t == i for t in row)), -1)
    return Dfa(out, accept, rank[part[0]], first, dead)
