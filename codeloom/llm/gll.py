"""Generalised LL parsing with a graph-structured stack.

Works on any context-free grammar, left-recursive and ambiguous ones included, from many start positions at once: the
stack nodes (nonterminal, position) are shared by all of them, so a function is recognised wherever it stands, however
broken the text around it. Derivations are kept as a binary subtree set, from which the parts of a match are read.

Grammars are lines ``name = symbols | symbols``; ``?``, ``*`` and ``+`` behind a symbol are short for helper rules.
Quoted words are token kinds; capital names are classes of kinds given by the caller, or jumps: terminals that cover a whole
balanced group.
"""

from __future__ import annotations

import re


class Grammar:
    def __init__(self, text: str, classes: dict[str, frozenset[str]], start: str):
        #: a class is (kinds, whether they are excluded); a jump is the name alone
        self.classes = classes
        self.rules: dict[str, list[tuple]] = {}
        for line in re.sub(r"\n\s+", " ", text.strip()).split("\n"):
            name, _, body = line.partition(" = ")
            self.rules[name.strip()] = []
            for alt in re.split(r"\s\|(?:\s|$)", body):
                self.rules[name.strip()].append(tuple(self._symbol(w) for w in alt.split()))
        self.start = start
        self._firsts()

    def _symbol(self, word: str):
        mark = word[-1] if word[-1] in "?*+" and not word.endswith("'") else ""
        base = word[:-1] if mark else word
        symbol = ("t", base[1:-1]) if base[0] == "'" else ("c", base) if base.isupper() else ("n", base)
        if not mark:
            return symbol
        helper = f"{base}{mark}"
        if helper not in self.rules:
            self.rules[helper] = {"?": [(symbol,), ()], "*": [(symbol, ("n", helper)), ()], "+": [(symbol, ("n", helper)), (symbol,)]}[mark]
        return ("n", helper)

    def _firsts(self):
        """Whether an alternative can start with a kind; None stands for any."""
        self.nullable: set[str] = set()
        changed = True
        while changed:
            changed = False
            for name, alts in self.rules.items():
                if name not in self.nullable and any(all(k == "n" and x in self.nullable for k, x in alt) for alt in alts):
                    self.nullable.add(name)
                    changed = True
        self.first: dict[str, set] = {n: set() for n in self.rules}
        changed = True
        while changed:
            changed = False
            for name, alts in self.rules.items():
                before = len(self.first[name])
                for alt in alts:
                    self.first[name] |= self._first(alt)
                changed |= len(self.first[name]) != before

    def _first(self, alt) -> set:
        out: set = set()
        for k, x in alt:
            if k == "n":
                out |= self.first[x]
                if x not in self.nullable:
                    return out
            else:
                out.add((k, x))
                return out
        return out


class Parse:
    """One run over token kinds; ``jumps`` gives, per jump name, the position behind the group that starts at a position."""

    def __init__(self, grammar: Grammar, kinds: list[str], jumps: dict[str, dict[int, int]]):
        self.g, self.kinds, self.jumps = grammar, kinds, jumps
        self.ends: dict[tuple[str, int], set[int]] = {}  # completed nonterminals by stack node
        self.back: dict[tuple[str, int], set] = {}  # edges of the stack: who waits for a node
        self.subtrees: dict[tuple, set[int]] = {}  # (rule, alternative, dot, start, end) -> pivots

    def _fits(self, symbol, i: int) -> int:
        """The position behind a terminal at i, or -1."""
        k, x = symbol
        if i >= len(self.kinds):
            return -1
        if k == "t":
            return i + 1 if self.kinds[i] == x else -1
        if x in self.jumps:
            return self.jumps[x].get(i, -1)
        kinds, excluded = self.g.classes[x]
        return i + 1 if (self.kinds[i] in kinds) != excluded else -1

    def _may(self, alt, i: int) -> bool:
        if all(k == "n" and x in self.g.nullable for k, x in alt):
            return True
        return any(self._fits(s, i) >= 0 for s in self.g._first(alt)) or any(k == "n" and x in self.g.nullable for k, x in alt[:1])

    def run(self, starts: list[int]) -> None:
        g = self.g
        work: list[tuple] = []
        seen: set[tuple] = set()

        def add(name, a, dot, origin, i):
            d = (name, a, dot, origin, i)
            if d not in seen:
                seen.add(d)
                work.append(d)

        def call(name, i):
            if (name, i) in self.ends:
                return
            self.ends[name, i], self.back[name, i] = set(), set()
            for a, alt in enumerate(g.rules[name]):
                if self._may(alt, i):
                    add(name, a, 0, i, i)

        for i in starts:
            call(g.start, i)
        while work:
            name, a, dot, origin, i = work.pop()
            alt = g.rules[name][a]
            while True:
                if dot == len(alt):
                    node = (name, origin)
                    if i not in self.ends[node]:
                        self.ends[node].add(i)
                        for up, b, d, o in self.back[node]:
                            self.subtrees.setdefault((up, b, d, o, i), set()).add(origin)
                            add(up, b, d, o, i)
                    break
                kind, x = alt[dot]
                if kind == "n":
                    call(x, i)
                    edge = (name, a, dot + 1, origin)
                    if edge not in self.back[x, i]:
                        self.back[x, i].add(edge)
                        for end in list(self.ends[x, i]):
                            self.subtrees.setdefault((name, a, dot + 1, origin, end), set()).add(i)
                            add(name, a, dot + 1, origin, end)
                    break
                nxt = self._fits(alt[dot], i)
                if nxt < 0:
                    break
                self.subtrees.setdefault((name, a, dot + 1, origin, nxt), set()).add(i)
                dot, i = dot + 1, nxt

    def matches(self, start: int) -> list[int]:
        return sorted(self.ends.get((self.g.start, start), ()))

    def parts(self, name: str, start: int, end: int, wanted: frozenset[str]) -> list[tuple[str, int, int]]:
        """The (name, start, end) of wanted nonterminals in the first derivation of a match, in text order."""
        out: list[tuple[str, int, int]] = []
        stack = [(name, start, end)]
        while stack:
            n, i, j = stack.pop()
            if n in wanted:
                out.append((n, i, j))
            for a, alt in enumerate(self.g.rules[n]):
                cut, right, found = [], j, True
                for dot in range(len(alt), 0, -1):
                    pivots = self.subtrees.get((n, a, dot, i, right))
                    if not pivots or (dot == 1 and i not in pivots):
                        found = False
                        break
                    left = i if dot == 1 else max(pivots)
                    cut.append((alt[dot - 1], left, right))
                    right = left
                if found and right == i:
                    stack.extend((x, lo, hi) for (k, x), lo, hi in cut if k == "n")
                    break
        return sorted(out, key=lambda p: (p[1], -p[2]))
