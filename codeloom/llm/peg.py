"""Parsing-expression grammars over tokens, compiled to packrat recognisers.

A grammar is text: ``name <- expression`` lines. Quoted words and capital names are token kinds,
small names are rules; ``/`` is ordered choice, ``* + ? & !`` as usual; ``NLB`` holds before a token that starts a line. Each rule becomes a Python function from a
position to the position behind its match (or -1) that keeps its results by position, so every rule runs
at most once per position and parsing takes linear time. Rules written with ``<~`` aren't kept: they are cheap and
tried once. The recogniser also tells the furthest position at which a token didn't fit.

Nesting deeper than the interpreter's stack is filled in from the right: every kept rule is tried at the last token, then at the one before,
and so on, so each finds what it needs already kept and no call goes deep, whatever the input.
"""

from __future__ import annotations

import re
import sys

EOF = "EOF"
#: Calls within calls before a text is parsed from the right instead; some hundred bytes each.
STACK = 20_000
_WORD = re.compile(r"\s*(?:(?P<lit>'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<op>[/*+?&!()]))")
_RULE = re.compile(r"^(\w+)\s*<([-~])", re.M)


def _parse_expression(text: str):
    words = []
    at = 0
    text = text.strip()
    while at < len(text):
        m = _WORD.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at:at + 40]!r}")
        words.append(m.group("lit") or m.group("name") or m.group("op"))
        at = m.end()
    pos = 0

    def choice():
        nonlocal pos
        alts = [sequence()]
        while pos < len(words) and words[pos] == "/":
            pos += 1
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else ("alt", alts)

    def sequence():
        items = []
        while pos < len(words) and words[pos] not in ("/", ")"):
            items.append(prefix())
        return items[0] if len(items) == 1 else ("seq", items)

    def prefix():
        nonlocal pos
        if words[pos] in ("&", "!"):
            sign = words[pos]
            pos += 1
            return ("and" if sign == "&" else "not", prefix())
        return suffix()

    def suffix():
        nonlocal pos
        out = primary()
        while pos < len(words) and words[pos] in ("*", "+", "?"):
            out = ({"*": "star", "+": "plus", "?": "opt"}[words[pos]], out)
            pos += 1
        return out

    def primary():
        nonlocal pos
        w = words[pos]
        pos += 1
        if w == "(":
            out = choice()
            pos += 1
            return out
        if w[0] == "'":
            return ("tok", w[1:-1])
        if w == "NLB":
            return ("line", None)
        return ("tok", w) if w.isupper() else ("rule", w)

    return choice()


class Grammar:
    """A compiled grammar; :meth:`run` takes token kinds that end in EOF."""

    def __init__(self, text: str, start: str = "file"):
        text = re.sub(r"^\s*#.*$", "", text, flags=re.M)
        heads = list(_RULE.finditer(text))
        self.rules, self.kept = {}, set()
        for h, nxt in zip(heads, [*heads[1:], None]):
            self.rules[h.group(1)] = _parse_expression(text[h.end():nxt.start() if nxt else len(text)])
            if h.group(2) == "-":
                self.kept.add(h.group(1))
        for name, e in self.rules.items():
            for used in self._names(e):
                if used not in self.rules:
                    raise ValueError(f"grammar: {name} uses {used}")
        self._first_sets()
        self.start = start
        self.run = self._compile(start)
        self._from_right = None

    def _names(self, e):
        kind, x = e
        if kind == "rule":
            yield x
        elif kind in ("alt", "seq"):
            for y in x:
                yield from self._names(y)
        elif kind not in ("tok", "line"):
            yield from self._names(x)

    def _first_sets(self):
        """Per rule the tokens a match can start with, and whether it may be empty."""
        self.first = {r: (frozenset(), False) for r in self.rules}
        changed = True
        while changed:
            changed = False
            for r, e in self.rules.items():
                now = self._first(e)
                if now != self.first[r]:
                    self.first[r] = now
                    changed = True

    def _first(self, e):
        kind, x = e
        if kind == "tok":
            return frozenset([x]), False
        if kind == "rule":
            return self.first[x]
        if kind in ("star", "opt"):
            return self._first(x)[0], True
        if kind == "plus":
            return self._first(x)
        if kind in ("and", "not", "line"):
            return frozenset(), True
        if kind == "alt":
            parts = [self._first(y) for y in x]
            return frozenset().union(*[p[0] for p in parts]), any(p[1] for p in parts)
        out = frozenset()
        for y in x:
            f, empty = self._first(y)
            out |= f
            if not empty:
                return out, False
        return out, True

    def _compile(self, start, from_right: bool = False):
        """The recogniser; ``from_right`` keeps with each result how far it looked, so that results found early report the same furthest position."""
        self.lines, self.sets, self.n = [], {}, 0
        put = self.lines.append
        put("def run(K, B):")
        put("    far = 0")
        for r in self.kept:
            put(f"    M_{r} = {{}}")
        for r, e in self.rules.items():
            put(f"    def r_{r}(p):")
            put("        nonlocal far")
            if r in self.kept:
                put(f"        m = M_{r}.get(p)")
                if from_right:
                    put("        if m is not None:")
                    put("            if m[1] > far: far = m[1]")
                    put("            return m[0]")
                    put("        before = far; far = 0")
                else:
                    put("        if m is not None: return m")
                put("        at = p")
            self._emit(e, 8)
            if r in self.kept:
                put(f"        M_{r}[at] = " + ("(p, far)" if from_right else "p"))
                if from_right:
                    put("        if before > far: far = before")
            put("        return p")
        if from_right:
            put("    for i in range(len(K) - 1, -1, -1):")
            put("        k = K[i]")
            for r in sorted(self.kept):
                first, empty = self.first[r]
                put(f"        r_{r}(i)" if empty else f"        if k in {self._set(first)}: r_{r}(i)")
            put("    far = 0")
        put(f"    return r_{start}(0), far")
        space = {f"F{i}": s for s, i in self.sets.items()}
        exec(compile("\n".join(self.lines), "<grammar>", "exec"), space)  # noqa: S102 - the text is this package's own
        return space["run"]

    def _set(self, s):
        return f"F{self.sets.setdefault(s, len(self.sets))}"

    def _emit(self, e, ind):
        put, pad = self.lines.append, " " * ind
        kind, x = e
        self.n += 1
        n = self.n
        if kind == "tok":
            put(f"{pad}if K[p] == {x!r}: p += 1")
            put(f"{pad}else:")
            put(f"{pad}    if p > far: far = p")
            put(f"{pad}    p = -1")
        elif kind == "line":
            put(f"{pad}if not B[p]: p = -1")
        elif kind == "rule":
            put(f"{pad}p = r_{x}(p)")
        elif kind == "seq":
            for i, y in enumerate(x):
                if i:
                    put(f"{pad}if p >= 0:")
                    pad += " "
                    ind += 1
                self._emit(y, ind)
            if not x:
                put(f"{pad}pass")
        elif kind == "alt":
            if all(y[0] == "tok" for y in x):
                put(f"{pad}if K[p] in {self._set(frozenset(y[1] for y in x))}: p += 1")
                put(f"{pad}else:")
                put(f"{pad}    if p > far: far = p")
                put(f"{pad}    p = -1")
                return
            put(f"{pad}s{n} = p; k{n} = K[p]; p = -1")
            for y in x:
                first, empty = self._first(y)
                guard = "" if empty else f" and k{n} in {self._set(first)}"
                put(f"{pad}if p < 0{guard}:")
                put(f"{pad} p = s{n}")
                self._emit(y, ind + 1)
            put(f"{pad}if p < 0 and s{n} > far: far = s{n}")
        elif kind in ("star", "plus", "opt"):
            if kind == "plus":
                self._emit(x, ind)
                put(f"{pad}if p >= 0:")
                ind += 1
                pad += " "
            first, empty = self._first(x)
            if kind == "opt":
                put(f"{pad}if True:" if empty else f"{pad}if K[p] in {self._set(first)}:")
                put(f"{pad} s{n} = p")
                self._emit(x, ind + 1)
                put(f"{pad} if p < 0: p = s{n}")
            else:
                put(f"{pad}while True:" if empty else f"{pad}while K[p] in {self._set(first)}:")
                put(f"{pad} s{n} = p")
                self._emit(x, ind + 1)
                put(f"{pad} if p <= s{n}:")
                put(f"{pad}  p = s{n}; break")
        elif kind == "not":
            put(f"{pad}s{n} = p; f{n} = far")
            self._emit(x, ind)
            put(f"{pad}far = f{n}; p = -1 if p >= 0 else s{n}")
        elif kind == "and":
            put(f"{pad}s{n} = p")
            self._emit(x, ind)
            put(f"{pad}if p >= 0: p = s{n}")

    def parse(self, kinds: list[str], breaks: list[bool] | None = None) -> tuple[bool, int]:
        """(whether the whole input matches, the furthest token that didn't fit)."""
        if sys.getrecursionlimit() < STACK:
            sys.setrecursionlimit(STACK)
        try:
            end, far = self.run(kinds, breaks)
        except RecursionError:
            self._from_right = self._from_right or self._compile(self.start, True)
            end, far = self._from_right(kinds, breaks)
        return end == len(kinds), far
