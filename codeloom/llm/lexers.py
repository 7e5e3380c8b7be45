"""Tokens of eight languages for the grammars of :mod:`codeloom.llm.grammars`.

Each lexer gives token kinds (keywords and punctuation as themselves, classes like ID, NUM, STR in capitals, EOF at
the end), their start offsets and, for languages in which line ends matter, a flag for a token that starts a new line.
What is no token at all raises :class:`NoToken`; lexers with ``recover`` leave it out and go on from there in the same pass.
"""

from __future__ import annotations

import re


class NoToken(Exception):
    def __init__(self, at: int, cause: str):
        super().__init__(cause)
        self.at, self.cause = at, cause


class Tokens:
    __slots__ = ("kinds", "starts", "breaks")

    def __init__(self):
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.breaks: list[bool] = []


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _punct(text: str) -> str:
    return "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True))


# Reserved words (fixed values of the languages).
JS_WORDS = _words("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with")
JS_SOFT = _words("async await of get set static let yield from as")
TS_SOFT = _words("type interface namespace module declare abstract public private protected readonly override keyof infer is asserts satisfies unique global implements out accessor require")
JAVA_WORDS = _words("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null")
JAVA_SOFT = _words("var record sealed permits yield when module open")
GO_WORDS = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
RUST_WORDS = _words("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while")
PY_WORDS = _words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield")
PY_SOFT = _words("match case type _")

_JSON = re.compile(r'''(?P<ws>[ \t\n\r]+)|(?P<STR>"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")|(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>\w+)|(?P<op>[{}\[\],:])''')

_ID = r"(?:[^\W\d]|\$)(?:\w|\$)*"
_JS = re.compile(rf'''(?P<ws>[ \t\f\v\xa0\ufeff]+)|(?P<nl>[\r\n\u2028\u2029]\s*)|(?P<com>//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)|(?P<word>{_ID}|\\u[0-9a-fA-F]{{4}}\w*)|(?P<priv>\#{_ID})|(?P<STR>"[^"\\\n\r]*(?:\\(?:\r\n|[\s\S])[^"\\\n\r]*)*"|'[^'\\\n\r]*(?:\\(?:\r\n|[\s\S])[^'\\\n\r]*)*')|(?P<NUM>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))|(?P<op>{_punct("{ } ( ) [ ] ; , ... . ?. ?? ??= ? : => = == === != !== ! + ++ += - -- -= * *= ** **= % %= & && &= &&= | || |= ||= ^ ^= ~ < <= << <<= > >= >>= >>>= @")})|(?P<slash>/=?)|(?P<tick>`)''')
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_TPL = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*")
#: After these an expression has ended, so that a slash divides.
_ENDED = frozenset("ID NUM STR REGEX TPL TTAIL ) ] } this super null true false ++ --".split()) | JS_SOFT - {"of", "await", "yield"}

_JAVA = re.compile(rf'''(?P<ws>\s+)|(?P<com>//[^\n\r]*|/\*[\s\S]*?\*/)|(?P<word>{_ID})|(?P<STR>"""[ \t]*\r?\n[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""|"[^"\\\n\r]*(?:\\[^\n\r][^"\\\n\r]*)*")|(?P<CHR>'(?:[^'\\\n\r]|\\(?:u+[0-9a-fA-F]{{4}}|[0-7]{{1,3}}|[btnfrs"'\\]))')|(?P<NUM>(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))|(?P<op>{_punct("{ } ( ) [ ] ; , . ... @ :: -> = == != ! + ++ += - -- -= * *= / /= % %= & && &= | || |= ^ ^= ~ < <= <<= > >= >>= >>>= ? :")})''')

_GO = re.compile(rf'''(?P<ws>[ \t\r\f\v\ufeff]+)|(?P<nl>\n)|(?P<com>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<word>[^\W\d]\w*)|(?P<STR>"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"|`[^`]*`)|(?P<CHR>'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[0-7]{{3}}|[abfnrtv'\\]))')|(?P<NUM>(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))|(?P<op>{_punct("{ } ( ) [ ] ; , . ... := = == != ! + ++ += - -- -= * *= / /= % %= & && &= &^ &^= | || |= ^ ^= ~ < <= << <<= <- > >= >> >>= :")})''')

_RUST = re.compile(rf'''(?P<ws>\s+)|(?P<com>//[^\n]*)|(?P<block>/\*)|(?P<STR>[bc]?"[^"\\]*(?:\\[\s\S][^"\\]*)*"|[bc]?r(?P<h>\#*)"[\s\S]*?"(?P=h))|(?P<CHR>b?'(?:[^'\\\n\t\r]|\\(?:x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]+\}}|[nrt0'"\\]))')|(?P<LIFE>'[^\W\d]\w*(?!'))|(?P<word>(?:r\#)?[^\W\d]\w*(?!["'])|[^\W\d]\w*(?=\s))|(?P<NUM>(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w))|(?P<op>{_punct("{ } ( ) [ ] ; , . .. ... ..= :: : -> => = == != ! + += - -= * *= / /= % %= & && &= | || |= ^ ^= < <= <<= > >= >>= ? @ # $ ~")})''')

_PY_BLOCK = re.compile(r"[ \t\f]*(?:def|class|async[ \t]+def)[ \t]+[^\W\d]")
_PY_PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
_PY = re.compile(rf'''(?P<ws>[ \t\f]+|\\\r?\n|\ufeff)|(?P<nl>\r?\n|\r)|(?P<com>\#[^\n\r]*)|(?P<STR>{_PY_PREFIX}(?:"""[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""|\'\'\'[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*\'\'\'|"[^"\\\n\r]*(?:\\(?:\r\n|[\s\S])[^"\\\n\r]*)*"(?!"")|'[^'\\\n\r]*(?:\\(?:\r\n|[\s\S])[^'\\\n\r]*)*'(?!'')|""(?!")|\'\'(?!')))|(?P<word>[^\W\d]\w*)|(?P<NUM>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)(?!\w))|(?P<op>{_punct("( ) [ ] { } , : := . ... ; @ @= = == != + += - -= * *= ** **= / /= // //= % %= & &= | |= ^ ^= ~ < <= << <<= > >= >> >>= -> ->")})''')


def _unfit(text: str, at: int) -> NoToken:
    """What is wrong at a place where no token starts."""
    c = text[at:at + 1]
    if c in "\"'`":
        return NoToken(at, "open_string")
    if text.startswith("/*", at):
        return NoToken(at, "open_comment")
    return NoToken(at, "stray_character")


_LINE = re.compile(r"[^\r\n]*")


def _behind(text: str, fault: NoToken) -> int:
    """Where lexing goes on behind what is no token: at the next character, or at the end of the line."""
    if fault.cause in ("unbalanced", "stray_character"):
        return fault.at + 1
    return max(fault.at + 1, _LINE.match(text, fault.at).end())


def json(text: str) -> Tokens:
    out = Tokens()
    kinds, starts = out.kinds, out.starts
    at = 1 if text.startswith("\ufeff") else 0
    match = _JSON.match
    n = len(text)
    while at < n:
        m = match(text, at)
        if m is None:
            raise _unfit(text, at)
        group = m.lastgroup
        if group != "ws":
            word = m.group()
            if group == "word" and word not in ("true", "false", "null"):
                raise NoToken(at, "stray_character")
            kinds.append("LIT" if group == "word" else word if group == "op" else group)
            starts.append(at)
        at = m.end()
    kinds.append("EOF")
    starts.append(n)
    return out


def _script(text: str, soft: frozenset[str], recover: bool) -> Tokens:
    out = Tokens()
    kinds, starts, breaks = out.kinds, out.starts, out.breaks
    at, n, fresh = 0, len(text), True
    match = _JS.match
    depth: list[int] = []  # open braces within each open template
    if text.startswith("#!"):
        at = (text.find("\n") + 1) or n
    unclosed = False  # whether no comment ends any more
    while at < n:
        try:
            if unclosed and text.startswith("/*", at):
                raise NoToken(at, "open_comment")
            m = match(text, at)
            if m is None:
                raise _unfit(text, at)
            group, end = m.lastgroup, m.end()
            if group == "ws":
                at = end
                continue
            if group == "nl":
                fresh, at = True, end
                continue
            if group == "com":
                if "\n" in m.group():
                    fresh = True
                at = end
                continue
            kind = m.group()
            if group == "word":
                if kind not in JS_WORDS and kind not in soft:
                    kind = "ID"
            elif group == "STR" or group == "NUM":
                kind = group
            elif group == "priv":
                kind = "PRIV"
            elif group == "slash" and recover and text.startswith("/*", at):
                raise NoToken(at, "open_comment")
            elif group == "slash":
                if not kinds or kinds[-1] not in _ENDED:
                    m = _JS_REGEX.match(text, at)
                    if m is None:
                        raise NoToken(at, "open_string")
                    kind, end = "REGEX", m.end()
            elif group == "tick" or (kind == "}" and depth and depth[-1] == 0):
                # a template, from its start or from behind a substitution
                first = group == "tick"
                stop = _TPL.match(text, at + 1).end()
                if text.startswith("`", stop):
                    kind, end = ("TPL" if first else "TTAIL"), stop + 1
                    if not first:
                        depth.pop()
                elif text.startswith("${", stop):
                    kind, end = ("THEAD" if first else "TMID"), stop + 2
                    if first:
                        depth.append(0)
                else:
                    raise NoToken(at, "open_string")
            elif depth and kind in "{}":
                depth[-1] += 1 if kind == "{" else -1
            kinds.append(kind)
            starts.append(at)
            breaks.append(fresh)
            fresh = False
            at = end
        except NoToken as e:
            if not recover:
                raise
            unclosed |= e.cause == "open_comment"
            if depth and text[e.at] == "}":
                depth.pop()  # its template never ends
            at = _behind(text, e)
    kinds.append("EOF")
    starts.append(n)
    breaks.append(True)
    return out


def javascript(text: str, recover: bool = False) -> Tokens:
    return _script(text, JS_SOFT, recover)


def typescript(text: str, recover: bool = False) -> Tokens:
    return _script(text, JS_SOFT | TS_SOFT, recover)


def java(text: str, recover: bool = False) -> Tokens:
    out = Tokens()
    kinds, starts = out.kinds, out.starts
    at, n, match = 0, len(text), _JAVA.match
    if text.startswith("\ufeff"):
        at = 1
    unclosed = False  # whether no comment ends any more
    while at < n:
        try:
            if unclosed and text.startswith("/*", at):
                raise NoToken(at, "open_comment")
            m = match(text, at)
            if m is None:
                if text[at] == "\x1a" and at == n - 1:
                    break
                raise _unfit(text, at)
            group = m.lastgroup
            if group != "ws" and group != "com":
                kind = m.group()
                if group == "word":
                    kind = kind if kind in JAVA_WORDS or kind in JAVA_SOFT else "ID"
                elif group != "op":
                    kind = group
                    if m.group().startswith("/*"):
                        raise _unfit(text, at)
                elif kind == "/" and text.startswith("/*", at):
                    raise NoToken(at, "open_comment")
                kinds.append(kind)
                starts.append(at)
            at = m.end()
        except NoToken as e:
            if not recover:
                raise
            unclosed |= e.cause == "open_comment"
            at = _behind(text, e)
    kinds.append("EOF")
    starts.append(n)
    return out


_GO_END = frozenset("ID NUM STR CHR break continue fallthrough return ++ -- ) ] }".split())


def go(text: str, recover: bool = False) -> Tokens:
    """With the semicolons that Go adds at line ends."""
    out = Tokens()
    kinds, starts = out.kinds, out.starts
    at, n, match = 0, len(text), _GO.match
    unclosed = False  # whether no comment ends any more
    while at < n:
        try:
            if unclosed and text.startswith("/*", at):
                raise NoToken(at, "open_comment")
            m = match(text, at)
            if m is None:
                raise _unfit(text, at)
            group, end = m.lastgroup, m.end()
            if group == "nl" or (group == "block" and "\n" in m.group()):
                if kinds and kinds[-1] in _GO_END:
                    kinds.append(";")
                    starts.append(at)
            elif group not in ("ws", "com", "block"):
                kind = m.group()
                if group == "word":
                    kind = kind if kind in GO_WORDS else "ID"
                elif group != "op":
                    kind = group
                elif kind == "/" and text.startswith("/*", at):
                    raise NoToken(at, "open_comment")
                kinds.append(kind)
                starts.append(at)
            at = end
        except NoToken as e:
            if not recover:
                raise
            unclosed |= e.cause == "open_comment"
            at = _behind(text, e)
    if kinds and kinds[-1] in _GO_END:
        kinds.append(";")
        starts.append(n)
    kinds.append("EOF")
    starts.append(n)
    return out


_RUST_NEST = re.compile(r"/\*|\*/")


def _rust_comments(text: str, at: int) -> dict[int, int]:
    """The end of each nested comment from a position on, by start; open ones are left out."""
    out, stack = {}, []
    for m in _RUST_NEST.finditer(text, at):
        if m.group() == "/*":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def rust(text: str, recover: bool = False) -> Tokens:
    out = Tokens()
    kinds, starts = out.kinds, out.starts
    at, n, match = 0, len(text), _RUST.match
    if text.startswith("\ufeff"):
        at = 1
    if text.startswith("#!", at) and not text.startswith("#![", at):
        at = (text.find("\n") + 1) or n
    closers, nested = None, 0  # ends of the comments behind the first open one
    while at < n:
        try:
            m = match(text, at)
            if m is None:
                raise _unfit(text, at)
            group, end = m.lastgroup, m.end()
            if group == "block":
                if closers is not None and at >= nested:
                    end = closers.get(at, -1)
                    if end < 0:
                        raise NoToken(at, "open_comment")
                    at = end
                    continue
                level = 1
                while level:
                    m = _RUST_NEST.search(text, end)
                    if m is None:
                        nested, closers = at, _rust_comments(text, at) if recover else None
                        raise NoToken(at, "open_comment")
                    level += 1 if m.group() == "/*" else -1
                    end = m.end()
            elif group != "ws" and group != "com":
                kind = m.group()
                if group == "word":
                    kind = kind if kind in RUST_WORDS else "_" if kind == "_" else "ID"
                elif group != "op":
                    kind = "STR" if group == "h" else group
                kinds.append(kind)
                starts.append(at)
            at = end
        except NoToken as e:
            if not recover:
                raise
            at = _behind(text, e)
    kinds.append("EOF")
    starts.append(n)
    return out


def python(text: str, recover: bool = False) -> Tokens:
    """With NL at the end of each logical line, INDENT and DEDENT."""
    out = Tokens()
    kinds, starts = out.kinds, out.starts
    at, n, match = 0, len(text), _PY.match
    levels, open_brackets, line_start = [(0, 0)], [], True
    if text.startswith("\ufeff"):
        at = 1
    pairs = {")": "(", "]": "[", "}": "{"}
    while at < n:
        try:
            if line_start and not open_brackets:
                col = alt = 0
                begin, held, known = at, levels, len(kinds)
                while at < n and text[at] in " \t\f":
                    c = text[at]
                    col = (col // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else col + 1
                    alt = 0 if c == "\f" else alt + 1
                    at += 1
                if at >= n:
                    break
                if text[at] not in "\n\r#\\":
                    if col > levels[-1][0]:
                        if alt <= levels[-1][1]:
                            raise NoToken(at, "indentation")
                        levels.append((col, alt))
                        kinds.append("INDENT")
                        starts.append(at)
                    else:
                        if col < levels[-1][0]:
                            held = list(levels)
                        while col < levels[-1][0]:
                            levels.pop()
                            kinds.append("DEDENT")
                            starts.append(at)
                        if (col, alt) != levels[-1]:
                            raise NoToken(at, "indentation")
                del begin
                line_start = False
            m = match(text, at)
            if m is None:
                raise _unfit(text, at)
            group, end = m.lastgroup, m.end()
            if group == "nl":
                if recover and open_brackets and _PY_BLOCK.match(text, end):
                    open_brackets.clear()  # no bracket holds such a line, so it was never closed
                if not open_brackets:
                    if kinds and kinds[-1] not in ("NL", "DEDENT", "INDENT"):
                        kinds.append("NL")
                        starts.append(at)
                    line_start = True
            elif group != "ws" and group != "com":
                kind = m.group()
                if group == "word":
                    kind = kind if kind in PY_WORDS or kind in PY_SOFT else "ID"
                elif group == "op":
                    if kind in "([{":
                        open_brackets.append(kind)
                    elif kind in ")]}":
                        if not open_brackets or open_brackets[-1] != pairs[kind]:
                            raise NoToken(at, "unbalanced")
                        open_brackets.pop()
                else:
                    kind = group
                    if kind == "STR" and text[at] not in "\"'" and "f" in text[at:at + 2].lower():
                        word = m.group()
                        if word.count("{") != word.count("}"):
                            end = _formatted(text, at)
                            if end < 0:
                                raise NoToken(at, "open_string")
                kinds.append(kind)
                starts.append(at)
            at = end
        except NoToken as e:
            if not recover:
                raise
            if e.cause == "indentation":  # the line counts as blank
                levels = held
                del kinds[known:], starts[known:]
            at = _behind(text, e)
    if open_brackets:
        kinds.append("EOF")  # the grammar finds the gap
        starts.append(n)
        return out
    if kinds and kinds[-1] not in ("NL", "DEDENT"):
        kinds.append("NL")
        starts.append(n)
    for _ in levels[1:]:
        kinds.append("DEDENT")
        starts.append(n)
    kinds.append("EOF")
    starts.append(n)
    return out


_PY_QUOTE = re.compile(r"[A-Za-z]*(\"\"\"|'''|\"|')")


def _formatted(text: str, at: int) -> int:
    """The end of a format string whose substitutions hold quotes, or -1."""
    m = _PY_QUOTE.match(text, at)
    quote, i, n = m.group(1), m.end(), len(text)
    raw = "r" in text[at:m.start(1)].lower()
    while i < n:
        if text.startswith(quote, i):
            return i + len(quote)
        c = text[i]
        if c == "\\" and not raw:
            i += 2
        elif c == "{" and text.startswith("{{", i):
            i += 2
        elif c == "{":
            level, i = 1, i + 1
            while i < n and level:
                c = text[i]
                if c in "\"'":
                    start = i
                    while start > 0 and text[start - 1].isalpha() and i - start < 2:
                        start -= 1
                    if "f" in text[start:i].lower():
                        i = _formatted(text, start)
                    else:
                        s = _PY.match(text, i)
                        i = s.end() if s and s.lastgroup == "STR" else -1
                    if i < 0:
                        return -1
                    continue
                level += (c in "{[(") - (c in "}])")
                i += 1
        elif c == "\n" and len(quote) == 1:
            return -1
        else:
            i += 1
    return -1


_TOML_STR = r'''"""[^"\\]*(?:(?:\\(?:[btnfre"\\]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n)|"(?!"")|""(?=""""?(?!")))[^"\\]*)*"{3,5}|\'\'\'[^']*(?:'(?!'')[^']*)*'{3,5}|"[^"\\\n\r\x00-\x08]*(?:\\(?:[btnfre"\\]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})[^"\\\n\r\x00-\x08]*)*"|'[^'\n\r]*\''''
_TOML_KEY = re.compile(rf'''(?P<ws>[ \t]+)|(?P<com>\#[^\n]*)|(?P<nl>\r?\n)|(?P<KEY>[A-Za-z0-9_-]+|"[^"\\\n\r]*(?:\\.[^"\\\n\r]*)*"|'[^'\n\r]*')|(?P<op>\[\[|\]\]|[\[\]=.,{{}}])''')
_TOML_VALUE = re.compile(rf'''(?P<ws>[ \t]+)|(?P<com>\#[^\n]*)|(?P<nl>\r?\n)|(?P<VAL>{_TOML_STR}|(?:true|false)(?!\w)|\d{{4}}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?|[+-]?(?:inf|nan)|0x[0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*|[+-]?(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w.:+-])|(?P<op>[\[\],{{}}])''')


def toml(text: str) -> Tokens:
    """Keys and values are told apart by where they stand; NL only where it ends something."""
    out = Tokens()
    kinds, starts = out.kinds, out.starts
    at, n = (1 if text.startswith("\ufeff") else 0), len(text)
    nest: list[str] = []  # open arrays and inline tables of a value
    value = False
    while at < n:
        m = (_TOML_VALUE if value else _TOML_KEY).match(text, at)
        if m is None:
            raise _unfit(text, at)
        group, end = m.lastgroup, m.end()
        if group == "nl":
            if not nest:
                if kinds and kinds[-1] != "NL":
                    kinds.append("NL")
                    starts.append(at)
                value = False
        elif group not in ("ws", "com"):
            kind = m.group() if group == "op" else group
            if kind == "=":
                value = True
            elif value and kind == "[":
                nest.append("[")
            elif value and kind == "{":
                nest.append("{")
                value = False
            elif nest and kind in ("]", "]]"):
                if value and nest[-1] == "[":
                    nest.pop()
            elif nest and kind == "}":
                nest.pop()
                value = True
            elif nest and kind == "," and nest[-1] == "{":
                value = False
            kinds.append(kind)
            starts.append(at)
        at = end
    if kinds and kinds[-1] != "NL":
        kinds.append("NL")
        starts.append(n)
    kinds.append("EOF")
    starts.append(n)
    return out
