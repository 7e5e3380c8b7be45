"""Functions paired with their documentation."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import gll, lexers
from codeloom.plans.cut import Workspace
from codeloom.plans.spread import spread
from codeloom.sources.tables import blank, current_rows

# Headers of functions by language; types, defaults and bodies are islands of balanced tokens.
_GRAMMARS = {
    "python": """
        func = decorator* 'async'? 'def' fname generics? '(' params? ')' returns? BODY
        decorator = '@' STUFF GROUP? 'NL' | '@' STUFF dots GROUP? 'NL'
        dots = '.' STUFF | dots '.' STUFF
        fname = NAME
        generics = SQUARE
        params = param | params ',' param | params ','
        param = pname note? default? | '*' | '*' pname note? | '**' pname note? | '/'
        pname = NAME
        note = ':' piece+
        default = '=' piece+
        piece = STUFF | GROUP | SQUARE | CURLY | ':' | '='
        returns = '->' piece+""",
    "rust": """
        func = attr* vis? qualifier* 'fn' fname generics? '(' params? ')' returns? where? ending
        attr = '#' SQUARE
        vis = 'pub' GROUP?
        qualifier = 'const' | 'async' | 'unsafe' | 'extern' | 'STR'
        fname = NAME
        generics = '<' piece* '>'
        params = param | params ',' param | params ','
        param = attr* pattern ':' piece+ | attr* receiver
        receiver = pname | 'mut' pname | '&' 'LIFE'? 'mut'? pname | receiver ':' piece+
        pattern = 'mut'? pname | 'ref' 'mut'? pname | GROUP | STUFF+ GROUP | '&' pattern
        pname = NAME | 'self' | '_'
        piece = STUFF | GROUP | SQUARE | ':' | 'mut' | '<' inner* '>'
        inner = piece | ',' | '='
        returns = '->' piece+
        where = 'where' inner+
        ending = BODY | ';'""",
    "go": """
        func = 'func' GROUP? fname SQUARE? '(' params? ')' result? BODY
        fname = NAME
        params = param | params ',' param | params ','
        param = pname type? | type
        pname = NAME
        type = piece+
        piece = STUFF | GROUP | SQUARE | CURLY
        result = GROUP | type""",
    "java": """
        func = modifier* generics? type fname '(' params? ')' dims* throws? ending
        modifier = WORD | '@' STUFF dots? GROUP?
        dots = '.' STUFF | dots '.' STUFF
        generics = '<' inner* '>'
        type = STUFF targs? dims* | type '.' STUFF targs? dims*
        targs = '<' inner* '>'
        inner = STUFF | '?' | ',' | '&' | '.' | '@' | SQUARE | '<' inner* '>' | 'extends' | 'super'
        dims = SQUARE | '...'
        fname = NAME
        params = param | params ',' param
        param = modifier* type pname dims*
        pname = NAME | 'this'
        throws = 'throws' inner+
        ending = BODY | ';'""",
    "javascript": """
        func = method | declared | arrow
        declared = lead* 'async'? 'function' '*'? fname generics? '(' params? ')' returns? ending
        lead = 'export' | 'default' | 'declare'
        method = WORD* '*'? fname '?'? generics? '(' params? ')' returns? ending
        arrow = lead* binder fname note? '=' 'async'? generics? '(' params? ')' returns? '=>' BODY
        binder = 'const' | 'let' | 'var'
        fname = NAME | 'PRIV'
        generics = '<' inner* '>'
        params = param | params ',' param | params ','
        param = WORD* '...'? target '?'? note? default?
        target = pname | CURLY | SQUARE
        pname = NAME | 'this'
        note = ':' piece+
        default = '=' piece+
        piece = STUFF | GROUP | SQUARE | CURLY | '<' inner* '>' | '?' | ':' | '=>' | '=' | '...'
        inner = piece | ','
        returns = ':' part+
        part = STUFF | GROUP | SQUARE | '<' inner* '>' | '?' | ':' | '=>'
        ending = BODY | ';'""",
}
_GRAMMARS["typescript"] = _GRAMMARS["javascript"]
_CLOSED = frozenset(", ) ( [ ] { } EOF NL INDENT DEDENT ;".split())
_CLASSES = {
    "python": {"NAME": (frozenset(["ID"]) | lexers.PY_SOFT, False), "STUFF": (_CLOSED | frozenset(": = ->".split()), True)},
    "rust": {"NAME": (frozenset(["ID"]), False), "STUFF": (_CLOSED | frozenset(": < > = where # self mut ref".split()), True)},
    "go": {"NAME": (frozenset(["ID"]), False), "STUFF": (_CLOSED | frozenset(["func"]) - frozenset(["func"]), True)},
    "java": {"NAME": (frozenset(["ID"]) | lexers.JAVA_SOFT, False), "STUFF": (frozenset(["ID", "void", "int", "long", "char", "byte", "short", "float", "double", "boolean"]) | lexers.JAVA_SOFT, False), "WORD": (frozenset("public private protected static final abstract synchronized native default strictfp transient volatile".split()), False)},
    "javascript": {"NAME": (frozenset(["ID"]) | lexers.JS_SOFT | lexers.TS_SOFT, False), "STUFF": (_CLOSED | frozenset(": < > = => ? ... function return if for while switch catch".split()), True), "WORD": (frozenset("async static get set public private protected readonly override abstract accessor".split()), False)},
}
_CLASSES["typescript"] = _CLASSES["javascript"]


@lru_cache(None)
def _grammar(language: str) -> gll.Grammar:
    text = "\n".join(line.strip() for line in _GRAMMARS[language].strip().split("\n"))
    return gll.Grammar(text, _CLASSES[language], "func")


def tolerant(language: str, text: str) -> lexers.Tokens:
    """The tokens of a text, however broken: what is no token is left out, and lexing goes on behind it, in one pass."""
    return getattr(lexers, language)(text, recover=True)


def _groups(kinds: list[str], python: bool) -> dict[str, dict[int, int]]:
    """Jumps over balanced groups; a stray closer ends nothing, an open group has no jump."""
    close = {")": "(", "]": "[", "}": "{"}
    out = {"GROUP": {}, "SQUARE": {}, "CURLY": {}, "BODY": {}}
    name = {"(": "GROUP", "[": "SQUARE", "{": "CURLY"}
    stack: list[tuple[str, int]] = []
    for i, k in enumerate(kinds):
        if k in "([{" and k in name:
            stack.append((k, i))
        elif k in close:
            # a closer of another kind: the groups opened since its own opener were never closed
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == close[k]:
                    at = stack[depth][1]
                    del stack[depth:]
                    out[name[close[k]]][at] = i + 1
                    if close[k] == "{" and not python:
                        out["BODY"][at] = i + 1
                    break
    if python:
        levels: list[int] = []
        closes: dict[int, int] = {}
        for i, k in enumerate(kinds):
            if k == "INDENT":
                levels.append(i)
            elif k == "DEDENT" and levels:
                closes[levels.pop()] = i + 1
        for at in levels:
            closes[at] = len(kinds) - 1
        line_end = len(kinds) - 1
        for i in range(len(kinds) - 1, -1, -1):
            if kinds[i] == "NL":
                line_end = i
            elif kinds[i] == ":":
                if line_end == i + 1 and i + 2 < len(kinds) and kinds[i + 2] == "INDENT":
                    out["BODY"][i] = closes[i + 2]
                elif line_end > i + 1:
                    out["BODY"][i] = min(line_end + 1, len(kinds))
    return out


_START = frozenset("; { } NL INDENT DEDENT".split())
#: Tokens that introduce a function wherever they stand.
_LEADS = frozenset("def fn func function".split())


def _places(language: str, text: str, tokens: lexers.Tokens) -> list[int]:
    """Where a declaration may start: behind what ends another and behind commas, at the first token of each line, at a leading keyword."""
    kinds, at = tokens.kinds, tokens.starts
    behind = _START | {","} | ({"]"} if language == "rust" else set())  # attributes end in ]
    return [i for i, k in enumerate(kinds) if k != "EOF" and (i == 0 or kinds[i - 1] in behind or k in _LEADS or text.find("\n", at[i - 1], at[i]) >= 0 or text.find("\r", at[i - 1], at[i]) >= 0)]


def find_functions(language: str, text: str) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, name, parameter names) of the functions in a text, nested ones included, valid ones also out of broken files.

    All places where a declaration may start are parsed at once on one graph-structured stack; whatever isn't a
    function there dies out, and parsing of the others goes on.
    """
    tokens = tolerant(language, text)
    kinds = tokens.kinds
    parse = gll.Parse(_grammar(language), kinds, _groups(kinds, language == "python"))
    starts = _places(language, text, tokens)
    parse.run(starts)
    found = []
    limits = tokens.starts
    script = language in ("javascript", "typescript")

    def word(i: int) -> str:
        end = limits[i + 1] if i + 1 < len(limits) else len(text)
        m = re.match(r"#?[\w$]+", text[limits[i]:end])
        return m.group() if m else ""

    used: set[int] = set()
    for s in starts:
        ends = parse.matches(s)
        if not ends:
            continue
        end = ends[-1]
        parts = parse.parts("func", s, end, frozenset(["fname", "pname"]))
        names = [p for p in parts if p[0] == "fname"]
        if not names or names[0][1] in used:
            continue
        if script and names[0][1] == s and kinds[end - 1] == ";" and ":" not in kinds[s:end]:
            continue  # a call
        used.add(names[0][1])
        stop = limits[end - 1]
        if kinds[end - 1] in ("DEDENT", "NL", "EOF"):
            stop = len(text[:stop].rstrip())
        else:
            stop += 1
        found.append((limits[s], stop, word(names[0][1]), [word(p[1]) for p in parts if p[0] == "pname"]))
    return found


@lru_cache(20_000)
def _shape(language: str, kinds: tuple[str, ...]) -> tuple[int, tuple[int, ...]] | None:
    """Places of the name and the parameters in a header's tokens, whose body, if it has one, is its last token.

    The grammar sees kinds alone, so equal headers share one parse.
    """
    tail = {"python": ("NL", "INDENT", "STR", "NL", "DEDENT", "EOF") if kinds[-1] == ":" else ("EOF",)}.get(language, ("}", "EOF") if kinds[-1] == "{" else ("EOF",))
    full = [*kinds, *tail]
    parse = gll.Parse(_grammar(language), full, _groups(full, language == "python"))
    starts = [0] + [i + 1 for i, k in enumerate(kinds[:-1]) if k in _START or k == "]"]
    parse.run(starts)
    for s in starts:
        if ends := parse.matches(s):
            parts = parse.parts("func", s, ends[-1], frozenset(["fname", "pname"]))
            names = [p[1] for p in parts if p[0] == "fname"]
            if names:
                return names[0], tuple(p[1] for p in parts if p[0] == "pname")
    return None


def header(language: str, code: str | None, signature: str | None) -> tuple[str, list[str]] | None:
    """(name, parameter names) of a function from its code, else from its signature; None if neither holds a function."""
    if language not in _GRAMMARS:
        return None
    for text, whole in ((code, True), (signature, False)):
        if not text or not text.strip():
            continue
        if language == "python":
            text = text.lstrip()
        if not whole:
            text = text.rstrip().rstrip(":{;").rstrip() + (":" if language == "python" else " {")
        else:
            text = text[:_body_start(language, text)]
        try:
            tokens = tolerant(language, text)
        except RecursionError:
            continue
        kinds = tuple(k for k in tokens.kinds if k not in ("EOF", "INDENT", "DEDENT"))
        starts = [s for s, k in zip(tokens.starts, tokens.kinds) if k not in ("EOF", "INDENT", "DEDENT")]
        while kinds and kinds[-1] == "NL":
            kinds = kinds[:-1]
        if not kinds:
            continue
        got = _shape(language, kinds)
        if got is not None:
            name = lambda i: (re.match(r"#?[\w$]+", text[starts[i]:]) or [""])[0]
            return name(got[0]), [name(i) for i in got[1]]
    return None


def _body_start(language: str, text: str) -> int:
    """The place behind the token that opens the body: the first brace (or, in Python, colon) outside all brackets."""
    level, i, n = 0, 0, len(text)
    opener = ":" if language == "python" else "{"
    while i < n:
        c = text[i]
        if c in "\"'" and not (language == "rust" and c == "'"):
            end = text.find(c, i + 1)
            i = n if end < 0 else end + 1
            continue
        if c == opener and level == 0:
            return i + 1
        if c in "([{":
            level += 1
        elif c in ")]}":
            level = max(0, level - 1)
        i += 1
    return n


# Marks, directives for tools, tags and placeholders of documentation comments.
_QUOTES = re.compile(r"^\s*[rRbBuU]{0,2}(\"\"\"|''')|(\"\"\"|''')\s*$")
_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\w)|//[/!]?|#+!?|--+|;;+|<!--|%+)?\s*|\s*(?:\*+/|-->)\s*$")
_DIRECTIVE = re.compile(
    r"^\s*@?(?:eslint(?:-\w+)*|tslint|jshint|jscs|prettier-ignore(?:-\w+)?|noinspection|nolint|noqa|nosec|nosonar|pylint|flake8|mypy|pyright|isort|yapf|fmt|type:\s*ignore|ts-(?:ignore|expect-error|nocheck|check)|rustfmt|clippy|allow\(|clang-format|spell-?checker|cspell|istanbul|c8|v8|coverage|pragma|go:\w+|\+build|formatter:\w+|checkstyle|suppresswarnings|stylelint|biome-ignore|deno-lint\S*|jslint|globals?|end-?region|region|sonar\w*|language=\w+|webpackchunkname)\b.*$",
    re.I,
)
_BARE_LINE = re.compile(r"^\s*@(?:since|version|author|copyright|license|see|category|module|namespace|package|memberof|name|function|method|kind|access|group|ingroup|file|date)\b[^a-z]*(?:\S+)?\s*$", re.I)
_PARAM = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|tparam|template|property|prop)(?:\[\w+\])?|:(?:param|arg|argument|parameter|key|keyword|type|var|ivar))\s+(?:\{[^}]*\}\s*)?(?:[\w.*]+\s+(?=\w+:))?\[?([\w$.*]+)(?:=[^\]]*)?\]?\s*:?\s*[-–]?\s*", re.I)
_TAG = re.compile(r"(?:^|(?<=\s))(?:\{?[@\\][A-Za-z][\w-]*\}?|:\w+:)(?:\s*\{[^}]*\})?")
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|examples?|notes?|attributes|keyword args|other parameters|see also|# (?:arguments|returns|panics|errors|examples|safety))\s*:?\s*$", re.I)
_XML = re.compile(r"</?[A-Za-z][^<>]*>")
#: Placeholders, and words that only name the kind of thing or bind others; alone they tell nothing. What else is a template, the corpus tells by its counts.
_PLACEHOLDERS = frozenset("todo fixme xxx tbd wip n a none null doc docs document describe description".split())
_BINDERS = frozenset("a an the of for and is are it its this that to in on by with or as at from be which see above below function functions method methods func fn procedure routine constructor self cls".split())
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def stem(w: str) -> str:
    """A word without the endings that verbs and nouns take."""
    if len(w) > 3:
        if w.endswith("ies"):
            w = w[:-3] + "y"
        elif w.endswith(("sses", "shes", "ches", "xes", "zes")):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("ing") and len(w) > 5:
            w = w[:-3]
            w = w[:-1] if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "ls" else w
        elif w.endswith("ied"):
            w = w[:-3] + "y"
        elif w.endswith("ed") and len(w) > 4:
            w = w[:-2]
            w = w[:-1] if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "ls" else w
    return w[:-1] if len(w) > 3 and w[-1] in "ey" else w


def description(doc: str | None) -> str:
    """A documentation comment without marks, decoration, directives for tools, bare tags and parameter names."""
    if not doc:
        return ""
    kept = []
    text = _QUOTES.sub("", doc.replace("\r\n", "\n").replace("\r", "\n"))
    for line in text.split("\n"):
        line = _MARKS.sub("", _MARKS.sub("", line))
        if not any(c.isalnum() for c in line) or _DIRECTIVE.match(line) or _BARE_LINE.match(line) or _SECTION.match(line):
            continue
        line = _PARAM.sub(lambda m: m.group(1) + ": " if m.end() < len(m.string.rstrip()) else m.group(1), line)
        line = _XML.sub(" ", _TAG.sub(" ", line)).strip()
        if any(c.isalnum() for c in line):
            kept.append(line)
    return "\n".join(kept)


def residue(doc: str | None, name: str | None, params: list[str]) -> str:
    """The words of a documentation comment that aren't those of its function's and parameters' names (inflected or not), placeholders or binders."""
    text = description(doc)
    if not text:
        return ""
    known = set()
    for n in (name, *params):
        known.update(stem(w.lower()) for w in _SPLIT.findall(n or ""))
    whole = {(n or "").lower() for n in (name, *params)}
    out = []
    for word in re.findall(r"[^\W\d_]+(?:'[a-z]+)?", re.sub(r"\b\w*\d\w*\b|\b[A-Za-z_$][\w$]*\b", lambda m: " ".join(_SPLIT.findall(m.group())) if m.group().lower() not in whole else " ", text)):
        w = word.lower()
        if len(w) == 1 and w.isascii():
            continue
        if w not in _PLACEHOLDERS and w not in _BINDERS and stem(w) not in known:
            out.append(w)
    return " ".join(out)


def _documented(symbols: DataFrame) -> DataFrame:
    """Current functions and methods with code and a comment; other rows' texts never leave their partitions."""
    mine = F.lower(F.trim("kind")).isin("function", "method")
    slim = symbols.select("id", "last_indexed", "kind", "language", "name", *[F.when(mine, F.col(c)).alias(c) for c in ("signature", "doc_comment", "code_context", "file_path")])
    now = current_rows(slim, "id", ["kind", "language", "name", "signature", "doc_comment", "code_context", "file_path"])
    return now.filter(mine & ~blank(F.col("code_context")) & ~blank(F.col("doc_comment")))


#: What is left of a comment besides names is a template if it has at most so many words and this share of all documented functions, and at least so many, have it.
RESIDUE_WORDS, RESIDUE_SHARE, RESIDUE_LEAST = 3, 0.001, 8


def documented_functions(symbols: DataFrame, texts: bool = True, share: float = RESIDUE_SHARE, least: int = RESIDUE_LEAST) -> DataFrame:
    """One row per current function or method whose documentation tells more than its names.

    Columns symbol_id, name, language, file_path, params, code, description (the last two only with ``texts``). The header is parsed by a generalised LL parser
    for the names of function and parameters; where code and signature hold no function it reads, the symbol's own
    name alone counts. What is left of the documentation without them (:func:`residue`) is counted by hash over the whole corpus, equal ones
    being folded before the shuffle: nothing left is trivial, and so is a residue of few words that the corpus repeats as a template ("Getter.",
    "Documentation goes here."). In a corpus so small that nothing repeats, only empty residues are trivial.

    Null or blank code or documentation gives no row; a
    null kind is no function; a null or unknown language is parsed by none; of repeated rows the greatest last_indexed counts; rows with null
    id are left out; an empty table gives no rows. Texts are taken whole.
    """
    rows = spread(_documented(symbols), "id")
    extra = ["code", "description"] * texts
    schema = "symbol_id string, name string, language string, file_path string, params array<string>, residue string" + ", code string, description string" * texts

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                got = header((r.language or "").strip().lower(), r.code_context, r.signature)
                params = got[1] if got else []
                names = [*params, got[0]] if got else params
                left = residue(r.doc_comment, r.name, names)
                # a trivial one is only counted, so its texts stay behind
                told = (r.code_context if left else None, description(r.doc_comment) if left else None) if texts else ()
                out.append((r.id, r.name, r.language, r.file_path, params, left, *told))
            yield pd.DataFrame(out, columns=["symbol_id", "name", "language", "file_path", "params", "residue", *extra])

    parsed = Workspace(symbols.sparkSession, "documented").cut(rows.mapInPandas(run, schema), "parsed")
    counts = parsed.groupBy(F.xxhash64("residue").alias("h"), (F.size(F.split("residue", " ")) <= RESIDUE_WORDS).alias("short")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # at most 1 / share rows each, so they can be broadcast whatever the corpus
    templates = counts.crossJoin(F.broadcast(total)).filter(F.col("short") & (F.col("n") >= least) & (F.col("n") > F.col("total") * share)).select("h")
    told = parsed.filter("residue <> ''").join(F.broadcast(templates), F.xxhash64("residue") == F.col("h"), "left_anti")
    return told.drop("residue")


#: A description is a template if this share of all pairs has it word for word, and at least so many.
TEMPLATE_SHARE, TEMPLATE_LEAST = 0.005, 20


def pairs(documented: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_LEAST) -> DataFrame:
    """Code-description pairs without descriptions that the corpus repeats as templates.

    Descriptions are counted by hash over the whole corpus; equal ones are folded before the shuffle. A template's rows are dropped wherever
    they stand, everything else stays.
    """
    key = F.xxhash64(F.lower(F.regexp_replace("description", r"[\W\d_]+", " ")))
    hashed = documented.withColumn("h", key)
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    templates = counts.crossJoin(F.broadcast(total)).filter((F.col("n") >= least) & (F.col("n") > F.col("total") * share)).select("h")
    return hashed.join(templates, "h", "left_anti").drop("h")


def functions_of_files(files: DataFrame) -> DataFrame:
    """Functions extracted from source files with the comment before them or the docstring within, broken files included.

    Columns path, name, params, start_line, end_line, code, description; the last is null without documentation that says
    more than the names. Null and blank contents and languages without a header grammar give no rows; of repeated rows the greatest last_indexed counts.
    """
    rows = current_rows(files, "path", ["language", "content"])
    rows = spread(rows.filter(F.lower(F.trim("language")).isin(*_GRAMMARS) & ~blank(F.col("content"))), "path")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                lang = r.language.strip().lower()
                breaks = [m.start() for m in re.finditer("\n", r.content)]
                for start, end, name, params in find_functions(lang, r.content):
                    code = r.content[start:end]
                    doc = comment_before(lang, r.content, start, breaks) or (docstring(code) if lang == "python" else None)
                    said = description(doc) if residue(doc, name, params) else None
                    out.append((r.path, name, params, bisect_left(breaks, start) + 1, bisect_left(breaks, end) + 1, code, said))
            yield pd.DataFrame(out, columns=["path", "name", "params", "start_line", "end_line", "code", "description"])

    return rows.select("path", "language", "content").mapInPandas(run, "path string, name string, params array<string>, start_line int, end_line int, code string, description string")


def comment_before(language: str, text: str, start: int, breaks: list[int]) -> str | None:
    """The comment block that ends right before a position; ``breaks`` are the places of the text's line ends."""
    i = bisect_left(breaks, start)

    def line(k: int) -> str:
        return text[breaks[k - 1] + 1 if k else 0:breaks[k]].strip()

    if i < 1:
        return None
    if (last := line(i - 1)).endswith("*/") and language != "python":
        at = text.rfind("/*", 0, start)
        return text[at:start].strip() if at >= 0 else None
    mark = "#" if language == "python" else "//"
    took = []
    while i > 0 and (last := line(i - 1)).startswith(mark):
        took.append(last)
        i -= 1
    return "\n".join(reversed(took)) or None


def docstring(code: str) -> str | None:
    """The string that stands first in a Python function."""
    at = _body_start("python", code)
    m = re.match(r"\s*(?:#[^\n]*\n\s*)*([rRuU]?(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\n]*\"|'[^'\n]*'))", code[at:])
    return m.group(1) if m else None
