"""Lexical retrieval: tokens, BM25 over fields, relaxation, reranking, line search."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.naming import compact
from codeloom.functions.paths import basename
from codeloom.plans.cut import Workspace

K1, B = 1.2, 0.75
# Field boosts and group weights of the unified sweep.
FIELD_BOOSTS = {"name": 4.0, "signature": 2.0, "path_text": 1.5, "doc_comment": 1.5, "relationship_text": 1.5, "pretokenized_code": 1.5, "code_body": 1.0, "content": 1.0}
GROUP_WEIGHTS = {"original": 5.0, "alias": 3.5, "normalized": 2.5}
KIND_BOOST = {"function": 60, "method": 60, "class": 50, "struct": 50, "trait": 50, "interface": 50, "enum": 40, "type": 40, "module": 30, "namespace": 30, "import": 5, "export": 5}
OTHER_KIND_BOOST = 20
EXACT_TITLE, PARTIAL_TITLE, PATH, PATH_FRAGMENT, BODY = 100, 50, 40, 25, 10
PHRASE, PHRASE_FILE, PHRASE_SOURCE, PHRASE_TERMS = 260, 120, 50, 4
INTENT_TITLE, INTENT_ROLE = 180, 120
FILE_BASENAME, FILE_KIND, FILE_TERM, BASENAME_TERM, PATH_SEGMENT, PATH_FULL = 120, 30, 30, 40, 160, 180
ROLE_PENALTY = 130
OVERFETCH, LEAST_CANDIDATES = 4, 500
_DELIMITERS = r"\s(){}\[\]<>,;\"'!@#$%^&*+=|~/\\`.\-:"


# --- tokens -----------------------------------------------------------------
def tokenize(text: str, preserve: tuple[str, ...] = (), affixes: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> list[str]:
    """Tokens of code: each segment whole, its camel and snake parts, its variants without known affixes.

    Variants are told once per segment; preserved operators are tokens of their own. Affixes match in the case given.
    """
    out: list[str] = []
    keep = "|".join(re.escape(p) for p in sorted(preserve, key=len, reverse=True))
    pattern = re.compile((f"({keep})|" if keep else "()") + f"([^{_DELIMITERS}]+?)(?=[{_DELIMITERS}]|$" + (f"|{keep}" if keep else "") + ")")
    for m in pattern.finditer(text):
        if m.group(1):
            out.append(m.group(1).lower())
            continue
        seg = m.group(2)
        if not seg or not all(c.isalnum() or c == "_" for c in seg):
            continue
        seen = [seg.lower()]

        def give(x: str, seen=seen):
            if x and x not in seen:
                seen.append(x)

        if any(c.isupper() for c in seg) and any(c.islower() for c in seg):
            for part in camel_split(seg):
                give(part.lower())
        if "_" in seg:
            for part in seg.split("_"):
                give(part.lower())
        for a in affixes:
            for rest in ([seg[len(a):]] if seg.startswith(a) else []) + ([seg[:-len(a)]] if seg.endswith(a) else []):
                if len(rest.encode()) >= 2:
                    give(rest.lower())
        for p in prefixes:
            if seg.startswith(p) and len(seg) > len(p) and seg[len(p)].isupper():
                give(seg[len(p):].lower())
        for s in suffixes:
            if seg.endswith(s) and len(seg) > len(s):
                give(seg[:-len(s)].lower())
        out += seen
    return out


def camel_split(s: str) -> list[str]:
    """F10 for one string."""
    cuts = [i for i in range(1, len(s)) if (s[i - 1].islower() and s[i].isupper()) or (i + 1 < len(s) and s[i - 1].isupper() and s[i].isupper() and s[i + 1].islower())]
    return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)]) if a < b]


def code_tokens(text: Column, **config) -> Column:
    """:func:`tokenize` as an Arrow-batched column, for indexing with variants."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: tokenize(x, **config) if x else [])

    return run(text)


def plain_tokens(text: Column) -> Column:
    """lower-case runs of letters, digits and ``_``, in the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def pretokenized(text: Column) -> Column:
    """words of a text followed by the parts of identifiers."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            out = []
            for word in x.split():
                seen = {word.lower()}
                out.append(word)
                parts = camel_split(word) if word.lower() != word and word.upper() != word else []
                parts += [p for p in word.split("_") if p] if "_" in word else []
                for p in parts:
                    if p.lower() not in seen:
                        seen.add(p.lower())
                        out.append(p)
            return " ".join(out)

        return s.map(lambda x: one(x) if x is not None else None)

    return run(text)


# --- queries ----------------------------------------------------------------
# The words that route a query, and phrases that stand for others.
KIND_WORDS = {"function": "function", "method": "method", "class": "class", "struct": "struct", "trait": "trait", "interface": "interface", "enum": "enum", "module": "module", "type": "type"}
TEST_WORDS = frozenset("test tests spec specs fixture fixtures conftest".split())
PHRASES = {
    ("workspace", "routing"): ("router", "registry"),
    ("symbol", "extraction"): ("symbols", "extractor", "indexer"),
    ("dependency", "graph"): ("references", "imports", "edges"),
    ("call", "trace"): ("callers", "callees", "stack"),
    ("index", "refresh"): ("reindex", "rebuild", "backfill"),
    ("semantic", "search"): ("relevance", "ranking", "retrieval"),
    ("reference", "lookup"): ("xref", "findrefs", "navigation"),
}


@dataclass
class Query:
    """A parsed query: original terms, alias and normalised ones, intent and annotation keys."""

    raw: str
    terms: list[str] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)
    normalized: list[str] = field(default_factory=list)
    intent: str = "free"
    annotations: list[str] = field(default_factory=list)

    def groups(self) -> list[tuple[str, str, float]]:
        return [(t, g, GROUP_WEIGHTS[g] / GROUP_WEIGHTS["original"]) for g, ts in (("original", self.terms), ("alias", self.aliases), ("normalized", self.normalized)) for t in ts]


def normalized_term(term: str) -> str | None:
    """without ``ing`` (five letters left) or a plural ``s`` (four left)."""
    if term.endswith("ing") and len(term) - 3 >= 5:
        return term[:-3]
    if term.endswith("s") and len(term) - 1 >= 4 and not term.endswith("ss"):
        return term[:-1]
    return None


def is_natural(query: str) -> bool:
    """at least two words, of which not all look like identifiers."""
    words = query.split()
    looks = lambda w: "_" in w or (any(c.islower() for c in w) and any(c.isupper() for c in w))
    return len(words) >= 2 and not all(looks(w) for w in words) and any(c.isascii() and c.isalpha() for w in words for c in w)


def has_test_intent(query: str) -> bool:
    """F18."""
    return any(w in TEST_WORDS or w.startswith(("test_", "spec_")) or w.endswith(("_test", "_tests", "_spec", "_specs")) for w in query.lower().split())


def parse_query(text: str) -> Query:
    """Annotation keys apart, terms once each, aliases for phrases (natural language only), normal forms; at most eight additions."""
    q = Query(text)
    rest = []
    for w in text.split():
        bare = w.strip(",;")
        m = re.fullmatch(r"#\[(.+)\]|\[\[(.+)\]\]|\[(.+)\]|@(.+)", bare)
        if m:
            key = next(x for x in m.groups() if x).split("(")[0].strip().lower()
            if key not in q.annotations:
                q.annotations.append(key)
        else:
            rest.append(w)
    words = rest
    if len(words) >= 3 and words[0].lower() in KIND_WORDS:
        q.intent, words = KIND_WORDS[words[0].lower()], words[1:]
    elif len(words) >= 3 and words[0].lower() in TEST_WORDS:
        q.intent, words = "test", words[1:]
    tokens = list(dict.fromkeys(t for w in words for t in tokenize(w)))
    q.terms = [t for t in tokens if not ("_" in t and all(p in tokens for p in t.split("_") if p))]
    if is_natural(text):
        low = [w.lower() for w in words]
        q.aliases = [a for pair, names in PHRASES.items() if pair in zip(low, low[1:]) for a in names if a not in q.terms]
    q.normalized = [n for n in dict.fromkeys(map(normalized_term, q.terms)) if n and n not in q.terms and n not in q.aliases]
    room = 8
    q.aliases = q.aliases[:room]
    q.normalized = q.normalized[:room - len(q.aliases)]
    return q


def rrf_weights(query: str) -> tuple[float, float]:
    """F16: weights of (keyword, semantic) ranks by the query's class."""
    words = query.split()
    if len(words) == 1 and re.fullmatch(r"[\w.:]+", query.strip()):
        return 1.0, 0.3
    return (0.5, 1.0) if is_natural(query) and not any("_" in w or re.search("[a-z][A-Z]", w) for w in words) else (0.8, 0.8)


def preprocess(query: str) -> str:
    """glob, pattern, symbol or standard."""
    if re.search(r"[*?]|\{.*,.*\}", query) and " " not in query:
        return "glob"
    if re.search(r"[\[\](){}<>=;]|=>|->|::<", query):
        return "pattern"
    return "symbol" if re.fullmatch(r"[A-Za-z_][\w.:]*", query.strip()) else "standard"


# --- BM25 -------------------------------------------------------------------
def bm25(docs: DataFrame, key: str, fields: dict[str, float], queries: list[Query], tokens=plain_tokens) -> DataFrame:
    """BM25 of every document that a query matches, over weighted fields.

    Per (term, field): boost * group weight / 5 * idf * tf (k1 + 1) / (tf + k1 (1 - b + b len / avg)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and
    avg over all documents. A document is an AND hit if every original term stands in some field; where a query has AND hits only those stay, else all (OR).

    Postings are made for the queries' terms alone, before anything is shuffled; lengths need no postings. Columns query, key, score, mode.
    Null and empty fields have length 0; a query without terms finds nothing.
    """
    spark = docs.sparkSession
    terms = sorted({(qi, t, g, w) for qi, q in enumerate(queries) for t, g, w in q.groups()})
    if not terms:
        return spark.createDataFrame([], f"query int, `{key}` {dict(docs.dtypes)[key]}, score double, mode string")
    wanted = F.array(*[F.lit(t) for t in sorted({t[1] for t in terms})])
    each = [F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("toks")) for f in fields]
    rows = docs.select(key, F.explode(F.array(*each)).alias("x")).select(key, "x.field", "x.toks", F.size("x.toks").alias("len"))
    # one pass over the texts: lengths and the wanted tokens are all that later steps read
    rows = rows.select(key, "field", F.greatest(F.col("len"), F.lit(0)).alias("len"), F.filter("toks", lambda t: F.array_contains(wanted, t)).alias("toks"))
    rows = Workspace(spark, "bm25").cut(rows, "lengths")
    stats = rows.groupBy("field").agg(F.count(F.lit(1)).alias("N"), F.avg("len").alias("avg"))
    post = rows.filter(F.size("toks") > 0).select(key, "field", "len", F.explode("toks").alias("term")).groupBy(key, "field", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    return score_postings(spark, post, stats, key, fields, queries)


def score_postings(spark, post: DataFrame, stats: DataFrame, key: str, fields: dict[str, float], queries: list[Query]) -> DataFrame:
    """The scores of :func:`bm25` from postings (term, field, key, tf, len) of the queries' terms and the statistics (field, N, avg) of all documents."""
    terms = sorted({(qi, t, g, w) for qi, q in enumerate(queries) for t, g, w in q.groups()})
    if not terms:
        return spark.createDataFrame([], f"query int, `{key}` {dict(post.dtypes)[key]}, score double, mode string")
    df = post.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    need = {qi: len(q.terms) for qi, q in enumerate(queries)}
    qt = spark.createDataFrame([(qi, t, g == "original", float(w), need[qi]) for qi, t, g, w in terms], "query int, term string, original boolean, weight double, need int")
    boost = F.create_map(*[F.lit(x) for f, b in fields.items() for x in (f, float(b))])
    # term statistics are as small as the queries, so both go out by broadcast
    weights = df.join(F.broadcast(stats), "field").join(F.broadcast(qt), "term")
    weights = weights.select("query", "term", "field", "original", "need", "avg", (boost[F.col("field")] * F.col("weight") * F.log1p((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    hits = post.join(F.broadcast(weights), ["term", "field"])
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = hits.groupBy("query", key).agg(F.sum(part).alias("score"), F.count_distinct(F.when(F.col("original"), F.col("term"))).alias("found"), F.max("need").alias("need"))
    scored = scored.filter((F.col("found") > 0) | (F.col("need") == 0)).withColumn("full", F.col("found") == F.col("need"))
    any_full = scored.groupBy("query").agg(F.max("full").alias("strict"))
    out = scored.join(F.broadcast(any_full), "query").filter(~F.col("strict") | F.col("full"))
    return out.select("query", key, "score", F.when(F.col("strict"), "and").otherwise("or").alias("mode"))


def top_hits(scored: DataFrame, key: str, limit: int) -> DataFrame:
    """The best documents of each query in a total order."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def rerank(candidates: DataFrame, q: Query) -> DataFrame:
    """adds ``final``: the score with the boosts for titles, paths, bodies, phrases, intents, and the demotion of vendored and generated files.

    Columns needed: score, title, path, kind, role, body, is_file, is_test, is_source.
    """
    title, path, body = F.lower("title"), F.lower("path"), F.lower(F.coalesce("body", F.lit("")))
    raw, compact_query = q.raw.lower(), re.sub(r"[\W_]", "", q.raw.lower())
    base = basename(path)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    is_file = F.col("is_file")
    kind = F.lit(OTHER_KIND_BOOST)
    for k, v in KIND_BOOST.items():
        kind = F.when(F.col("kind") == k, F.lit(v)).otherwise(kind)
    add = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(0)
    final = F.col("score")
    if raw:
        final += add(is_file & F.array_contains(F.split(path, "/"), raw), PATH_SEGMENT)
    fired = F.lit(False)
    if compact_query:
        is_name = (compact(base) == compact_query) | (compact(stem) == compact_query)
        is_title = compact(title) == compact_query
        whole = compact(path) == compact_query
        final += F.when(is_file & is_name, FILE_BASENAME + FILE_KIND).when(is_file & is_title, EXACT_TITLE + FILE_KIND).when(is_file & whole, PATH_FULL + FILE_KIND).otherwise(0)
        fired = ~is_file & is_title & ~title.isin(*(q.terms or [""]))
        final += F.when(fired, F.lit(EXACT_TITLE) + kind).otherwise(0)
    for t in q.terms:
        final += F.when(title == t, EXACT_TITLE).when(title.contains(t), PARTIAL_TITLE).otherwise(0)
        final += F.when(path.contains(t), F.when(is_file, PATH_FRAGMENT).otherwise(PATH)).otherwise(0)
        final += add(body.contains(t), BODY)
        c = re.sub(r"[\W_]", "", t)
        if c:
            final += add(is_file & (compact(stem) == c), FILE_TERM) + add(is_file & (compact(base) == c), BASENAME_TERM)
    if len(q.terms) >= PHRASE_TERMS:
        phrase = body.contains(" ".join(q.terms))
        final += add(phrase, PHRASE) + add(phrase & is_file, PHRASE_FILE) + add(phrase & F.col("is_source") & ~F.col("role").isin("docs", "test", "vendor", "generated"), PHRASE_SOURCE)
    if q.terms:
        near = F.lit(False)
        for t in q.terms:
            near = near | title.contains(t)
        if q.intent == "test":
            final += add(~is_file & near, INTENT_TITLE) + add(~is_file & near & F.col("is_test"), INTENT_ROLE)
        elif q.intent != "free":
            fits = ~is_file & near & (F.col("kind") == q.intent)
            final += add(fits, INTENT_TITLE) + add(fits & ~F.col("is_test"), INTENT_ROLE)
        final += F.when(~is_file & ~fired & (title == q.terms[0]), kind).otherwise(0)
    final -= add(F.col("role").isin("vendor", "generated"), ROLE_PENALTY)
    return candidates.withColumn("final", final)


def promote(hits: DataFrame, query: str, score: str = "final") -> DataFrame:
    """Definitions of exactly that name first (by role, then score), then other exact names, then the rest."""
    from codeloom.operators.catalog import DEFINITION_KINDS

    exact = F.lower("title") == query.lower()
    leaf = F.element_at(F.split(F.lower("title"), r"\."), -1) == query.lower()
    tier = F.when((exact | leaf) & F.col("kind").isin(*DEFINITION_KINDS), 0).when(exact | leaf, 1).otherwise(2)
    place = F.when(F.col("role") == "source", 0).when(F.col("role") == "test", 1).otherwise(2)
    return hits.withColumn("tier", tier).withColumn("place", F.when(tier == 0, place).otherwise(0)).orderBy("tier", F.when(exact, 0).otherwise(1), "place", F.desc(F.round(score, 9)), "title", "path")


def centrality_boost(score: Column, reference: Column) -> Column:
    """F22."""
    return score * (F.lit(1.0) + F.lit(0.3) * F.log1p(F.coalesce(reference, F.lit(0.0))))


def path_prior(score: Column, path: Column, test_intent: bool = False) -> Column:
    """source 1.08, docs 0.92, tests 0.85, fixtures 0.70; tests and fixtures keep their score when asked for."""
    from codeloom.functions.paths import is_docs_path, is_fixture_path, is_test_path

    t = 1.0 if test_intent else 0.85
    return score * F.when(is_fixture_path(path), 1.0 if test_intent else 0.70).when(is_test_path(path), t).when(is_docs_path(path), 0.92).otherwise(1.08)


def language_affinity(score: Column, language: Column, dominant: str | None) -> Column:
    """F24."""
    return score if dominant is None else score * F.when(language != dominant, 0.85).otherwise(1.0)


def pattern_boost(score: Column, signature: Column, patterns: list[str]) -> Column:
    """once by half if a signature holds an important pattern."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(F.contains(signature, F.lit(p)), F.lit(False))
    return F.when(hit, score * 1.5).otherwise(score)


# --- lines ------------------------------------------------------------------
@dataclass
class LineStrategy:
    """How a line must look: a literal in some variants, tokens wanted and unwanted, or any of several names."""

    literal: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)


def literal_variants(text: str) -> list[str]:
    """a literal in the other conventions: ``_`` and ``-`` swapped, flat, camel case split, escapes undone."""
    split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", text)
    out = [text, text.replace("_", "-"), text.replace("-", "_"), re.sub("[_-]", "", text), split, split.replace("_", "-"), re.sub(r"\\([^\w\s])", r"\1", text)]
    return list(dict.fromkeys(x.lower() for x in out if x))


def line_strategy(query: str) -> LineStrategy:
    """quotes make a literal, ``A OR B`` a choice, ``-word`` an exclusion; a single compound term is a literal too."""
    q = query.strip()
    if len(q) > 1 and q[0] == q[-1] and q[0] in "\"'":
        return LineStrategy(literal=[q[1:-1].lower()])
    branches = re.split(r"\s+OR\s+", q)
    if len(branches) > 1 and all(re.fullmatch(r"[\w.:]+", b) for b in branches):
        return LineStrategy(any_of=[b.lower() for b in branches])
    words = q.split()
    if len(words) == 1 and (re.search(r"[^\w]", q) or re.search("[a-z][A-Z]", q) or "_" in q):
        return LineStrategy(literal=literal_variants(q))
    return LineStrategy(required=[w.lower() for w in words if not w.startswith("-")], excluded=[w[1:].lower() for w in words if w.startswith("-") and len(w) > 1])


def line_matches(line: Column, s: LineStrategy) -> Column:
    """F32, F43, F44."""
    low = F.lower(line)
    if s.literal:
        hit = F.lit(False)
        for v in s.literal:
            hit = hit | low.contains(v)
        return hit
    toks = plain_tokens(line)
    if s.any_of:
        return F.arrays_overlap(toks, F.array(*[F.lit(x) for x in s.any_of]))
    hit = F.lit(bool(s.required))
    for w in s.required:
        hit = hit & F.array_contains(toks, w)
    for w in s.excluded:
        hit = hit & ~F.array_contains(toks, w)
    return hit


def phrase_match(line: Column, phrase: str) -> Column:
    """a contiguous run of tokens, punctuation being space."""
    p = " ".join(re.findall(r"\w+", phrase.lower()))
    return F.concat(F.lit(" "), F.array_join(plain_tokens(line), " "), F.lit(" ")).contains(f" {p} ")


def line_search(files: DataFrame, query: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, text) of the lines that match, numbered from 1, without trailing carriage returns.

    Files without any of the literal are dropped before they are split into lines.
    """
    s = line_strategy(query)
    rows = files.select(path, content).filter(F.col(content).isNotNull())
    needles = s.literal or s.any_of
    if needles:
        pre = F.lit(False)
        for n in needles:
            pre = pre | F.lower(content).contains(n)
        rows = rows.filter(pre)
    else:
        for n in s.required:
            rows = rows.filter(F.lower(content).contains(n))
    lines = rows.select(path, F.posexplode(F.split(content, "\n")).alias("i", "text"))
    return lines.select(path, (F.col("i") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text")).filter(line_matches(F.col("text"), s))


def line_density(files: DataFrame, query: str, path: str = "path", content: str = "content") -> DataFrame:
    """F33 per file: matching lines, all lines and their ratio."""
    hits = line_search(files, query, path, content).groupBy(path).agg(F.count(F.lit(1)).alias("hits"), F.min("line").alias("first"))
    total = files.select(path, F.size(F.split(content, "\n")).alias("lines"))
    return hits.join(total, path).withColumn("density", F.round(F.col("hits") / F.col("lines"), 6))


def zero_hit_reason(counts: dict[str, int]) -> str | None:
    """the first stage that left nothing."""
    for stage in ("candidates", "language", "file_pattern", "tests", "regions", "lines"):
        if stage in counts and counts[stage] == 0:
            return stage
    return None


def exclude_tests(query: str, file_pattern: str | None = None, explicit: bool | None = None) -> bool:
    """what was asked, else no for patterns and queries that name tests, else yes for natural language."""
    if explicit is not None:
        return explicit
    if file_pattern and re.search(r"(^|/)(tests?|spec|__tests__)(/|$)|_test\.|\.test\.|\.spec\.", file_pattern):
        return False
    return False if has_test_intent(query) else is_natural(query)


def file_scores(files: DataFrame, query: str) -> DataFrame:
    """files whose path holds all of a query's terms: exact path 40, exact name 25, 3 per term of the path."""
    q = query.strip().lower()
    path, name = F.lower("path"), F.lower(basename(F.col("path")))
    toks = plain_tokens(F.col("path"))
    terms = [t for t in dict.fromkeys(re.findall(r"\w+", q))]
    hits = sum((F.when(F.array_contains(toks, t), 3.0).otherwise(0.0) for t in terms), F.lit(0.0))
    out = files.withColumn("score", F.when(path == q, 40.0).otherwise(0.0) + F.when(name == q, 25.0).otherwise(0.0) + hits)
    everything = F.lit(True)
    for t in terms:
        everything = everything & F.array_contains(toks, t)
    return out.filter((everything & F.lit(bool(terms))) | (path == q) | (name == q))


def rescued(scoped: DataFrame, unscoped: DataFrame) -> DataFrame:
    """the hits within a scope, or all hits where it holds none, in one plan; ``rescued`` tells which."""
    none = scoped.agg((F.count(F.lit(1)) == 0).alias("none"))
    rest = unscoped.crossJoin(F.broadcast(none)).filter("none").drop("none").withColumn("rescued", F.lit(True))
    return scoped.withColumn("rescued", F.lit(False)).unionByName(rest)


def semantic_fallback(query: str, hits: int, scoped: bool, backend: str = "default") -> bool:
    """only for the default backend, unscoped, without hits, and a query like an identifier."""
    return hits == 0 and not scoped and backend == "default" and preprocess(query) == "symbol"
