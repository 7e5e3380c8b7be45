"""Queries on scalar functions and the parsing of queries (A04, A35, B24, E13, F14-F23, F32-F46, H) with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import naming, paths, risk, text
from codeloom.operators import analysis as A
from codeloom.operators import catalog as C
from codeloom.operators import search as S
from codeloom.queries.base import Area
from codeloom.queries.catalog import d24_k13_p95_score
from codeloom.sources import catalogue as T
from codeloom.sources import sinks
from codeloom.sources.tables import table

query = Area()
_NAMES = "(SELECT DISTINCT name FROM s WHERE name IS NOT NULL)"


def _names(spark, d):
    return T.symbols(spark, d, "name").select("name").filter("name is not null").distinct()


_SNAKE = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '(\p{Ll})(\p{Lu})', '\1_\2', 'g'), '([^_\-])(\p{Lu}\p{Ll})', '\1_\2', 'g'), '[_-]+', '_', 'g'), '^_', ''))"
_CAMEL = "array_to_string(list_transform(regexp_split_to_array(name, '[_-]+'), lambda x, i: CASE WHEN i = 1 THEN lower(x[1]) || x[2:] ELSE upper(x[1]) || x[2:] END), '')"


@query(f"SELECT name, {_SNAKE} AS snake, {_CAMEL} AS camel, upper({_CAMEL}[1]) || {_CAMEL}[2:] AS pascal, replace({_SNAKE}, '_', '-') AS kebab, upper({_SNAKE}) AS screaming FROM {_NAMES}")
def h02_h03_h04_h05_h06_conventions(spark, d):
    n = F.col("name")
    return _names(spark, d).select("name", naming.snake_case(n).alias("snake"), naming.camel_case(n).alias("camel"), naming.pascal_case(n).alias("pascal"), naming.kebab_case(n).alias("kebab"), naming.screaming_snake_case(n).alias("screaming"))


@query("""SELECT doc_id, ceil(words * 1.3::DOUBLE)::BIGINT AS words, ceil(tokens * 0.6::DOUBLE + ceil(words * 1.3::DOUBLE) * 0.4::DOUBLE)::BIGINT AS hybrid FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS words,
 ceil(length(text) / CASE WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]') THEN 2.0 ELSE 4.0 END)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL)""")
def h11_h12_word_estimates(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.word_estimate(t).alias("words"), text.hybrid_estimate(t).alias("hybrid"))


_CUT = "CASE WHEN strlen(text) <= 100 THEN text ELSE left(text, list_max(list_filter(range(0, 101), lambda k: strlen(left(text, k::INT)) <= 100))::INT) END"


@query(rf"SELECT doc_id, cut, CASE WHEN strlen(text) <= 100 THEN text WHEN regexp_matches(cut, '[ \t\n\x0B\f\r]') THEN regexp_replace(cut, '[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]*$', '') ELSE cut END AS words FROM (SELECT doc_id, text, {_CUT} AS cut FROM documents WHERE text IS NOT NULL)")
def h14_h15_truncations(spark, d):
    """The first 100 bytes of each text, cut between characters and at white space."""
    t = F.col("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.truncate_bytes(t, 100).alias("cut"), text.truncate_words(t, 100).alias("words"))


def _seg(words) -> str:
    return f"regexp_matches(path, '{paths.segment_pattern(words)}')"


_ROLE = f"CASE WHEN {_seg(paths.VENDOR_SEGMENTS)} THEN 'vendor' WHEN {_seg(paths.GENERATED_SEGMENTS)} THEN 'generated' WHEN regexp_matches(path, '@TEST@') THEN 'test' WHEN {_seg(paths.DOCS_SEGMENTS)} OR language IN ('markdown','json','toml','yaml') THEN 'docs' ELSE 'source' END"


@query(f"SELECT path, {_seg(paths.DOCS_SEGMENTS)} AS docs, {_seg(paths.FIXTURE_SEGMENTS)} AS fixture, {_seg(paths.VENDOR_SEGMENTS)} AS vendor, {_seg(paths.GENERATED_SEGMENTS)} AS generated, {_ROLE} AS role FROM f")
def h17_h18_h19_h20_h21_roles(spark, d):
    p = F.col("path")
    return T.files(spark, d, "language").select("path", paths.is_docs_path(p).alias("docs"), paths.is_fixture_path(p).alias("fixture"), paths.is_vendor_path(p).alias("vendor"), paths.is_generated_path(p).alias("generated"), paths.role(p, F.col("language")).alias("role"))


@query("""SELECT name, lower(name) = 'quota' OR string_split(lower(name), '.')[-1] = 'quota' AS bare, lower(name) = 'a.quota' OR string_split(lower(name), '.')[-1] = 'a.quota' OR ends_with(lower(name), '.a.quota') AS dotted,
 CASE WHEN contains(name, '::') THEN regexp_extract(name, '(?s)^(.*)::(.*)$', 1) WHEN contains(name, '.') THEN regexp_extract(name, '(?s)^(.*)\\.(.*)$', 1) END AS parent,
 CASE WHEN contains(name, '::') THEN regexp_extract(name, '(?s)^(.*)::(.*)$', 2) WHEN contains(name, '.') THEN regexp_extract(name, '(?s)^(.*)\\.(.*)$', 2) ELSE name END AS leaf
 FROM (SELECT DISTINCT name FROM (SELECT name FROM i UNION ALL SELECT name FROM s UNION ALL SELECT replace(path, '/', '.') FROM f UNION ALL SELECT replace(path, '/', '::') FROM f) WHERE name IS NOT NULL)""")
def h23_h25_qualified_names(spark, d):
    names = T.identifiers(spark, d, "name").select("name").unionByName(T.symbols(spark, d, "name").select("name"))
    for mark in (".", "::"):
        names = names.unionByName(T.files(spark, d).select(F.replace("path", F.lit("/"), F.lit(mark)).alias("name")))
    n = F.col("name")
    parent, leaf = naming.qualified(n)
    return names.filter("name is not null").distinct().select("name", naming.name_match(n, "quota").alias("bare"), naming.name_match(n, "A.Quota").alias("dotted"), parent.alias("parent"), leaf.alias("leaf"))


@query("SELECT path, path = 'core/index.ts' OR ends_with(path, '/core/index.ts') AS suffix, CASE WHEN starts_with(path, 'ember-freight/') THEN substr(path, 15) ELSE path END AS relative FROM f")
def h24_a35_paths(spark, d):
    p = F.col("path")
    return T.files(spark, d).select("path", paths.suffix_match(p, "./core/x/../index.ts").alias("suffix"), paths.relative_path(p, "ember-freight/").alias("relative"))


@query("""WITH ab AS (SELECT id, string_split(CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END, '/') AS a, string_split(CASE WHEN contains(other, '/') THEN regexp_replace(other, '/[^/]*$', '') ELSE '.' END, '/') AS b, file_path FROM (SELECT s.id, s.file_path, p.file_path AS other FROM s JOIN (SELECT language, min(file_path) AS file_path FROM s WHERE file_path IS NOT NULL GROUP BY 1) p ON s.language = p.language) WHERE file_path IS NOT NULL)
 SELECT id, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS directory, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda k: k <= least(len(a), len(b)) AND a[1:k] = b[1:k]))::INT AS depth FROM ab""")
def h39_h40_directories(spark, d):
    """The folder of each symbol and how many folders it shares with the first file of its language."""
    s = T.symbols(spark, d, "language", "file_path").filter("file_path is not null")
    first = s.groupBy("language").agg(F.min("file_path").alias("other"))
    return s.join(first, "language").select("id", paths.directory(F.col("file_path")).alias("directory"), paths.common_depth(F.col("file_path"), F.col("other")).alias("depth"))


_KIND = "CASE WHEN kind IN ('function','method','constructor','destructor','operator') THEN 1.0 WHEN kind IN ('class','struct','interface','trait','enum','union','module','namespace','type','delegate') THEN 0.7 WHEN kind IN ('variable','constant','property','field','enum_member','event') THEN 0.3 END::DOUBLE"


@query(f"""WITH n AS (SELECT count(*) AS n FROM s WHERE reference_score IS NOT NULL), r AS (SELECT reference_score, row_number() OVER (ORDER BY reference_score DESC, id) AS rn FROM s WHERE reference_score IS NOT NULL), p AS (SELECT reference_score AS p95 FROM r, n WHERE rn = floor(n * 0.05) + 1),
 x AS (SELECT id, {_KIND} AS k, round(CASE WHEN p95 <= 0 THEN 0.0 ELSE least(1.0, ln(1 + coalesce(reference_score, 0)) / ln(1 + p95)) END, 9)::DOUBLE AS c, CASE visibility WHEN 'public' THEN 'stub' WHEN 'private' THEN 'thorough' WHEN 'protected' THEN 'thin' END AS tier, least(1, greatest(0, coalesce(confidence, 0.5)))::DOUBLE AS cf, CASE visibility WHEN 'public' THEN 1.0 WHEN 'private' THEN 0.2 ELSE 0.5 END::DOUBLE AS v FROM s, p)
 SELECT id, k, c, round(t, 9) AS weakness, round(c * 0.35 + v * 0.25 + t * 0.3 + k * 0.1, 6)::DOUBLE AS risk FROM (SELECT *, 0.5 + (CASE tier WHEN 'stub' THEN 0.9 WHEN 'thin' THEN 0.6 WHEN 'thorough' THEN 0.1 ELSE 1.0 END::DOUBLE - 0.5) * cf AS t FROM x)""")
def h27_h28_h29_h30_risk_parts(spark, d):
    """The parts of the risk score and the score, the tier of a symbol's tests being told from its visibility here."""
    s = T.symbols(spark, d, "kind", "visibility", "reference_score", "confidence").crossJoin(F.broadcast(d24_k13_p95_score(spark, d)))
    v = F.col("visibility")
    tier = F.when(v == "public", "stub").when(v == "private", "thorough").when(v == "protected", "thin")
    s = s.withColumn("k", risk.kind_weight(F.col("kind")).cast("double")).withColumn("c", F.round(risk.centrality(F.coalesce("reference_score", F.lit(0.0)), F.col("p95")), 9)).withColumn("t", risk.test_weakness(tier, F.coalesce("confidence", F.lit(0.5))))
    return s.select("id", "k", "c", F.round("t", 9).alias("weakness"), F.round(risk.risk(F.col("c"), risk.visibility_score(v), F.col("t"), F.col("k")), 6).alias("risk"))


@query("SELECT id, CASE WHEN a = 0 THEN 'stub' WHEN a >= 3 OR e OR (m > 0 AND a >= 2) THEN 'thorough' WHEN a = 1 THEN 'thin' ELSE 'adequate' END AS tier FROM (SELECT id, start_line % 5 AS a, end_line % 3 AS m, coalesce(doc_comment, '') <> '' AND start_line % 7 = 0 AS e FROM s WHERE start_line IS NOT NULL AND end_line IS NOT NULL)")
def h32_quality_tiers(spark, d):
    """The tiers over all combinations of counts, which lines stand in for."""
    s = T.symbols(spark, d, "start_line", "end_line", "doc_comment").filter("start_line is not null and end_line is not null")
    return s.select("id", risk.quality_tier(F.col("start_line") % 5, F.col("end_line") % 3, (F.coalesce("doc_comment", F.lit("")) != "") & (F.col("start_line") % 7 == 0)).alias("tier"))


_NOT_CODE = r"""(?s)/\*.*?\*/|//[^\n]*|(?m:^|[ \t])#[^\n]*|""" + '"""' + r""".*?""" + '"""' + r"""|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|''[^''\\\n]*(?:\\.[^''\\\n]*)*''|`[^`]*`"""


@query(rf"SELECT id, sha256(regexp_replace(code_context, '{_NOT_CODE}', ' ', 'g')) AS code, regexp_matches(lower(trim(regexp_replace(trim(code_context), '(?s)^\{{(.*)\}}$', '\1'))), '^(pass|\.\.\.|todo!\(\)|unimplemented!\(\)|todo|// todo|# todo)( |$)') OR trim(regexp_replace(trim(code_context), '(?s)^\{{(.*)\}}$', '\1')) = '' AS placeholder FROM s WHERE code_context IS NOT NULL")
def h34_h36_code_only(spark, d):
    """A hash of each symbol's code without comments and strings, and whether it is a placeholder."""
    c = F.col("code_context")
    return T.symbols(spark, d, "code_context").filter(c.isNotNull()).select("id", text.content_hash(text.code_only(c)).alias("code"), text.is_placeholder(c).alias("placeholder"))


@query("SELECT id, CASE WHEN x IN ('fetch','get','post','put','delete','request','axios','open') THEN 'url' WHEN x IN ('query','execute','prepare','raw','select') THEN 'sql' WHEN x IN ('route','path','mount','handle','use') THEN 'route' END AS carrier FROM (SELECT id, lower(regexp_split_to_array(coalesce(name, '') || CASE start_line % 4 WHEN 0 THEN '.get' WHEN 1 THEN '::execute' WHEN 2 THEN '.Route' ELSE '' END, '::|\\.')[-1]) AS x FROM i WHERE start_line IS NOT NULL)")
def h38_literal_carriers(spark, d):
    """What a literal would be, if each use, with a call behind most, took it."""
    line = F.col("start_line") % 4
    call = F.concat(F.coalesce("name", F.lit("")), F.when(line == 0, ".get").when(line == 1, "::execute").when(line == 2, ".Route").otherwise(""))
    return T.identifiers(spark, d, "name", "start_line").filter("start_line is not null").select("id", A.literal_carrier(call).alias("carrier"))


_WEIGHT = "CASE WHEN contains(lower(path), 'node_modules') OR contains(lower(path), 'vendor') THEN 0.1 WHEN contains(lower(path), 'docs') OR contains(lower(path), 'documentation') THEN 0.2 WHEN regexp_matches(lower(path), '(^|/)(tests?|specs?)/|/__tests__/') THEN 0.4 WHEN contains(lower(path), 'src') OR contains(lower(path), 'lib') THEN 1.0 WHEN contains(lower(path), '__tests__') THEN 0.4 ELSE 0.7 END::DOUBLE"


@query(f"SELECT path, sha256(content) AS hash, w AS weight, round(w * CASE WHEN t THEN 0.3 WHEN w >= 1 THEN 1.2 ELSE 1.0 END, 6)::DOUBLE AS relevance, round(w * CASE WHEN t THEN 1.0 WHEN w >= 1 THEN 1.2 ELSE 1.0 END, 6)::DOUBLE AS for_tests FROM (SELECT path, content, regexp_matches(path, '@TEST@') AS t, {_WEIGHT} AS w FROM f)")
def h41_h42_h50_path_relevance(spark, d):
    p = F.col("path")
    return T.files(spark, d, "content").select("path", text.content_hash(F.col("content")).alias("hash"), paths.directory_weight(p).cast("double").alias("weight"), F.round(A.path_relevance(p), 6).alias("relevance"), F.round(A.path_relevance(p, True), 6).alias("for_tests"))


# literal frames: the tables hold only text, and queries are a driver's business
_CONTENTS = {"empty": "", "text": "616263", "zero": "610062", "straddling": "50010000", "half": "500150", "late": "61" * 8192 + "00"}


@query("SELECT * FROM (VALUES ('empty', TRUE), ('text', TRUE), ('zero', FALSE), ('straddling', FALSE), ('half', TRUE), ('late', TRUE)) AS t(name, is_text)")
def a04_text_sniff(spark, d):
    rows = spark.createDataFrame(list(_CONTENTS.items()), "name string, h string")
    return rows.select("name", sinks.looks_like_text(F.unhex("h")).alias("is_text"))


_RULES = "# build output\n*.toml\n!/Cargo.toml\ntests/\n/docs/**/old\ngenerated\n"


@query(r"SELECT path, CASE WHEN regexp_matches(path, '(^|/)generated(/|$)') OR regexp_matches(path, '(^|/)tests/') OR regexp_matches(path, '^docs/(?:.*/)?old(/|$)') THEN TRUE WHEN regexp_matches(path, '^Cargo\.toml(/|$)') THEN FALSE ELSE regexp_matches(path, '(^|/)[^/]*\.toml(/|$)') END AS ignored FROM f")
def a01_a02_ignore_rules(spark, d):
    return T.files(spark, d).select("path", paths.is_ignored(F.col("path"), paths.ignore_rules(_RULES)).alias("ignored"))


_IGNORED = "regexp_matches(path, '(^|/)[^/]*\\.lock(/|$)')"


@query(f"SELECT path, NOT {_IGNORED} AS full_index, NOT {_IGNORED} AND NOT {_seg(paths.VENDOR_SEGMENTS)} AND NOT {_seg(paths.GENERATED_SEGMENTS)} AS vendor, TRUE AS stale FROM f")
def a02_walker_profiles(spark, d):
    rules = paths.ignore_rules("*.lock\n")
    return T.files(spark, d).select("path", *[paths.walked(F.col("path"), rules, p).alias(p) for p in ("full_index", "vendor", "stale")])


def _udf(f, kind: str):
    """A driver-side parser over a column of queries, batched."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


_ASKED = r"(SELECT DISTINCT trim(string_split(doc_comment, chr(10))[1]) AS q FROM s WHERE doc_comment IS NOT NULL UNION SELECT DISTINCT name FROM s WHERE name IS NOT NULL)"


def _asked(spark, d):
    """Comments' first lines and names, as queries."""
    s = T.symbols(spark, d, "name", "doc_comment")
    lines = s.filter("doc_comment is not null").select(F.trim(F.split("doc_comment", "\n")[0]).alias("q"))
    return lines.unionByName(s.filter("name is not null").select(F.col("name").alias("q"))).distinct()


_WORDS = r"list_filter(regexp_split_to_array(q, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f\x0b]+'), lambda w: w <> '')"
_LOOKS = r"(contains(w, '_') OR (regexp_matches(w, '\p{Ll}') AND regexp_matches(w, '\p{Lu}')))"
_TESTS = r"regexp_matches(w, '^(test|tests|spec|specs|fixture|fixtures|conftest)$|^(test_|spec_)|(_test|_tests|_spec|_specs)$')"


@query(rf"""WITH a AS (SELECT q, {_WORDS} AS ws FROM {_ASKED}), b AS (SELECT q, len(ws) >= 2 AND len(list_filter(ws, lambda w: NOT {_LOOKS})) > 0 AND regexp_matches(q, '[A-Za-z]') AS nat, len(list_filter(ws, lambda w: {_TESTS.replace('(w,', '(lower(w),')})) > 0 AS tests FROM a)
 SELECT q, nat AS "natural", tests, NOT tests AND nat AS exclude_tests FROM b""")
def f17_f18_f36_query_words(spark, d):
    q = F.col("q")
    return _asked(spark, d).select("q", _udf(S.is_natural, "boolean")(q).alias("natural"), _udf(S.has_test_intent, "boolean")(q).alias("tests"), _udf(S.exclude_tests, "boolean")(q).alias("exclude_tests"))


_PARSED = [
    ("index refresh quota", "index refresh quota", "reindex rebuild backfill", "", "free", ""),
    ("function settle meters", "settle meters", "", "meter", "function", ""),
    ("test routing ledgers now", "routing ledgers now", "", "ledger", "test", ""),
    ("@deprecated mergeToken", "mergetoken merge token", "", "", "free", "deprecated"),
    ("call trace", "call trace", "callers callees stack", "", "free", ""),
    ("symbol extraction workspace routing", "symbol extraction workspace routing", "router registry symbols extractor indexer", "", "free", ""),
    ("scan_beacon", "scan beacon", "", "", "free", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in _PARSED) + ") AS t(q, terms, aliases, normalized, intent, annotations)")
def f14_f15_k05_parsed_queries(spark, d):
    rows = [(r[0], " ".join(p.terms), " ".join(p.aliases), " ".join(p.normalized), p.intent, " ".join(p.annotations)) for r in _PARSED for p in [S.parse_query(r[0])]]
    return spark.createDataFrame(rows, "q string, terms string, aliases string, normalized string, intent string, annotations string")


_CLASSES = [
    ("scanBeacon", 1.0, 0.3, "symbol", False), ("a::b", 1.0, 0.3, "symbol", False), ("where is the quota", 0.5, 1.0, "standard", True), ("merge_token fails", 0.8, 0.8, "standard", False), ("src/*.rs", 0.8, 0.8, "glob", False), ("fn main() {", 0.5, 1.0, "pattern", True),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', {a}::DOUBLE, {b}::DOUBLE, '{k}', {str(k == 'symbol').upper()}) " for q, a, b, k, _ in _CLASSES) + ") AS t(q, keyword, semantic, class, fallback)")
def f16_f37_f38_query_classes(spark, d):
    rows = [(q, *map(float, S.rrf_weights(q)), S.preprocess(q), S.semantic_fallback(q, 0, False)) for q, *_ in _CLASSES]
    return spark.createDataFrame(rows, "q string, keyword double, semantic double, class string, fallback boolean")


_LINES = r"(SELECT path, line::INT AS line, regexp_replace(raw, '\r$', '') AS text FROM (SELECT path, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM f WHERE content IS NOT NULL))"
_TOKS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(rf"""SELECT 'either' AS q, path, line FROM {_LINES} WHERE list_has_any({_TOKS}, ['quota', 'raise']) UNION ALL
 SELECT 'without', path, line FROM {_LINES} WHERE list_contains({_TOKS}, 'return') AND NOT list_contains({_TOKS}, 'self') UNION ALL
 SELECT 'variants', path, line FROM {_LINES} WHERE contains(lower(text), 'goes_below') OR contains(lower(text), 'goes-below') OR contains(lower(text), 'goesbelow')""")
def f32_f42_f45_f46_line_predicates(spark, d):
    """Lines with either of two names, with one word but not another, and with a compound in any convention."""
    files = T.files(spark, d, "content")
    out = None
    for name, q in (("either", "quota OR raise"), ("without", "return -self"), ("variants", "goes_below")):
        hits = S.line_search(files, q).select(F.lit(name).alias("q"), "path", "line")
        out = hits if out is None else out.unionByName(hits)
    return out


@query(r"SELECT path, score::DOUBLE AS score FROM (SELECT path, CASE WHEN lower(path) = 'src quota' THEN 40 ELSE 0 END + CASE WHEN lower(regexp_replace(path, '^.*/', '')) = 'src quota' THEN 25 ELSE 0 END + 6 AS score FROM f WHERE list_has_all(regexp_extract_all(lower(path), '[\p{L}\p{N}_]+'), ['src', 'py']))")
def f05_file_scores(spark, d):
    return S.file_scores(T.files(spark, d).select("path"), "src py").select("path", "score")


@query("WITH sc AS (SELECT id FROM s WHERE language = 'cobol' AND kind = 'class'), al AS (SELECT id FROM s WHERE kind = 'class') SELECT id, FALSE AS rescued FROM sc UNION ALL SELECT id, TRUE FROM al WHERE NOT EXISTS (SELECT * FROM sc)")
def f35_scope_rescue(spark, d):
    classes = T.symbols(spark, d, "language", "kind").filter("kind = 'class'")
    return S.rescued(classes.filter("language = 'cobol'").select("id"), classes.select("id"))


@query("SELECT * FROM (VALUES ('nothing', 'candidates'), ('language', 'language'), ('late', 'lines'), ('none', NULL)) AS t(name, reason)")
def f34_zero_hits(spark, d):
    counts = {"nothing": {"candidates": 0}, "language": {"candidates": 9, "language": 0, "lines": 0}, "late": {"candidates": 9, "language": 4, "file_pattern": 3, "lines": 0}, "none": {"candidates": 2, "lines": 1}}
    return spark.createDataFrame([(k, S.zero_hit_reason(v)) for k, v in counts.items()], "name string, reason string")


@query("""SELECT id, CASE WHEN x AND kind IN ('class','struct','interface','trait','enum','function','method','constructor','module','namespace','type','constant','delegate') THEN 0 WHEN x THEN 1 ELSE 2 END::INT AS tier,
 CASE WHEN x AND kind IN ('class','struct','interface','trait','enum','function','method','constructor','module','namespace','type','constant','delegate') THEN CASE role WHEN 'source' THEN 0 WHEN 'test' THEN 1 ELSE 2 END ELSE 0 END::INT AS place
 FROM (SELECT id, kind, (lower(name) = 'quota' OR string_split(lower(name), '.')[-1] = 'quota') AS x, """ + _ROLE.replace("path", "file_path") + " AS role FROM s WHERE name IS NOT NULL AND file_path IS NOT NULL AND kind IS NOT NULL)")
def e03_promotion(spark, d):
    s = T.symbols(spark, d, "name", "kind", "file_path", "language", "reference_score").filter("name is not null and file_path is not null and kind is not null")
    hits = s.select("id", F.col("name").alias("title"), F.col("file_path").alias("path"), "kind", paths.role(F.col("file_path"), F.col("language")).alias("role"), F.coalesce("reference_score", F.lit(0.0)).alias("final"))
    return S.promote(hits, "Quota").select("id", "tier", "place")


_BOOST = "CASE kind WHEN 'function' THEN 60 WHEN 'method' THEN 60 WHEN 'class' THEN 50 WHEN 'struct' THEN 50 WHEN 'trait' THEN 50 WHEN 'interface' THEN 50 WHEN 'enum' THEN 40 WHEN 'type' THEN 40 WHEN 'module' THEN 30 WHEN 'namespace' THEN 30 WHEN 'import' THEN 5 WHEN 'export' THEN 5 ELSE 20 END"


@query(rf"""WITH x AS (SELECT id, lower(name) AS t, lower(file_path) AS p, lower(coalesce(code_context, '')) AS b, coalesce(kind, '') AS kind, {_ROLE.replace('path', 'file_path')} AS role, regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]', '', 'g') AS c FROM s WHERE name IS NOT NULL AND file_path IS NOT NULL),
 y AS (SELECT *, c = 'settlequota' AND t NOT IN ('settle', 'quota') AS fired FROM x)
 SELECT id, (CASE WHEN fired THEN 100 + {_BOOST} ELSE 0 END
  + CASE WHEN t = 'settle' THEN 100 WHEN contains(t, 'settle') THEN 50 ELSE 0 END + CASE WHEN contains(p, 'settle') THEN 40 ELSE 0 END + CASE WHEN contains(b, 'settle') THEN 10 ELSE 0 END
  + CASE WHEN t = 'quota' THEN 100 WHEN contains(t, 'quota') THEN 50 ELSE 0 END + CASE WHEN contains(p, 'quota') THEN 40 ELSE 0 END + CASE WHEN contains(b, 'quota') THEN 10 ELSE 0 END
  + CASE WHEN NOT fired AND t = 'settle' THEN {_BOOST} ELSE 0 END - CASE WHEN role IN ('vendor', 'generated') THEN 130 ELSE 0 END)::DOUBLE AS final FROM y""")
def f19_f20_rerank_boosts(spark, d):
    """The reranker's boosts of every symbol for one query, on a score of zero."""
    s = T.symbols(spark, d, "name", "kind", "file_path", "language", "code_context").filter("name is not null and file_path is not null")
    p = F.col("file_path")
    rows = s.select("id", F.lit(0.0).alias("score"), F.col("name").alias("title"), p.alias("path"), F.coalesce("kind", F.lit("")).alias("kind"), paths.role(p, F.col("language")).alias("role"), F.col("code_context").alias("body"), F.lit(False).alias("is_file"), paths.is_test_path(p).alias("is_test"), F.lit(True).alias("is_source"))
    return S.rerank(rows, S.parse_query("settle quota")).select("id", F.col("final").cast("double").alias("final"))


@query("SELECT id, round(coalesce(reference_score, 0) * (1.0::DOUBLE + 0.3::DOUBLE * ln(1 + coalesce(reference_score, 0))), 9) AS boosted, CASE WHEN regexp_matches(file_path, '" + paths.segment_pattern(paths.FIXTURE_SEGMENTS) + "') THEN 1.0 WHEN regexp_matches(file_path, '@TEST@') THEN 1.0 WHEN regexp_matches(file_path, '" + paths.segment_pattern(paths.DOCS_SEGMENTS) + "') THEN 0.92 ELSE 1.08 END::DOUBLE AS asked FROM s WHERE file_path IS NOT NULL")
def f22_f23_priors(spark, d):
    s = T.symbols(spark, d, "reference_score", "file_path").filter("file_path is not null")
    r = F.coalesce("reference_score", F.lit(0.0))
    return s.select("id", F.round(S.centrality_boost(r, F.col("reference_score")), 9).alias("boosted"), S.path_prior(F.lit(1.0), F.col("file_path"), True).alias("asked"))


def _like(c: Column, requested: str) -> Column:
    return F.lower(c) == C.language_alias(requested)


@query("SELECT 'b02' AS op, id FROM s WHERE name = 'Quota' UNION ALL SELECT 'b11', id FROM s WHERE language = 'rust' AND kind = 'function' UNION ALL SELECT 'b14', id FROM i WHERE name IN ('Map', 'Set') UNION ALL SELECT 'b20', id FROM e WHERE from_id IN (SELECT id FROM s WHERE kind = 'method') UNION ALL SELECT 'b27', path FROM f WHERE lower(language) = 'rust' UNION ALL SELECT 'b36', id FROM s WHERE metadata IS NOT NULL AND id IN (SELECT from_id FROM e) UNION ALL SELECT 'd15', id FROM s WHERE reference_score IS NOT NULL AND name = 'Quota'")
def b02_b11_b14_b20_b27_b36_d15_lookups(spark, d):
    """Lookups by name, language, many names, many ids and aliases, each with its key."""
    s = T.symbols(spark, d, "name", "kind", "language", "metadata", "reference_score")
    e, named = T.edges(spark, d), lambda op, df, key="id": df.select(F.lit(op).alias("op"), F.col(key).alias("id"))
    parts = [
        named("b02", C.lookup(s, "name", "Quota")), named("b11", C.lookup(C.lookup(s, "language", "rust"), "kind", "function")), named("b14", C.lookup(T.identifiers(spark, d, "name"), "name", ["Map", "Set"])),
        named("b20", C.lookup_joined(e, "from_id", C.lookup(s, "kind", "method").select("id"))), named("b27", T.files(spark, d, "language").filter(_like(F.col("language"), "Rust")), "path"),
        named("b36", C.lookup_joined(s.filter("metadata is not null"), "id", e.select("from_id"))), named("d15", C.lookup(s.filter("reference_score is not null"), "name", "Quota")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES, ORACLES = query.QUERIES, query.ORACLES
