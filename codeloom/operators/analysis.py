"""Analyses on top of the catalogue: test quality and roles, likely tests, warnings, embedding selection, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths, risk
from codeloom.functions.text import code_only, count_matches, is_placeholder

# What tests are made of, by language-independent patterns, and names that mean something.
ASSERTIONS = r"\b(assert\w*|expect|require|should\w*|verify)\b\s*!?\s*[.(]|\bassert\s"
MOCKS = r"\b(mock\w*|stub\w*|spy\w*|patch|fake\w*)\b\s*[.(]"
ERRORS = r"\b(raises|throws|toThrow|should_panic|assertThrows|unwrap_err|catch|except)\b"
KIND_GROUPS = {"class": "class struct interface trait", "callable": "function method constructor", "module": "module namespace", "type": "type enum"}
EMBEDDABLE = ("function", "method", "class", "struct", "interface", "trait", "enum", "type", "module", "namespace")
NOISE_NAMES = ("i", "j", "k", "x", "y", "tmp", "temp", "val", "value", "data", "item", "result", "res", "ret", "err", "error", "ctx", "self", "this", "args", "opts")
CARRIERS = {"url": "fetch get post put delete request axios open", "sql": "query execute prepare raw select", "route": "route path mount handle use"}
EMBED_CHARS = 1200


def kind_group(kind: Column) -> Column:
    """Kinds that are the same thing in different languages."""
    out = kind
    for group, kinds in KIND_GROUPS.items():
        out = F.when(kind.isin(*kinds.split()), F.lit(group)).otherwise(out)
    return out


def test_quality(symbols: DataFrame) -> DataFrame:
    """Per test function its assertions, mocks and error checks, and the tier that they make."""
    t = symbols.filter(F.col("kind").isin("function", "method") & paths.is_test_path(F.col("file_path")) & F.col("code_context").isNotNull())
    body = F.col("code_context")
    t = t.select("id", count_matches(body, ASSERTIONS).alias("assertions"), count_matches(body, MOCKS).alias("mocks"), (count_matches(body, ERRORS) > 0).alias("errors"))
    return t.withColumn("tier", risk.quality_tier(F.col("assertions"), F.col("mocks"), F.col("errors")))


# Names that are evidence of a test, by language.
EVIDENCE = {
    "python": {"assertions": ("assert", "assertequal", "asserttrue", "assertfalse", "assertin", "assertisnone", "assertraises"), "errors": ("assertraises", "pytest.raises"), "mocks": ("mock", "magicmock", "patch", "mock_open")},
    "rust": {"assertions": ("assert_eq", "assert_ne", "assert", "assert_matches", "debug_assert"), "errors": ("should_err", "should_panic"), "mocks": ()},
    "java": {"assertions": ("assertequals", "asserttrue", "assertfalse", "assertnull", "assertnotnull", "assertthrows", "assertthat"), "errors": ("assertthrows",), "mocks": ("mock", "spy", "when", "verify")},
}


def call_evidence(uses: DataFrame) -> DataFrame:
    """Per container the calls that are assertions, error checks and mocks in its language; only containers with a call have a row. Names count in either case."""
    def is_in(kind: str):
        out = F.lit(False)
        for language, sets in EVIDENCE.items():
            if sets[kind]:
                out = out | ((F.col("language") == language) & F.lower("name").isin(*sets[kind]))
        return out

    calls = uses.filter((F.col("kind") == "call") & F.col("containing_symbol_id").isNotNull())
    return calls.groupBy(F.col("containing_symbol_id").alias("id")).agg(*[F.count_if(is_in(k)).cast("int").alias(k) for k in ("assertions", "errors", "mocks")])


def assess_tests(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """(id, assertions, errors, mocks, tier, evidence, confidence) of test functions.

    A body that is a placeholder is a stub at once; names of calls are evidence where a language has them, else patterns over the code without comments and strings
    are (with less confidence). Symbols outside tests, other kinds and helpers by convention have no row.
    """
    t = symbols.filter(F.col("kind").isin("function", "method") & F.col("code_context").isNotNull())
    t = t.withColumn("role", test_role(F.col("name"), F.col("kind"), F.col("file_path"))).filter(F.col("role") == "test_case")
    t = t.join(call_evidence(uses).withColumnRenamed("assertions", "ca").withColumnRenamed("errors", "ce").withColumnRenamed("mocks", "cm"), "id", "left")
    body = code_only(F.col("code_context"))
    empty = is_placeholder(F.col("code_context"))
    named = F.coalesce(F.col("ca") + F.col("ce") + F.col("cm") > 0, F.lit(False))
    pick = lambda c, pattern: F.when(empty, 0).when(named, F.col(c)).otherwise(count_matches(body, pattern)).cast("int")
    rows = t.select("id", pick("ca", ASSERTIONS).alias("assertions"), pick("ce", ERRORS).alias("errors"), pick("cm", MOCKS).alias("mocks"), F.when(empty, "placeholder").when(named, "calls").otherwise("patterns").alias("evidence"))
    tier = F.when(F.col("evidence") == "placeholder", "stub").otherwise(risk.quality_tier(F.col("assertions"), F.col("mocks"), F.col("errors") > 0))
    return rows.withColumn("tier", tier).withColumn("confidence", F.when(F.col("evidence") == "patterns", 0.5).otherwise(1.0))


def test_role(name: Column, kind: Column, path: Column) -> Column:
    """H37 by convention, as the tables hold no annotations: container, set-up, tear-down, case, helper; null outside tests."""
    n = F.lower(name)
    role = F.when(kind.isin("class", "struct", "module", "namespace"), "test_container").when(n.rlike("^(set_?up|before)"), "fixture_setup").when(n.rlike("^(tear_?down|after)"), "fixture_teardown").when(n.rlike("^test|test$|^should|^it_"), "test_case").when(kind.isin("function", "method"), "test_helper")
    return F.when(paths.is_test_path(path), role)


def literal_carrier(carrier: Column) -> Column:
    """What a literal is by the last part of the call that takes it: url before sql before route, else null."""
    last = F.lower(F.element_at(F.split(carrier, r"::|\."), -1))
    out = F.lit(None).cast("string")
    for kind in reversed(CARRIERS):
        out = F.when(last.isin(*CARRIERS[kind].split()), F.lit(kind)).otherwise(out)
    return out


def path_relevance(path: Column, asks_for_tests: bool = False) -> Column:
    """The place's weight, less for test files unless they are asked for, more for production code."""
    test = paths.is_test_path(path)
    return paths.directory_weight(path) * F.when(test, 1.0 if asks_for_tests else 0.3).otherwise(F.when(paths.directory_weight(path) >= 1.0, 1.2).otherwise(1.0))


def exact_match_boost(name: Column, query: str) -> Column:
    """Equal, starting with, containing at a word's border, containing."""
    n, q = F.lower(name), query.lower()
    return F.when(n == q, 3.0).when(n.startswith(q), 2.0).when(F.concat(F.lit("_"), n, F.lit("_")).contains(f"_{q}_"), 1.5).when(n.contains(q), 1.2).otherwise(1.0)


def variable_signal(name: Column) -> Column:
    """Names with several words count a little more, noise names less."""
    return F.when(name.contains("_") | (F.length(name) >= 12), 0.15).otherwise(0.0) - F.when(F.lower(name).isin(*NOISE_NAMES), 0.5).when(F.length(name) <= 2, 0.25).otherwise(0.0)


def embedding_text(symbols: DataFrame) -> DataFrame:
    """The text to embed of each embeddable symbol outside tests and data languages."""
    s = symbols.filter(F.col("kind").isin(*EMBEDDABLE) & ~paths.is_test_path(F.col("file_path")) & ~F.coalesce(F.col("language").isin(*paths.DOC_LANGUAGES), F.lit(False)))
    first = F.element_at(F.split(F.coalesce("signature", F.lit("")), "\n"), 1)
    return s.select("id", F.substring(F.concat_ws(" ", "kind", "name", first, F.coalesce("doc_comment", F.lit("")), F.concat(F.lit("in: "), "file_path")), 1, EMBED_CHARS).alias("text"))


def seeds(symbols: DataFrame, ids: list[str], files: list[str], changed: DataFrame) -> DataFrame:
    """Symbols by id, by file and by changed file (file_path), imports left out, each once."""
    hit = F.col("id").isin(ids) | F.col("file_path").isin(files)
    by_change = symbols.join(changed.select("file_path").distinct(), "file_path", "left_semi")
    return symbols.filter(hit).unionByName(by_change).filter(~F.coalesce(F.col("kind").isin("import", "export"), F.lit(False))).select("id").distinct()


def likely_tests(seed: DataFrame, symbols: DataFrame, edges: DataFrame, uses: DataFrame) -> DataFrame:
    """Tests for changed symbols: by edge, else by a use of the name, else by a test file that shares the file's stem; the first tier that holds anything, per symbol."""
    s = symbols.join(seed.select("id"), "id", "left_semi").filter(~paths.is_test_path(F.col("file_path"))).select(F.col("id").alias("seed"), F.col("name").alias("sname"), F.col("file_path").alias("spath"))
    tests = symbols.filter(paths.is_test_path(F.col("file_path")) & F.col("kind").isin("function", "method")).select(F.col("id").alias("test"), F.col("file_path").alias("tpath"))
    one = edges.join(s, F.col("to_id") == F.col("seed")).join(tests, F.col("from_id") == F.col("test")).select("seed", "test", F.lit(1).alias("tier"))
    two = uses.join(s.select("seed", "sname"), F.col("name") == F.col("sname")).join(tests.select("test"), F.col("containing_symbol_id") == F.col("test")).select("seed", "test", F.lit(2).alias("tier"))
    stem = lambda c: F.regexp_replace(F.regexp_replace(paths.basename(c), r"\.[^.]*$", ""), "^test_|_test$", "")
    three = s.withColumn("st", stem(F.col("spath"))).filter(F.length("st") >= 8).join(tests.withColumn("st", stem(F.col("tpath"))), "st").select("seed", "test", F.lit(3).alias("tier"))
    found = one.unionByName(two).unionByName(three).groupBy("seed", "test").agg(F.min("tier").alias("tier"))
    best = found.groupBy("seed").agg(F.min("tier").alias("tier"))
    return found.join(best, ["seed", "tier"]).select("seed", "test", "tier")


def test_references(symbols: DataFrame, uses: DataFrame, names: list[str]) -> DataFrame:
    """Tests that use some names, one row per file and container."""
    tests = symbols.filter(paths.is_test_path(F.col("file_path"))).select(F.col("id").alias("containing_symbol_id"))
    return uses.filter(F.col("name").isin(names)).join(tests, "containing_symbol_id", "left_semi").groupBy("name", "file_path", "containing_symbol_id").agg(F.min("start_line").alias("line"))


def warnings(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols to look at: entry points, unreferenced public code, much-used code without documentation."""
    used = edges.select(F.col("to_id").alias("id")).distinct().withColumn("used", F.lit(True))
    s = symbols.filter(F.col("kind").isin("function", "method") & ~paths.is_test_path(F.col("file_path"))).join(used, "id", "left")
    entry = F.lower("name").rlike(r"^(main|run|handle|handler|start|serve)(_|$)")
    bare = ~F.coalesce(F.length(F.trim("doc_comment")) > 0, F.lit(False))
    each = F.array_compact(F.array(F.when(F.coalesce(entry, F.lit(False)), F.lit("entry_point")), F.when((F.col("visibility") == "public") & F.col("used").isNull(), F.lit("unreferenced")), F.when((F.coalesce("reference_score", F.lit(0.0)) >= 5) & bare, F.lit("undocumented_hot"))))
    return s.select("id", F.explode(each).alias("warning"))


def freshness(workspaces: DataFrame, files: DataFrame) -> DataFrame:
    """Whether what was derived of a workspace is as new as its files: missing, stale or ready."""
    newest = files.groupBy("workspace_id").agg(F.max("last_indexed").alias("newest"), F.count(F.lit(1)).alias("files"))
    j = workspaces.select("workspace_id", "last_indexed").join(newest, "workspace_id", "left")
    return j.select("workspace_id", F.coalesce("files", F.lit(0)).alias("files"), F.when(F.col("last_indexed").isNull(), "missing").when(F.col("newest") > F.col("last_indexed"), "stale").otherwise("ready").alias("state"))


def repeated_searches(calls: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """Searches whose words overlap those of the session's search before by at least half of the longer: (id)."""
    w = Window.partitionBy("session_id").orderBy("called_at", "id")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("metadata", F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0)))
    rows = calls.filter(F.col("tool_name").isin(*tools) & F.col("session_id").isNotNull() & F.col("called_at").isNotNull()).withColumn("words", words).withColumn("before", F.lag("words").over(w))
    most = F.greatest(F.size("words"), F.size("before"))
    return rows.filter(F.col("before").isNotNull() & (most > 0) & (F.size(F.array_intersect("words", "before")) * 2 >= most)).select("id")
