"""Joins that resolve names to things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import directory, is_test_path

CALLABLE = ("function", "method", "constructor")
AMBIGUOUS = 10


def _parent(d: Column) -> Column:
    return F.when(F.instr(d, "/") > 0, F.regexp_replace(d, "/[^/]*$", "")).otherwise(".")


def resolve_calls(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """The best definition for each pending use (id, name, language, file_path).

    Score: 1, +100 for the same language, +50 for the same folder or else +25 for the same parent folder, +10 for a callable, -75 for a test path, at least 0;
    ties go to the last in (language, file_path, id).

    A score is a candidate's own part and a part for what it shares with the caller, so instead of joining all callers of a name with all its
    candidates, each sharing level keeps its best candidate, and six equi joins find the overall best: the work is linear even for a name that
    a third of all rows use.
    """
    own = F.lit(1) + F.when(F.col("kind").isin(*CALLABLE), 10).otherwise(0) - F.when(is_test_path(F.col("file_path")), 75).otherwise(0)
    c = symbols.select("name", F.col("language").alias("lang"), directory(F.col("file_path")).alias("dir"), own.alias("own"), "file_path", "id", F.col("language").alias("tl")).filter(F.col("name").isNotNull())
    c = c.withColumn("par", _parent(F.col("dir")))
    callers = pending.select(F.col("id").alias("use_id"), "name", F.col("language").alias("lang"), directory(F.col("file_path")).alias("dir")).withColumn("par", _parent(F.col("dir")))
    classes = callers.select("name", "lang", "dir", "par").distinct()
    best = classes
    levels = [(["lang", "dir"], 150), (["lang", "par"], 125), (["lang"], 100), (["dir"], 50), (["par"], 25), ([], 0)]
    for i, (keys, bonus) in enumerate(levels):
        top = c.groupBy("name", *keys).agg(F.max(F.struct((F.col("own") + bonus).alias("score"), F.coalesce("tl", F.lit("")).alias("language"), "file_path", "id")).alias(f"b{i}"))
        best = best.join(top, ["name", *keys], "left")
    found = best.select("name", "lang", "dir", F.greatest(*[F.col(f"b{i}") for i in range(len(levels))]).alias("b")).filter(F.col("b").isNotNull())
    joined = callers.alias("u").join(found.alias("f"), (F.col("u.name") == F.col("f.name")) & F.col("u.lang").eqNullSafe(F.col("f.lang")) & F.col("u.dir").eqNullSafe(F.col("f.dir")))
    return joined.select("u.use_id", F.col("f.b.id").alias("symbol_id"), F.greatest(F.lit(0), F.col("f.b.score")).cast("int").alias("score"))


def first_names(pairs: DataFrame, group: str, name: str, most: int) -> DataFrame:
    """The first ``most`` distinct names of each group; the rank filter cuts each task's rows before they meet."""
    w = Window.partitionBy(group).orderBy(name)
    return pairs.distinct().withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def unique_names(symbols: DataFrame) -> DataFrame:
    """Names that one symbol alone has, with its id."""
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter((F.col("n") == 1) & F.col("name").isNotNull()).select("name", "id")


def resolve_unique(uses: DataFrame, column: str, symbols: DataFrame, label: str) -> DataFrame:
    """Uses with the symbol of that name, if just one has it, else a label for something external."""
    one = unique_names(symbols).select(F.col("name").alias("__n"), F.col("id").alias("symbol_id"))
    return uses.join(one, F.col(column) == F.col("__n"), "left").withColumn("external", F.when(F.col("symbol_id").isNull(), F.concat(F.lit(label + ":"), F.col(column)))).drop("__n")


def link_tests(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """Production symbols with the tests that use them: by resolved target, else by name where at most ten symbols of the language have it.

    Columns id, tests, sources, names (at most five, sorted). Names with more candidates are left out as ambiguous; among candidates the smallest id is taken.
    """
    prod = symbols.filter(~is_test_path(F.col("file_path")) & F.col("kind").isin(*CALLABLE))
    tests = symbols.filter(is_test_path(F.col("file_path")) & F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("test_id"), F.col("name").alias("test_name"))
    calls = uses.join(tests, F.col("containing_symbol_id") == F.col("test_id"))
    ids = prod.select(F.col("id").alias("prod_id"))
    by_id = calls.join(ids, F.col("target_symbol_id") == F.col("prod_id")).select("prod_id", "test_id", "test_name", F.lit("resolved").alias("source"))
    named = prod.groupBy("name", "language").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("prod_id")).filter(F.col("n") <= AMBIGUOUS)
    open_calls = calls.filter(F.coalesce(F.trim("target_symbol_id"), F.lit("")) == "").select("name", "language", "test_id", "test_name")
    by_name = open_calls.join(named, ["name", "language"]).select("prod_id", "test_id", "test_name", F.lit("name").alias("source"))
    pairs = by_id.unionByName(by_name).distinct()
    first = first_names(pairs.select("prod_id", "test_name"), "prod_id", "test_name", 5).groupBy("prod_id").agg(F.array_sort(F.collect_list("test_name")).alias("names"))
    counted = pairs.groupBy("prod_id").agg(F.count_distinct("test_id").alias("tests"), F.array_sort(F.collect_set("source")).alias("sources"))
    return counted.join(first, "prod_id").select(F.col("prod_id").alias("id"), "tests", F.array_join("sources", ",").alias("sources"), F.array_join("names", ",").alias("names"))


def partner_names(edges: DataFrame, symbols: DataFrame, max_bytes: int = 2000) -> DataFrame:
    """C17: the names next to each symbol in either direction, distinct, sorted and joined, within a byte limit."""
    ends = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"))).distinct()
    named = ends.join(symbols.select(F.col("id").alias("other"), "name"), "other").filter(F.col("name").isNotNull())
    text = F.array_join(F.array_sort(F.collect_list("name")), " ")
    # a name and its blank take two bytes at least, so later names can't be within the limit
    return first_names(named.select("id", "name"), "id", "name", max_bytes // 2 + 2).groupBy("id").agg(text.alias("partners")).withColumn("partners", F.when(F.octet_length("partners") <= max_bytes, F.col("partners")).otherwise(F.regexp_replace(F.substring("partners", 1, max_bytes), r" \S*$", "")))


def callee_map(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Per function or method the sorted distinct names it calls."""
    f = symbols.filter(F.col("kind").isin("function", "method")).select(F.col("id").alias("from_id"))
    names = symbols.select(F.col("id").alias("to_id"), F.col("name").alias("callee"))
    return edges.filter(F.col("kind") == "calls").join(f, "from_id", "left_semi").join(names, "to_id").select("from_id", "callee").distinct().groupBy(F.col("from_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("callee")), ",").alias("callees"))


def edges_per_file(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges that touch each file: the OR of two equi joins as their union."""
    s = symbols.select("id", "file_path")
    a = edges.select(F.col("id").alias("edge"), F.col("from_id").alias("id"))
    b = edges.select(F.col("id").alias("edge"), F.col("to_id").alias("id"))
    return a.unionByName(b).join(s, "id").groupBy("file_path").agg(F.count_distinct("edge").alias("edges"))


def references(edges: DataFrame, uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """All places that refer to some symbols (id, name, file_path, start_line): edges and uses of the name, one row per file and line, edges first, definitions left out."""
    e = edges.join(definitions.select(F.col("id").alias("to_id")), "to_id").select("file_path", F.col("line_number").alias("line"), F.lit(0).alias("p"), "kind")
    u = uses.join(definitions.select("name").distinct(), "name").select("file_path", F.col("start_line").alias("line"), F.lit(1).alias("p"), "kind")
    d = definitions.select("file_path", F.col("start_line").alias("line")).distinct()
    return e.unionByName(u).join(d, ["file_path", "line"], "left_anti").groupBy("file_path", "line").agg(F.min(F.struct("p", "kind")).alias("b")).select("file_path", "line", F.when(F.col("b.p") == 0, "edge").otherwise("use").alias("source"), "b.kind")


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def match_routes(calls: DataFrame, handlers: DataFrame, least: float = 0.5) -> DataFrame:
    """Client calls (id, verb, path, confidence) with the handler (id, verb, template, confidence) whose template fits.

    ``:x``, ``{x}`` and ``<x>`` fit any one segment. Of several fitting handlers the highest lesser confidence wins; if different ones tie, or
    none fits, the call is external. A handler without verb takes any verb, a call without verb none.

    Handlers are folded by (segment count, verb, template, confidence) with their number first, so equal templates meet a call once; the join
    is on the number of segments and the first fixed segment.
    """
    param = r"^(:.*|\{.*\}|<.*>)$"
    h = handlers.filter(F.col("confidence") >= least).withColumn("segs", _segments(F.col("template")))
    h = h.groupBy("segs", F.upper("verb").alias("verb"), "confidence").agg(F.count_distinct("id").alias("n"), F.min("id").alias("handler"))
    h = h.withColumn("k", F.size("segs")).withColumn("head", F.when(F.try_element_at("segs", F.lit(1)).rlike(param), F.lit("*")).otherwise(F.try_element_at("segs", F.lit(1))))
    c = calls.filter(F.col("confidence") >= least).withColumn("parts", _segments(F.col("path"))).withColumn("kc", F.size("parts"))
    shapes = c.select("parts", "kc", F.upper("verb").alias("cv")).distinct().withColumn("heads", F.array(F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit("")), F.lit("*")))
    probe = shapes.select("parts", "kc", "cv", F.explode("heads").alias("hc"))
    fits = probe.join(h, (F.col("k") == F.col("kc")) & (F.col("head") == F.col("hc")))
    fits = fits.filter(F.forall(F.zip_with("parts", "segs", lambda a, b: b.rlike(param) | (a == b)), lambda x: x) & F.col("cv").isNotNull() & (F.col("verb").isNull() | (F.col("verb") == F.col("cv"))))
    best = fits.select("parts", "cv", F.col("confidence").alias("hconf"), "n", "handler")
    hit = c.withColumn("cv", F.upper("verb")).join(best, ["parts", "cv"], "left").withColumn("conf", F.when(F.col("hconf").isNotNull(), F.least("confidence", "hconf")))
    # handlers of equal confidence are folded first, then the highest confidence is taken
    level = hit.groupBy("id", "verb", "path", "conf").agg(F.sum("n").alias("n"), F.min("handler").alias("handler"))
    per = level.groupBy("id", "verb", "path").agg(F.max(F.struct("conf", "n", "handler")).alias("m"))
    one = F.when((F.col("m.n") == 1) & F.col("m.conf").isNotNull(), F.col("m.handler"))
    label = F.when(F.col("verb").isNotNull() & F.col("path").isNotNull(), F.concat_ws(" ", F.upper("verb"), "path")).otherwise(F.coalesce(F.upper("verb"), "path", F.lit("?")))
    return per.select("id", one.alias("handler_id"), F.when(one.isNull(), label).alias("external"), F.col("m.conf").alias("confidence"))


def changed_files(now: DataFrame, before: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """New, modified, deleted and unchanged paths between two listings."""
    a, b = now.select(F.col(key).alias("a"), F.col(value).alias("av")), before.select(F.col(key).alias("b"), F.col(value).alias("bv"))
    j = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return j.select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("av").eqNullSafe(F.col("bv")), "unchanged").otherwise("modified").alias("state"))


def namespace_score(namespace: Column, module: Column) -> Column:
    """500 if a namespace of the own crate is the candidate's module path, 450 for one of the standard library, 0 without a namespace, null (a veto) otherwise."""
    tail = F.regexp_replace(namespace, "^(crate|std)::", "")
    fits = (module == tail) | module.endswith(F.concat(F.lit("::"), tail))
    return F.when(namespace.isNull() | (namespace == ""), 0).when(namespace.startswith("crate::") & fits, 500).when(namespace.startswith("std::") & fits, 450)


def implementor_map(symbols: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """Per trait or interface the first sorted distinct names of what implements or extends it; an unknown end stays as its id."""
    t = symbols.filter(F.col("kind").isin("trait", "interface")).select(F.col("id").alias("to_id"))
    names = symbols.select(F.col("id").alias("from_id"), "name")
    hit = edges.filter(F.col("kind").isin("implements", "extends")).join(t, "to_id", "left_semi").join(names, "from_id", "left")
    first = first_names(hit.select("to_id", F.coalesce("name", "from_id").alias("n")), "to_id", "n", most)
    return first.groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_list("n")).alias("implementors"))


def parent_context(candidates: DataFrame, uses: DataFrame) -> DataFrame:
    """Whether the caller's file or scope (caller_file, caller_scope) mentions the name of a candidate's parent (parent_name)."""
    by_file = uses.select(F.col("file_path").alias("caller_file"), F.col("name").alias("parent_name")).distinct().withColumn("in_file", F.lit(True))
    by_scope = uses.select(F.col("containing_symbol_id").alias("caller_scope"), F.col("name").alias("parent_name")).distinct().withColumn("in_scope", F.lit(True))
    out = candidates.join(by_file, ["caller_file", "parent_name"], "left").join(by_scope, ["caller_scope", "parent_name"], "left")
    return out.withColumn("in_file", F.coalesce("in_file", F.lit(False))).withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def chase_reexports(pending: DataFrame, reexports: DataFrame, most: int = 8) -> DataFrame:
    """C11: import paths (id, path) with the path that re-exports (path, target) lead to, at most ``most`` steps; rings and paths without re-export stay as they are.

    Steps are joins with the unique re-exports; of several with one path the least target counts.
    """
    step = reexports.filter(F.col("path") != F.col("target")).groupBy(F.col("path").alias("__p")).agg(F.min("target").alias("__t"))
    out = pending.select("id", "path", F.col("path").alias("now"), F.array("path").alias("seen"), F.lit(False).alias("ring"))
    for _ in range(most):
        out = out.join(step, F.col("now") == F.col("__p"), "left")
        ring = F.col("ring") | F.coalesce(F.array_contains("seen", F.col("__t")), F.lit(False))
        out = out.select("id", "path", F.coalesce("__t", "now").alias("now"), F.when(F.col("__t").isNotNull() & (F.size("seen") <= most), F.concat("seen", F.array("__t"))).otherwise(F.col("seen")).alias("seen"), ring.alias("ring"))
    return out.select("id", "path", F.when(F.col("ring"), F.col("path")).otherwise(F.col("now")).alias("resolved"))
