"""Lookups, filters, counts and rankings over the catalogue (B, D, E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import is_fixture_path, is_test_path

#: Rows that a request gets at most.
MOST = 500

DEFINITION_KINDS = ("class", "struct", "interface", "trait", "enum", "function", "method", "constructor", "module", "namespace", "type", "constant", "delegate")
DOCUMENTABLE = ("class", "struct", "interface", "trait", "enum", "function", "method", "module", "namespace", "type")


def lookup(df: DataFrame, key: str, values, order: list | None = None) -> DataFrame:
    """Rows whose key is a value or one of a driver-side list."""
    hit = df.filter(F.col(key).isin(list(values)) if isinstance(values, (list, tuple, set)) else F.col(key) == values)
    return hit.orderBy(*order) if order else hit


def lookup_joined(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key stands in another table, however many keys there are."""
    return df.join(wanted.select(F.col(wanted.columns[0]).alias(key)).distinct(), key, "left_semi")


def like_search(df: DataFrame, pattern: str, columns: list[str], limit: int = 1000, order: tuple = ("name", "file_path", "id")) -> DataFrame:
    """A pattern anywhere in some columns, letters of either case."""
    text = "%" + pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(text), F.lit(False))
    return df.filter(hit).orderBy(*order).limit(limit)


def qualified_suffix(df: DataFrame, name: str, limit: int) -> DataFrame:
    """Definitions whose qualified name ends in ``.name``, the most referenced first."""
    hit = F.lower("name").endswith("." + name.lower()) & (F.col("name") != name) & F.col("kind").isin(*DEFINITION_KINDS)
    return df.filter(hit).orderBy(F.desc_nulls_last("reference_score"), "name", "file_path", "id").limit(limit)


def names_or_members(df: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Rows named N, ``N::...`` or ``N....``: an equi join on the head of the name, then an exact check."""
    n = names.select(F.col(names.columns[0]).alias("__n")).distinct()
    heads = df.withColumn("__head", F.element_at(F.split(column, r"::|\."), 1)).join(n.withColumn("__h", F.element_at(F.split("__n", r"::|\."), 1)), F.col("__head") == F.col("__h"))
    hit = (F.col(column) == F.col("__n")) | F.col(column).startswith(F.concat("__n", F.lit("::"))) | F.col(column).startswith(F.concat("__n", F.lit(".")))
    return heads.filter(hit).drop("__head", "__h", "__n").distinct()


def presence(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Which of the wanted key pairs occur."""
    return wanted.select(*keys).distinct().join(df.select(*keys), keys, "left_semi")


def glob_pattern(pattern: str) -> tuple[list[str], list[str]]:
    """Regular expressions of a glob's including and excluding (``!``) segments, split at commas and bars outside braces.

    Segments without wildcard and separator match a file's name.
    """
    parts, level, now = [], 0, ""
    for c in pattern:
        if c == "{":
            level += 1
        elif c == "}":
            level -= 1
        if c in ",|" and level == 0:
            parts.append(now)
            now = ""
        else:
            now += c
    parts.append(now)
    keep, drop = [], []
    for part in (p.strip() for p in parts):
        if not part:
            continue
        to, text = (drop, part[1:]) if part.startswith("!") else (keep, part)
        if not any(c in text for c in "*?[{/"):
            to.append("(^|/)" + _escape(text) + "$")
            continue
        out, i = "", 0
        while i < len(text):
            c = text[i]
            if text.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
                continue
            if text.startswith("**", i):
                out, i = out + ".*", i + 2
                continue
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c, c if c in "[]" else _escape(c))
            i += 1
        to.append("^" + out + "$")
    return keep, drop


def _escape(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$*+?()[]{}|" else c for c in text)


def glob(path: Column, pattern: str) -> Column:
    keep, drop = glob_pattern(pattern)
    hit = path.rlike("|".join(f"(?:{k})" for k in keep)) if keep else F.lit(True)
    return hit & ~path.rlike("|".join(f"(?:{k})" for k in drop)) if drop else hit


def language_alias(requested: str) -> str:
    """B27."""
    return {"c++": "cpp", "c#": "csharp"}.get(requested.lower(), requested.lower())


def lines_in_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines (file_path, line) that some region (file_path, start_line, end_line) spans: an equi join on the file with a range residual."""
    r = regions.select(F.col("file_path").alias("__f"), "start_line", "end_line")
    return lines.join(r, (lines.file_path == r["__f"]) & (lines.line >= r.start_line) & (lines.line <= r.end_line), "left_semi")


def revision_range(changes: DataFrame, after: int, upto: int) -> DataFrame:
    """The half-open range (after, upto]."""
    return changes.filter((F.col("revision") > after) & (F.col("revision") <= upto))


def recent_files(files: DataFrame, now: int, days: int, limit: int) -> DataFrame:
    """B29, K14."""
    return files.filter(F.col("last_modified") >= now - days * 86400).orderBy(F.desc("last_modified"), "path").limit(limit)


def ranked(df: DataFrame, by: str, limit: int, ties: tuple[str, ...]) -> DataFrame:
    """Top k in a total order."""
    return df.orderBy(F.desc(by), *ties).limit(limit)


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Counts with their share of all rows; counted first, so that the one window sees a row per key."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def documentation_coverage(symbols: DataFrame) -> DataFrame:
    """Documented share of documentable symbols, per language and overall (language null), in one rollup."""
    has = F.coalesce(F.length(F.trim("doc_comment")) > 0, F.lit(False))
    rows = symbols.filter(F.col("kind").isin(*DOCUMENTABLE)).withColumn("language", F.coalesce("language", F.lit("")))
    out = rows.rollup("language").agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("documented"))
    return out.withColumn("percent", F.round(F.col("documented") * 100.0 / F.col("total"), 4))


def undocumented(symbols: DataFrame, limit: int) -> DataFrame:
    """Public documentable symbols without documentation outside tests and fixtures, the most referenced first."""
    bare = ~F.coalesce(F.length(F.trim("doc_comment")) > 0, F.lit(False))
    path = F.col("file_path")
    return symbols.filter((F.col("visibility") == "public") & F.col("kind").isin(*DOCUMENTABLE) & bare & ~is_test_path(path) & ~is_fixture_path(path)).orderBy(F.desc_nulls_last("reference_score"), "name", "file_path", "id").limit(limit)


def first_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """One row per group by a total order. As a minimum of structs it combines before the shuffle, so no group is too hot."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.min(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *rest)).alias("__b")).select(*group, *[F.col(f"__b.{c}") for c in rest])


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def nth_element(df: DataFrame, group: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact elements of the sorted values: index floor(n * q), at most n - 1.

    Equal values are folded first, so what each group sorts are its distinct values with counts.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*group).orderBy(value)
    ranked = counts.withColumn("__upto", F.sum("__c").over(w)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*group)))
    aggs = [F.min(F.when(F.col("__upto") > F.least(F.floor(F.col("__n") * q), F.col("__n") - 1), F.col(value))).alias(name) for name, q in fractions.items()]
    return ranked.groupBy(*group).agg(F.max("__n").alias("n"), *aggs)


def offset_row(df: DataFrame, order: list, fraction: float, value: str) -> DataFrame:
    """The value at offset floor(count * fraction) of a total order, found by an exact percentile of rank."""
    n = df.count()
    k = int(n * fraction)
    return df.orderBy(*order).limit(k + 1).select(value).orderBy(F.asc(value)).limit(1) if n else df.select(value)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows [offset, offset + limit) of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def symbol_lookup(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of the full name, else of parent and leaf, else of the bare leaf: the first tier that holds any, in one plan.

    Columns needed: id, name, parent_id.
    """
    leaf = name.split("::")[-1].split(".")[-1]
    parent = name[: len(name) - len(leaf)].rstrip(":.").split("::")[-1].split(".")[-1]
    owners = symbols.filter(F.col("name") == parent).select(F.col("id").alias("parent_id"), F.lit(True).alias("owned")).distinct()
    rows = symbols.filter(F.col("name").isin(name, leaf)).join(owners, "parent_id", "left")
    rows = rows.withColumn("tier", F.when(F.col("name") == name, 0).when(F.col("owned"), 1).otherwise(2))
    least = rows.agg(F.min("tier").alias("least"))
    return rows.crossJoin(F.broadcast(least)).filter("tier = least").drop("owned", "least")


def limit_roots(sets: DataFrame, group: DataFrame, limit: int) -> DataFrame:
    """(grp, node) of the first ``limit`` roots of each group with all their descendants.

    ``sets`` are nested sets; ``group`` gives (node, grp, place) of the roots' order. Descendants follow by the root's name alone, whatever their depth.
    """
    tops = sets.filter(F.col("depth") == 0).select("node").join(group, "node")
    w = Window.partitionBy("grp").orderBy("place", "node")
    kept = tops.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit).select(F.col("node").alias("__root"), "grp")
    return sets.join(kept, F.col("root") == F.col("__root")).select("grp", "node")


def order_pivots(df: DataFrame, limit: int) -> DataFrame:
    """The first pivots by score, code before the rest, name, path and id, with their rank. Columns needed: id, name, path, score, is_code."""
    top = df.orderBy(F.desc("score"), F.desc("is_code"), "name", "path", "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("is_code"), "name", "path", "id")))


def pivot_counts(df: DataFrame, group: str, score: str) -> DataFrame:
    """E06 for many requests at once: (group, pivots): one if the first score is twice the second, three if the third is at least 0.7 of the first, else two; never more than there are."""
    w = Window.partitionBy(group).orderBy(F.desc(score))
    top = df.filter(F.col(score).isNotNull()).select(group, score, F.row_number().over(w).alias("__r")).filter(F.col("__r") <= 3)
    place = lambda i: F.max(F.when(F.col("__r") == i, F.col(score)))
    per = top.groupBy(group).agg(place(1).alias("a"), place(2).alias("b"), place(3).alias("c"))
    return per.select(group, F.when(F.col("b").isNull() | (F.col("a") >= 2 * F.col("b")), 1).when(F.col("c") >= 0.7 * F.col("a"), 3).otherwise(2).alias("pivots"))


def pattern_ids(observed: DataFrame, text: str, column: str = "pattern") -> DataFrame:
    """The observed patterns (pattern, n) of exactly that id, else those that hold the text in either case, else all: the first tier that holds any, in one plan."""
    low = F.lower(column)
    rows = observed.withColumn("tier", F.when(F.col(column) == text, 0).when(low.contains(text.lower()), 1).otherwise(2))
    least = rows.agg(F.min("tier").alias("least"))
    return rows.crossJoin(F.broadcast(least)).filter("tier = least").drop("least")


def failing_links(linked: DataFrame, failing: list[str], leaves: list[str], paths_column: str = "linked_test_paths", names_column: str = "linked_tests") -> DataFrame:
    """Rows whose JSON arrays of linked tests meet failing tests: a path that ends one with the other, or a name among the leaves. Null and broken arrays meet none."""
    hit = F.lit(False)
    found = F.from_json(paths_column, "array<string>")
    for f in failing:
        hit = hit | F.coalesce(F.exists(found, lambda p: (p == f) | p.endswith("/" + f) | F.lit(f).endswith(F.concat(F.lit("/"), p))), F.lit(False))
    names = F.from_json(names_column, "array<string>")
    for n in leaves:
        hit = hit | F.coalesce(F.array_contains(names, n), F.lit(False))
    return linked.filter(hit)


def story_cards(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row per card: the largest language, kind and folder's file with its share, and the most referenced symbol."""
    def top(card: str, df: DataFrame, key: str) -> DataFrame:
        best = share_of_total(df.filter(F.col(key).isNotNull()), key).agg(F.max_by(F.struct(F.col(key).alias("label"), "n", "share"), F.struct("n", F.col(key))).alias("b"))
        return best.filter(F.col("b").isNotNull()).select(F.lit(card).alias("card"), F.col("b.label").alias("label"), F.round(F.col("b.share") * 100, 1).alias("percent"))

    star = symbols.filter(F.col("reference_score").isNotNull()).agg(F.max_by("name", F.struct("reference_score", "id")).alias("label"))
    star = star.select(F.lit("most_referenced").alias("card"), "label", F.lit(None).cast("double").alias("percent"))
    return top("language", files, "language").unionByName(top("kind", symbols, "kind")).unionByName(top("hotspot", symbols, "file_path")).unionByName(star)


def clamp(limit: int, most: int = MOST) -> int:
    """A request's limit within 1 and the most that is given."""
    return max(1, min(most, limit))


def search_filter(language: str | None = None, kind: str | None = None, file_pattern: str | None = None, no_tests: bool = False) -> Column:
    """The condition on language (aliases too), kind, path and tests that a search asks for; what isn't given says nothing."""
    keep = F.lit(True)
    if language:
        keep = keep & (F.col("language") == language_alias(language))
    if kind:
        keep = keep & (F.col("kind") == kind)
    if file_pattern:
        keep = keep & glob(F.col("file_path"), file_pattern)
    return keep & ~is_test_path(F.col("file_path")) if no_tests else keep


def update_where_exists(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``updates`` (key, column; one row per key) where there is such a row, else as it was."""
    new = updates.select(F.col(key).alias("__k"), F.col(column).alias("__v"), F.lit(True).alias("__there"))
    return df.join(new, F.col(key) == F.col("__k"), "left").withColumn(column, F.when(F.col("__there"), F.col("__v")).otherwise(F.col(column))).drop("__k", "__v", "__there")
