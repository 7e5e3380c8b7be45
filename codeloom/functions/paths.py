"""Roles and weights of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of folders and files by role.
TEST_SEGMENTS = ("test", "tests", "Test", "Tests", "spec", "Spec", "__tests__")
DOCS_SEGMENTS = ("docs", "doc", "documentation", "Docs", "Doc", "Documentation")
FIXTURE_SEGMENTS = ("fixtures", "fixture", "Fixtures", "Fixture", "testdata", "test_data", "test-data", "__fixtures__", "snapshots", "Snapshots", "__snapshots__", "benchmarks", "Benchmarks", "benchmark", "Benchmark")
VENDOR_SEGMENTS = ("node_modules", "vendor", "Vendor", "third_party", "third-party", "deps", "external", "Pods", "bower_components")
GENERATED_SEGMENTS = ("target", "build", "Build", "dist", "out", "bin", "obj", "generated", "Generated", "__generated__", "gen")
DOC_LANGUAGES = ("markdown", "json", "toml", "yaml")


def segment_pattern(words: tuple[str, ...]) -> str:
    return f"(^|/)({'|'.join(words)})(/|$)"


TEST_PATTERN = "|".join([segment_pattern(TEST_SEGMENTS), r"\.Tests?(/|$)", r"\.Tests?\.[^/]*(/|$)", r"_test\.(go|c|cc|cpp)$", r"\.(test|spec)\.(ts|tsx|js|jsx)$", r"(^|/)test_[^/]*\.py$"])


def is_test_path(path: Column) -> Column:
    """H16."""
    return path.rlike(TEST_PATTERN)


def is_docs_path(path: Column) -> Column:
    """H17."""
    return path.rlike(segment_pattern(DOCS_SEGMENTS))


def is_fixture_path(path: Column) -> Column:
    """H18."""
    return path.rlike(segment_pattern(FIXTURE_SEGMENTS))


def is_vendor_path(path: Column) -> Column:
    """H19."""
    return path.rlike(segment_pattern(VENDOR_SEGMENTS))


def is_generated_path(path: Column) -> Column:
    """H20."""
    return path.rlike(segment_pattern(GENERATED_SEGMENTS))


def role(path: Column, language: Column) -> Column:
    """Vendor, generated, test, docs or source, the first that holds."""
    return F.when(is_vendor_path(path), "vendor").when(is_generated_path(path), "generated").when(is_test_path(path), "test").when(is_docs_path(path) | language.isin(*DOC_LANGUAGES), "docs").otherwise("source")


def test_subrole(path: Column) -> Column:
    """Integration, smoke or unit by the first such folder of a test path, else empty."""
    found = F.regexp_extract(path, "(?:^|/)(integration|integration_tests|Integration|smoke|Smoke|unit|Unit)(?:/|$)", 1)
    return F.when(~is_test_path(path) | (found == ""), "").when(found.ilike("integration%"), "integration").otherwise(F.lower(found))


def directory(path: Column) -> Column:
    """The folder of a path, ``.`` at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def common_depth(a: Column, b: Column) -> Column:
    """The number of leading folders that two paths share."""
    both = F.zip_with(F.split(directory(a), "/"), F.split(directory(b), "/"), lambda x, y: x == y)
    upto = F.array_position(F.transform(both, lambda x: F.coalesce(x, F.lit(False))), False)
    return F.when(upto == 0, F.size(both)).otherwise(upto - 1).cast("int")


def relative_path(path: Column, root: str) -> Column:
    """Forward slashes, relative to a workspace's root; other paths stay absolute."""
    clean = F.regexp_replace(path, r"[\\/]+", "/")
    prefix = root.rstrip("/") + "/"
    return F.when(clean.startswith(prefix), F.substring(clean, len(prefix) + 1, 1 << 30)).otherwise(clean)


def suffix_match(path: Column, wanted: str) -> Column:
    """A path equals or ends with a filter's whole components."""
    parts: list[str] = []
    for part in wanted.split("/"):
        if part == "..":
            del parts[-1:]
        elif part not in ("", "."):
            parts.append(part)
    text = "/".join(parts)
    return (path == text) | path.endswith("/" + text)


def directory_weight(path: Column) -> Column:
    """How relevant a path's place is, by words anywhere in it, the first that holds."""
    p = F.lower(path)
    return F.when(p.contains("node_modules") | p.contains("vendor"), 0.1).when(p.contains("docs") | p.contains("documentation"), 0.2).when(p.rlike("(^|/)(tests?|specs?)/|/__tests__/"), 0.4).when(p.contains("src") | p.contains("lib"), 1.0).when(p.contains("__tests__"), 0.4).otherwise(0.7)


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(whether it ignores, regular expression) of each line of an ignore file, in order.

    A rule with a separator before its end is anchored at the root, others match at any depth; one that ends in ``/`` matches folders; ``!`` takes back;
    ``*`` and ``?`` stay within a component, ``**`` doesn't; blank lines and ``#`` comments say nothing.
    """
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        drop, rule = not line.startswith("!"), line.lstrip("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.lstrip("/")
        body, i = "", 0
        while i < len(rule):
            if rule.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif rule.startswith("**", i):
                body, i = body + ".*", i + 2
            else:
                c = rule[i]
                body += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c in "[]" or c.isalnum() or c in "_-" else "\\" + c)
                i += 1
        out.append((drop, ("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)")))
    return out


def is_ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last rule that matches a path ignores it."""
    out = F.lit(False)
    for drop, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(drop)).otherwise(out)
    return out


#: What a walk leaves out besides ignored files: everything that isn't one's own, only the folders of tools, or nothing (to find stale rows).
PROFILES = ("vendor", "full_index", "stale")


def walked(path: Column, rules: list[tuple[bool, str]], profile: str = "full_index") -> Column:
    """Whether a walker's profile visits a path."""
    if profile not in PROFILES:
        raise ValueError(profile)
    if profile == "stale":
        return F.lit(True)
    seen = ~is_ignored(path, rules)
    return seen & ~is_vendor_path(path) & ~is_generated_path(path) if profile == "vendor" else seen
