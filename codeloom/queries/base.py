"""Registering queries with their SQL."""

from __future__ import annotations

import re

#: Common table expressions that queries' SQL may name: current rows and the graph derived from them.
CTES = {
    "s": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_indexed DESC) AS rn FROM symbols) WHERE rn = 1",
    "f": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_indexed DESC) AS rn FROM files) WHERE rn = 1",
    "i": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_indexed DESC) AS rn FROM identifiers) WHERE rn = 1",
    "ta": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_indexed DESC) AS rn FROM type_arguments) WHERE rn = 1",
    "sr": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_indexed DESC) AS rn FROM source_regions) WHERE rn = 1",
    "tc": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY called_at DESC) AS rn FROM tool_calls) WHERE rn = 1",
    "e": "SELECT i.id, i.containing_symbol_id AS from_id, i.target_symbol_id AS to_id, CASE i.kind WHEN 'call' THEN 'calls' WHEN 'import' THEN 'imports' WHEN 'type_usage' THEN 'uses' WHEN 'member_access' THEN 'uses' ELSE 'references' END AS kind, i.file_path, i.start_line AS line_number, i.confidence FROM i WHERE i.containing_symbol_id IN (SELECT id FROM s) AND i.target_symbol_id IN (SELECT id FROM s)",
}
_NEEDS = {"e": ("s", "i")}
TEST = r"(^|/)(test|tests|Test|Tests|spec|Spec|__tests__)(/|$)|\.Tests?(/|$)|\.Tests?\.[^/]*(/|$)|_test\.(go|c|cc|cpp)$|\.(test|spec)\.(ts|tsx|js|jsx)$|(^|/)test_[^/]*\.py$"


def with_ctes(sql: str) -> str:
    """Puts the common table expressions that a statement names before it."""
    names: list[str] = []

    def need(name):
        for n in _NEEDS.get(name, ()):
            need(n)
        if name not in names:
            names.append(name)

    for name in CTES:
        if re.search(rf"\b(?:FROM|JOIN|IN \(SELECT \w+ FROM)\s+{name}\b", sql):
            need(name)
    sql = sql.replace("@TEST@", TEST)
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {m.group(1) or ''}{head}, {sql[m.end():]}" if m else f"WITH {head} {sql}"


class Area:
    """The queries of one area."""

    def __init__(self):
        self.QUERIES, self.ORACLES = {}, {}

    def __call__(self, sql: str | None = None):
        def put(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLES[f.__name__] = with_ctes(sql)
            return f

        return put
