"""Source files that do not parse in the language given for them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import grammars, lexers
from codeloom.plans.spread import spread
from codeloom.sources.tables import current_rows

#: Other names of the languages.
ALIASES = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "node": "javascript", "ts": "typescript", "golang": "go", "rs": "rust"}

_MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)", re.M)
_TEMPLATE = re.compile(r"\{\{.*?\}\}|<%.*?%>|%%\w+%%")


def judge(language: str | None, text: str | None) -> tuple[bool | None, int | None, int | None, str | None]:
    """(valid, line, column, cause) of one text; valid is None where there is nothing to judge.

    Line and column (from 1) are those of the furthest token that didn't fit. Causes: conflict_marker, truncated (the text ends
    too early), open_string, open_comment, stray_character, indentation, unbalanced, template, unexpected_token.
    """
    name = (language or "").strip().lower()
    name = ALIASES.get(name, name)
    if name not in grammars.TEXTS or not text or not text.strip():
        return None, None, None, None
    try:
        tokens = getattr(lexers, name)(text)
        valid, far = grammars.grammar(name).parse(tokens.kinds, tokens.breaks)
        if valid:
            return True, None, None, None
        far = min(far, len(tokens.kinds) - 1)
        at, cause = tokens.starts[far], "truncated" if tokens.kinds[far] == "EOF" else "unexpected_token"
    except lexers.NoToken as e:
        at, cause = e.at, e.cause
    start = text.rfind("\n", 0, at) + 1
    end = text.find("\n", at)
    here = text[start:end if end >= 0 else len(text)]
    before = text.rfind("\n", 0, max(0, start - 1)) + 1
    if _MARKER.match(here) or _MARKER.match(text[before:start]):
        cause = "conflict_marker"
    elif cause == "unexpected_token" and _TEMPLATE.search(here):
        cause = "template"
    return False, text.count("\n", 0, at) + 1, at - start + 1, cause


def check_syntax(files: DataFrame, key: str = "path", language: str = "language", content: str = "content", keep: tuple[str, ...] = ("workspace_id",), version: str = "last_indexed") -> DataFrame:
    """One row per current file: key, keep, language, valid, line, col, cause.

    The language's parsing-expression grammar must match the whole text (packrat, so in linear time); unknown names and types don't
    matter, JavaScript may be script or module. ``valid`` is null for null or blank contents and for languages without a grammar (null included).
    Of repeated rows the greatest ``version`` counts; rows with a null key are left out; other columns don't
    matter; an empty table gives no rows. Texts are parsed whole; equal texts in one batch are parsed once.
    """
    rows = current_rows(files, key, [*keep, language, content], version).select(key, *keep, language, content)
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [key, *keep, language]) + ", valid boolean, line int, col int, cause string"

    def run(batches):
        for pdf in batches:
            seen: dict[tuple, tuple] = {}
            got = []
            for lang, text in zip(pdf[language], pdf[content]):
                pair = (lang, text)
                if pair not in seen:
                    seen[pair] = judge(lang, text)
                got.append(seen[pair])
            out = pdf[[key, *keep, language]].copy()
            for i, c in enumerate(("valid", "line", "col", "cause")):
                out[c] = pd.Series([g[i] for g in got], index=out.index, dtype=object)
            yield out

    return spread(rows, key).mapInPandas(run, schema)


def rates(checked: DataFrame, by: tuple[str, ...] = ("workspace_id", "language")) -> DataFrame:
    """Per group: files judged, broken ones, those with conflict markers, those cut off, and the broken share."""
    judged = checked.filter(F.col("valid").isNotNull())
    out = judged.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("broken"), F.count_if(F.col("cause") == "conflict_marker").alias("conflicts"), F.count_if(F.col("cause") == "truncated").alias("truncated"))
    return out.withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
