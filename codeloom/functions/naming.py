"""Naming conventions and identifier splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def camel_parts(name: Column) -> Column:
    """``XMLParser`` -> XML, Parser; case changes and ends of acronyms split."""
    return F.split(name, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")


def snake_parts(name: Column) -> Column:
    """F11."""
    return F.filter(F.split(name, "_"), lambda x: x != "")


def snake_case(name: Column) -> Column:
    """A capital after or before a small letter starts a word; runs of ``_`` and ``-`` become one ``_``, none at the start."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1_$2"), r"([^_\-])(\p{Lu}\p{Ll})", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(spaced, "[_-]+", "_"), "^_", ""))


def kebab_case(name: Column) -> Column:
    """H05."""
    return F.replace(snake_case(name), F.lit("_"), F.lit("-"))


def screaming_snake_case(name: Column) -> Column:
    """H06."""
    return F.upper(snake_case(name))


def _first(w: Column, change) -> Column:
    return F.concat(change(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))


def camel_case(name: Column) -> Column:
    """Capitals after ``_`` and ``-``, a small letter at the start; other letters stay."""
    return F.array_join(F.transform(F.split(name, "[_-]+"), lambda x, i: F.when(i == 0, _first(x, F.lower)).otherwise(_first(x, F.upper))), "")


def pascal_case(name: Column) -> Column:
    """H04."""
    return _first(camel_case(name), F.upper)


def variants(name: Column) -> Column:
    """The name itself first, then the other conventions, each once."""
    return F.array_distinct(F.array(name, snake_case(name), camel_case(name), pascal_case(name), kebab_case(name), screaming_snake_case(name)))


def compact(text: Column) -> Column:
    """Letters and digits alone, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def name_match(name: Column, query: str) -> Column:
    """Equal, the last component, or a qualified suffix at a component's start."""
    n, q = F.lower(name), query.lower()
    hit = (n == q) | (F.element_at(F.split(n, r"\."), -1) == q)
    return hit | n.endswith("." + q) if "." in q else hit


def qualified(name: Column) -> tuple[Column, Column]:
    """(parent, leaf) at the rightmost ``::``, else the rightmost ``.``; parent is null for bare names."""
    colons, dot = F.instr(name, "::") > 0, F.instr(name, ".") > 0
    part = lambda pattern, k: F.regexp_extract(name, pattern, k)
    parent = F.when(colons, part(r"(?s)^(.*)::(.*)$", 1)).when(dot, part(r"(?s)^(.*)\.(.*)$", 1))
    return parent, F.when(colons, part(r"(?s)^(.*)::(.*)$", 2)).when(dot, part(r"(?s)^(.*)\.(.*)$", 2)).otherwise(name)


def drop_compounds(tokens: Column) -> Column:
    """``a_b`` goes where a and b are both present."""
    return F.filter(tokens, lambda t: ~((F.instr(t, "_") > 0) & F.forall(snake_parts(t), lambda p: F.array_contains(tokens, p))))
