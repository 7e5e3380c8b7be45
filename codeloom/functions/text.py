"""Text measures (H10-H15, H35, H36, H48) and line predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts whose characters weigh more tokens.
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"


def has_cjk(text: Column) -> Column:
    """H13."""
    return text.rlike(CJK)


def token_estimate(text: Column) -> Column:
    """Characters by four, by two where there is CJK, rounded up."""
    return F.ceil(F.length(text) / F.when(has_cjk(text), 2.0).otherwise(4.0)).cast("long")


def word_estimate(text: Column) -> Column:
    """H11."""
    return F.ceil(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * F.lit(1.3)).cast("long")


def hybrid_estimate(text: Column) -> Column:
    """H12."""
    return F.ceil(token_estimate(text) * 0.6 + word_estimate(text) * 0.4).cast("long")


def truncate_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, cut between characters.

    A binary search over the number of characters, as no character takes less than a byte.
    """
    head = F.substring(text, 1, limit)
    step = F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.struct(F.lit(0).alias("lo"), F.length(head).alias("hi")), lambda a, _: F.when(F.octet_length(F.substring(head, F.lit(1), F.ceil((a.lo + a.hi) / 2).cast("int"))) <= limit, F.struct(F.ceil((a.lo + a.hi) / 2).cast("int").alias("lo"), a.hi.alias("hi"))).otherwise(F.struct(a.lo.alias("lo"), (F.ceil((a.lo + a.hi) / 2) - 1).cast("int").alias("hi"))))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(head, F.lit(1), step.lo))


def truncate_words(text: Column, limit: int) -> Column:
    """As :func:`truncate_bytes`, then back to the last white space."""
    cut = truncate_bytes(text, limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.when(cut.rlike(r"\s"), F.regexp_replace(cut, r"\s+\S*\z", "")).otherwise(cut))


#: Comments and strings, whichever begins first; a comment mark within a string, or a quote within a comment, begins nothing.
NOT_CODE = r"(?s)/\*.*?\*/|//[^\n]*+|(?m:^|[ \t])#[^\n]*+|\"\"\".*?\"\"\"|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`]*+`"


def code_only(text: Column) -> Column:
    """H34 in the JVM: each comment and string replaced by a blank."""
    return F.regexp_replace(text, NOT_CODE, " ")


def count_matches(text: Column, pattern: str) -> Column:
    """H35."""
    return F.regexp_count(text, F.lit(pattern))


def is_placeholder(body: Column) -> Column:
    """An empty body or one that holds nothing but a placeholder statement."""
    inner = F.trim(F.regexp_replace(F.trim(body), r"(?s)^\{(.*)\}$", "$1"))
    return (inner == "") | F.lower(inner).rlike(r"^(pass|\.\.\.|todo!\(\)|unimplemented!\(\)|todo|// todo|# todo)( |$)")


def bracket_balance(text: Column) -> Column:
    """Openers less closers of the three bracket kinds."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    return F.struct((n(r"\(") - n(r"\)")).alias("round"), (n(r"\[") - n(r"\]")).alias("square"), (n(r"\{") - n(r"\}")).alias("curly"))


def content_hash(text: Column) -> Column:
    """Opaque equality of contents."""
    return F.sha2(text.cast("binary"), 256)
