"""Risk and test quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds by weight.
CALLABLE = ("function", "method", "constructor", "destructor", "operator")
CONTAINER = ("class", "struct", "interface", "trait", "enum", "union", "module", "namespace", "type", "delegate")
DATA = ("variable", "constant", "property", "field", "enum_member", "event")
TIERS = {"stub": 0.9, "thin": 0.6, "adequate": 0.3, "thorough": 0.1}
WEIGHTS = {"centrality": 0.35, "visibility": 0.25, "test": 0.30, "kind": 0.10}


def visibility_score(v: Column) -> Column:
    """H26."""
    return F.when(v == "public", 1.0).when(v == "private", 0.2).otherwise(0.5)


def kind_weight(kind: Column) -> Column:
    """Null for imports, exports and unknown kinds."""
    return F.when(kind.isin(*CALLABLE), 1.0).when(kind.isin(*CONTAINER), 0.7).when(kind.isin(*DATA), 0.3)


def test_weakness(tier: Column, confidence: Column) -> Column:
    """Pulled towards 0.5 by low confidence."""
    raw = F.when(tier.isNull(), 1.0)
    for name, v in TIERS.items():
        raw = raw.when(tier == name, v)
    return F.lit(0.5) + (raw.otherwise(0.5) - 0.5) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def centrality(score: Column, p95: Column) -> Column:
    """H29."""
    return F.when(p95 <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(score) / F.log1p(p95)))


def risk(c: Column, v: Column, t: Column, k: Column) -> Column:
    """H30."""
    return c * WEIGHTS["centrality"] + v * WEIGHTS["visibility"] + t * WEIGHTS["test"] + k * WEIGHTS["kind"]


def risk_label(score: Column) -> Column:
    """H31."""
    return F.when(score >= 0.7, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")


def quality_tier(assertions: Column, mocks: Column, errors: Column) -> Column:
    """Error tests or mocks make up for few assertions, but not for none."""
    return F.when(assertions == 0, "stub").when((assertions >= 3) | errors | ((mocks > 0) & (assertions >= 2)), "thorough").when(assertions == 1, "thin").otherwise("adequate")
