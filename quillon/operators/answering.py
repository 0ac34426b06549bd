"""Decisions between retrieval and answer: grades, sufficiency, abstention, verdicts, freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of grading and abstention.
CORRECT, ENTITY_CORRECT, AMBIGUOUS = 0.30, 0.22, 0.15
STRONG, FLOOR = 0.30, 0.12
SUPPORTED, PARTIAL = 0.5, 0.3


def grade(score: Column, names_entity: Column) -> Column:
    """correct or incorrect; what is ambiguous by score is decided by whether it names an asked entity."""
    sure = (score >= CORRECT) | ((score >= ENTITY_CORRECT) & names_entity)
    return F.when(sure | ((score >= AMBIGUOUS) & names_entity), "correct").otherwise("incorrect")


def sufficient(strong: Column, needed: Column, covered: Column) -> Column:
    return (strong >= needed) & covered


def abstain(n_evidence: Column, all_gaps: Column, names_entity: Column, asks_entity: Column, best: Column) -> Column:
    """Nothing found, nothing known of what is asked, no asked entity in the evidence, or no evidence above the floor."""
    return (n_evidence == 0) | all_gaps | (asks_entity & ~names_entity) | (F.coalesce(best, F.lit(0.0)) < FLOOR)


def freshness(published: Column, as_of: Column, weight: float, half_life: float = 365.0) -> Column:
    """1 for what is new, falling to 1 - weight; null dates count as neutral."""
    age = F.greatest(F.datediff(as_of, published), F.lit(0)).cast("double")
    return F.when(published.isNull(), F.lit(1.0 - weight / 2)).otherwise((1.0 - weight) + weight * F.pow(F.lit(2.0), -age / half_life))


def verdict(coverage: Column, missing_numbers: Column, cited: Column, cited_coverage: Column) -> Column:
    """What a claim's evidence says of it."""
    return (
        F.when(coverage < PARTIAL, "unsupported")
        .when(missing_numbers, "contradicted")
        .when(coverage < SUPPORTED, "partial")
        .when(cited & (cited_coverage < PARTIAL), "misattributed")
        .otherwise("supported")
    )


def claim_verdict(coverage: Column, n_numbers: Column, n_names: Column | None = None) -> Column:
    """A claim with a number that the evidence lacks is never even partly right; of names, well covered claims may lack two for a part, others one."""
    names = F.lit(0) if n_names is None else n_names
    allowed = F.when(coverage >= SUPPORTED, 2).when(coverage >= PARTIAL, 1).otherwise(-1)
    held = (n_numbers == 0) & (names <= allowed)
    return F.when(~held, "unsupported").when((coverage >= SUPPORTED) & (names == 0), "supported").otherwise("partial")


def rollup(claims):
    """One row of rates from claims(verdict, cited, cited_ok)."""
    is_ = lambda v: (F.col("verdict") == v).cast("int")
    rate = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return claims.agg(
        rate(is_("supported"), "faithfulness"), rate(is_("supported") + is_("partial") * 0.5, "soft"),
        rate(F.when(F.col("cited"), F.col("cited_ok").cast("int")), "citation_accuracy"),
        rate(F.col("cited").cast("int"), "citation_coverage"), rate(is_("unsupported"), "hallucination"),
    )
