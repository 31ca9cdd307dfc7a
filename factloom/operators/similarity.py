"""Pairwise claim alignment: an exact similarity join finds the pairs, typed signals are expressions over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.hashing import stable_id
from factloom.functions.text import casefold
from factloom.functions.udf import arrow_udf
from factloom.operators.similarity_join import indel, lcs, similar_pairs
from factloom.session import written

VERSION = "2.0.0"
THRESHOLD = 0.55
MOST_CANDIDATES = 50_000


def ratio(a: str, b: str) -> float:
    """Indel similarity in 0..100; two empty texts are equal."""
    return indel(lcs(a, b), len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Indel similarity of token sets: 100 if one holds the other and they meet, 0 if one is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (left and right):
        return 100.0
    with_left, with_right = " ".join(filter(None, (both, left))), " ".join(filter(None, (both, right)))
    best = ratio(with_left, with_right)
    return max(best, ratio(both, with_left), ratio(both, with_right)) if both else best


@arrow_udf("array<string>")
def token_set(statements: pd.Series) -> pd.Series:
    return statements.map(lambda x: list(dict.fromkeys(x.split())))


@arrow_udf("double")
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


def _compatible(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def signals(claims: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of claims of different units at or above the threshold, with their typed signals.

    Claim ids are unique, as the records' schema demands. A claim without an id or a unit pairs with none; a null statement,
    subject or predicate counts as empty, while null times and scopes only agree with each other.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("INVALID_PARAMETER: the threshold lies between 0 and 1")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    c = claims.where("evidence_claim_id IS NOT NULL AND evidence_unit_id IS NOT NULL").select(
        F.col("evidence_claim_id").cast("string").alias("id"), F.col("evidence_unit_id").cast("string").alias("unit"), text("statement").alias("statement"), "polarity", "modality", "claim_type",
        casefold(text("statement")).alias("folded"), token_set(text("statement")).alias("tokens"), casefold(text("subject")).alias("subject"), casefold(text("predicate")).alias("predicate"),
        casefold("time").alias("time"), casefold("scope").alias("scope"), F.array_sort(F.array_distinct("conditions")).alias("conditions"),
    )
    c = written(c)
    found = similar_pairs(c.select("id", "unit", "folded", "statement", "tokens"), threshold)
    typed = c.select("id", F.struct("polarity", "modality", "claim_type", "subject", "predicate", "time", "scope", "conditions").alias("of"))
    scored = found.join(typed.select(F.col("id").alias("left_claim_id"), F.col("of").alias("a")), "left_claim_id").join(typed.select(F.col("id").alias("right_claim_id"), F.col("of").alias("b")), "right_claim_id")
    return scored.select(
        "left_claim_id", "right_claim_id",
        F.round("lexical", 6).alias("lexical_similarity"), "lexical",
        (similar("a.subject", "b.subject") >= 85).alias("entity"), (similar("a.predicate", "b.predicate") >= 75).alias("predicate"),
        (F.col("a.polarity") == F.col("b.polarity")).alias("polarity"), _compatible(F.col("a.time"), F.col("b.time")).alias("temporal"),
        (_compatible(F.col("a.scope"), F.col("b.scope")) & (F.col("a.conditions") == F.col("b.conditions"))).alias("qualifier"),
        (F.col("a.modality") == F.col("b.modality")).alias("modality"), (F.col("a.claim_type") == F.col("b.claim_type")).alias("claim_type"),
    )


def relate(pairs: DataFrame) -> DataFrame:
    """Relation, policy and ordered reasons of each pair."""
    conflict = F.col("entity") & F.col("predicate") & ~F.col("polarity") & F.col("temporal") & F.col("qualifier")
    equal = (F.col("lexical") >= 0.75) & F.col("entity") & F.col("polarity") & F.col("temporal") & F.col("qualifier") & F.col("modality") & F.col("claim_type")
    named = (("entity", "entity"), ("polarity", "polarity"), ("temporal", "time"), ("qualifier", "qualifier"), ("modality", "modality"), ("claim_type", "claim-type"))
    reasons = F.filter(F.array(*(F.when(~F.col(c), f"{n}-incompatible") for c, n in named)), lambda x: x.isNotNull())
    relation = F.when(conflict, "possibly-conflicting").when(equal, "possibly-equivalent").otherwise("related")
    why = (
        F.when(conflict, F.array(F.lit("polarity-incompatible")))
        .when(equal, F.array(F.lit("candidate-only-no-automatic-merge")))
        .when(F.size(reasons) == 0, F.array(F.lit("insufficient-equivalence-signals")))
        .otherwise(reasons)
    )
    return pairs.select(
        stable_id("align", F.col("left_claim_id"), F.col("right_claim_id"), F.lit(VERSION)).alias("alignment_candidate_id"),
        "left_claim_id", "right_claim_id", relation.alias("candidate_relation"), "lexical_similarity",
        F.col("entity").alias("entity_compatible"), F.col("polarity").alias("polarity_compatible"), F.col("temporal").alias("temporal_compatible"), F.col("qualifier").alias("qualifier_compatible"),
        F.when(relation == "related", "keep-separate").otherwise("human-review").alias("policy_decision"), why.alias("decision_reasons"),
    )


def suggest(claims: DataFrame, threshold: float = THRESHOLD, most: int = MOST_CANDIDATES) -> DataFrame:
    """Alignment candidates; more than ``most`` of them is an error and never a shorter result."""
    found = written(relate(signals(claims, threshold)))
    if found.limit(most + 1).count() > most:
        raise ValueError("ALIGNMENT_LIMIT_EXCEEDED")
    return found


def comparisons(claims: DataFrame) -> DataFrame:
    """How many pairs of claims of different units there are, from counts alone."""
    n = claims.agg(F.count("*").alias("n"))
    same = claims.groupBy("evidence_unit_id").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("same"))
    return n.crossJoin(same).select((F.expr("n * (n - 1) div 2") - F.col("same")).alias("comparison_count"))
