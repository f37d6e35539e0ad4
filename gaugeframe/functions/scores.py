"""Scores and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calibrated_probability(z0: Column, z1: Column, temperature: float | Column) -> Column:
    """Softmax of two logits at a temperature, in the form that cannot overflow."""
    return 1 / (1 + F.exp((z0 - z1) / temperature))


def softmax(z: Column, temperature: float | Column = 1.0) -> Column:
    """Softmax of an array of logits, shifted by its maximum."""
    scaled = F.transform(z, lambda x: F.exp((x - F.array_max(z)) / temperature))
    return F.transform(scaled, lambda x: x / F.aggregate(scaled, F.lit(0.0), lambda s, y: s + y))


def logit(p: Column) -> Column:
    """ln(p / (1 - p)) with p held off 0 and 1 by 1e-12; null for null."""
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12)))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def decide(df: DataFrame, threshold: float | Column, low: float | Column, high: float | Column, p: str = "p") -> DataFrame:
    """Add predicted (p >= threshold), confidence (of the predicted class) and needs_review (low <= p < high)."""
    score = F.col(p)
    hit = score >= threshold
    return df.withColumns(
        {"predicted": hit.cast("int"), "confidence": F.when(hit, score).otherwise(1 - score), "needs_review": (score >= low) & (score < high)}
    )
