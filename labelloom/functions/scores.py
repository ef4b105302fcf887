"""Predictions and losses from an array of class scores (logits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(logits: Column) -> Column:
    """Index of the highest score, the lowest index among equals; NaN scores are an error."""
    best = F.array_max(logits)
    checked = F.when(F.isnan(best), F.raise_error(F.lit("logits contain NaN"))).otherwise(best)
    return (F.array_position(logits, checked) - 1).cast("int")


def log_sum_exp(logits: Column) -> Column:
    """Shifted by the maximum, so that large scores stay finite.

    The maximum is held beside the scores in a struct; named inside the sum it would be found anew
    for every score.
    """
    held = F.array(F.struct(logits.alias("x"), F.array_max(logits).alias("top")))
    shifted = lambda s: F.aggregate(s["x"], F.lit(0.0), lambda total, x: total + F.exp(x - s["top"]))
    return F.transform(held, lambda s: s["top"] + F.log(shifted(s)))[0]


def cross_entropy(logits: Column, label: Column, smoothing: float = 0.0) -> Column:
    """Loss of one example; ``smoothing`` moves that share of the target evenly to all classes."""
    log_total = log_sum_exp(logits)
    at_label = log_total - F.element_at(logits, label.cast("int") + 1)
    if not smoothing:
        return at_label
    mean = F.aggregate(logits, F.lit(0.0), lambda total, x: total + x) / F.size(logits)
    return (1 - smoothing) * at_label + smoothing * (log_total - mean)


def perplexity(loss: Column) -> Column:
    return F.exp(loss)
