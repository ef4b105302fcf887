"""Token-level loss, perplexity and accuracy, and two countable models to measure with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import perplexity
from ..functions.text import words
from .encoding import token_counts
from .scale import sized_join, store


def _mean_loss(total: Column, tokens: Column) -> Column:
    """Infinity without tokens."""
    return F.when(tokens > 0, total / tokens).otherwise(F.lit(float("inf")))


def token_metrics(
    df: DataFrame, pad: int | None = None, by: list[str] | None = None, weight: str | None = None
) -> DataFrame:
    """Loss, perplexity and accuracy over rows ``(target, prediction, nll)``, without targets equal
    to the padding id. Accuracy is in percent, and 0 without rows. ``weight`` names the column that
    says how many positions a row stands for.
    """
    rows = df if pad is None else df.filter(F.col("target") != pad)
    n = F.lit(1) if weight is None else F.col(weight)
    loss = _mean_loss(F.sum(n * F.col("nll")), F.sum(F.when(F.col("nll").isNotNull(), n)))
    hits = F.sum(F.when(F.col("target") == F.col("prediction"), n).otherwise(0))
    percent = F.when(F.sum(n) > 0, 100 * hits / F.sum(n)).otherwise(0.0)
    return (
        rows.groupBy(*(by or []))
        .agg(loss.alias("loss"), percent.alias("token_accuracy"))
        .withColumn("perplexity", perplexity(F.col("loss")))
    )


def unigram_token_losses(train: DataFrame, held_out: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per ``by`` and held-out token its occurrences ``n`` and negative log probability ``nll``.

    The model is the add-one unigram model of train. Held-out tokens are counted before they meet
    the train counts, so a frequent word is one row per group.
    """
    by = by or []
    seen = store(token_counts(train).withColumnRenamed("n", "train_n"), "train-tokens")
    size = seen.agg(F.coalesce(F.sum("train_n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    denominator = F.lit(float(size.tokens + size.distinct + 1))
    counted = token_counts(held_out, by)
    matched = sized_join(counted, seen, ["token"], "left", spread_by=by or None)
    return matched.select(*by, "token", "n", (-F.log((F.coalesce("train_n", F.lit(0)) + 1) / denominator)).alias("nll"))


def unigram_loss(train: DataFrame, held_out: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tokens, mean loss and perplexity of the held-out texts under the unigram model of train."""
    by = by or []
    losses = unigram_token_losses(train, held_out, by)
    tokens = F.coalesce(F.sum("n"), F.lit(0))
    return losses.groupBy(*by).agg(
        tokens.alias("tokens"), _mean_loss(F.sum(F.col("n") * F.col("nll")), tokens).alias("loss")
    ).withColumn("perplexity", perplexity(F.col("loss")))


def unigram_perplexity(train: DataFrame, held_out: DataFrame, by: list[str]) -> DataFrame:
    """``unigram_loss`` overall (``grouping`` is ``all``) and for each value of each ``by`` column.

    Tokens are scored once; the totals per combination of ``by`` are then summed up each way.
    """
    losses = unigram_token_losses(train, held_out, by)
    totals = losses.groupBy(*by).agg(F.sum("n").alias("tokens"), F.sum(F.col("n") * F.col("nll")).alias("nll"))
    levels = [F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("value"))]
    levels += [F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("value")) for c in by]
    return (
        totals.select("tokens", "nll", F.inline(F.array(*levels)))
        .groupBy("grouping", "value")
        .agg(F.sum("tokens").alias("tokens"), (F.sum("nll") / F.sum("tokens")).alias("loss"))
        .withColumn("perplexity", perplexity(F.col("loss")))
    )


def successor_pairs(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Occurrences ``n`` of each pair of neighbouring tokens ``(previous, token)``."""
    by = by or []
    split = df.select(*by, words(F.col("text")).alias("w"))
    pairs_in_text = F.greatest(F.size("w") - 1, F.lit(0))
    before = F.slice("w", F.lit(1), pairs_in_text)
    after = F.slice("w", F.lit(2), pairs_in_text)
    pairs = split.select(*by, F.inline_outer(F.arrays_zip(before.alias("previous"), after.alias("token")))).filter(
        F.col("token").isNotNull()
    )
    return pairs.groupBy(*by, "previous", "token").agg(F.count("*").alias("n"))


def successor_accuracy(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Token accuracy, in percent, of predicting each token as the commonest train successor of the
    one before (the smallest among equally common ones). First tokens are not scored; an unknown
    previous token is a miss.

    Both sides of the join are distinct ``(previous, token)`` pairs: a pair is a hit when it is the
    predicted one, so no previous token has more than one partner.
    """
    best = F.min(F.struct((-F.col("n")).alias("rare"), F.col("token").alias("token"))).getField("token")
    predicted = successor_pairs(train).groupBy("previous").agg(best.alias("token")).withColumn("hit", F.lit(1))
    scored = successor_pairs(held_out).join(predicted, ["previous", "token"], "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    hits = F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0))
    return scored.agg(
        total.alias("tokens"), F.when(total > 0, 100 * hits / total).otherwise(0.0).alias("token_accuracy")
    )
