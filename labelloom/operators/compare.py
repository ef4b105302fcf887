"""Finished runs side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import running, sized_join, spread, store

# Fixed value: price of an hour of training.
HOURLY_PRICE = 1.50
HIGHER, LOWER = "higher", "lower"
DIRECTIONS = {
    **dict.fromkeys(["accuracy", "test_acc", "val_acc", "f1", "f1_macro", "f1_weighted", "val_f1"], HIGHER),
    **dict.fromkeys(["precision_macro", "precision_weighted", "recall_macro", "recall_weighted"], HIGHER),
    **dict.fromkeys(["loss", "val_loss", "test_loss", "perplexity", "val_perplexity"], LOWER),
    **dict.fromkeys(["training_time_minutes", "cost", "generalization_gap"], LOWER),
}
LOSS_KINDS = ["loss", "perplexity"]


def compare_runs(
    results: DataFrame,
    run_a: str,
    run_b: str,
    metrics: list[str],
    run: str = "run_id",
    same_loss: bool = False,
    directions: dict[str, str | None] | None = None,
) -> DataFrame:
    """Per metric the value of both runs, a minus b, and the winner (null on a tie).

    ``directions`` adds to and overrides ``DIRECTIONS``; a metric without a direction, such as the
    number of epochs or parameters, has no winner. Losses and perplexities have one only with
    ``same_loss``, that is, when both runs used one loss definition.
    """
    known = DIRECTIONS | (directions or {})
    long = results.filter(F.col(run).isin(run_a, run_b)).unpivot([run], metrics, "metric", "value")
    a, b = F.col("value_a"), F.col("value_b")
    values = long.groupBy("metric").agg(
        F.max(F.when(F.col(run) == run_a, F.col("value"))).alias("value_a"),
        F.max(F.when(F.col(run) == run_b, F.col("value"))).alias("value_b"),
    )
    higher = [m for m in metrics if known.get(m) == HIGHER]
    lower = [m for m in metrics if known.get(m) == LOWER]
    sign = F.when(F.col("metric").isin(higher), 1).when(F.col("metric").isin(lower), -1).otherwise(0)
    unlike = [m for m in metrics if not same_loss and any(m.endswith(kind) for kind in LOSS_KINDS)]
    ahead = sign * (a - b)
    comparable = ~F.col("metric").isin(unlike)
    winner = F.when(comparable & (ahead > 0), run_a).when(comparable & (ahead < 0), run_b)
    return values.select("metric", "value_a", "value_b", (a - b).alias("difference"), winner.alias("winner"))


def run_efficiency(results: DataFrame, planned_epochs: int, run: str = "run_id") -> DataFrame:
    """Minutes, ratio to the fastest run, cost, trainable share, and epochs done and saved.

    A ratio to zero is null.
    """
    minutes = F.col("training_time_minutes")
    fastest = results.agg(F.min("training_time_minutes").alias("fastest")).first().fastest
    return results.select(
        run,
        minutes,
        F.try_divide(minutes, F.lit(fastest)).alias("ratio_to_fastest"),
        (minutes / 60 * HOURLY_PRICE).alias("cost"),
        F.try_divide("trainable_parameters", "total_parameters").alias("trainable_share"),
        F.col("epochs"),
        F.greatest(F.lit(0), F.lit(planned_epochs) - F.col("epochs")).alias("epochs_saved"),
    )


def leaderboard(results: DataFrame, metric: str = "f1_macro", run: str = "run_id") -> DataFrame:
    """Rank of each run among those of its dataset; equal runs share a rank.

    Runs without a score, null or NaN, share the rank after all others; runs without a dataset are
    one dataset. Ranks are counted on the distinct scores, so neither a dataset with very many runs
    nor a score that very many runs share ends up in one task.
    """
    score = F.col(metric).cast("double")
    keyed = results.withColumns(
        {
            "_dataset": F.to_json(F.array("dataset")),
            "_score": F.coalesce(F.nanvl(score, F.lit(float("-inf"))), F.lit(float("-inf"))),
        }
    )
    scores = keyed.groupBy("_dataset", "_score").agg(F.count("*").alias("n"))
    order = [F.col("_score").desc()]
    ahead = running(spread(scores, ["_dataset"], order), ["_dataset"], order, {"ahead": (F.sum, F.col("n"), False)})
    ranks = store(
        ahead.select("_dataset", "_score", (F.coalesce("ahead", F.lit(0)) + 1).cast("int").alias("rank")), "ranks"
    )
    joined = sized_join(keyed, ranks, ["_dataset", "_score"], spread_by=[run])
    return joined.select("rank", "dataset", run, metric)
