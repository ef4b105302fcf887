"""Two recipes on the same splits, scored once on test and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classifiers import TextWeights, score_texts
from ..operators.compare import leaderboard
from ..operators.metrics import classification_metrics
from ..operators.scale import store


def experiment(df: DataFrame, dataset: str) -> DataFrame:
    """Validation and test metrics of the keyword and the centroid classifier, with test rank.

    ``df`` has ``(id, split, label, text)``. Both recipes share one pass over train and one over
    the held-out texts.
    """
    recipes = ["keywords", "centroids"]
    scored = score_texts(df.filter("split <> 'train'"), TextWeights(df), recipes)
    each = [F.struct(F.lit(r).alias("run_id"), F.col(f"{r}.prediction").alias("prediction")) for r in recipes]
    runs = scored.select("split", "label", F.inline(F.array(*each)))
    metrics = store(classification_metrics(runs, ["run_id", "split"]), "run-metrics")
    test = metrics.filter("split = 'test'").withColumn("dataset", F.lit(dataset))
    best_val = metrics.filter("split = 'validation'").select("run_id", F.col("f1_macro").alias("best_val_f1"))
    ranks = leaderboard(test).select("run_id", "rank")
    return test.drop("split").join(best_val, "run_id", "left").join(ranks, "run_id")
