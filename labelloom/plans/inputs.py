"""The operators' inputs, derived from whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import number_epochs
from ..operators.scale import widen
from ..operators.schema import class_catalog, encode_label
from ..operators.splits import split_train_val_test


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unlabelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def languages(spark: SparkSession, folder: str) -> DataFrame:
    """The classes of the documents: their languages."""
    return class_catalog(table(spark, folder, "documents"), "lang")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, text, lang, source, label)`` with the language as label."""
    rows = unlabelled_documents(spark, folder)
    return encode_label(rows, class_catalog(rows, "lang"), "lang")


def split_documents(spark: SparkSession, folder: str) -> DataFrame:
    """As ``documents``, with ``split``; ready for work on the texts."""
    rows = unlabelled_documents(spark, folder)
    labelled = encode_label(split_train_val_test(rows), class_catalog(rows, "lang"), "lang")
    return widen(labelled, rows, "id")


def quality_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quality and toxicity under the column names a dataset might use."""
    rows = table(spark, folder, "documents").select("doc_id", "text")
    marks = table(spark, folder, "labels").select(
        "doc_id", F.col("quality").alias("class"), F.col("toxic").alias("category")
    )
    return widen(rows.join(marks, "doc_id"), rows, "doc_id")


def quality_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Quality as label, predicted from toxicity."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction")
    )


def split_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return split_train_val_test(vectors.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("features")))


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector taken as the scores of as many classes; one run in batches of 32."""
    vectors = table(spark, folder, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("id"),
        "label",
        F.col("embedding").cast("array<double>").alias("logits"),
        F.floor(F.col("vec_id") / 32).alias("batch_id"),
        F.lit("vectors").alias("run_id"),
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumnRenamed("user_id", "run_id")


def histories(spark: SparkSession, folder: str) -> DataFrame:
    """One run per user, one epoch per event in time order."""
    events = _events(spark, folder).select("run_id", "ts", "event_id", F.col("value").alias("val_f1"))
    return number_epochs(events, ["ts", "event_id"]).select("run_id", "epoch", "val_f1")


def _as_loss(df: DataFrame) -> DataFrame:
    """The score a hundredth of which is the loss, and itself the seconds of the epoch."""
    return df.withColumns({"val_loss": F.col("val_f1") / 100, "epoch_time": F.col("val_f1")}).drop("val_f1")


def loss_histories(spark: SparkSession, folder: str) -> DataFrame:
    return _as_loss(histories(spark, folder))


def epoch_losses(spark: SparkSession, folder: str) -> DataFrame:
    """As ``loss_histories``, for what does not depend on the epochs' order."""
    return _as_loss(_events(spark, folder).select("run_id", F.col("value").alias("val_f1")))


def accuracy_histories(spark: SparkSession, folder: str) -> DataFrame:
    """One epoch per user and day: views are validation, all other events train; either may be null."""
    days = _events(spark, folder).groupBy("run_id", F.to_date("ts").alias("day")).agg(
        F.round(F.avg(F.when(F.col("event_type") != "view", F.col("value"))), 6).alias("train_acc"),
        F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 6).alias("val_acc"),
    )
    return number_epochs(days, ["day"]).select("run_id", "epoch", "train_acc", "val_acc")


def test_accuracies(spark: SparkSession, folder: str) -> DataFrame:
    purchases = _events(spark, folder).filter("event_type = 'purchase'")
    return purchases.groupBy("run_id").agg(F.round(F.avg("value"), 6).alias("test_acc"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One finished run per event type."""
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("run_id")).agg(
        F.lit("all").alias("dataset"),
        F.round(F.sum("value") / 60, 6).alias("training_time_minutes"),
        F.round(F.avg("value") / 100, 6).alias("f1_macro"),
        F.count("*").alias("epochs"),
        F.countDistinct("user_id").alias("trainable_parameters"),
        F.count("*").alias("total_parameters"),
    )


def user_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One finished run per event type (as dataset) and user; its score, a share of few events,
    often equals another's."""
    return table(spark, folder, "events").groupBy(
        F.col("event_type").alias("dataset"), F.col("user_id").alias("run_id")
    ).agg((F.count_if(F.col("value") > 30) / F.count("*")).alias("f1_macro"))
