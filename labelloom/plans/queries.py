"""Every operator bound to the tables of a data folder; each query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import classifiers, compare, encoding, history, metrics, models, profile, schema, splits, token_models
from ..operators.scale import scratch_path, sized_join, store, widen
from ..sources import datasets, runs
from . import inputs
from .experiment import experiment as run_experiment
from .prepare import open_prepared, prepare_dataset

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _rounded(df: DataFrame) -> DataFrame:
    """Sums of floats depend on their order in the last digits, exponentials of them on more."""
    digits = {"perplexity": 3}
    return df.select(
        *[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _train(df: DataFrame) -> DataFrame:
    return df.filter("split = 'train'")


def _held_out(df: DataFrame) -> DataFrame:
    return df.filter("split <> 'train'")


def _joined(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


# Sources and sinks


@query
def load_splits(spark, folder):
    paths = {"train": "documents", "validation": "conversations", "test": "benchmark"}
    own = ["doc_id", "lang", "source", "n_chars", "conv_id", "turn", "role", "item_id"]
    loaded = datasets.load_splits(spark, {s: f"{folder}/{t}.parquet" for s, t in paths.items()}, optional=own)
    return loaded.select("split", "text")


@query
def resolve_splits(spark, folder):
    paths = {"train": f"{folder}/documents.parquet", "val": f"{folder}/conversations.parquet"}
    own = ["doc_id", "lang", "source", "n_chars", "conv_id", "turn", "role"]
    loaded = datasets.load_splits(spark, paths, optional=own)
    keyed = loaded.select(F.coalesce("doc_id", F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "split")
    return splits.resolve_splits(keyed, set(paths)).select("id", "split")


@query
def read_jsonl_roundtrip(spark, folder):
    path = scratch_path(spark, "jsonl")
    datasets.write_jsonl(inputs.split_documents(spark, folder), path)
    return datasets.read_jsonl(spark, path)


@query
def dataset_metadata(spark, folder):
    rows = inputs.split_documents(spark, folder)
    metadata = datasets.dataset_metadata(
        "documents",
        inputs.languages(spark, folder),
        profile.split_sizes(rows),
        profile.text_stats(_train(rows)),
        "text",
        "lang",
    )
    path = scratch_path(spark, "metadata")
    datasets.write_metadata(metadata, path)
    loaded = datasets.load_metadata(spark, path)
    flat = loaded.withColumn("class_names", F.array_join("class_names", ",")).select(
        "dataset_name",
        "num_classes",
        "class_names",
        "text_column",
        "label_column",
        F.col("splits.train").alias("n_train"),
        F.col("splits.val").alias("n_val"),
        F.col("splits.test").alias("n_test"),
        "text_stats.*",
    )
    return _rounded(flat)


@query
def history_long(spark, folder):
    vectors = inputs.table(spark, folder, "embeddings")
    series = F.col("embedding").cast("array<double>")
    path = scratch_path(spark, "history")
    vectors.select(
        F.col("vec_id").cast("string").alias("run_id"), series.alias("train_loss"), F.reverse(series).alias("val_f1")
    ).write.json(path)
    return runs.read_history(spark, path, lines=True).select("run_id", "epoch", "train_loss", "val_f1")


@query
def results_flat(spark, folder):
    finished = inputs.runs(spark, folder)
    nested = finished.select(
        "run_id",
        "dataset",
        "training_time_minutes",
        F.struct("f1_macro").alias("test_metrics"),
        F.create_map(F.lit("num_epochs"), F.col("epochs").cast("string")).alias("config"),
    )
    path = scratch_path(spark, "results")
    runs.write_results(nested, path)
    flat = runs.flatten_results(runs.read_results(spark, path, lines=True))
    return flat.select(
        "run_id", "dataset", "training_time_minutes", "f1_macro", F.col("config")["num_epochs"].alias("num_epochs")
    )


@query
def tracker_long(spark, folder):
    vectors = inputs.table(spark, folder, "embeddings")
    series = F.col("embedding").cast("array<double>")
    path = scratch_path(spark, "tracker")
    vectors.select(
        F.col("vec_id").cast("string").alias("run_id"), series.alias("val_losses"), F.reverse(series).alias("epoch_times")
    ).write.json(path)
    return runs.read_tracker(spark, path, lines=True).select("run_id", "epoch", "val_loss", "epoch_time")


@query
def history_roundtrip(spark, folder):
    path = scratch_path(spark, "history")
    runs.write_history(inputs.histories(spark, folder), path, piece_epochs=5)
    return runs.read_history(spark, path, lines=True).select("run_id", "epoch", "val_f1")


@query
def prepared_dataset(spark, folder):
    given, output = scratch_path(spark, "given"), scratch_path(spark, "prepared")
    inputs.quality_documents(spark, folder).write.parquet(given)
    prepare_dataset(spark, "quality", {"train": given}, output, "doc_id", class_names=["low", "high"])
    _, rows = open_prepared(spark, output)
    return rows.groupBy("split", "label", "class_name").agg(
        F.count("*").alias("n"), F.sum(text.word_count(F.col("text"))).alias("words")
    )


# Columns, labels and scalar functions


@query
def normalize(spark, folder):
    return schema.normalize(inputs.quality_documents(spark, folder), "doc_id")


@query
def class_catalog(spark, folder):
    by_name = inputs.languages(spark, folder)
    by_number = schema.class_catalog(inputs.table(spark, folder, "labels"), "quality")
    return by_name.withColumn("column", F.lit("lang")).unionByName(by_number.withColumn("column", F.lit("quality")))


@query
def decode_label(spark, folder):
    vectors = inputs.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return schema.decode_label(vectors, inputs.languages(spark, folder))


@query
def sample_examples(spark, folder):
    train = _train(inputs.split_documents(spark, folder))
    return profile.sample_examples(train, inputs.languages(spark, folder))


@query
def argmax_predict(spark, folder):
    return inputs.logits(spark, folder).select("id", "label", scores.argmax(F.col("logits")).alias("prediction"))


@query
def cross_entropy(spark, folder):
    rows = inputs.logits(spark, folder)
    return _rounded(rows.select("id", scores.cross_entropy(F.col("logits"), F.col("label")).alias("loss")))


@query
def cross_entropy_smoothed(spark, folder):
    rows = inputs.logits(spark, folder)
    return _rounded(rows.select("id", scores.cross_entropy(F.col("logits"), F.col("label"), smoothing=0.1).alias("loss")))


@query
def checkpoint_epochs(spark, folder):
    return history.checkpoint_epochs(inputs.histories(spark, folder))


# Text encoding


@query
def word_count(spark, folder):
    rows = inputs.unlabelled_documents(spark, folder)
    return widen(rows, rows, "id").select("id", text.word_count(F.col("text")).alias("words"))


@query
def build_vocab(spark, folder):
    return encoding.build_vocab(_train(inputs.split_documents(spark, folder)))


@query
def encode_tokens(spark, folder):
    rows = inputs.split_documents(spark, folder)
    encoded = encoding.encode(rows, encoding.build_vocab(_train(rows)))
    return encoded.select("id", F.size("input_ids").alias("length"), _joined("input_ids").alias("input_ids"))


@query
def pad_truncate(spark, folder):
    rows = inputs.split_documents(spark, folder)
    fixed = encoding.encode_fixed(rows, encoding.build_vocab(_train(rows)))
    return fixed.select("id", _joined("input_ids").alias("input_ids"))


def _padded(rows, vocab):
    """All ids of each text, filled up with padding."""
    return encoding.encode(rows, vocab, keep=["lang"]).withColumn("input_ids", text.pad_blocks(F.col("input_ids")))


def _masked(spark, folder):
    rows = inputs.split_documents(spark, folder)
    padded = _padded(rows, encoding.build_vocab(_train(rows)))
    return padded.withColumn("attention_mask", text.attention_mask(F.col("input_ids")))


@query
def attention_mask(spark, folder):
    return _masked(spark, folder).select("id", _joined("attention_mask").alias("attention_mask"))


@query
def last_valid_token(spark, folder):
    last = text.last_valid(F.col("input_ids"), F.col("attention_mask"))
    return _masked(spark, folder).select("id", last.alias("last_id"))


@query
def make_batches(spark, folder):
    rows = inputs.split_documents(spark, folder).select("id", "split")
    return encoding.make_batches(rows, epoch=1)


# Splits


@query
def split_test(spark, folder):
    rows = inputs.documents(spark, folder).withColumn("split", F.lit("train"))
    return splits.carve_test(rows).select("id", "split")


@query
def split_train_val_test(spark, folder):
    return inputs.split_documents(spark, folder).select("id", "split")


@query
def split_by_text_hash(spark, folder):
    rows = inputs.documents(spark, folder)
    return splits.split_train_val_test(rows, mode="hash", group_key="text").select("id", "split")


@query
def split_three_way(spark, folder):
    return splits.split_three_way(inputs.documents(spark, folder)).select("id", "split")


@query
def split_overlap(spark, folder):
    return _rounded(splits.split_overlap(inputs.split_documents(spark, folder)))


@query
def split_drift(spark, folder):
    return _rounded(splits.split_drift(inputs.split_documents(spark, folder)))


# Aggregates


@query
def split_sizes(spark, folder):
    return profile.split_sizes(inputs.split_documents(spark, folder))


@query
def class_distribution(spark, folder):
    rows = inputs.split_documents(spark, folder)
    return _rounded(profile.class_distribution(rows, inputs.languages(spark, folder)))


@query
def text_stats(spark, folder):
    return _rounded(profile.text_stats(_train(inputs.split_documents(spark, folder))))


@query
def text_stats_full(spark, folder):
    return _rounded(profile.text_stats(_train(inputs.split_documents(spark, folder)), sample=None))


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(inputs.quality_predictions(spark, folder))


@query
def per_class_metrics(spark, folder):
    counts = metrics.confusion_matrix(inputs.quality_predictions(spark, folder))
    return _rounded(metrics.per_class_metrics(counts))


@query
def classification_metrics(spark, folder):
    return _rounded(metrics.classification_metrics(inputs.quality_predictions(spark, folder)))


@query
def unigram_loss(spark, folder):
    rows = inputs.split_documents(spark, folder)
    return _rounded(token_models.unigram_loss(_train(rows), _held_out(rows), ["split"]))


@query
def unigram_perplexity(spark, folder):
    rows = inputs.split_documents(spark, folder)
    return _rounded(token_models.unigram_perplexity(_train(rows), _held_out(rows), ["lang", "source"]))


@query
def token_accuracy(spark, folder):
    rows = inputs.split_documents(spark, folder)
    return _rounded(token_models.successor_accuracy(_train(rows), _held_out(rows)))


@query
def masked_token_metrics(spark, folder):
    """Each position of the whole texts predicted as the commonest token and scored with its train
    frequency; padding left out. Positions are counted before they meet the frequencies."""
    rows = inputs.split_documents(spark, folder)
    vocab = encoding.build_vocab(_train(rows))
    size = vocab.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    positions = _padded(rows, vocab).select("lang", F.explode("input_ids").alias("target"))
    # stored, since the join may count its keys first
    counted = store(positions.groupBy("lang", "target").agg(F.count("*").alias("positions")), "positions")
    frequency = vocab.select(F.col("token_id").alias("target"), "n")
    looked_up = sized_join(counted, frequency, ["target"], "left", spread_by=["lang"])
    probability = (F.coalesce("n", F.lit(0)) + 1) / F.lit(float(size.tokens + size.distinct + 1))
    scored = looked_up.withColumns({"nll": -F.log(probability), "prediction": F.lit(2)})
    return _rounded(token_models.token_metrics(scored, pad=0, by=["lang"], weight="positions"))


@query
def epoch_loss(spark, folder):
    rows = inputs.logits(spark, folder).withColumn("loss", scores.cross_entropy(F.col("logits"), F.col("label")))
    both = [
        metrics.epoch_loss(rows, weighting=w).select(F.lit(w).alias("weighting"), "epoch_loss")
        for w in ("batch", "example")
    ]
    return _rounded(both[0].unionByName(both[1]))


@query
def run_summary(spark, folder):
    return _rounded(history.run_summary(inputs.epoch_losses(spark, folder)))


# Run histories


@query
def best_epoch(spark, folder):
    return history.best_epoch(inputs.histories(spark, folder))


@query
def improvement_streak(spark, folder):
    return history.improvement_streak(inputs.histories(spark, folder))


@query
def early_stop(spark, folder):
    return history.early_stop(inputs.histories(spark, folder))


@query
def running_accuracy(spark, folder):
    scored = inputs.logits(spark, folder).withColumn("prediction", scores.argmax(F.col("logits")))
    return _rounded(metrics.running_accuracy(scored, ["run_id"]))


@query
def generalization_gap(spark, folder):
    return _rounded(history.generalization_gap(inputs.accuracy_histories(spark, folder), metric="val_acc"))


@query
def val_test_gap(spark, folder):
    return _rounded(
        history.val_test_gap(inputs.accuracy_histories(spark, folder), inputs.test_accuracies(spark, folder))
    )


@query
def history_curves(spark, folder):
    return history.history_curves(inputs.accuracy_histories(spark, folder), ["train_acc", "val_acc"])


@query
def history_perplexity(spark, folder):
    return _rounded(history.with_perplexity(inputs.loss_histories(spark, folder)).drop("epoch_time"))


# Comparisons


@query
def compare_runs(spark, folder):
    measured = ["f1_macro", "training_time_minutes", "epochs", "trainable_parameters"]
    finished = inputs.runs(spark, folder).select("run_id", *[F.col(m).cast("double").alias(m) for m in measured])
    return _rounded(compare.compare_runs(finished, "view", "click", measured))


@query
def run_efficiency(spark, folder):
    return _rounded(compare.run_efficiency(inputs.runs(spark, folder), planned_epochs=2000))


@query
def leaderboard(spark, folder):
    return compare.leaderboard(inputs.user_runs(spark, folder))


# Models


@query
def keyword_classifier(spark, folder):
    scored = classifiers.keyword_classifier(inputs.split_documents(spark, folder))
    return scored.withColumn("score", F.round("score", 3))


@query
def centroid_classifier(spark, folder):
    return _rounded(classifiers.centroid_classifier(inputs.split_vectors(spark, folder)))


@query
def experiment(spark, folder):
    return _rounded(run_experiment(inputs.split_documents(spark, folder), "documents"))


@query
def train_from_text(spark, folder):
    """Loss and accuracy on every split after each step."""
    return _rounded(models.train_from_text(inputs.split_documents(spark, folder))[1])


@query
def save_and_reload(spark, folder):
    """Predictions of a text model that was written, read back and compared with what was written."""
    rows = inputs.split_documents(spark, folder)
    bags = models.text_bags(rows)
    kept = models.save_and_reload(models.train_from_text(rows, bags=bags)[0], rows, bags)
    return models.predict(kept, rows, bags).select(
        "id", "split", "label", "prediction", F.round(F.array_max("logits"), 6).alias("score")
    )


@query
def train_head(spark, folder):
    """Predictions of the layer learnt on fixed vectors."""
    rows = inputs.split_vectors(spark, folder)
    return models.predict(models.train_head(rows), rows).select(
        "id", "split", "label", "prediction", F.round(F.array_max("logits"), 6).alias("score")
    )


def _fixed_weights(batch):
    """Logits of four classes; the weight of dimension d for class c is (7c + 3d) mod 11 - 5."""
    vectors = np.stack(batch["features"].to_numpy()).astype("float64")
    dims, classes = np.arange(vectors.shape[1]), np.arange(4)
    return list(vectors @ ((7 * classes[None, :] + 3 * dims[:, None]) % 11 - 5.0))


@query
def predict_eval(spark, folder):
    scored = models.predict_with(inputs.split_vectors(spark, folder), _fixed_weights, ["features"])
    return scored.select("id", "split", "label", "prediction", F.round(F.array_max("logits"), 6).alias("score"))


@query
def select_model(spark, folder):
    marked = schema.normalize(inputs.quality_documents(spark, folder), "doc_id")
    return _rounded(models.select_model(splits.split_train_val_test(marked)))
