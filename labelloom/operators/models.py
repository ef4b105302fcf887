"""Trained linear models: softmax regression on texts, a ridge layer on fixed vectors, and their choice.

Weights are tables, training is a fixed number of steps over Spark aggregates, and nothing is drawn
by chance, so every loss and prediction can be computed again elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import argmax
from .blocks import CHUNK, Blocks, binaries, in_order, met, numbers_of, pieces, text_blocks
from .encoding import build_vocab
from .metrics import classification_metrics
from .scale import bucketed, scratch_path, store

INTERCEPT = 0  # feature id; the vocabulary's ids begin at 2
MAX_DIMENSIONS = 4096
CARRIED = ["id", "split", "label"]


@dataclass(frozen=True)
class Candidate:
    """Settings of one training run: L2 penalty (not on the intercept), step size, full-batch steps."""

    l2: float = 0.0001
    rate: float = 12.0
    steps: int = 5


# The small grid that select_model tries by default.
CANDIDATES = [Candidate(0.01, 4.0, 2), Candidate(0.001, 12.0, 4), Candidate(0.0, 12.0, 5)]


@dataclass
class LinearModel:
    """``weights (feature, token, w)`` with one number per class in ``w``; ``token`` is null for vectors.

    Feature 0 of a text model and feature -1 of a vector model is the intercept.
    """

    weights: DataFrame
    classes: list
    features: str  # "text" or the name of the vector column


def _train_rows(df: DataFrame) -> DataFrame:
    return df.filter("split = 'train'")


def _classes(df: DataFrame) -> list:
    found = sorted(r.label for r in _train_rows(df).select("label").distinct().collect())
    if not found:
        raise ValueError("there are no train rows to learn from")
    return found


# Texts


@dataclass
class Design:
    """Counts of tokens over the length of each text's count vector, and where the tokens' weights are.

    ``blocks`` has the texts: ``id``, the ``split`` and ``label`` of its rows, codes and counts of its
    tokens. Weights lie in as many parts as there are blocks: that of a feature in the part of its
    remainder, in the order of its quotient. ``places (part, block, codes, at)`` says which tokens
    of a block have their weights where in a part, code -1 being the intercept.
    """

    blocks: Blocks
    places: DataFrame
    slots: int  # weights of a part


def text_bags(df: DataFrame) -> Blocks:
    """The texts of ``(id, split, label, text)`` as counts of their tokens; texts that share an id count as one."""

    def bags(keys: pa.Table, codes: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        group, ids = pd.factorize(keys["id"].to_pandas(), sort=False)
        order = np.argsort(group, kind="stable")
        keys = keys.take(pa.array(order)).combine_chunks()
        starts, lengths = offsets[order], np.diff(offsets)[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(ids)))])  # rows of each id
        bounds = np.concatenate([[0], np.cumsum(lengths)])[first]
        lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), keys[c].combine_chunks()) for c in CARRIED[1:]]
        whole = pa.table([keys["id"].take(pa.array(first[:-1])), *lists], CARRIED)
        for a, b in pieces(bounds):
            rows = slice(first[a], first[b])
            text = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
            both, n = np.unique(text << 32 | in_order(codes, starts[rows], lengths[rows]), return_counts=True)
            ends = np.searchsorted(both >> 32, np.arange(b - a + 1))
            part = whole.slice(a, b - a).combine_chunks()
            part = part.append_column("codes", binaries((both & 0xFFFFFFFF).astype(np.int32), ends))
            yield from part.append_column("counts", binaries(n.astype(np.int32), ends)).to_batches()

    lists = {c: T.ArrayType(df.schema[c].dataType) for c in CARRIED[1:]}
    kept = {**lists, "codes": T.BinaryType(), "counts": T.BinaryType()}
    return text_blocks(df.filter(F.col("id").isNotNull()), CARRIED, ["id"], shape=bags, kept=kept)


def design_matrix(df: DataFrame, vocab: DataFrame, bags: Blocks | None = None) -> Design:
    """The texts as ``text_bags`` (``bags`` if the caller has them) and the places of the known tokens' weights.

    A token is in a block's dictionary once, so the join with the vocabulary has no hot keys.
    """
    bags = bags or text_bags(df)
    parts = np.array(bags.numbers)
    known = bags.dictionary.join(vocab.select("token", F.col("token_id").cast("long").alias("feature")), "token")
    every = bags.texts.select("block").distinct()
    ones = every.select("block", F.lit(-1).alias("code"), F.lit(INTERCEPT).cast("long").alias("feature"))

    def dealt(found: pa.Table) -> pa.Table:
        feature, code = found["feature"].to_numpy(), found["code"].to_numpy().astype(np.int32)
        order = np.lexsort((feature, feature % len(parts)))
        ends = np.searchsorted(feature[order] % len(parts), np.arange(len(parts) + 1))
        some = np.flatnonzero(np.diff(ends))
        at = (feature[order] // len(parts)).astype(np.int32)
        block = pa.array(np.full(len(parts), found["block"][0].as_py()))
        return pa.table([pa.array(parts), block, binaries(code[order], ends), binaries(at, ends)], ["part", "block", "codes", "at"]).take(some)

    rows = known.select("block", "code", "feature").unionByName(ones).groupBy("block").applyInArrow(
        dealt, "part long, block long, codes binary, at binary"
    )
    places = bucketed(rows.repartition(len(parts), "part"), "part", len(parts), "places")
    last = vocab.agg(F.max("token_id")).first()[0] or INTERCEPT
    return Design(bags, places, int(last) // len(parts) + 1)


PARTS = "part long, data binary"  # all weights of a part: place after place of ``w``, slot after slot


def _sent(design: Design, weights: DataFrame, size: int) -> DataFrame:
    """Each part's weights on their way to the blocks that have the tokens."""

    def send(places: pa.Table, weights: pa.Table) -> pa.Table:
        w = np.zeros((size, design_slots))
        if weights.num_rows:
            w = numbers_of(weights["data"], "<f8")[0].reshape(size, -1)
        at, ends = numbers_of(places["at"], "<i4")
        data = [w[:, at[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        return places.select(["block", "part", "codes"]).append_column("data", pa.array(data, pa.binary()))

    design_slots = design.slots
    return design.places.groupBy("part").cogroup(weights.groupBy("part")).applyInArrow(
        send, "block long, part long, codes binary, data binary"
    )


def _met_weights(texts: pa.Table, sent: pa.Table, size: int) -> tuple:
    """Logits of a block's texts, with what they were made of: codes, shares and offsets, rows per id, places of each part."""
    codes, offsets = numbers_of(texts["codes"], "<i4")
    counts = numbers_of(texts["counts"], "<i4")[0]
    w = np.zeros((size, (int(codes.max()) if len(codes) else 0) + 2))  # the last is the intercept's
    here, ends = numbers_of(sent["codes"], "<i4")
    values = numbers_of(sent["data"], "<f8")[0]
    for a, b in zip(ends[:-1], ends[1:]):
        w[:, here[a:b]] = values[size * a : size * b].reshape(size, -1)
    rows = pc.list_value_length(texts["split"]).to_numpy()
    z, x = np.outer(rows, w[:, -1]), np.empty(len(codes))
    for a, b in pieces(offsets):
        part = slice(offsets[a], offsets[b])
        text = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        n = counts[part].astype(np.float64)
        x[part] = n / np.sqrt(np.bincount(text, n * n, b - a))[text]
        for j in range(size):
            z[a:b, j] += np.bincount(text, x[part] * w[j, codes[part]], b - a)
    return z, codes, x, offsets, rows, here, ends


def _logit_rows(texts: pa.Table, z: np.ndarray, rows: np.ndarray) -> pa.Table:
    """A row per row that the texts came from: ``id, split, label, z``."""
    of = np.repeat(np.arange(len(rows)), rows)
    flat = pa.array(z[of].ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * z.shape[1]), flat)
    split, label = (pc.list_flatten(texts[c]) for c in CARRIED[1:])
    return pa.table([texts["id"].take(pa.array(of)), split, label, lists], [*CARRIED, "z"])


def _logits(design: Design, weights: DataFrame, size: int) -> DataFrame:
    """``(id, split, label, z)``: for each place of ``w`` the sum of a text's shares times their weights."""

    def score(texts: pa.Table, sent: pa.Table) -> pa.Table:
        z, *_, rows, _, _ = _met_weights(texts, sent, size)
        return _logit_rows(texts, z, rows)

    kinds = {f.name: f.dataType for f in design.blocks.texts.schema}
    fields = [T.StructField("id", kinds["id"]), *[T.StructField(c, kinds[c].elementType) for c in CARRIED[1:]]]
    schema = T.StructType([*fields, T.StructField("z", T.ArrayType(T.DoubleType()))])
    return met(design.blocks, _sent(design, weights, size), score, schema)


def _in_parts(weights: DataFrame, design: Design, size: int) -> DataFrame:
    """``(feature, w)`` as the parts that ``_sent`` takes."""
    parts, slots = np.array(design.blocks.numbers), design.slots
    of = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.pmod("feature", F.lit(len(parts))).cast("int") + 1)

    def pack(rows: pa.Table) -> pa.Table:
        w = np.zeros((size, slots))
        w[:, rows["feature"].to_numpy() // len(parts)] = pc.list_flatten(rows["w"]).to_numpy().reshape(-1, size).T
        return pa.table([rows["part"][:1], pa.array([w.tobytes()], pa.binary())], ["part", "data"])

    return weights.select(of.cast("long").alias("part"), "feature", "w").groupBy("part").applyInArrow(pack, PARTS)


def _from_parts(weights: DataFrame, design: Design, size: int) -> DataFrame:
    """The parts as ``(feature, w)``, in the order of their places."""
    place = {int(p): i for i, p in enumerate(design.blocks.numbers)}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["data"]):
                w = np.frombuffer(data.as_buffer(), "<f8").reshape(size, -1)
                for a in range(0, w.shape[1], CHUNK // 64):
                    some = np.ascontiguousarray(w[:, a : a + CHUNK // 64].T)
                    feature = (a + np.arange(len(some))) * len(place) + place[part]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * size), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(feature), lists], ["feature", "w"])

    return weights.select("part", "data").mapInArrow(unpack, "feature long, w array<double>")


def _each(z: str, candidates: int, classes: int) -> Column:
    """The logits of each candidate."""
    return F.array(*[F.slice(z, c * classes + 1, classes) for c in range(candidates)])


def _log_total(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda total, v: total + F.exp(v - top)))


@dataclass
class Fit:
    weights: DataFrame  # feature, w: candidate after candidate, one number per class each
    classes: list
    logits: list[DataFrame]  # after each step: id, split, label, target, z


def fit_texts(df: DataFrame, design: Design, candidates: list[Candidate]) -> Fit:
    """Full-batch gradient steps of all candidates at once, from zero.

    A step reads each block's texts once: with the weights that came from the parts it makes the
    logits and what the probabilities miss, and sums up its gradient, one number per token and class.
    The parts add up the blocks' gradients and move their weights. So what travels are the blocks'
    dictionaries and not the texts. A candidate whose steps are done keeps its weights.
    """
    classes = _classes(df)
    k, size, slots = len(classes), len(candidates) * len(classes), design.slots
    n = df.filter("split = 'train'").count()
    steps = max(c.steps for c in candidates)
    kinds = {f.name: f.dataType for f in design.blocks.texts.schema}
    carried = [T.StructField("id", kinds["id"]), *[T.StructField(c, kinds[c].elementType) for c in CARRIED[1:]]]
    scored = [*carried, T.StructField("target", T.IntegerType()), T.StructField("z", T.ArrayType(T.DoubleType()))]
    part, data = T.StructField("part", T.LongType()), T.StructField("data", T.BinaryType())
    block = T.StructField("block", T.LongType())
    moving, moved = T.StructType([part, block, data, *scored]), T.StructType([part, data, *scored])
    first = int(design.blocks.numbers[0])  # the part of the intercept, in its slot 0

    def filled(rows: pa.Table, like: pa.Schema, n: int) -> pa.Table:
        return pa.table([rows[f.name] if f.name in rows.column_names else pa.nulls(n, f.type) for f in like], like.names)

    def forward(texts: pa.Table, sent: pa.Table) -> pa.Table:
        z, codes, x, offsets, rows, here, ends = _met_weights(texts, sent, size)
        out = _logit_rows(texts, z, rows)
        label = out["label"].combine_chunks()
        place = pc.index_in(label, value_set=pa.array(classes, label.type))
        target = pc.if_else(label.is_null(), pa.scalar(None, pa.int32()), pc.fill_null(place, -1))
        out = out.append_column("target", target)
        block = texts["block"][0].as_py()
        out = out.append_column("part", pa.array(np.full(len(out), block)))
        # what the probabilities miss, over the train rows of each id
        of = np.repeat(np.arange(len(rows)), rows)
        train = np.flatnonzero(pc.fill_null(pc.equal(out["split"], "train"), False).to_numpy())
        missed, times = np.zeros_like(z), np.bincount(of[train], minlength=len(rows))[:, None]
        aim = place.to_numpy(zero_copy_only=False)[train]
        for a in range(0, size, k):
            p = np.exp(z[:, a : a + k] - z[:, a : a + k].max(axis=1, keepdims=True))
            missed[:, a : a + k] = times * p / p.sum(axis=1, keepdims=True)
            known = ~np.isnan(aim.astype(np.float64))
            np.subtract.at(missed, (of[train][known], a + aim[known].astype(np.int64)), 1.0)
        width = (int(codes.max()) if len(codes) else 0) + 2
        g = np.zeros((size, width))
        g[:, -1] = rows @ missed
        for a, b in pieces(offsets):
            some = slice(offsets[a], offsets[b])
            text = np.repeat(np.arange(a, b), np.diff(offsets[a : b + 1]))
            for j in range(size):
                g[j] += np.bincount(codes[some], x[some] * missed[text, j], width)
        sums = pa.array([g[:, here[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
        blocks = pa.array(np.full(sent.num_rows, block))
        gradient = pa.table([sent["part"], blocks, sums], ["part", "block", "data"])
        like = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())] + [(c, out.schema.field(c).type) for c in [*CARRIED, "target", "z"]])
        return pa.concat_tables([filled(gradient, like, len(gradient)), filled(out, like, len(out))])

    def step_of(step: int) -> Callable:
        def back(key: tuple, places: pa.Table, sent: pa.Table) -> pa.Table:
            number = key[0].as_py()
            at, ends = numbers_of(places["at"], "<i4")
            where = {b: at[x:y] for b, x, y in zip(places["block"].to_pylist(), ends[:-1], ends[1:])}
            w, g = np.zeros((size, slots)), np.zeros((size, slots))
            numeric = sent.filter(sent["data"].is_valid()).select(["block", "data"]).sort_by("block")
            for b, values in zip(numeric["block"].to_pylist(), numeric["data"]):
                array = np.frombuffer(values.as_buffer(), "<f8").reshape(size, -1)
                if b < 0:
                    w = array
                else:
                    g[:, where[b]] += array
            new = w.copy()
            for c, one in enumerate(candidates):
                if step <= one.steps:
                    some = slice(c * k, c * k + k)
                    shrink = one.l2 * w[some]
                    if number == first:
                        shrink[:, INTERCEPT] = 0.0
                    new[some] = w[some] - one.rate * (g[some] / n + shrink)
            logits = sent.filter(sent["data"].is_null()).select(["part", *[f.name for f in scored]])
            like = pa.schema([("part", pa.int64()), ("data", pa.binary())] + [(f.name, logits.schema.field(f.name).type) for f in scored])
            rows = pa.table([pa.array([number]), pa.array([new.tobytes()], pa.binary())], ["part", "data"])
            kept = [filled(rows, like, 1)] if places.num_rows else []
            return pa.concat_tables([*kept, filled(logits, like, len(logits))])

        return back

    spark, logits = df.sparkSession, []
    weights = spark.createDataFrame([], PARTS)
    for step in range(1, steps + 1):
        out = met(design.blocks, _sent(design, weights, size), forward, moving)
        before = weights.withColumn("block", F.lit(-1).cast("long"))
        sent = out.unionByName(before, allowMissingColumns=True)
        table = store(design.places.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(step_of(step), moved), "weights")
        if step > 1:
            logits.append(table.filter("data IS NULL").select(*[f.name for f in scored]))
        weights = table.filter("data IS NOT NULL").select("part", "data")
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    last = store(_logits(design, weights, size).select(*CARRIED, place.cast("int").alias("target"), "z"), "logits")
    return Fit(_from_parts(weights, design, size), classes, [*logits, last])


def learning_curve(fit: Fit, candidates: list[Candidate]) -> DataFrame:
    """``candidate, epoch, split, n, loss, accuracy`` after each step; labels that train lacks have no loss."""
    curves, k = None, len(fit.classes)
    labels = F.array(*[F.lit(c) for c in fit.classes])
    for step, state in enumerate(fit.logits, start=1):
        each = F.explode(F.transform(_each("z", len(candidates), k), lambda x, i: F.struct((i + 1).alias("candidate"), x.alias("x"))))
        one = state.select(*CARRIED, "target", each.alias("e")).select(*CARRIED, "target", F.lit(step).alias("epoch"), "e.*")
        curves = one if curves is None else curves.unionByName(one)
    loss = F.when(F.col("target") >= 0, _log_total(F.col("x")) - F.get("x", F.col("target")))
    right = F.element_at(labels, argmax(F.col("x")) + 1) == F.col("label")
    return curves.groupBy("candidate", "epoch", "split").agg(
        F.count("*").alias("n"), F.avg(loss).alias("loss"), (F.count_if(right) / F.count("*")).alias("accuracy")
    )


def train_from_text(df: DataFrame, candidate: Candidate = Candidate(), bags: Blocks | None = None) -> tuple[LinearModel, DataFrame]:
    """Learn every weight from the text of train ``(id, split, label, text)``; the model and its learning curve.

    Every token of train has a weight of its own for each class. Ids must be unique. ``bags`` are
    the ``text_bags`` of ``df``, if the caller has them.
    """
    vocab = build_vocab(_train_rows(df))
    design = design_matrix(df, vocab, bags)
    fit = fit_texts(df, design, [candidate])
    tokens = vocab.select(F.col("token_id").cast("long").alias("feature"), "token")
    weights = fit.weights.join(tokens, "feature", "left").filter(F.col("token").isNotNull() | (F.col("feature") == INTERCEPT))
    model = LinearModel(store(weights.select("feature", "token", "w"), "model"), fit.classes, "text")
    return model, learning_curve(fit, [candidate]).drop("candidate")


# Fixed vectors


def moments(df: DataFrame, features: str, classes: list) -> tuple[np.ndarray, np.ndarray, int]:
    """Gram matrix of the vectors and a one, their sums by class, and the number of rows.

    Each task adds up the outer products of its rows; the sums are merged by place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.stack(batch["x"].to_numpy()), np.ones(len(batch))]).astype(np.float64)
                y = batch["target"].to_numpy()[:, None] == np.arange(len(classes))[None, :]
                here = x.T @ np.column_stack([x, y])
                total = here if total is None else total + here
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    rows = df.select(F.col(features).cast("array<double>").alias("x"), place.cast("int").alias("target"))
    found = rows.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    size = int(found["i"].max()) + 1
    if size > MAX_DIMENSIONS + 1:
        raise ValueError(f"vectors of more than {MAX_DIMENSIONS} dimensions")
    whole = np.zeros((size, size + len(classes)))
    whole[found["i"], found["j"]] = found["v"]
    return whole[:, :size], whole[:, size:], int(round(whole[size - 1, size - 1]))


def train_head(df: DataFrame, features: str = "features", l2: float = 0.1) -> LinearModel:
    """Learn only the classification layer on fixed vectors: ridge regression of the classes.

    Solves ``(XᵀX + l2 n I) W = XᵀY``, with a one added to each vector whose weight isn't shrunk.
    The matrix has as many rows as the vectors have dimensions, whatever the number of rows.
    """
    train, classes = _train_rows(df), _classes(df)
    gram, sums, n = moments(train, features, classes)
    penalty = np.eye(len(gram)) * l2 * n
    penalty[-1, -1] = 0.0
    solved = np.linalg.solve(gram + penalty, sums)
    rows = [(i if i < len(solved) - 1 else -1, None, [float(v) for v in w]) for i, w in enumerate(solved)]
    weights = df.sparkSession.createDataFrame(rows, "feature long, token string, w array<double>")
    return LinearModel(store(weights.coalesce(1), "model"), classes, features)


# Using models


def predict(model: LinearModel, df: DataFrame, bags: Blocks | None = None) -> DataFrame:
    """``(id, split, label, logits, prediction)``; predictions stay distributed.

    ``bags`` are the ``text_bags`` of ``df``, if the caller has them.
    """
    labels = F.array(*[F.lit(c) for c in model.classes])
    if model.features == "text":
        vocab = model.weights.filter(f"feature <> {INTERCEPT}").select("token", F.col("feature").alias("token_id"))
        design, size = design_matrix(df, vocab, bags), len(model.classes)
        rows = _logits(design, _in_parts(model.weights, design, size), size).withColumnRenamed("z", "logits")
        return rows.select(*CARRIED, "logits", F.element_at(labels, argmax(F.col("logits")) + 1).alias("prediction"))
    solved = {r.feature: r.w for r in model.weights.collect()}  # dimensions times classes
    intercept = np.array(solved.pop(-1))
    weights = np.array([solved[i] for i in range(len(solved))])
    column = model.features

    def scorer(batch: pd.DataFrame) -> list:
        return list(np.stack(batch[column].to_numpy()).astype(np.float64) @ weights + intercept)

    scored = predict_with(df, scorer, [column])
    return scored.withColumn("prediction", F.element_at(labels, F.col("prediction") + 1))


_LOADED: dict[str, Callable] = {}


def _scorer(key: str, load: Callable) -> Callable:
    """What ``load`` gives, kept in this worker for the tasks to come."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = load()
    return _LOADED[key]


def predict_with(
    df: DataFrame, scorer: Callable[[pd.DataFrame], list] | None, columns: list[str], load: Callable[[], Callable] | None = None
) -> DataFrame:
    """As ``predict``, for any function from a batch of the given columns to a list of logits.

    With ``load`` instead of ``scorer`` each worker calls it once and keeps the function that it
    returns, so a large model is read where it is used and doesn't travel with the tasks.
    """
    if (scorer is None) == (load is None):
        raise ValueError("give either scorer or load")
    key = uuid.uuid4().hex

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer or _scorer(key, load)
        for frame in frames:
            out = frame[CARRIED].copy()
            out["logits"] = list(score(frame[columns]))
            yield out

    fields = [*CARRIED, *[c for c in columns if c not in CARRIED]]
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in CARRIED)
    scored = df.select(*fields).mapInPandas(batches, f"{kept}, logits array<double>")
    return scored.withColumn("prediction", argmax(F.col("logits")))


# Saving


def fingerprint(df: DataFrame) -> str:
    """Number of rows and their hashes combined, whatever their order."""
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
    return f"{row.n}:{row.x or 0}"


def save(model: LinearModel, path: str, scored: DataFrame | None = None, bags: Blocks | None = None) -> None:
    """Write weights and, beside them, their fingerprint and that of the predictions for ``scored``."""
    model.weights.write.parquet(f"{path}/weights")
    spark = model.weights.sparkSession
    said = "" if scored is None else fingerprint(predict(model, scored, bags).select("id", "prediction"))
    about = [(model.features, str(len(model.classes)), fingerprint(spark.read.parquet(f"{path}/weights")), said)]
    described = spark.createDataFrame(about, "features string, size string, weights string, predictions string")
    described.coalesce(1).write.json(f"{path}/about")
    classes = spark.createDataFrame([(i, c) for i, c in enumerate(model.classes)]).toDF("place", "label")
    classes.coalesce(1).write.parquet(f"{path}/classes")


def load(spark, path: str, scored: DataFrame | None = None, bags: Blocks | None = None) -> LinearModel:
    """Read a saved model; an error if its weights, or its predictions for ``scored``, aren't those saved."""
    about = spark.read.json(f"{path}/about").first()
    weights = spark.read.parquet(f"{path}/weights")
    if fingerprint(weights) != about.weights:
        raise ValueError(f"the weights in {path} aren't those that were saved")
    classes = [r.label for r in spark.read.parquet(f"{path}/classes").orderBy("place").collect()]
    model = LinearModel(weights, classes, about.features)
    if scored is not None and fingerprint(predict(model, scored, bags).select("id", "prediction")) != about.predictions:
        raise ValueError(f"the model in {path} predicts otherwise than when it was saved")
    return model


def save_and_reload(model: LinearModel, df: DataFrame, bags: Blocks | None = None) -> LinearModel:
    """Through the shared folder, so that what is scored is what was kept; checked on the rows of ``df``.

    Both checks predict anew, from the weights at hand and from those read back; only the texts'
    ``bags``, which don't depend on the model, are made once.
    """
    path = scratch_path(df.sparkSession, "model")
    if model.features == "text":
        bags = bags or text_bags(df)
    save(model, path, df, bags)
    return load(df.sparkSession, path, df, bags)


# Choosing


def select_model(df: DataFrame, candidates: list[Candidate] | None = None) -> DataFrame:
    """Train all candidates in the same passes; one row each with its validation macro F1.

    The validation metrics of all come from one scan of the stacked logits. The first with the
    highest F1 above 0 is ``best``; only that one is scored on test.
    """
    candidates = candidates or CANDIDATES
    fit = fit_texts(df, design_matrix(df, build_vocab(_train_rows(df))), candidates)
    labels = F.array(*[F.lit(c) for c in fit.classes])
    each = F.transform(
        _each("z", len(candidates), len(fit.classes)),
        lambda x, i: F.struct((i + 1).alias("candidate"), F.element_at(labels, argmax(x) + 1).alias("prediction")),
    )
    scored = fit.logits[-1].select("split", "label", F.inline(each))
    measured = {r.candidate: r.f1_macro for r in classification_metrics(scored.filter("split = 'validation'"), ["candidate"]).collect()}
    best_f1, best = 0.0, None
    for number in range(1, len(candidates) + 1):
        if measured.get(number, 0.0) > best_f1:
            best_f1, best = measured[number], number
    test = None
    if best is not None:
        test = classification_metrics(scored.filter((F.col("split") == "test") & (F.col("candidate") == best)), ["split"]).first()
    reported = ["accuracy", "f1_macro", "f1_weighted"]
    rows = [
        (n, c.l2, c.rate, c.steps, measured.get(n, 0.0), n == best, *[test[m] if test and n == best else None for m in reported])
        for n, c in enumerate(candidates, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "candidate int, l2 double, rate double, steps int, val_f1_macro double, best boolean, "
        + ", ".join(f"test_{m} double" for m in reported),
    )
