"""Two classifiers with a closed form: keywords (naive Bayes) and nearest centroid.

Both fit on the rows whose ``split`` is ``train`` and score every row. Results have one row per
input row: ``id, split, label``, the ``prediction`` and its ``score``. Equal scores (to 6 places)
go to the lowest class. There may be any number of classes: weights exist for tokens and classes
that met, and what all other classes score follows from three numbers of each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words
from .blocks import CHUNK, groups, in_order, met, numbers_of, pieces, text_blocks
from .encoding import exploded_tokens
from .scale import BROADCAST_BYTES, number, sized_join, store

SCORE_PLACES = 6
CLASS_BYTES = 40  # a class's numbers, as they are sent to the tasks
CARRIED = ["id", "split", "label"]


class TextWeights:
    """What both text classifiers learn from one pass over train.

    ``tokens`` has a row per token with its classes, each with ``keyword`` (log of occurrences and
    one) and ``centroid`` (mean share). ``classes`` has the class's log prior ``prior``, the
    log-likelihood ``unseen`` of a token that it lacks, and ``bias``, minus half its squared centroid.
    """

    def __init__(self, df: DataFrame):
        train = df.filter("split = 'train'")
        classes = store(train.groupBy("label").agg(F.count("*").alias("docs")), "classes")
        total = classes.agg(F.sum("docs")).first()[0]
        if not total:
            raise ValueError("there are no train rows to learn from")
        split = train.select("label", words(F.col("text")).alias("w"))
        shares = split.select("label", F.try_divide(F.lit(1.0), F.size("w")).alias("share"), "w")
        counts = exploded_tokens(shares).groupBy("token", "label").agg(F.count("*").alias("n"), F.sum("share").alias("f"))
        counts = store(sized_join(store(counts, "token-counts"), classes, ["label"]), "token-counts")
        mean = F.col("f") / F.col("docs")
        weight = F.struct(F.col("label").alias("class"), F.log(F.col("n") + 1).alias("keyword"), mean.alias("centroid"))
        self.tokens = store(counts.groupBy("token").agg(F.collect_list(weight).alias("weights")), "token-weights")
        sums = counts.groupBy("label").agg(F.sum("n").alias("n"), (-0.5 * F.sum(mean * mean)).alias("bias"))
        size = self.tokens.count()
        smoothed = F.coalesce("n", F.lit(0)) + size
        self.classes = store(
            classes.join(sums, "label", "left").select(
                F.col("label").alias("class"),
                F.log(F.col("docs") / F.lit(float(total))).alias("prior"),
                (-F.log(F.when(smoothed == 0, 1).otherwise(smoothed))).alias("unseen"),
                F.coalesce("bias", F.lit(0.0)).alias("bias"),
            ),
            "class-weights",
        )


def score_texts(df: DataFrame, weights: TextWeights, recipes: list[str]) -> DataFrame:
    """``id, split, label`` and, for each of ``keywords`` and ``centroids`` asked for, a struct ``prediction, score``.

    Texts meet only the classes that share a token with them. Of all others only the best can
    win, and that depends on nothing but the number of known tokens. Tokens that train lacks add
    nothing. The weights meet each block's tokens once and are added up text by text in the block.
    """
    if weights.classes.count() * CLASS_BYTES > BROADCAST_BYTES:
        raise ValueError("the classes' numbers no longer fit a broadcast")
    known = weights.classes.orderBy("class").select("class", "prior", "unseen", "bias").collect()
    kind = weights.classes.schema["class"].dataType
    labels, numbers = [r[0] for r in known], np.array([r[1:] for r in known], np.float64)  # a null label is a class
    blocks = text_blocks(df, CARRIED, CARRIED)
    found = blocks.dictionary.join(weights.tokens, "token").select("block", "code", F.inline("weights"))

    def best(scores: np.ndarray) -> tuple:
        rounded = np.round(scores, SCORE_PLACES)
        at = int((rounded == rounded.max()).argmax())
        return rounded[at], at, scores[at]

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        prior, unseen, bias = numbers.T
        codes, offsets = numbers_of(texts["codes"], "<i4")
        place = pc.index_in(found["class"], value_set=pa.array(labels, found.schema.field("class").type)).to_numpy()
        order = np.lexsort((place, found["code"].to_numpy()))
        place = place[order].astype(np.int64)
        weight = {r: found[c].to_numpy()[order] for r, c in (("keywords", "keyword"), ("centroids", "centroid")) if r in recipes}
        ends = np.searchsorted(found["code"].to_numpy()[order], np.arange(int(codes.max(initial=0)) + 2))
        classes = np.diff(ends)  # of each token

        group = groups(texts.select(CARRIED))
        by_group, lengths = np.argsort(group, kind="stable"), np.diff(offsets)
        first = np.concatenate([[0], np.cumsum(np.bincount(group))])  # rows of each group
        total = np.concatenate([[0], np.cumsum(classes[codes])])
        met_of = (total[offsets[1:]] - total[offsets[:-1]])[by_group]
        others: dict = {}
        parts = []
        for a, b in pieces(np.concatenate([[0], np.cumsum(met_of + 1)])[first]):
            rows = by_group[first[a] : first[b]]
            token = in_order(codes, offsets[rows], lengths[rows])
            text = np.repeat(group[rows] - a, lengths[rows])
            n = np.bincount(text, classes[token] > 0, b - a).astype(np.int64)
            at = in_order(np.arange(len(place)), ends[token], classes[token])
            key = np.repeat(text, classes[token]) * len(labels) + place[at]
            size = (b - a) * len(labels)
            if size <= 2 * CHUNK:
                there = np.bincount(key, minlength=size) > 0
                pairs, key = np.flatnonzero(there), (np.cumsum(there) - 1)[key]
            else:
                pairs, key = np.unique(key, return_inverse=True)
            whose, which = np.divmod(pairs, len(labels))
            head = np.flatnonzero(np.diff(whose, prepend=-1))
            made = {}
            for r in recipes:
                if r == "keywords":
                    sums = np.bincount(key, weight[r][at], len(pairs))
                    scores = prior[which] + n[whose] * unseen[which] + sums
                else:
                    share = np.repeat(1.0 / np.maximum(lengths[rows], 1), lengths[rows])
                    sums = np.bincount(key, weight[r][at] * np.repeat(share, classes[token]), len(pairs))
                    scores = bias[which] + sums
                kinds, back = np.unique(n if r == "keywords" else np.zeros_like(n), return_inverse=True)
                for x in kinds.tolist():
                    if (r, x) not in others:
                        others[r, x] = best(prior + x * unseen if r == "keywords" else bias)
                top, winner, value = (np.array([others[r, x][i] for x in kinds.tolist()])[back] for i in range(3))
                if len(pairs):
                    rounded = np.round(scores, SCORE_PLACES)
                    highest = np.maximum.reduceat(rounded, head)
                    hit = np.flatnonzero(rounded == np.repeat(highest, np.diff(np.append(head, len(pairs)))))
                    hit = hit[np.unique(whose[hit], return_index=True)[1]]  # the lowest class of equal ones
                    mine, here = whose[hit], which[hit]
                    less = here < winner[mine]
                    same = (here == winner[mine]) & (scores[hit] > value[mine])
                    wins = (rounded[hit] > top[mine]) | ((rounded[hit] == top[mine]) & (less | same))
                    winner[mine[wins]], value[mine[wins]] = here[wins], scores[hit][wins]
                made[f"{r}_prediction"] = pa.array(labels, found.schema.field("class").type).take(pa.array(winner))
                made[f"{r}_score"] = pa.array(value)
            keys = texts.select(CARRIED).take(pa.array(by_group[first[a:b]]))
            parts.append(pa.table([*keys.columns, *made.values()], [*CARRIED, *made]))
        return pa.concat_tables(parts)

    fields = [T.StructField(c, df.schema[c].dataType) for c in CARRIED]
    for r in recipes:
        fields += [T.StructField(f"{r}_prediction", kind), T.StructField(f"{r}_score", T.DoubleType())]
    scored = met(blocks, found, score, T.StructType(fields))
    each = [F.struct(F.col(f"{r}_prediction").alias("prediction"), F.col(f"{r}_score").alias("score")).alias(r) for r in recipes]
    return scored.select(*CARRIED, *each)


def _classify(df: DataFrame, recipe: str) -> DataFrame:
    return score_texts(df, TextWeights(df), [recipe]).select(*CARRIED, f"{recipe}.*")


def keyword_classifier(df: DataFrame) -> DataFrame:
    """Multinomial naive Bayes with add-one smoothing on ``(id, split, label, text)``."""
    return _classify(df, "keywords")


def text_centroid_classifier(df: DataFrame) -> DataFrame:
    """Nearest centroid of term frequencies on ``(id, split, label, text)``."""
    return _classify(df, "centroids")


def centroid_classifier(df: DataFrame, features: str = "features", block_bytes: int = BROADCAST_BYTES // 2) -> DataFrame:
    """Nearest centroid on a fixed feature array; ``(id, split, label)`` are carried over.

    The centroids go to the tasks in blocks of at most ``block_bytes``, in order of their labels;
    each block gives every vector its best class, and the best of the blocks wins. One block is
    enough as long as the model is that small, and then nothing of the vectors is shuffled.
    """
    train = df.filter("split = 'train'")
    long = train.select("label", F.posexplode(F.col(features).cast("array<double>")).alias("dim", "value"))
    means = long.groupBy("label", "dim").agg(F.avg("value").alias("mean"))
    centroid = F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"])
    model = store(
        means.groupBy("label").agg(centroid.alias("w"), (F.sum(F.col("mean") * F.col("mean")) * -0.5).alias("bias")), "centroids"
    )
    classes, values = model.agg(F.count("*"), F.sum(F.size("w") + 2)).first()
    if not classes:
        raise ValueError("there are no train rows to learn from")
    blocks = -(-8 * values // block_bytes)
    size = -(-classes // blocks)
    placed = number(model, ["label"], "_nth") if blocks > 1 else model.withColumn("_nth", F.lit(1))
    placed = store(placed, "centroid-blocks") if blocks > 1 else placed
    kinds = {c: df.schema[c].dataType.simpleString() for c in CARRIED}
    schema = ", ".join(f"{c} {kinds[c]}" for c in CARRIED) + f", prediction {kinds['label']}, score double"
    spark, best = df.sparkSession, None
    for b in range(blocks):
        rows = placed.filter((F.col("_nth") > b * size) & (F.col("_nth") <= (b + 1) * size)) if blocks > 1 else placed
        frame = rows.select("label", "w", "bias").toPandas().sort_values("label")
        sent = spark.sparkContext.broadcast(
            (frame["label"].to_numpy(), np.stack(frame["w"].to_numpy()).T.copy(), frame["bias"].to_numpy())
        )

        def nearest(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            labels, w, bias = sent.value
            step = max(1, (1 << 22) // len(labels))  # scores held at a time
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.iloc[at : at + step]
                    scores = np.round(np.stack(part[features].to_numpy()).astype(np.float64) @ w + bias, SCORE_PLACES)
                    top = scores.argmax(axis=1)
                    yield part[CARRIED].assign(prediction=labels[top], score=scores[np.arange(len(part)), top])

        found = df.select(*CARRIED, features).mapInPandas(nearest, schema)
        best = found if best is None else best.unionByName(found)
    if blocks == 1:
        return best
    first = F.min(F.struct((-F.col("score")).alias("less"), "prediction")).alias("b")
    return best.groupBy(*CARRIED).agg(first).select(*CARRIED, "b.prediction", (-F.col("b.less")).alias("score"))
