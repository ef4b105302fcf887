"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier, fitted on a bounded sample of labelled rows, gives each document's evidence
of being good (quality 1 and not toxic). Over all documents the evidence is summed by host and by
path; a path's rate is shrunk towards its host's and a host's towards the global one, by as many
pseudo-documents as the spread between hosts (paths) asks for. The document's odds are its evidence
odds times path odds over global odds.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common as C
from labelloom.operators.scale import free_name, sized_join

SAMPLE_ROWS = 6_000
MAX_MARKS = 4_000
MIN_TOXIC = 6
MIN_RATIO = 20.0
KEEP_FROM = 0.5
WORD = re.compile(r"\w+")
PREFIXES = (4, 5)


def marks_of(text: str) -> set[str]:
    """Lower-case words and their first letters, the latter with a hyphen."""
    found = set(WORD.findall(text.lower()))
    return found.union(*[{w[:n] + "-" for w in found if len(w) >= n} for n in PREFIXES])


def shape_of(text: str) -> list[float]:
    """What a text looks like: shares of characters, words and lines, each cut off where it is clear."""
    size = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    letters = max(1, int(size[65:91].sum() + size[97:123].sum()))
    n_bytes = max(1, int(size.sum()))
    split = text.split()
    n = max(1, len(split))
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(map(operator.eq, split, split[1:])) / n
    clear = lambda x, most: min(1.0, x / most)
    return [
        math.log1p(len(split)) / 10,
        clear(size[65:91].sum() / letters, 0.5),
        clear(size[33] / n, 0.3),
        clear((size[35:39].sum() + size[42]) / n_bytes, 0.1),
        clear(size[124] / n, 0.2),
        clear(size[48:58].sum() / n_bytes, 0.1),
        clear(again, 0.2),
        1 - len(set(lines)) / max(1, len(lines)),
        clear(len(set(split)) / n, 0.3),
        clear(sum(map(len, split)) / n, 20),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 60) -> np.ndarray:
    """Logistic regression by damped Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[float], list[str]] | None:
    """Weights and toxic marks from at most ``rows`` labelled documents, chosen by a hash of their ids.

    None if the sample has not both good and bad documents; rows with a null label are left out.
    """
    chosen = (
        labels.select("doc_id", "quality", "toxic")
        .dropna()
        .dropDuplicates(["doc_id"])
        .join(docs.select("doc_id").dropDuplicates(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    sample = C.stored(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .dropDuplicates(["doc_id"]),
        "labelled",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                if marks := sorted(marks_of(text)):
                    yield pd.DataFrame({"mark": marks, "toxic": int(toxic)})

    toxic, clean = sample.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") != 1, 1))).first()
    counted = (
        sample.select("text", "toxic").dropDuplicates(["text"]).mapInPandas(run, "mark string, toxic int")
        .groupBy("mark")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    )
    ratio = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    marks = sorted(
        r["mark"]
        for r in counted.filter((F.col("t") >= MIN_TOXIC) & (ratio >= MIN_RATIO))
        .orderBy(F.desc("t"), "mark")
        .limit(MAX_MARKS)
        .collect()
    )
    shaped = sample.select(features(F.col("text"), marks).alias("x"), "quality", "toxic").collect()
    y = np.array([float(r["quality"] == 1 and r["toxic"] != 1) for r in shaped])
    if len(set(y)) < 2:
        return None
    return fit(np.array([r["x"] for r in shaped], float), y).tolist(), marks


def features(text: Column, marks: list[str]) -> Column:
    known = frozenset(marks)

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [[*shape_of(t), min(1.0, hits), math.log1p(hits)] for t in texts if (hits := len(known & marks_of(t))) >= 0]
            )

    return of(text)


def evidence(text: Column, model: tuple[list[float], list[str]] | None) -> Column:
    """The classifier's probability that a text is good; 1 without a model."""
    if model is None:
        return F.lit(1.0)
    weights, marks = model
    x = features(F.coalesce(text, F.lit("")), marks)
    score = F.aggregate(
        F.zip_with(x, F.array(*[F.lit(w) for w in weights[:-1]]), lambda a, b: a * b),
        F.lit(weights[-1]),
        lambda total, z: total + z,
    )
    return 1 / (1 + F.exp(-score))


def _shrunk(groups: DataFrame, prior: Column, strength: float) -> Column:
    return (F.col("good") + strength * prior) / (F.col("n") + strength)


def _strength(groups: DataFrame, centre: Column) -> float:
    """Pseudo-documents of a beta prior, by moments: spread within groups over spread between them."""
    rate = F.col("good") / F.col("n")
    within, between = groups.agg(
        F.avg(centre * (1 - centre)), F.sum((rate - centre) ** 2 * F.col("n")) / F.sum("n")
    ).first()
    if not within or not between:
        return 1_000.0
    return float(min(1_000.0, max(5.0, within / between - 1)))


def site_rates(scored: DataFrame) -> DataFrame:
    """``host, path, rate, overall`` from rows ``host, path, evidence`` of all documents."""
    paths = C.stored(
        scored.groupBy("host", "path").agg(F.sum("evidence").alias("good"), F.count("*").alias("n")), "paths"
    )
    overall = paths.agg(F.sum("good") / F.sum("n")).first()[0]
    overall = min(1 - 1e-6, max(1e-6, overall if overall is not None else 0.5))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    host_rate = _shrunk(hosts, F.lit(overall), _strength(hosts, F.lit(overall)))
    hosts = hosts.select(F.col("host").alias("of"), host_rate.alias("host_rate"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    path_rate = _shrunk(both, F.col("host_rate"), _strength(both, F.col("host_rate")))
    return both.select("host", "path", "host_rate", path_rate.alias("rate"), F.lit(overall).alias("overall"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: str = "source",
    path: str = "lang",
    rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """All columns of ``docs`` with ``_evidence``, ``_rate``, ``_posterior`` and ``_good``.

    ``host`` and ``path`` name columns; null hosts and paths are a site of their own. Null texts and
    texts without words are not good. Without labelled rows of both kinds every other text is good.
    Rows with repeated ids are judged one by one. Columns of ``docs`` may have any names; those with
    the names of the added ones stand beside them in the result.
    """
    judged, names = _judged(docs, labels, host, path, docs.columns, rows)
    return judged.select(*docs.columns, *[F.col(names[n]).alias(f"_{n}") for n in ("evidence", "rate", "posterior", "good")])


def _judged(
    docs: DataFrame, labels: DataFrame, host: str, path: str, keep: list[str], rows: int = SAMPLE_ROWS
) -> tuple[DataFrame, dict[str, str]]:
    """Columns ``keep`` of ``docs`` with what ``classify`` adds, under names that none of its columns has.

    Texts are scored once and stored with their scores; site rates and posteriors come from there.
    """
    names = {n: free_name(f"_{n}", docs.columns) for n in ("host", "path", "rate", "overall", "evidence", "posterior", "good")}
    model = train(docs, labels, rows)
    site = {n: F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in (("host", host), ("path", path))}
    said = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    scored = C.stored(
        docs.select(
            *keep,
            *[s.alias(names[n]) for n, s in site.items()],
            evidence(F.col("text"), model).alias(names["evidence"]),
            said.alias(names["good"]),
        ),
        "scored",
    )
    rates = site_rates(scored.select(*[F.col(names[n]).alias(n) for n in ("host", "path", "evidence")]))
    rates = C.stored(rates, "rates").select(*[F.col(n).alias(names[n]) for n in ("host", "path", "rate", "overall")])
    joined = sized_join(scored, rates, [names["host"], names["path"]], spread_by=["doc_id"])
    odds = lambda n: F.greatest(F.col(names[n]), F.lit(1e-9)) / F.greatest(1 - F.col(names[n]), F.lit(1e-9))
    total = odds("evidence") * odds("rate") / odds("overall")
    joined = joined.withColumn(names["posterior"], total / (1 + total))
    return joined.withColumn(names["good"], F.col(names["good"]) & (F.col(names["posterior"]) >= KEEP_FROM)), names


def query(spark, folder: str) -> DataFrame:
    docs, labels = (C.table(spark, folder, t) for t in ("documents", "labels"))
    judged, names = _judged(docs, labels, "source", "lang", ["doc_id"])
    shown = {"evidence": "evidence", "rate": "site_rate", "posterior": "posterior", "good": "good"}
    return judged.select("doc_id", *[F.col(names[n]).alias(alias) for n, alias in shown.items()])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are good by ``classify``, sites being ``source`` and ``lang``."""
    judged, names = _judged(docs, labels, "source", "lang", docs.columns)
    return judged.filter(F.col(names["good"])).select(*docs.columns)
