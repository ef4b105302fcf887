"""License scan by diagonal voting.

Rolling 3-word runs of the documents are joined to the places of the same run in the templates.
Matches of one template at one offset (document position minus template position) lie on a
diagonal and vote for it; neighbouring diagonals, which stem from inserted or missing words, are
merged; a merged span counts if it covers enough of the template's runs. Runs are compared word by
word, not only by hash. A phrase is found where one diagonal has all its runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm import common as C
from labelloom.operators.scale import sized_join

RUN = 3
MAX_SHIFT = 3
MIN_COVER = 0.8

# Phrases whose every place counts, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Opening sentences of public license notices.
NOTICES = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "mit-notice",
    ),
    (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "apache-2-notice",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "bsd-notice",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "gpl-notice",
    ),
    ("This work is licensed under a Creative Commons Attribution", "cc-by-notice"),
)


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *notices])]
    return spark.createDataFrame(rows, "template int, text string, label string, phrase boolean")


def scan(docs: DataFrame, given: DataFrame | None = None, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per row of ``docs``: word count, phrase places, labels and a score.

    ``n_base`` counts phrase places; ``first_word`` and ``last_word`` are the smallest and largest
    word at which one starts; ``score`` is the largest covered share of any template. Null and
    wordless texts have no matches. Templates need at least three words.
    """
    given = templates(docs.sparkSession) if given is None else given
    split = given.select("template", "label", "phrase", C.words(C.ascii_lower(F.col("text")), C.NOT_ALNUM).alias("w"))
    split = split.filter(F.size("w") >= RUN)
    places = split.select(
        "template", "label", "phrase", (F.size("w") - (RUN - 1)).alias("runs"), F.posexplode(C.shingles(F.col("w"), RUN)).alias("at", "s")
    )
    places = places.select("template", "label", "phrase", "runs", "at", *[x.alias(f"t{i}") for i, x in enumerate(C.parts("s", RUN))])
    places = places.groupBy(*[F.col(f"t{i}").alias(f"w{i}") for i in range(RUN)]).agg(
        F.collect_list(F.struct("template", "label", "phrase", "runs", "at")).alias("places")
    )
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", C.words(C.ascii_lower(F.col("text")), C.NOT_ALNUM).alias("w")
    )
    runs = words.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer(C.shingles(F.col("w"), RUN)).alias("pos", "s"))
    runs = runs.select("row", "doc_id", "n_words", "pos", *[x.alias(f"w{i}") for i, x in enumerate(C.parts("s", RUN))])
    # the first run of a document stays without a match too, so that every document has a row
    met = sized_join(runs, places, [f"w{i}" for i in range(RUN)], "left", spread_by=["row", "pos"]).filter(
        F.col("places").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0)
    )
    one = ["row", "doc_id", "n_words"]
    hits = met.select(*one, "pos", F.explode_outer("places").alias("p")).select(
        *one, "pos", "p.*", (F.col("pos") - F.col("p.at")).alias("diagonal")
    )
    lines = hits.groupBy(*one, "template", "label", "phrase", "runs", "diagonal").agg(F.collect_set("at").alias("covered"))
    order = Window.partitionBy(*one, "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > MAX_SHIFT).cast("int"), F.lit(0))
    spans = (
        lines.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(order))
        .groupBy(*one, "template", "label", "phrase", "runs", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("cover"),
            F.count(F.when(F.size("covered") == F.col("runs"), 1)).alias("whole"),
            F.min(F.when(F.size("covered") == F.col("runs"), F.col("diagonal"))).alias("first"),
            F.max(F.when(F.size("covered") == F.col("runs"), F.col("diagonal"))).alias("last"),
        )
    )
    share = F.col("cover") / F.col("runs")
    base = F.col("phrase") & (F.col("whole") > 0)
    named = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    return spans.groupBy(*one).agg(
        F.coalesce(F.sum(F.when(base, F.col("whole"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        named(base).alias("base_labels"),
        named(base | (~F.col("phrase") & (share >= min_cover))).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    ).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        "labels",
        "score",
    )


def query(spark, folder: str) -> DataFrame:
    return scan(C.table(spark, folder, "documents"))
