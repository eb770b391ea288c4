"""License scans by diagonal voting.

All rolling word 3-grams of all texts join by hash to their places in a small table of templates. A hit votes for its diagonal:
its place in the text minus its place in the template. Votes are counted by diagonal, so a template that stands word for word gets
all its votes on one; inserted or missing words shift the rest to a neighbouring diagonal, and neighbours merge to a
span. A span is verified against the template: a gram of the template counts once, however often the text has it, and only
where the span's diagonals follow in the template's order. A span counts when it then covers enough of the template and is
not much longer than it. Hits compare the words themselves as well, so a full diagonal is an exact match.

Only DataFrame functions are used. The template table is fixed and small, so it is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
NEAR = 3  # diagonals this close merge
COVER = 0.6  # share of a template's grams that a span needs
MOST_GRAMS = 63  # of a template: places seen are bits of a long
LONGER = 1.5  # span over template length, at most


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False  # counts only where its words stand consecutively


# Base phrases, and wordings of public licenses.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    Template("gpl", "gnu general public license"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "creative commons zero"),
    Template("proprietary", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits and of signs beyond ASCII.

    ``lower`` also changes letters beyond ASCII; they stay beyond it, except the Kelvin sign, which is set aside
    before it turns into a plain k.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e7"))
    return F.array_remove(F.split(F.lower(plain), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(template, label, base, length, t_at, t_words, t_hash): a row for each gram of each template."""
    rows = []
    for number, template in enumerate(templates):
        words = template.text.split()
        if len(words) < GRAM:
            raise ValueError(f"template {template.text!r} is shorter than {GRAM} words")
        if len(words) - GRAM >= MOST_GRAMS:
            raise ValueError(f"template {template.text!r} has more than {MOST_GRAMS} grams; give it in parts")
        rows += [
            (number, template.label, template.base, len(words), at, words[at : at + GRAM])
            for at in range(len(words) - GRAM + 1)
        ]
    table = spark.createDataFrame(
        rows, "template int, label string, base boolean, length int, t_at int, t_words array<string>"
    )
    return table.withColumn("t_hash", F.xxhash64(*[F.col("t_words")[i] for i in range(GRAM)]))


def _votes(docs: DataFrame, id_col: str, text_col: str, grams: DataFrame) -> DataFrame:
    """One row per document and diagonal with votes, and one row per document with a null template."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        words_of(F.col(f"`{text_col}`")).alias("words"),
    )
    n = F.size("words")
    places = F.when(n >= GRAM, F.sequence(F.lit(0), n - GRAM)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(GRAM)]))
    # the null at the end keeps each document in the result, whether it has a hit or not
    rolled = texts.withColumn("hashes", F.concat(hashes, F.array(F.lit(None).cast("long"))))
    exploded = rolled.select("row", "id", "words", F.size("words").alias("n_words"), F.posexplode("hashes").alias("at", "hash"))
    same = (F.col("hash") == F.col("t_hash")) & (F.slice("words", F.col("at") + 1, GRAM) == F.col("t_words"))
    hits = exploded.join(F.broadcast(grams), same, "left").where("template is not null or hash is null")
    return (
        hits.select("row", "id", "n_words", "template", "label", "base", "length", (F.col("at") - F.col("t_at")).alias("diagonal"), "at", "t_at")
        .groupBy("row", "id", "n_words", "template", "label", "base", "length", F.when(F.col("template").isNotNull(), F.col("diagonal")).alias("diagonal"))
        .agg(
            F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"), F.min("t_at").alias("t_low"),
            F.max("t_at").alias("t_high"), F.bit_or(F.expr("shiftleft(1L, t_at)")).alias("seen"),
        )
    )


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text is empty; an empty text has 0 words, null places, empty labels and score 0. Rows that repeat an id are scanned
    one by one. Overlapping places of a phrase all count. An empty table gives an empty table.
    """
    votes = _votes(docs, id_col, text_col, template_grams(docs.sparkSession, templates))
    of_template = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(of_template)
    apart = F.coalesce((gap > NEAR) | F.col("base"), F.lit(True)).cast("int")
    numbered = votes.withColumn("starts", apart).withColumn("band", F.sum("starts").over(of_template))
    # a diagonal counts where it goes on in the template behind those before it in the text
    earlier = Window.partitionBy("row", "template", "band").orderBy("low", "diagonal").rowsBetween(Window.unboundedPreceding, -1)
    follows = F.coalesce(F.col("t_low") > F.max("t_high").over(earlier), F.lit(True))
    checked = numbered.withColumn("seen", F.when(follows, F.col("seen")).otherwise(F.lit(0).cast("long")))
    spans = checked.groupBy("row", "id", "n_words", "template", "label", "base", "length", "band").agg(
        F.sum("votes").alias("votes"), F.bit_count(F.bit_or("seen")).alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal")
    )
    cover = F.col("covered") / (F.col("length") - GRAM + 1)
    fits = F.col("high") - F.col("low") + GRAM <= F.col("length") * LONGER
    exact = F.coalesce(F.col("base") & (F.col("votes") == F.col("length") - GRAM + 1), F.lit(False))
    close = F.coalesce(~F.col("base") & (cover >= COVER) & fits, F.lit(False))
    start = F.when(exact, F.col("diagonal")).cast("long")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return (
        spans.groupBy("row", "id", "n_words")
        .agg(
            F.count(F.when(exact, 1)).alias("n_base"),
            F.min(start).alias("first_word"),
            F.max(start).alias("last_word"),
            joined(exact).alias("base_labels"),
            joined(exact | close).alias("labels"),
            F.coalesce(F.max(F.when(exact | close, cover)), F.lit(0.0)).alias("score"),
        )
        .select(
            F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word",
            "base_labels", "labels", "score",
        )
    )
