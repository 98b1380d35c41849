"""Licences in texts, by a positional index of the templates' rare words.

Built-in functions only.  Licence phrases are counted in every text by themselves.  Beyond them, templates are found
even where their text is cut or altered:

1. Every word of every text meets the template vocabulary (a few dozen words, broadcast); what remains are places of licence words,
   and document counts, hence IDF, over the whole corpus.
2. For each template whose key phrases it holds, a document looks up its ``rare_words`` words of that template of highest
   IDF, so templates do not take each other's places.  A posting ``(template, position)`` and a place
   in the text give an offset; words that agree on an offset stand in the text as they stand in the template.
3. The IDF of agreeing words over that of the template's own rarest words is the score; a template also needs all of its
   key phrases.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lineloom.llm.rows import ascii_lower, row_key
from lineloom.workspace import Workspace

# Fixed phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
LEAST_LETTERS = 5
RARE_WORDS = 8
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Template:
    text: str
    required: tuple[str, ...]


TEMPLATES = {
    "apache": Template(
        "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
        ("apache license",),
    ),
    "bsd": Template(
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met", ("redistribution and use",),
    ),
    "cc": Template(
        "this work is licensed under a creative commons attribution international license", ("creative commons",)
    ),
    "gpl": Template(
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation", ("general public license",),
    ),
    "isc": Template(
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted", ("hereby granted", "permission to use"),
    ),
    "mit": Template(
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files", ("permission is hereby granted",),
    ),
    "mit-notice": Template("released under the mit license", ("mit license",)),
    "mpl": Template(
        "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)
    ),
}


def spaced_words(text: str = "text") -> Column:
    """The words in lower case, a blank before, between and after them; one blank for none."""
    lowered = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    spaced = F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """``doc_id, row_key, n_words, n_base, first_word, last_word, base`` (sorted labels) for every row."""
    docs = docs.select("doc_id", row_key().alias("row_key"), spaced_words().alias("spaced"))
    spaced = F.col("spaced")
    n_words = F.when(F.length(spaced) <= 2, F.lit(0)).otherwise(_blanks(spaced) - 1)
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        padded = f" {phrase} "
        has = spaced.contains(padded)
        # blanks up to the one before the first place; blanks behind the last one
        first = _blanks(F.substr(spaced, F.lit(1), F.instr(spaced, padded))) - 1
        tail = _blanks(F.substring_index(spaced, padded, -1)) + 1
        last = _blanks(spaced) - tail - len(phrase.split())
        counts.append(F.when(has, F.regexp_count(spaced, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(F.lit(0)))
        firsts.append(F.when(has, first))
        lasts.append(F.when(has, last))
        labels.append(F.when(has, F.lit(label)))
    return docs.select(
        "doc_id", "row_key", n_words.cast("bigint").alias("n_words"), sum(counts[1:], counts[0]).cast("bigint").alias("n_base"),
        F.least(*firsts).cast("bigint").alias("first_word"), F.greatest(*lasts).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    )


def template_matches(
    docs: DataFrame, templates: Mapping[str, Template] = TEMPLATES, rare_words: int = RARE_WORDS,
    least_score: float = LEAST_SCORE, workspace: Workspace | None = None,
) -> DataFrame:
    """``doc_id, row_key, label, at_word, score``: templates found, and where the best copy would start."""
    spark = docs.sparkSession
    workspace = workspace or Workspace(spark)
    postings = spark.createDataFrame(
        [(label, word, at) for label, t in templates.items() for at, word in enumerate(t.text.split())
         if len(word) >= LEAST_LETTERS], "label string, word string, at int",
    )
    vocabulary = F.broadcast(postings.select("word").distinct())  # the templates' words
    phrases = {label: t.required for label, t in templates.items()}

    def holds(spaced: Column) -> Column:
        tests = []
        for label, required in phrases.items():
            test = F.lit(True)
            for phrase in required:
                test = test & spaced.contains(f" {phrase} ")
            tests.append(F.when(test, F.lit(label)))
        return F.array_compact(F.array(*tests))

    read = docs.select("doc_id", row_key().alias("row_key"), spaced_words().alias("spaced"))
    # what is needed of the whole text comes before the explosion, or it would be worked out for every word
    read = read.select("doc_id", "row_key", holds(F.col("spaced")).alias("verified"), F.split(F.trim("spaced"), " ").alias("list"))
    words = read.select("doc_id", "row_key", "verified", F.posexplode("list").alias("pos", "word"))
    places = workspace.table(words.join(vocabulary, "word"), "licence-words")
    total = docs.count()
    known = places.select("doc_id", "row_key", "word").distinct()
    idf = known.groupBy("word").agg(
        F.log((F.lit(float(total)) + 1) / (F.count(F.lit(1)) + 0.5)).alias("idf")
    )
    idf = F.broadcast(workspace.table(idf, "idf"))  # one row for each template word
    # only texts with the key phrases of a template go on, for each such template by itself
    held = places.where(F.size("verified") > 0)
    by_rarity = Window.partitionBy("doc_id", "row_key", "label").orderBy(F.col("idf").desc(), "word")  # bounded by the template
    rare = held.select("doc_id", "row_key", "word", F.explode("verified").alias("label")).distinct().join(
        F.broadcast(postings.select("label", "word").distinct()), ["label", "word"]
    ).join(idf, "word").withColumn("nth", F.row_number().over(by_rarity)).where(F.col("nth") <= rare_words)
    # a template word that no text holds has the highest IDF of all
    unseen = F.log((F.lit(float(total)) + 1) / 0.5)
    by_template = Window.partitionBy("label").orderBy(F.col("idf").desc(), "word")
    weights = postings.select("label", "word").distinct().join(idf, "word", "left").withColumn("idf", F.coalesce("idf", unseen))
    weights = weights.withColumn("nth", F.row_number().over(by_template)).where(F.col("nth") <= rare_words)
    weights = F.broadcast(weights.groupBy("label").agg(F.sum("idf").alias("whole")))
    looked_up = held.join(
        rare.select(
            F.col("doc_id").alias("its_id"), F.col("row_key").alias("its_key"), F.col("word").alias("its_word"), "label", "idf"
        ),
        F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("row_key") == F.col("its_key"))
        & (F.col("word") == F.col("its_word")),
    )
    aligned = looked_up.join(F.broadcast(postings), ["label", "word"]).select(
        "doc_id", "row_key", "label", (F.col("pos") - F.col("at")).alias("at_word"), "word", "idf"
    ).distinct()
    agreeing = aligned.groupBy("doc_id", "row_key", "label", "at_word").agg(F.sum("idf").alias("agreed"))
    best = agreeing.join(weights, "label").withColumn(
        "score", F.when(F.col("whole") > 0, F.least(F.lit(1.0), F.col("agreed") / F.col("whole"))).otherwise(F.lit(1.0))
    ).groupBy("doc_id", "row_key", "label").agg(
        F.min_by("at_word", F.struct(-F.col("score"), "at_word")).alias("at_word"), F.max("score").alias("score")
    )
    return best.where(F.col("score") >= least_score)


def scan_licences(docs: DataFrame, workspace: Workspace | None = None, **options) -> DataFrame:
    """One row for each row of ``docs``: counts and labels of the phrases, and ``labels`` with the templates' as well.

    ``score`` is 1 where a phrase is, else the best template's score, else 0.  A null or empty text has no words.  Rows that repeat
    id and text share their result.
    """
    found = template_matches(docs, workspace=workspace, **options).groupBy("doc_id", "row_key").agg(
        F.collect_set("label").alias("more"), F.max("score").alias("best")
    ).select(F.col("doc_id").alias("its_id"), F.col("row_key").alias("its_key"), "more", "best")
    base = phrase_places(docs)
    both = base.join(
        found, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("row_key") == F.col("its_key")), "left"
    )
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
