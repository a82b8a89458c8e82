"""License scans by diagonal voting, in DataFrame functions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. The
hashes of all rolling k-grams of words are joined with the k-gram positions of fixed
notice texts. A hit at word p for template position q votes for the diagonal p - q.
Diagonals of one document and template no further than `drift` apart merge (words put in
or left out move an occurrence from one to the next), and a merged group is a span. It is
verified if the share of the template's words that its hits cover reaches `coverage` and it
is at most twice the template's length; its label then joins the base labels. Words that make
another license of it (`AGAINST`: Affero, Lesser, Library or none of them before General Public
License) vote against a template: the k-gram that ends with such a word in the place of the
template's own is looked for on the same diagonals, and a span with one such hit is not verified. Base labels are those of the base phrases, wherever
their words stand consecutively.

The template table is fixed and has a few hundred rows, so broadcasting it is bounded. One
pass over the texts gives both: rolling hashes are exploded, and a document keeps its first
row and the rows that hit. After that, only those are shuffled.

score is 1 if a base phrase occurs, else the largest share of a template's words covered in
one span, verified or not, else 0.

Null text counts as empty: no words, null places, empty labels. Rows are told apart by id
and text, so rows of one id with different texts stay apart; rows repeated in full each get
their result. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_column

K = 3
DRIFT = 2
COVERAGE = 0.8

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The words of common license notices, and the labels they add.
TEMPLATES = {
    "agpl-3.0": "licensed under the gnu affero general public license version 3",
    "agpl-header": "it under the terms of the gnu affero general public license as published by the free software foundation",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-no-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc0-dedication": "dedicated to the public domain under the creative commons cc0 1 0 universal public domain dedication",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-3.0": "licensed under the gnu lesser general public license version 3",
    "lgpl-header": "it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit-conditions": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-release": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license",
}

#: The word that tells a template from its kin.
TELLING = {"agpl-3.0": "affero", "agpl-header": "affero", "gpl-3.0": "general", "gpl-header": "general", "lgpl-3.0": "lesser", "lgpl-header": "lesser"}

#: Words that speak against a template if they stand in the place of its telling word.
AGAINST = {word: {label: own for label, own in TELLING.items() if own != word} for word in ("affero", "general", "lesser", "library")}

#: What separates words, once A-Z are in lower case.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """All words. Beyond A-Z, lower() changes characters from 128 up only, which stay word characters of words that no phrase has."""
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def _rolling(words: Column, k: int) -> Column:
    whole = F.transform(words, lambda w, i: F.when(i + k <= F.size(words), F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k)))))
    return F.slice(whole, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))


def template_grams(templates: dict[str, str], k: int, against: dict[str, dict[str, str]] = AGAINST) -> list[tuple[str, int, int, bool, str]]:
    """label, size (the template's words), q, whether the gram speaks against the template, and its words; one row for each position."""
    rows = []
    for label, text in templates.items():
        words = text.split()
        rows += [(label, len(words), q, False, " ".join(words[q : q + k])) for q in range(len(words) - k + 1)]
        for word, where in against.items():
            if where.get(label) in words:
                at = words.index(where[label])
                # the gram ends with the word
                rows.append((label, len(words), at - k + 1, True, " ".join([*words[at - k + 1 : at], word])))
    return rows


def _template_table(df: DataFrame, templates: dict[str, str], k: int) -> DataFrame:
    """The same rows with the gram's hash."""
    rows = [(*row[:-1], *row[-1].split()) for row in template_grams(templates, k)]
    names = [f"w{j}" for j in range(k)]
    table = df.sparkSession.createDataFrame(rows, "label string, size int, q int, against boolean, " + ", ".join(f"{n} string" for n in names))
    return table.select("label", "size", "q", "against", F.xxhash64(*names).alias("gram"))


def _base_places(words: Column, phrase: str) -> Column:
    p = phrase.split()
    at = lambda i: F.array(*(F.get(words, i + j) for j in range(len(p)))) == F.array(*map(F.lit, p))
    return F.filter(F.transform(words, lambda w, i: F.when((w == p[0]) & at(i), i)), lambda x: x.isNotNull())


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, k: int = K, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans for every row."""
    text = text_column(text_col)
    words = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("own"), words_of(text).alias("words"))
    # a phrase's last word is looked for first; most texts have none, and their words are not gone through again
    none = F.array().cast("array<int>")
    places = {label: F.when(F.array_contains("words", phrase.split()[-1]), _base_places(F.col("words"), phrase)).otherwise(none) for phrase, label in BASE.items()}
    marked = words.select("doc_id", "own", "words", *(c.alias(f"at_{label}") for label, c in places.items()))
    every = F.concat(*(F.col(f"at_{label}") for label in places))
    based = marked.select(
        "doc_id", "own", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(F.size(f"at_{label}") > 0, label) for label in places))).alias("base"), _rolling(F.col("words"), k).alias("rolling"),
    )
    kept = ["doc_id", "own", "n_words", "n_base", "first_word", "last_word", "base"]
    # place 0 holds no gram: the one row that each document keeps whatever it hits
    grams = based.select(*kept, F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "rolling")).alias("p", "gram"))
    table = F.broadcast(_template_table(df, templates, k))
    hits = grams.join(table, "gram", "left").where("label IS NOT NULL OR p = 0")
    hits = hits.withColumn("line", F.col("p") - F.col("q"))

    same = ["doc_id", "own", "label"]
    by_line = Window.partitionBy(*same).orderBy("line")
    started = F.when(F.col("line") - F.lag("line").over(by_line) <= drift, 0).otherwise(1)
    grouped = hits.withColumn("new", started).withColumn("span", F.sum("new").over(by_line))
    spans = grouped.groupBy(*kept, "label", "size", "span").agg(F.collect_set(F.when(~F.col("against"), F.col("q"))).alias("found"), F.coalesce(F.bool_or("against"), F.lit(False)).alias("against"), F.min("p").alias("first"), F.max("p").alias("last"), F.count(F.lit(1)).alias("rows"))
    # a span has each template position once at most, so the sets are as small as the templates
    covered = F.size(F.array_distinct(F.flatten(F.transform("found", lambda q: F.sequence(q, q + (k - 1))))))
    share = covered / F.col("size")
    verified = F.col("label").isNotNull() & ~F.col("against") & (share >= coverage) & (F.col("last") - F.col("first") + k <= 2 * F.col("size"))
    per = spans.groupBy("doc_id", "own").agg(
        *(F.first(c).alias(c) for c in kept[2:]),
        F.sort_array(F.collect_set(F.when(verified, F.col("label")))).alias("more"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("share"),
        F.sum(F.when(verified, 1).otherwise(0)).cast("long").alias("n_spans"),
        F.max(F.when(F.col("label").isNull(), F.col("rows"))).alias("copies"),
    )
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return per.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("share")).alias("score"), "n_spans",
    )
