"""Licence notices in documents by diagonal voting.

Every run of k neighbouring words of a document (k = 3; 2 for templates of two words) is hashed and joined to the places
of the same hash in the templates. A hit votes for the diagonal document place - template place; votes are counted by
document, template and diagonal. Neighbouring diagonals, as left by words put in or left out, are merged where their
template parts follow one another, and a span with votes for enough of its template is verified word by word. Phrases are
templates that must stand exactly. The template index is the only broadcast; its size is that of the given templates.

A short notice that only names a licence ("licensed under the mit license") does not count if one of the three words before it
denies it ("not", "no longer", "isn't"). Sentences of a licence itself count wherever they stand, and so do phrases.

Nulls: a null text has no words; a null doc_id stays null. Repeated rows get a row each. Empty tables give empty results. Very long
texts are scanned whole; a row's words and grams are in memory at once. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written
from .decontamination import BROADCAST_ROWS, words

GRAM = 3
SLACK = 4  # diagonals this close belong together
VOTED, VERIFIED = 0.6, 0.75  # share of a template's grams that must vote, and be found again in the span
NAMING = 12  # notices of fewer words may be denied by the words before them
DENIAL = 3
# Words that deny a notice; "isn't" and the like are cut into two words, of which the second is the t.
DENYING = ["not", "no", "never", "neither", "nor", "without", "cannot", "t"]

# Phrases that label a document by standing anywhere in it.
PHRASES = {"cc-by": ["cc by"], "gpl": ["general public license"], "reserved": ["all rights reserved"]}
# Opening sentences of well-known licence notices and usual ways to name a licence.
NOTICES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction including without limitation the rights to use "
        "copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "gpl-notice": [
        "licensed under the gnu general public license version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "lgpl-notice": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
        "with this file you can obtain one at",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by-nc": ["licensed under cc by nc"],
    "cc-licence": [
        "this work is licensed under a creative commons attribution 4 0 international license",
        "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit",
    ],
    "cc0": [
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    ],
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool

    @property
    def gram(self) -> int:
        return min(GRAM, len(self.words))


def templates(phrases: dict[str, list[str]] = PHRASES, notices: dict[str, list[str]] = NOTICES) -> list[Template]:
    """Given texts as templates; those without words are left out."""
    cut = lambda text: tuple(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text))
    found = [Template(label, cut(t), True) for label, texts in phrases.items() for t in texts]
    found += [Template(label, cut(t), False) for label, texts in notices.items() for t in texts]
    return [t for t in found if t.words]


def _hash(column: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(column), at + j) for j in range(k)])


def _grams(column: str, sizes: list[int]) -> Column:
    """Places, sizes and hashes of all word runs of the array column."""
    none = F.expr("cast(array() as array<struct<pos:int,k:int,h:bigint>>)")

    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(column) - k)
        found = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), _hash(column, i, k).alias("h")))
        return F.when(F.size(column) >= k, found).otherwise(none)

    return F.concat(*[runs(k) for k in sizes])


def votes(docs: DataFrame, given: list[Template]) -> DataFrame:
    """Written table of doc_id, key, template, pos, tpos: all hits, and for each row one of template -1 with n_words as pos."""
    spark = docs.sparkSession
    sizes = sorted({t.gram for t in given})
    table = spark.createDataFrame(
        [(n, t.gram, list(t.words)) for n, t in enumerate(given)], "template int, size int, w array<string>"
    )
    index = table.select("template", "size", F.explode(_grams("w", sizes)).alias("g")).filter("g.k = size").select(
        "template", F.col("g.pos").alias("tpos"), "g.k", "g.h"
    )
    mark = spark.range(1).select(F.lit(-1).alias("template"), F.lit(0).alias("tpos"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("h"))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), words(F.col("text")).alias("w")
    )
    count = F.struct(F.size("w").alias("pos"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("h"))
    spread = rows.select("doc_id", "key", F.explode(F.concat(F.array(count), _grams("w", sizes))).alias("g")).select(
        "doc_id", "key", "g.pos", "g.k", "g.h"
    )
    hits = spread.join(F.broadcast(index.unionByName(mark)), ["k", "h"])
    return written(hits.select("doc_id", "key", "template", "pos", "tpos"), "votes")


def _spans(cast: DataFrame, given: list[Template]) -> DataFrame:
    """Spans with enough votes: doc_id, key, template, start, end, share of grams voted."""
    spark = cast.sparkSession
    sizes = spark.createDataFrame(
        [(n, len(t.words) - t.gram + 1, t.gram, t.exact) for n, t in enumerate(given)], "template int, grams int, gram int, exact boolean"
    )
    diagonals = cast.filter("template >= 0").groupBy("doc_id", "key", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("voted"), F.min("tpos").alias("low"), F.max("tpos").alias("high")
    ).join(F.broadcast(sizes), "template")
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    follows = (
        ~F.col("exact") & (F.col("diagonal") - F.lag("diagonal").over(order) <= SLACK)
        & (F.col("diagonal") + F.col("low") - F.lag(F.col("diagonal") + F.col("high")).over(order) <= F.col("grams") + SLACK)
    )
    numbered = diagonals.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn(
        "span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = numbered.groupBy("doc_id", "key", "template", "span", "grams", "exact").agg(
        F.array_distinct(F.flatten(F.collect_list("voted"))).alias("voted"),
        F.min(F.col("diagonal") + F.col("low")).alias("start"),
        F.max(F.col("diagonal") + F.col("high") + F.col("gram")).alias("end"),
    )
    share = F.size("voted") / F.col("grams")
    return merged.filter(F.when(F.col("exact"), share == 1).otherwise(share >= VOTED)).select(
        "doc_id", "key", "template", "start", "end", "exact", share.alias("voted")
    )


def license_spans(docs: DataFrame, cast: DataFrame, given: list[Template]) -> DataFrame:
    """Verified spans: doc_id, key, label, exact, start, end (words from 0) and score, the share of the template found."""
    spark = docs.sparkSession
    spans = written(_spans(cast, given), "spans")
    table = spark.createDataFrame([(n, t.label, list(t.words), t.gram) for n, t in enumerate(given)], "template int, label string, t array<string>, gram int")
    asked = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("template", "exact", "start", "end")).alias("spans")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "spans")
    # Places only, a few numbers a span; counted before the broadcast.
    asked = F.broadcast(asked) if spans.count() <= BROADCAST_ROWS else asked
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    met = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")))
    before = lambda s: F.slice("w", F.greatest(s["start"] - DENIAL, F.lit(0)) + 1, F.least(s["start"], F.lit(DENIAL)))
    place = lambda s: F.struct(
        s.alias("s"), F.slice("w", s["start"] + 1, s["end"] - s["start"]).alias("w"),
        F.arrays_overlap(before(s), F.array(*[F.lit(word) for word in DENYING])).alias("denied"),
    )
    cut = met.select("doc_id", "key", "spans", words(F.col("text")).alias("w")).select(
        "doc_id", "key", F.explode(F.transform("spans", place)).alias("s")
    ).select("doc_id", "key", "s.s.*", "s.w", "s.denied").join(F.broadcast(table), "template")
    cut = cut.filter(F.col("exact") | ~F.col("denied") | (F.size("t") >= NAMING))
    runs = lambda c: F.transform(
        F.sequence(F.lit(0), F.size(c) - F.col("gram")), lambda i: F.concat_ws(" ", F.slice(c, i + 1, F.col("gram")))
    )
    score = F.when(F.col("exact"), (F.col("w") == F.col("t")).cast("double")).otherwise(
        F.size(F.array_intersect(runs("w"), runs("t"))) / F.size(F.array_distinct(runs("t")))
    )
    found = cut.withColumn("score", score).filter(F.when(F.col("exact"), F.col("score") == 1).otherwise(F.col("score") >= VERIFIED))
    return found.select("doc_id", "key", "label", "exact", "start", "end", "score").distinct()


def license_labels(docs: DataFrame, given: list[Template] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    given = templates() if given is None else given
    cast = votes(docs, given)
    counted = cast.filter("template = -1").select("doc_id", "key", F.col("pos").cast("bigint").alias("n_words"))
    spans = license_spans(docs, cast, given)
    base = lambda c: F.when(F.col("exact"), c)
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    per_row = spans.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(
        F.count(base(F.lit(1))).alias("n_base"),
        F.min(base(F.col("start"))).cast("bigint").alias("first_word"),
        F.max(base(F.col("start"))).cast("bigint").alias("last_word"),
        joined(base(F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    result = counted.join(per_row, counted["doc_id"].eqNullSafe(F.col("_d")) & (counted["key"] == F.col("_k")), "left")
    return result.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
