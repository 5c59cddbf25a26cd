"""Licence scan by a positional index of rare words, in DataFrame operations only.

Templates are short word lists with mandatory places (their key phrases).  Inverse document frequencies of the template words
are counted over all texts.  A file that holds the rarest key word of some template looks up its highest-IDF licence words and
those key words; each hit names the place at which a template would start, and hits that agree on a place are one
candidate.  A candidate counts if every mandatory word stands at its place; its score is the share of the template's
IDF weight found there, and labels need ``least`` of it.  Base phrases are templates whose words are all mandatory; as
their rarest word is always looked up, all their places are found.

Defined cases: a null text is empty: no words, no places, empty label lists, score 0.  Templates may run over either end of a
text as long as their key phrases do not.  Null ids and repeated rows are scanned like any other.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: label, words, key phrases
BASE = [
    ("mit", "under the mit license", ["under the mit license"]),
    ("apache-2", "apache license version 2", ["apache license version 2"]),
    ("cc-by-nc", "cc by nc", ["cc by nc"]),
]
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "obtaining a copy"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license", ["except in compliance with the license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
]
LOOKUPS = 6
LEAST = 0.6
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what parts words, once A-Z are lower case


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, GAP), lambda w: w != "")


def _mandatory(words: list[str], phrases: Sequence[str]) -> list[int]:
    out: set[int] = set()
    for p in phrases:
        k = p.split()
        at = next(i for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k)
        out.update(range(at, at + len(k)))
    return sorted(out)


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> tuple[dict[str, int], int]:
    """Number of texts that hold each word of the (small, given) vocabulary, and of all texts."""
    found = docs.select(F.explode(F.array_append(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary))), F.lit(""))).alias("w"))
    df = {r.w: r["count"] for r in found.groupBy("w").count().collect()}  # one row per vocabulary word
    return {w: df.get(w, 0) for w in vocabulary}, df.get("", 0)


def scan(docs: DataFrame, base: Sequence[tuple] = tuple(BASE), notices: Sequence[tuple] = tuple(NOTICES), lookups: int = LOOKUPS, least: float = LEAST) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places``; ``places``
    lists ``(label, first word, base, score)`` of every match."""
    templates = [(label, text.split(), phrases) for label, text, phrases in [*base, *notices]]
    vocabulary = sorted({w for _, t, _ in templates for w in t})
    df, n = document_frequencies(docs, vocabulary)
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1e-3 for w in vocabulary}
    must = [_mandatory(t, p) for _, t, p in templates]
    keys = sorted({max((t[j] for j in m), key=lambda w: (idf[w], w)) for (_, t, _), m in zip(templates, must)})
    rank = sorted(vocabulary, key=lambda w: (-idf[w], w))  # highest IDF first

    strings = lambda a: F.array(*map(F.lit, a))
    postings = {w: [k << 32 | j for k, (_, t, _) in enumerate(templates) for j, x in enumerate(t) if x == w] for w in vocabulary}
    index = F.create_map(*[c for w in vocabulary for c in (F.lit(w), F.array(*[F.lit(p).cast("bigint") for p in postings[w]]))])
    table = F.array(*[
        F.struct(F.lit(label).alias("label"), strings(t).alias("words"), F.array(*[F.lit(idf[w]) for w in t]).alias("weights"),
                 F.array(*map(F.lit, m)).alias("must"), F.lit(sum(idf[w] for w in t)).alias("total"), F.lit(k < len(base)).alias("base"))
        for k, ((label, t, _), m) in enumerate(zip(templates, must))
    ])

    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "words", F.array_intersect(strings(rank), F.col("words")).alias("own"))
    rows = rows.withColumn("look", F.when(F.arrays_overlap("own", strings(keys)), F.array_union(F.slice("own", 1, lookups), F.array_intersect("own", strings(keys)))))
    hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("look", w), F.struct(i.alias("at"), w.alias("w")))), lambda h: h.isNotNull())
    # a candidate is one number: the template and the place (shifted by 2**31) where it would start
    starts = F.flatten(F.transform(hits, lambda h: F.transform(index[h["w"]], lambda p: F.shiftleft(F.shiftright(p, 32), 33) + h["at"] - p.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 31))))
    rows = rows.withColumn("starts", F.when(F.col("look").isNull(), F.array().cast("array<bigint>")).otherwise(F.array_distinct(starts)))

    def judge(c):
        t = table[F.shiftright(c, 33).cast("int")]
        at = (c.bitwiseAND(F.lit((1 << 33) - 1)) - F.lit(1 << 31)).cast("int")
        there = lambda j: F.coalesce(F.get(F.col("words"), at + j) == F.get(t["words"], j), F.lit(False))
        full = F.forall(t["must"], there)
        weight = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0.0), lambda s, j: s + F.when(there(j), F.get(t["weights"], j)).otherwise(0.0))
        score = F.least(F.lit(1.0), weight / t["total"])
        return F.when(full, F.struct(t["label"].alias("label"), at.cast("bigint").alias("at"), t["base"].alias("base"), score.alias("score")))

    rows = rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.filter(F.transform("starts", judge), lambda p: p.isNotNull() & (p["base"] | (p["score"] >= least))).alias("places"))
    first = F.filter("places", lambda p: p["base"])
    names = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["label"]))), ",")
    at = F.transform(first, lambda p: p["at"])
    return rows.select(
        "doc_id", "n_words", F.size(first).cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        names(first).alias("base_labels"), names(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"), "places",
    )
