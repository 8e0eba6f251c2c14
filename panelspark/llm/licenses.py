"""License scans as an exact set-similarity join (DataFrame functions only).

Blocks are the paragraphs of a text (between empty lines, however their lines are wrapped) and, as notices can be broken
by empty lines too, all runs of ``SPAN`` times a template's length in words.  A block meets a template when it holds at
least ``THRESHOLD`` of the template's distinct words.  Template words are put in one global order, rarest in the corpus
first; a qualifying block must hold one of the first |T| - ceil(t |T|) + 1 words of a template (prefix filter), at least
ceil(t |T|) words (length filter), and enough words of both sides after the first shared one (positional filter).
Blocks that pass are verified; runs are taken around each prefix word.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, settled

THRESHOLD, SPAN = Fraction(4, 5), Fraction(3, 2)
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EMPTY_LINE = r"\n[\x00-\x20]*\n"

# License notices, each with the label it stands for.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution license"),
)
SETS = [(label, sorted(set(text.split()))) for label, text in TEMPLATES]
VOCABULARY = sorted({w for _, ws in SETS for w in ws})


def tokens(text):
    """Words of a text, ASCII letters and digits in lower case and every character beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), GAP, -1), "")


def frequencies(docs: DataFrame) -> dict[str, int]:
    """Documents holding each template word; at most one row per template word comes back."""
    known = F.array(*[F.lit(w) for w in VOCABULARY])
    seen = docs.select(F.explode(F.array_intersect(known, tokens(F.col("text")))).alias("w"))
    return {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def licensed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of ``docs``.

    ``score`` is the largest containment of a template met by a block, 1 where a base phrase stands, else 0.  A null or
    empty text has no words, labels or places; repeated rows are scanned alike; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    count = frequencies(docs)
    ordered = [(label, sorted(ws, key=lambda w: (count.get(w, 0), w))) for label, ws in SETS]
    need = [ceil(THRESHOLD * len(ws)) for _, ws in ordered]
    span = [ceil(SPAN * len(text.split())) for _, text in TEMPLATES]
    prefix = spark.createDataFrame([(w, t, p, need[t], len(ws), span[t], label, ws) for t, (label, ws) in enumerate(ordered)
                                    for p, w in enumerate(ws[: len(ws) - need[t] + 1])],
                                   "token string, template int, place int, need int, width int, span int, label string, words array<string>")
    heads = sorted({w for t, (_, ws) in enumerate(ordered) for w in ws[: len(ws) - need[t] + 1]})
    rank = sorted(VOCABULARY, key=lambda w: (count.get(w, 0), w))
    known, first = F.array(*[F.lit(w) for w in rank]), F.array(*[F.lit(w) for w in heads])

    text = F.coalesce(F.col("text"), F.lit(""))
    low = docs.select("doc_id", text.alias("text"), settled(tokens(F.col("text"))).alias("w"))
    n = F.size("w")
    at = lambda i, *ws: F.lit(True) if not ws else (F.get("w", i) == ws[0]) & at(i + 1, *ws[1:])

    def places(*ws: str):
        found = F.filter(F.sequence(F.lit(0), n - len(ws)), lambda i: at(i, *ws))
        return F.when((n >= len(ws)) & F.array_contains("w", "license"), found).otherwise(F.array().cast("array<int>"))

    blocks = F.transform(F.split("text", EMPTY_LINE, -1), lambda x, i: F.struct(i.alias("block"), tokens(x).alias("words")))
    # the order of ``known`` makes the shared words of a block come rarest first
    near = F.filter(blocks, lambda x: F.arrays_overlap(x["words"], first) & (F.size(x["words"]) >= min(need)))
    short = F.transform(near, lambda x: F.struct(x["block"].alias("block"), F.array_intersect(known, x["words"]).alias("words")))

    # what lies within a run's length of each prefix word; runs inside one paragraph add nothing to it
    reach = max(span) - 1
    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(first, F.get("w", i)))
    around = F.transform(hits, lambda i: F.struct(
        F.get("w", i).alias("token"), F.least(i, F.lit(reach)).alias("at"),
        F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1).alias("words")))

    def enough(x):
        out = F.lit(False)
        for t, (_, ws) in enumerate(ordered):
            every = F.array(*[F.lit(w) for w in ws])
            out = out | (x["token"].isin(ws[: len(ws) - need[t] + 1]) & (F.size(F.array_intersect(every, x["words"])) >= need[t]))
        return out

    kind = "array<struct<token:string,at:int,words:array<string>>>"
    rows = kept_rows(low.select(
        "doc_id", n.cast("long").alias("n_words"), places("mit", "license").alias("mit"), places("apache", "license").alias("apache"),
        places("general", "public", "license").alias("gpl"),
        F.when(F.arrays_overlap("w", first), short).otherwise(F.array().cast("array<struct<block:int,words:array<string>>>")).alias("near"),
        F.when(F.arrays_overlap("w", first) & F.col("text").rlike(EMPTY_LINE), F.filter(around, enough)).otherwise(F.array().cast(kind)).alias("around")))

    near = rows.select("_row", F.explode("near").alias("x")).select("_row", "x.block", "x.words")
    probes = near.select("*", F.posexplode("words").alias("at", "token"))
    pairs = probes.join(F.broadcast(prefix.drop("words")), "token").groupBy("_row", "block", "template").agg(
        F.min("place").alias("place"), F.min("at").alias("at"), F.first("words").alias("words"), F.first("need").alias("need"), F.first("width").alias("width"))
    pairs = pairs.where((F.size("words") >= F.col("need")) & (F.col("width") - F.col("place") >= F.col("need"))
                        & (F.size("words") - F.col("at") >= F.col("need")))
    full = prefix.select("template", "label", F.col("words").alias("all")).dropDuplicates(["template"])
    met = pairs.join(F.broadcast(full), "template").withColumn("shared", F.size(F.array_intersect("words", "all"))).where("shared >= need")

    runs = rows.select("_row", F.explode("around").alias("x")).select("_row", "x.*").join(
        F.broadcast(prefix.select("token", "label", "need", "width", "span", F.col("words").alias("all"))), "token")
    shared = F.transform(F.sequence(F.greatest(F.col("at") - F.col("span") + 1, F.lit(0)), F.col("at")),
                         lambda i: F.size(F.array_intersect(F.slice("words", i + 1, F.col("span")), F.col("all"))))
    runs = runs.withColumn("shared", F.array_max(shared)).where("shared >= need")
    of = met.select("_row", "label", "shared", "width").unionByName(runs.select("_row", "label", "shared", "width")).groupBy("_row").agg(
        F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("width")).alias("best"))

    base = F.array_compact(F.array(*[F.when(F.size(k) > 0, F.lit(k)) for k in ("apache", "gpl", "mit")]))
    spots = F.concat("mit", "apache", "gpl")
    none = F.array().cast("array<string>")
    return rows.join(of, "_row", "left").select(
        "doc_id", "n_words", F.size(spots).cast("long").alias("n_base"), F.array_min(spots).cast("long").alias("first_word"),
        F.array_max(spots).cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", none))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size(spots) > 0, 1.0).otherwise(0.0)).alias("score"))
