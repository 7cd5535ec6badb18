"""Operator 12: license notices by diagonal voting, with DataFrame functions only.

All rolling word k-grams of a text (``K`` words, or the whole of a shorter template) are joined by hash to the
positions of the templates that hold them; the words of a hit are compared, so an equal hash alone is no vote.
A vote at word p for template position t lies on the diagonal p - t.  Votes are aggregated by (document,
template, diagonal) to a bit mask of the template words found; neighbouring diagonals, at most ``SLACK`` words
apart, are merged, since an inserted or missing word only shifts the diagonal; a span is a notice when its merged
mask covers ``COVERED`` of the template's words.  The base phrases are templates too and count where one diagonal
covers all their words.

The template table is a few hundred rows and broadcast; texts are read once and never shuffled, only votes are.

Edge cases: a null or empty text has no words, no places, empty labels and score 0; repeated rows give equal rows; a
null doc_id is kept; an empty table gives no rows; extra columns are ignored; a document is split nowhere, its votes
are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words after A-Z are lower-cased
K = 3
SLACK = 3
COVERED = 0.8
MAX_WORDS = 62  # bits of a mask

# fixed values: base phrases and their labels
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# the method's own notices: wordings that well-known licenses ask for or that name them
NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words(text: Column) -> Column:
    """Runs of the other characters: split, not matched one by one (a match result copies the whole text in Java)."""
    lower = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.array_remove(F.split(lower, BETWEEN), ""), F.array().cast("array<string>"))


def template_rows(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """``(template, base, label, n, t, k, gram)``: every k-gram of every template."""
    out = []
    for i, (base, (label, text)) in enumerate([(True, p) for p in phrases] + [(False, p) for p in notices]):
        w = text.split()
        if not 2 <= len(w) <= MAX_WORDS:
            raise ValueError(f"a template has 2 to {MAX_WORDS} words: {text!r}")
        k = min(K, len(w))
        out += [(i, base, label, len(w), t, k, w[t:t + k]) for t in range(len(w) - k + 1)]
    return out


def _rolling() -> list[tuple[str, Column]]:
    """Hashes of all words, 2-grams and 3-grams of ``w``: the hash of the shorter gram is carried on by a word."""
    def carried(name, k):
        return F.zip_with(name, F.slice("h1", F.lit(k), F.greatest(F.size("h1") - (k - 1), F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return [("h1", F.transform("w", lambda x: F.xxhash64(x))), ("h2", carried("h1", 2)), ("h3", carried("h2", 3))]


def _grams(spark: SparkSession, rows: list[tuple], k: int) -> DataFrame:
    """Template positions by k-gram hash, one row per hash."""
    df = spark.createDataFrame([r for r in rows if r[5] == k],
                               "template int, base boolean, label string, n int, t int, k int, gram array<string>")
    df = df.withColumn("w", F.col("gram"))
    for name, step in _rolling():
        df = df.withColumn(name, step)
    return df.groupBy(F.element_at(f"h{k}", 1).alias(f"h{k}")).agg(F.collect_list(F.struct("template", "t", "k", "gram")).alias(f"at{k}"))


def diagonals(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """``doc_id, key, template, diagonal, mask``: the template words found on each diagonal (key: hash of the text)."""
    rows = template_rows(phrases, notices)
    w = docs.select("doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), words(F.col("text")).alias("w"))
    rolled = w
    for name, step in _rolling():  # one projection a step: higher-order functions are not shared inside one
        rolled = rolled.withColumn(name, step)
    p = rolled.select("doc_id", "key", "w", F.posexplode(F.arrays_zip("h2", "h3")).alias("p", "h"))
    p = p.select("doc_id", "key", "w", "p", "h.h2", "h.h3")
    for k in (2, 3):  # at most one row per template position: a few hundred
        p = p.join(F.broadcast(_grams(docs.sparkSession, rows, k)), f"h{k}", "left")
    none = F.array().cast("array<struct<template:int,t:int,k:int,gram:array<string>>>")
    hits = p.where("at2 IS NOT NULL OR at3 IS NOT NULL").select(
        "doc_id", "key", "w", "p", F.explode(F.concat(F.coalesce("at2", none), F.coalesce("at3", none))).alias("x"))
    votes = hits.where(F.slice("w", F.col("p") + 1, F.col("x.k")) == F.col("x.gram"))
    bits = F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.k")) - 1, F.col("x.t"))
    return (votes.select("doc_id", "key", "x.template", (F.col("p") - F.col("x.t")).alias("diagonal"), bits.alias("bits"))
            .groupBy("doc_id", "key", "template", "diagonal").agg(F.bit_or("bits").alias("mask")))


def license_spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Verified spans: ``doc_id, key, base, label, template, first_word, last_word, covered``; a phrase has one row
    for each of its places."""
    spark = docs.sparkSession
    templates = {r[0]: (r[0], r[1], r[2], r[3]) for r in template_rows(phrases, notices)}
    lengths = F.broadcast(spark.createDataFrame(list(templates.values()), "template int, base boolean, label string, n int"))
    found = diagonals(docs, phrases, notices).join(lengths, "template").withColumn("share", F.bit_count("mask") / F.col("n"))
    line = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    # the places of a phrase are exact, each diagonal for itself
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(line) > SLACK)
    found = found.withColumn("cut", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("cut").over(line))
    spans = found.groupBy("doc_id", "key", "template", "island").agg(
        F.first("base").alias("base"), F.first("label").alias("label"), F.first("n").alias("n"),
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.max("share").alias("best"), F.bit_or("mask").alias("mask"))
    merged = F.when(F.col("high") - F.col("low") <= 2 * SLACK, F.bit_count("mask") / F.col("n")).otherwise(F.col("best"))
    return (spans.withColumn("covered", F.greatest("best", merged))
            .where(F.col("covered") >= F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(COVERED)))
            .select("doc_id", "key", "base", "label", "template", F.greatest("low", F.lit(0)).cast("long").alias("first_word"),
                    (F.col("high") + F.col("n") - 1).cast("long").alias("last_word"), "covered"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    per = license_spans(docs, phrases, notices).groupBy("doc_id", "key").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"), F.min(F.when(F.col("base"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first_word"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("bases"), F.collect_set("label").alias("all"),
        F.max("covered").alias("score"))
    per = per.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "n_base", "first_word", "last_word", "bases", "all", "score")
    rows = docs.select("doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"),
                       F.size(words(F.col("text"))).cast("long").alias("n_words"))

    def listed(name):
        return F.coalesce(F.array_join(F.array_sort(name), ","), F.lit(""))
    return rows.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        listed("bases").alias("base_labels"), listed("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
