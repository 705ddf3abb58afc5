"""License scans by diagonal voting.

Every run of three words of every text is hashed and joined to the places where a template has it. A hit votes
for the diagonal text place minus template place: the words of a copied notice vote for one, and a word put in or
left out moves the votes to a neighbour. Diagonals up to ``NEAR`` words apart are merged, and a merged span with
enough votes is verified word by word along its diagonals. Short phrases must stand as they are, at every place.

Votes and verification are those of a distinct text (two hashes of it), so copies share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import settled

#: Anything that is in no word once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a hashed run; words between diagonals that are merged.
K, NEAR = 3, 8
#: Share of a notice's runs that must vote, and of its words that must be there.
LEAST_VOTES, LEAST_COVER = 0.25, 0.8
#: Keys of texts (16 bytes) up to which they are broadcast.
KEYS = 1_000_000

# fixed values: phrases and their labels
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# fixed values: notices as their licenses word them, without marks
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]
TEMPLATES = [(i, label, i < len(PHRASES), text) for i, (label, text) in enumerate(PHRASES + NOTICES)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def license_spans(docs: DataFrame, templates: list[tuple[int, str, bool, str]] = TEMPLATES) -> DataFrame:
    """(t1, t2, spans) of each distinct text of ``docs`` (text, t1, t2) with candidates.

    ``templates``: number, label, whether every word must stand (a phrase), and words of three letters' runs or
    more. A span is (label, phrase, start, cover): the share of the template's words found along the diagonals;
    spans below the bounds are kept with their cover, so callers see near misses. Null texts are empty.
    """
    spark = docs.sparkSession
    t = spark.createDataFrame(templates, "tpl int, label string, phrase boolean, words string").withColumn("words", F.split("words", " "))
    runs = lambda w: F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)])))
    grams = t.select("tpl", F.posexplode(runs(F.col("words"))).alias("tpos", "gram"))
    rows = docs.select("t1", "t2", words(F.coalesce("text", F.lit(""))).alias("w"))
    hits = rows.select("t1", "t2", F.posexplode(runs(F.col("w"))).alias("pos", "gram")).join(F.broadcast(grams), "gram")
    diagonals = hits.groupBy("t1", "t2", "tpl", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.collect_set("tpos").alias("votes"))
    diagonals = diagonals.join(F.broadcast(t), "tpl").withColumn("all", F.size("words") - K + 1)
    by = W.partitionBy("t1", "t2", "tpl").orderBy("diag")
    fresh = F.col("phrase") | F.coalesce(F.col("diag") - F.lag("diag").over(by) > NEAR, F.lit(True))
    merged = diagonals.filter(~F.col("phrase") | (F.size("votes") == F.col("all"))).withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(by))
    merged = merged.groupBy("t1", "t2", "tpl", "span").agg(F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("words").alias("words"), F.first("all").alias("all"),
                                                           F.array_sort(F.collect_list("diag")).alias("diags"), F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("n"))
    merged = merged.filter(F.col("n") >= LEAST_VOTES * F.col("all"))
    asked = settled(merged.groupBy("t1", "t2").agg(F.collect_list(F.struct("label", "phrase", "words", "diags")).alias("asked")))
    keys = asked.select("t1", "t2")
    keys = F.broadcast(keys) if keys.count() <= KEYS else keys.hint("shuffle_hash")
    texts = docs.join(keys, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    whole = texts.join(asked, ["t1", "t2"]).withColumn("w", words(F.col("text")))

    def covered(c: Column) -> Column:
        there = lambda d: F.filter(F.sequence(F.lit(0), F.size(c["words"]) - 1), lambda j: F.get("w", d + j) == F.get(c["words"], j))
        return F.size(F.array_distinct(F.flatten(F.transform(c["diags"], there)))) / F.size(c["words"])

    span = lambda c: F.struct(c["label"].alias("label"), c["phrase"].alias("phrase"), F.array_min(c["diags"]).cast("long").alias("start"), covered(c).alias("cover"))
    return whole.select("t1", "t2", F.transform("asked", span).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of ``docs`` (doc_id, text).

    Null texts are empty and have no labels. Repeated rows, and rows of one id or none, are judged by their own
    text. Other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("again"), F.col("text"))})
    found = license_spans(docs.select("t1", "t2", "text"))
    base = F.filter("spans", lambda s: s["phrase"] & (s["cover"] == 1))
    good = F.filter("spans", lambda s: F.when(s["phrase"], s["cover"] == 1).otherwise(s["cover"] >= LEAST_COVER))
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(spans["label"])), ",")
    places = F.transform(base, lambda s: s["start"])
    found = found.select("t1", "t2", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
                         names(base).alias("base_labels"), names(good).alias("labels"), F.array_max(F.transform("spans", lambda s: s["cover"])).alias("score"))
    out = docs.select("doc_id", "t1", "t2", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(found, ["t1", "t2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                      F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op12_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_VALUES = ", ".join(f"({i}, '{label}', {phrase}, string_split('{text}', ' '))" for i, label, phrase, text in TEMPLATES)
OP12_SQL = rf"""
WITH t(tpl, label, phrase, words) AS (VALUES {_VALUES}),
d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT rid, unnest(range(len(w))) AS pos, unnest(w) AS w FROM d),
g AS (SELECT rid, pos, w || ' ' || lead(w, 1) OVER r || ' ' || lead(w, 2) OVER r AS gram FROM u WINDOW r AS (PARTITION BY rid ORDER BY pos)),
tu AS (SELECT tpl, label, phrase, len(words) AS n, unnest(range(len(words))) AS tpos, unnest(words) AS tw FROM t),
tg AS (SELECT tpl, phrase, n, tpos, tw || ' ' || lead(tw, 1) OVER r || ' ' || lead(tw, 2) OVER r AS gram FROM tu WINDOW r AS (PARTITION BY tpl ORDER BY tpos)),
dg AS (SELECT rid, tpl, phrase, n - {K - 1} AS al, pos - tpos AS diag, list(tpos) AS votes FROM g JOIN tg USING (gram) GROUP BY ALL HAVING NOT phrase OR count(*) = n - {K - 1}),
fr AS (SELECT *, CASE WHEN phrase OR coalesce(diag - lag(diag) OVER r > {NEAR}, true) THEN 1 ELSE 0 END AS fresh FROM dg WINDOW r AS (PARTITION BY rid, tpl ORDER BY diag)),
sp AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, tpl ORDER BY diag) AS span FROM fr),
ok AS (SELECT rid, tpl, span, list(diag) AS diags FROM sp GROUP BY rid, tpl, span, al HAVING len(list_distinct(flatten(list(votes)))) >= {LEAST_VOTES} * al),
cv AS (SELECT ok.rid, ok.tpl, ok.span, list_min(ok.diags) AS start, tu.label, tu.phrase, count(DISTINCT CASE WHEN u.w = tu.tw THEN tu.tpos END) / any_value(tu.n) AS cover
  FROM (SELECT *, unnest(diags) AS diag FROM ok) ok JOIN tu USING (tpl) LEFT JOIN u ON u.rid = ok.rid AND u.pos = ok.diag + tu.tpos GROUP BY ALL),
su AS (SELECT rid, count(*) FILTER (phrase AND cover = 1) AS n_base, min(start) FILTER (phrase AND cover = 1) AS first_word, max(start) FILTER (phrase AND cover = 1) AS last_word,
  list(DISTINCT label) FILTER (phrase AND cover = 1) AS bl, list(DISTINCT label) FILTER (cover = 1 OR NOT phrase AND cover >= {LEAST_COVER}) AS al, max(cover) AS score FROM cv GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(al), ','), '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN su USING (rid)
"""
