"""License scans by diagonal voting, in DataFrame operations throughout.

All rolling word k-grams of a document are hashed and joined to the templates' k-grams.
A match at word p of the document and word q of a template votes for diagonal p - q;
votes are summed by diagonal, neighbouring diagonals merge (words put in or left out
shift a match by a few), and a merged span is verified by the share of the template's
words that its matches cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

# Label and words of well-known notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form"),
)
# Base phrases and their labels.
PHRASES: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    """A-Z in lower case. Other letters may change as well, which phrases and templates of ASCII words cannot
    tell, so long as none becomes ASCII: the Kelvin sign and the dotted I, the two that would, give way first."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))


def gram_hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def template_grams(spark: SparkSession, k: int = 3, templates=TEMPLATES) -> DataFrame:
    """(template, label, t_len, t_pos, hash): a row for each k-gram of each template."""
    notices = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.split(F.lit(text), " ").alias("t_words")) for i, (label, text) in enumerate(templates)])
    rows = spark.range(1).select(F.inline(notices))
    at = F.explode(F.sequence(F.lit(0), F.size("t_words") - k))
    rows = rows.filter(F.size("t_words") >= k).withColumn("t_pos", at)
    return rows.select("template", "label", F.size("t_words").alias("t_len"), "t_pos", gram_hash(F.col("t_words"), F.col("t_pos"), k).alias("hash"))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    here = lambda i: [F.get(words, i + j) == F.lit(p) for j, p in enumerate(parts)]

    def match(i: Column) -> Column:
        out = here(i)[-1]
        for c in here(i)[:-1]:
            out = out & c
        return F.coalesce(out, F.lit(False))

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), match)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, k: int = 3, coverage: float = 0.8, gap: int = 2, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score), one row for each row of docs.

    labels are arrays, sorted; spans are structs (label, start, end, covered), ends past
    the last word, of verified spans. score is the best span's share of template words,
    1 where a base phrase stands, else 0. Null and empty texts have no words and score 0.
    Templates are this module's fixed list or the caller's: they are what is broadcast,
    a few hundred rows however many documents there are.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, k, templates)
    known = sorted({r[0] for r in grams.select("hash").collect()})
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))
    hashes = F.when(F.size("words") >= k, F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: gram_hash(F.col("words"), i, k)))
    hashed = words.select("doc_id", "words", hashes.alias("hashes"))
    voting = F.arrays_overlap("hashes", F.array(*map(F.lit, known)))
    ends = {p.split()[-1] for p, _ in phrases}
    likely = F.lit(False)
    for word in ends:
        likely = likely | F.array_contains("words", word)
    places = F.when(likely, F.struct(*[_places(F.col("words"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)]))
    rows = hashed.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"),
        F.when(voting, F.col("hashes")).alias("hashes"),
    )
    rows = materialize(rows, "license-rows")

    votes = rows.filter("hashes is not null").select("row", F.posexplode("hashes").alias("pos", "hash"))
    votes = votes.join(F.broadcast(grams), "hash").withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    keys = ["row", "template", "label", "t_len"]
    lines = votes.groupBy(*keys, "diagonal").agg(F.collect_set("t_pos").alias("at"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))
    lines = lines.withColumn("run", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = lines.groupBy(*keys, "run").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("start").alias("start"), F.max("end").alias("end"))
    own = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (k - 1))))))
    merged = merged.withColumn("covered", own / F.col("t_len")).filter((F.col("covered") >= coverage) & (F.col("end") - F.col("start") <= 2 * F.col("t_len")))
    spans = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "start", "end", "covered"))).alias("spans"))

    found = rows.drop("hashes").join(spans, "row", "left")
    every = F.concat(*[F.coalesce(F.col(f"places.p{i}"), F.array().cast("array<int>")) for i in range(len(phrases))])
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"places.p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())))
    extra = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    n_base = F.size(every).cast("long")
    return found.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        base.alias("base_labels"), F.array_sort(F.array_union(base, extra)).alias("labels"), F.coalesce("spans", F.expr("array()").cast("array<struct<label:string,start:int,end:int,covered:double>>")).alias("spans"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))).alias("score"),
    )


def oracle(k: int = 3, coverage: float = 0.8, gap: int = 2) -> str:
    """DuckDB SQL for the digest of scan()."""
    values = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, i - 1 AS pos, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d)),
t AS (SELECT id, label, string_split(words, ' ') AS w FROM (VALUES {values}) x(id, label, words)),
tg AS (SELECT id, label, len(w) AS n, i - 1 AS q, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - {k - 2})) AS i FROM t)),
v AS (SELECT r, id, label, n, q, pos, pos - q AS diag FROM g JOIN tg USING (gram)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r, id ORDER BY diag RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM
    (SELECT *, CASE WHEN diag = lag(diag) OVER w THEN 0 WHEN diag - lag(diag) OVER w <= {gap} THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY r, id ORDER BY diag, q, pos))),
m AS (SELECT r, id, label, n, run, min(pos) AS a, max(pos) + {k} AS b FROM runs GROUP BY ALL),
c AS (SELECT r, id, run, count(DISTINCT q + o) AS own FROM runs, (SELECT unnest(range(0, {k})) AS o) GROUP BY ALL),
s AS (SELECT m.r, m.label, own / n::DOUBLE AS covered FROM m JOIN c USING (r, id, run) WHERE own / n::DOUBLE >= {coverage} AND b - a <= 2 * n),
p AS (SELECT r, i - 1 AS pos, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) x
    JOIN (VALUES {phrases}) y(phrase, label, n) ON list_extract(w, i) = split_part(phrase, ' ', 1) AND array_to_string(list_slice(w, i, i + n - 1), ' ') = phrase),
b AS (SELECT r, count(*) AS n_base, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION SELECT r, label FROM s) GROUP BY r),
sc AS (SELECT r, max(covered) AS score FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN sc USING (r)
"""
