"""License scans by diagonal voting; DataFrame functions only.

A template is a notice's words. All its rolling k-grams (k is 3, or a shorter template's length) make a table of hashes
and template positions; a document's rolling k-grams join it. A hit at document word i and template word j votes for the
diagonal i - j, the place where the template would start. Words that were put in or left out move the votes to diagonals
nearby, so the diagonals of a template that lie within a quarter of its length of one another are merged. A merged run is
verified: its hits' words, compared as text, must cover ``SHARE`` of the template's words, within a span that is no longer
than the template and the words put in; its share is what it covers of the longer of both. A diagonal on which every k-gram votes is an exact place and stands for itself.

Positions whose two words begin no k-gram of a template can't join and aren't laid out. The template table is a fixed
parameter of some hundred rows and is broadcast; hits and one row for each document are shuffled once, by row.

Defined cases: null and wordless texts have no words and no spans; repeated rows are rows each; very long texts are scanned
whole; equal spans of several templates are spans each; repeated template words vote for several diagonals; no rows give
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

K = 3
#: Share of a template's words that a span without an exact place must cover.
SHARE = 0.75
#: The phrases whose every exact place counts.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Wordings of public license notices.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "no rights reserved"),
    ("cc0", "dedicated to the public domain"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "spdx license identifier mit"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _grams(text: str) -> list[list[str]]:
    w = text.split()
    k = min(K, len(w))
    return [w[i : i + k] for i in range(len(w) - k + 1)]


def _hash(words: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, F.lit(i)) for i in range(k)])


def template_grams(spark: SparkSession, base: list, notices: list) -> DataFrame:
    """(hash, gram, tid, j, label, base, size): every rolling k-gram of the templates."""
    rows = [(tid, j, " ".join(g), label, tid < len(base), len(text.split())) for tid, (label, text) in enumerate([*base, *notices]) for j, g in enumerate(_grams(text))]
    made = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("tid", "j", "gram", "label", "base", "size"), strict=True)]) for r in rows])
    t = spark.range(1).select(F.explode(made).alias("t")).select("t.*")
    words = F.split("gram", " ")
    by_size = F.coalesce(*[F.when(F.size(words) == k, _hash(words, k)) for k in range(1, K + 1)])
    return t.withColumn("hash", by_size)


def scan(docs: DataFrame, base: list = BASE, notices: list = NOTICES) -> DataFrame:
    """(doc_id, n_words, spans): a row per document; spans: start, stop, label, base, share, by start.

    Places of ``base`` are exact; ``notices`` may also be found in changed wordings, with a share below 1.
    """
    if any(len(t.split()) < 2 for _, t in [*base, *notices]):
        raise ValueError("templates have two words at least")
    grams = [g for _, t in [*base, *notices] for g in _grams(t)]
    first, pairs = sorted({g[0] for g in grams}), sorted({" ".join(g[:2]) for g in grams})
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words")).withColumn("n_words", F.size("words").cast("long"))
    w = lambda i: F.get("words", i)
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))), lambda i: w(i).isin(first) & F.concat(w(i), F.lit(" "), w(i + 1)).isin(pairs))
    found = F.flatten(F.transform(at, lambda i: F.transform(F.array(*[F.lit(k) for k in range(2, K + 1)]), lambda k: F.struct(i.alias("i"), F.slice("words", i + 1, k).alias("words")))))
    d = d.select("row", "doc_id", "n_words", F.explode_outer(found).alias("g")).select("row", "doc_id", "n_words", "g.i", F.col("g.words").alias("own"))
    d = d.withColumn("hash", F.coalesce(*[F.when(F.size("own") == k, _hash(F.col("own"), k)) for k in range(2, K + 1)]))
    t = template_grams(docs.sparkSession, base, notices)
    hits = d.join(F.broadcast(t), "hash", "left").withColumn("same", F.array_join("own", " ") == F.col("gram"))
    hits = hits.select("row", "doc_id", "n_words", *[F.when(F.col("same"), F.col(c)).alias(c) for c in ("i", "tid", "j", "label", "base", "size")])
    # one shuffle: all that follows is grouped within a row
    hits = hits.repartition("row")
    k = F.least(F.lit(K), F.col("size"))
    diagonal = hits.groupBy("row", "doc_id", "n_words", "tid", "label", "base", "size", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.collect_set("j").alias("js"), F.min("i").alias("low"), F.max("i").alias("high")
    )
    near = Window.partitionBy("row", "tid").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(near)
    diagonal = diagonal.withColumn("_new", F.when(gap <= F.floor(F.col("size") / 4), 0).otherwise(1)).withColumn("run", F.sum("_new").over(near))
    exact = F.size("js") == F.col("size") - k + 1
    run = diagonal.groupBy("row", "doc_id", "n_words", "tid", "label", "base", "size", "run").agg(
        F.collect_list(F.when(exact, F.col("diagonal"))).alias("exact"), F.flatten(F.collect_list("js")).alias("js"),
        F.min("low").alias("low"), (F.max("high") + F.max(k)).alias("high"), (F.max("diagonal") - F.min("diagonal")).alias("moved"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + k - 1)))))
    span = lambda start, stop, share: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.col("label"), F.col("base"), share.alias("share"))
    passes = ~F.col("base") & (covered >= SHARE * F.col("size")) & (F.col("high") - F.col("low") <= F.col("size") + F.col("moved"))
    spans = F.when(F.size("exact") > 0, F.transform("exact", lambda x: span(x, x + F.col("size"), F.lit(1.0)))).when(passes, F.array(span(F.col("low"), F.col("high"), covered / F.greatest(F.col("size"), F.col("high") - F.col("low")))))
    run = run.select("row", "doc_id", "n_words", F.coalesce(F.when(F.col("tid").isNotNull(), spans), F.array().cast("array<struct<start:bigint,stop:bigint,label:string,base:boolean,share:double>>")).alias("spans"))
    return run.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).drop("row")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base places, and the labels of all notices found in it."""
    s = scan(documents(spark, sf_dir))
    own = F.filter("spans", lambda x: x["base"])
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    starts = F.transform(own, lambda x: x["start"])
    return s.select(
        "doc_id", "n_words", F.size(own).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(own).alias("base_labels"), named(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op13_licenses": op13_licenses}

_VALUES = ",\n    ".join(f"({tid}, '{label}', {str(tid < len(BASE)).lower()}, '{text}')" for tid, (label, text) in enumerate([*BASE, *NOTICES]))
#: Every word's k-grams are joined as texts.
ORACLE_SQL = {
    "op13_licenses": rf"""
WITH tpl AS (
  SELECT *, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS size, least({K}, len(string_split(text, ' '))) AS k FROM (VALUES
    {_VALUES}) v(tid, label, base, text)
), tg AS (
  SELECT tid, label, base, size, k, j, array_to_string(w[j + 1:j + k], ' ') AS gram FROM (SELECT *, unnest(range(0, size - k + 1)) AS j FROM tpl)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), p AS (
  SELECT r, i, w1 || ' ' || w2 AS two, w1 || ' ' || w2 || ' ' || w3 AS three FROM (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3 FROM d)
), hits AS (
  SELECT r, tid, label, base, size, k, j, i, i - j AS diag FROM (SELECT r, i, two AS gram FROM p UNION ALL SELECT r, i, three FROM p) g JOIN tg USING (gram)
), dg AS (
  SELECT r, tid, label, base, size, k, diag, list(DISTINCT j) AS js, min(i) AS low, max(i + k) AS high FROM hits GROUP BY ALL
), m AS (
  SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, tid ORDER BY diag) <= size // 4 THEN 0 ELSE 1 END AS fresh FROM dg
), n AS (SELECT *, sum(fresh) OVER (PARTITION BY r, tid ORDER BY diag) AS run FROM m),
ex AS (SELECT r, tid, run, label, base, diag AS start, CAST(1 AS DOUBLE) AS share FROM n WHERE len(js) = size - k + 1),
cov AS (
  SELECT r, tid, run, label, size, count(DISTINCT c) AS covered FROM (SELECT r, tid, run, label, size, k, unnest(js) AS j FROM n WHERE NOT base), LATERAL (SELECT unnest(range(j, j + k)) AS c) GROUP BY ALL
), runs AS (SELECT r, tid, run, min(low) AS low, max(high) AS high, max(diag) - min(diag) AS moved FROM n GROUP BY ALL),
loose AS (
  SELECT r, tid, run, label, covered / greatest(size, high - low) AS share FROM cov JOIN runs USING (r, tid, run)
  WHERE covered >= {SHARE} * size AND high - low <= size + moved AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.r = cov.r AND ex.tid = cov.tid AND ex.run = cov.run)
), spans AS (
  SELECT r, label, base, start, share FROM ex UNION ALL SELECT r, label, false, NULL, share FROM loose
)
SELECT any_value(doc_id) AS doc_id, any_value(len(w)) AS n_words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(share), 0) AS score
FROM d LEFT JOIN spans USING (r) GROUP BY r
"""
}
