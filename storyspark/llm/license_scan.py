"""Licence scan: sparse TF-IDF cosine to templates, then directory inheritance.

Every sentence of a file that mentions a licence is a candidate (a header line, a
line of a licence file). Candidates and templates become sparse TF-IDF vectors,
with document frequencies over all candidates of the corpus; a file's own
licence is that of its best template at ``LEAST`` cosine or more. A file whose
words are mostly candidate sentences, or whose name says so, is a licence file and speaks for its
directory. A file without a licence of its own inherits from the nearest
directory above it that has one.

Scale: texts are read once and leave as a short array of candidate sentences.
Equal sentences, equal arrays and equal directories collapse before any join, so
a licence line in a third of all files is scored once. Only the template
weights are broadcast; their number is fixed by ``TEMPLATES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

LEAST = 0.5              # cosine from which a sentence names a licence
FILE_SHARE = 0.5         # share of candidate words that makes a licence file

# fixed values: wording of well-known licences and their usual notices
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under this license"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 license 1.0."),
    ("Proprietary", "Copyright. All rights reserved."),
]
MENTION = r"(?i)licen[cs]|copyright|spdx|all rights reserved|public domain|permission is hereby"
BREAK = r"\n|(?<=[.!?])[ \t\r]+"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def sentence_licences(sentences: DataFrame, least: float = LEAST) -> DataFrame:
    """``sentences(sentence, n)``, distinct with their number of mentions ->
    ``(sentence, licence, score)`` of the best template, where it reaches
    ``least``; ties go to the licence first by name."""
    spark = sentences.sparkSession
    own = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES)], "template int, licence string, sentence string")
    counts = lambda df, *keys: (df.select(*keys, F.explode(_terms(F.col("sentence"))).alias("term"))
                                .groupBy(*keys, "term").agg(F.count("*").alias("tf")))
    terms = cut_lineage(counts(sentences, "sentence", "n"))
    own_terms = counts(own, "template", "licence", "sentence").drop("sentence")
    total = (sentences.agg(F.sum("n")).first()[0] or 0) + len(TEMPLATES)
    df = cut_lineage(terms.select("term", "n").union(own_terms.select("term", F.lit(1).cast("long")))
                     .groupBy("term").agg(F.sum("n").alias("df")))
    weight = (1 + F.log("tf")) * (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1)
    left = terms.join(df, "term").select("sentence", "term", weight.alias("w"))
    norm = left.groupBy("sentence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    right = own_terms.join(df, "term").select("template", "licence", "term", weight.alias("v"))
    own_norm = right.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("own_norm"))
    right = right.join(own_norm, "template")
    dots = (left.join(F.broadcast(right), "term").groupBy("sentence", "template", "licence", "own_norm")
            .agg(F.sum(F.col("w") * F.col("v")).alias("dot")))
    scored = dots.join(norm, "sentence").withColumn("score", F.round(F.col("dot") / F.col("norm") / F.col("own_norm"), 6))
    best = scored.where(F.col("score") >= least).groupBy("sentence").agg(
        F.min(F.struct((-F.col("score")).alias("order"), "licence")).alias("b"))
    return best.select("sentence", F.col("b.licence").alias("licence"), (-F.col("b.order")).alias("score"))


def scan(files: DataFrame, id_cols: tuple[str, ...] = ("path",), least: float = LEAST, share: float = FILE_SHARE) -> DataFrame:
    """``files(path, text, id columns)`` -> ``(id columns, licence, score,
    origin, licence_dir)``, one row per input row. ``origin`` is own,
    inherited or none; ``licence_dir`` is the directory an inherited licence
    comes from.

    Null text counts as empty, a null path as a file in the root directory.
    Of a file's candidates the best score wins, then the licence first by
    name; so for several licence files of a directory. Repeated rows agree;
    other columns are ignored; an empty table gives no rows."""
    text, path = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("path"), F.lit(""))
    sentences = F.filter(F.when(text.rlike(MENTION), F.split(text, BREAK, -1)).otherwise(F.array().cast("array<string>")),
                         lambda s: s.rlike(MENTION))
    words = lambda t: F.size(F.array_remove(F.split(t, r"\s+", -1), ""))
    rows = files.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(id_cols)],
        F.regexp_replace(path, "/?[^/]*$", "").alias("dir"), path.rlike(FILE_NAME).alias("named"),
        F.array_distinct(sentences).alias("candidates"),
        F.when(text.rlike(MENTION), F.aggregate(F.transform(sentences, words), F.lit(0), lambda a, x: a + x)
               >= share * F.greatest(words(text), F.lit(1))).otherwise(False).alias("mostly"))
    rows = cut_lineage(rows)
    keys = [f"__k{i}" for i in range(len(id_cols))]

    groups = rows.where(F.size("candidates") > 0).groupBy("candidates").agg(F.count("*").alias("n"))
    mentions = groups.select("candidates", "n", F.explode("candidates").alias("sentence"))
    named = sentence_licences(cut_lineage(mentions.groupBy("sentence").agg(F.sum("n").alias("n"))), least)
    own = (mentions.join(named, "sentence").groupBy("candidates")
           .agg(F.min(F.struct((-F.col("score")).alias("order"), "licence")).alias("b"))
           .select("candidates", F.col("b.licence").alias("licence"), (-F.col("b.order")).alias("score")))
    plain = rows.where(F.size("candidates") == 0).select(
        *keys, "dir", F.lit(False).alias("speaks"), F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("score"))
    held = rows.where(F.size("candidates") > 0).join(own, "candidates", "left").select(
        *keys, "dir", (F.col("mostly") | F.col("named")).alias("speaks"), "licence", "score")
    marked = cut_lineage(plain.unionByName(held))

    speaking = (marked.where("speaks and licence is not null").groupBy("dir")
                .agg(F.min(F.struct((-F.col("score")).alias("order"), "licence")).alias("b"))
                .select(F.col("dir").alias("licence_dir"), F.col("b.licence").alias("from_licence"), (-F.col("b.order")).alias("from_score")))
    parts = F.split("dir", "/")
    above = marked.where("licence is null").select("dir").distinct().select("dir", F.explode(F.array_distinct(F.concat(
        F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))))
        .alias("licence_dir"))
    nearest = (above.join(speaking, "licence_dir").groupBy("dir")
               .agg(F.max(F.struct(F.length("licence_dir").alias("depth"), "licence_dir", "from_licence", "from_score")).alias("b"))
               .select("dir", "b.licence_dir", "b.from_licence", "b.from_score"))
    done = marked.where("licence is null").join(nearest, "dir", "left").select(
        *keys, F.col("from_licence").alias("licence"), F.col("from_score").alias("score"),
        F.when(F.col("from_licence").isNull(), "none").otherwise("inherited").alias("origin"), "licence_dir")
    mine = marked.where("licence is not null").select(
        *keys, "licence", "score", F.lit("own").alias("origin"), F.lit(None).cast("string").alias("licence_dir"))
    out = mine.unionByName(done)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, id_cols)], "licence", "score", "origin", "licence_dir")


def _values() -> str:
    return ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(TEMPLATES))


#: documents as files: the path is source/lang/doc_id.txt
DOCUMENTS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, concat_ws('/', source, lang, doc_id || '.txt') AS path,
             coalesce(text, '') AS t FROM documents),
own(template, licence, sentence) AS (VALUES """ + _values() + r"""),
s AS (SELECT k, sentence FROM (
        SELECT k, unnest(string_split(regexp_replace(t, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10))) AS sentence FROM d)
      WHERE regexp_matches(sentence, '(?i)licen[cs]|copyright|spdx|all rights reserved|public domain|permission is hereby')),
m AS (SELECT sentence, count(DISTINCT k) AS n FROM s GROUP BY sentence),
st AS (SELECT sentence, n, term, count(*) AS tf FROM (
        SELECT sentence, n, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM m) GROUP BY ALL),
ot AS (SELECT template, licence, term, count(*) AS tf FROM (
        SELECT template, licence, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM own) GROUP BY ALL),
total AS (SELECT coalesce((SELECT sum(n) FROM m), 0) + (SELECT count(*) FROM own) AS total),
df AS (SELECT term, sum(n) AS df FROM (SELECT term, n FROM st UNION ALL SELECT term, 1 FROM ot) GROUP BY term),
l AS (SELECT sentence, term, (1 + ln(tf)) * (ln((1.0 + total) / (1 + df)) + 1) AS w FROM st JOIN df USING (term), total),
r AS (SELECT template, licence, term, (1 + ln(tf)) * (ln((1.0 + total) / (1 + df)) + 1) AS v FROM ot JOIN df USING (term), total),
ln AS (SELECT sentence, sqrt(sum(w * w)) AS norm FROM l GROUP BY sentence),
rn AS (SELECT template, sqrt(sum(v * v)) AS own_norm FROM r GROUP BY template),
c AS (SELECT sentence, licence, round(sum(w * v) / any_value(norm) / any_value(own_norm), 6) AS score
      FROM l JOIN r USING (term) JOIN ln USING (sentence) JOIN rn USING (template) GROUP BY sentence, template, licence),
o AS (SELECT k, licence, score FROM s JOIN c USING (sentence) WHERE score >= 0.5
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, licence) = 1),
sh AS (SELECT k, sum(len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> ''))) AS said FROM s GROUP BY k),
f AS (SELECT d.k, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, licence, score,
        coalesce(said >= 0.5 * greatest(len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')), 1), false) AS speaks
      FROM d LEFT JOIN o USING (k) LEFT JOIN sh USING (k)),
sp AS (SELECT dir AS licence_dir, licence, score FROM f WHERE speaks AND licence IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1),
n AS (SELECT f.dir, sp.* FROM (SELECT DISTINCT dir FROM f) f
      JOIN sp ON f.dir = sp.licence_dir OR sp.licence_dir = '' OR starts_with(f.dir, sp.licence_dir || '/')
      QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY length(sp.licence_dir) DESC) = 1)
SELECT doc_id, path, coalesce(f.licence, n.licence) AS licence, coalesce(f.score, n.score) AS score,
  CASE WHEN f.licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN f.licence IS NULL THEN n.licence_dir END AS licence_dir
FROM f LEFT JOIN n ON f.dir = n.dir
"""
