"""License scans by diagonal voting, in DataFrame operations only.

Templates (phrases and notices) are word lists. Every rolling k-word window of a document is hashed and joined to the
template windows of equal hash; the words themselves are compared as well. A hit votes for the diagonal, document
position minus template position. Votes are summed by diagonal; diagonals at most ``slack`` apart merge, since a word
left out or put in moves the rest of a notice by one. A merged span is verified by the template's words that its hits cover:
a phrase must stand whole on one diagonal, a notice needs ``least`` of its words. Any one word of a notice may be
changed, left out or put in.

The word list of a document is exploded in place and only hits leave the task, so one small shuffle by document
is all, whatever the documents' sizes.

Result cases. Null or wordless text: no words, no labels, score 0. Null doc_id: reported as null. Rows that repeat a
doc_id and text each get the same result row. Very long texts are scanned whole. Ties: labels are sorted. Empty table:
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.llm.common import LOWER, UPPER, whole_text

# fixed values: phrases of the base report
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# fixed values: public notices
NOTICES = [
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
     compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
     Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
     an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
     specific language governing permissions and limitations under the License."""),
    ("mit-grant", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
     associated documentation files (the "Software"), to deal in the Software without restriction, including without
     limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
     Software, and to permit persons to whom the Software is furnished to do so"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met"""),
    ("gpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
     General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
     option) any later version."""),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
     was not distributed with this file, You can obtain one at"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
     hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

PHRASE_WORDS, NOTICE_WORDS = 2, 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLACK = 3
LEAST = 0.65  # of a notice's words


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD, -1), "")


def template_windows(spark, templates: list[tuple[str, str]], k: int, base: bool) -> DataFrame:
    """(hash, at): each window's places (label, base, n_windows, place, words). As large as the list of templates."""
    known = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(text).alias("text")) for label, text in templates]))
    lists = spark.range(1).select(known.alias("t")).select("t.label", license_words(F.col("t.text")).alias("list"))
    n = F.size("list") - k + 1
    windows = lists.select("label", n.alias("n_windows"), "list", F.explode(F.sequence(F.lit(0), n - 1)).alias("place")).select(
        "label", F.lit(base).alias("base"), "n_windows", "place", F.slice("list", F.col("place") + 1, k).alias("words")
    )
    window_hash = F.xxhash64(*[F.col("words")[i] for i in range(k)])
    at = F.struct("label", "base", "n_windows", "place", "words")
    return windows.groupBy(window_hash.alias(f"h{k}")).agg(F.collect_list(at).alias(f"at{k}"))


def hits(docs: DataFrame, phrases=tuple(PHRASES), notices=tuple(NOTICES)) -> DataFrame:
    """(doc_id, text_hash, n_words, label, base, n_windows, place, diagonal) of every window that is also a template's,
    and one row without label for every document."""
    spark = docs.sparkSession
    text = whole_text()
    lists = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), license_words(text).alias("words"))
    n = F.size("words")
    places = lists.select("doc_id", "text_hash", n.alias("n_words"), "words", F.explode(F.sequence(F.lit(-1), n - 1)).alias("pos"))
    for k in (PHRASE_WORDS, NOTICE_WORDS):
        window = F.xxhash64(*[F.get("words", F.col("pos") + i) for i in range(k)])
        places = places.withColumn(f"h{k}", F.when((F.col("pos") >= 0) & (F.col("pos") + k <= F.col("n_words")), window))
    for k, templates, base in ((PHRASE_WORDS, phrases, True), (NOTICE_WORDS, notices, False)):
        # both sides of the hint are literals in this module or arguments of the plan
        places = places.join(F.broadcast(template_windows(spark, list(templates), k, base)), f"h{k}", "left")
    none = F.array().cast("array<struct<label:string,base:boolean,n_windows:int,place:int,words:array<string>>>")
    met = places.where("pos < 0 OR at2 IS NOT NULL OR at3 IS NOT NULL").select(
        "doc_id", "text_hash", "n_words", "words", "pos",
        F.explode_outer(F.concat(F.coalesce("at2", none), F.coalesce("at3", none))).alias("t"),
    )
    same = F.col("t").isNull() | (F.slice("words", F.col("pos") + 1, F.size("t.words")) == F.col("t.words"))
    return met.where(same).select(
        "doc_id", "text_hash", "n_words", F.col("t.label").alias("label"), F.col("t.base").alias("base"),
        F.col("t.n_windows").alias("n_windows"), F.col("t.place").alias("place"), (F.col("pos") - F.col("t.place")).alias("diagonal"),
    )


def spans(found: DataFrame, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """One row per document and verified span: label, base, first and last word, part of the template covered.
    Documents without a span have one row without label; ``copies`` counts equal rows of the input."""
    doc = ["doc_id", "text_hash"]
    votes = found.groupBy(*doc, "n_words", "label", "base", "n_windows", "diagonal").agg(
        F.collect_set("place").alias("places"), F.count("*").alias("rows")
    )
    per_template = Window.partitionBy(*doc, "label", "base").orderBy("diagonal")
    reach = F.when(F.col("base"), 0).otherwise(slack)
    gap = F.col("diagonal") - F.lag("diagonal").over(per_template)
    # a later copy of the same notice starts anew: its diagonal is far away
    banded = votes.withColumn("new", F.when(gap <= reach, 0).otherwise(1)).withColumn("band", F.sum("new").over(per_template))
    place = F.explode_outer("places").alias("place")
    merged = (
        banded.select(*doc, "n_words", "label", "base", "n_windows", "band", "diagonal", "rows", place)
        .groupBy(*doc, "n_words", "label", "base", "n_windows", "band")
        .agg(F.collect_set("place").alias("places"), F.min(F.col("diagonal") + F.col("place")).alias("first"),
             F.max(F.col("diagonal") + F.col("place")).alias("last"), F.max("rows").alias("copies"))
    )
    tail = F.when(F.col("base"), PHRASE_WORDS).otherwise(NOTICE_WORDS) - 1
    # as many as a template has words, at most
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + tail)))))
    part = covered / (F.col("n_windows") + tail)
    whole = F.when(F.col("base"), F.size("places") == F.col("n_windows")).otherwise(part >= least)
    return merged.where(F.col("label").isNull() | whole).select(
        *doc, "n_words", "label", "base", "first", (F.col("last") + tail).alias("last"), part.alias("part"), "copies"
    )


def license_report(docs: DataFrame, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score (the best part of a
    template that stands in the document)."""
    is_base = F.col("base")
    joined = [F.array_join(F.array_sort(F.collect_set(x)), ",") for x in (F.when(is_base, F.col("label")), F.col("label"))]
    per = spans(hits(docs), slack, least).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        joined[0].alias("base_labels"), joined[1].alias("labels"), F.coalesce(F.max("part"), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("label").isNull(), F.col("copies"))).cast("int").alias("copies"),
    )
    return per.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy", "copies", "text_hash")



def _sql() -> str:
    """The report in SQL, by the same steps, for tables with one row per doc_id."""
    rows = ", ".join(
        f"('{label}', {str(base).lower()}, {k}, '{' '.join(text.split())}')"
        for templates, base, k in ((PHRASES, True, PHRASE_WORDS), (NOTICES, False, NOTICE_WORDS)) for label, text in templates
    )
    words = f"list_filter(string_split_regex(translate({{}}, '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT label, base, k, {words.format('text')} AS w FROM (VALUES {rows}) v(label, base, k, text)),
tg AS (
  SELECT label, base, k, n, place, array_to_string(w[place + 1 : place + k], ' ') AS gram
  FROM (SELECT *, len(w) - k + 1 AS n, unnest(range(0, len(w) - k + 1)) AS place FROM t)),
d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM d),
g AS (
  SELECT doc_id, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS gram
  FROM p, (VALUES ({PHRASE_WORDS}), ({NOTICE_WORDS})) ks(k) WHERE pos + k <= len(w)),
h AS (SELECT DISTINCT doc_id, label, base, n, k, place, pos - place AS diagonal FROM g JOIN tg USING (k, gram)),
v AS (SELECT DISTINCT doc_id, label, base, diagonal FROM h),
b AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, label, base ORDER BY diagonal) AS band
  FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, label, base ORDER BY diagonal)
    <= CASE WHEN base THEN 0 ELSE {SLACK} END THEN 0 ELSE 1 END AS fresh FROM v)),
m AS (
  SELECT doc_id, label, base, band, any_value(n) AS n, any_value(n + k - 1) AS size, count(DISTINCT place) AS places,
    len(list_distinct(flatten(list(range(place, place + k))))) AS covered, min(diagonal + place) AS first
  FROM h JOIN b USING (doc_id, label, base, diagonal) GROUP BY doc_id, label, base, band),
s AS (SELECT *, covered / size AS part FROM m WHERE CASE WHEN base THEN places = n ELSE covered / size >= {LEAST} END)
SELECT d.doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base,
  CAST(min(first) FILTER (base) AS BIGINT) AS first_word, CAST(max(first) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(part), 0.0)::DOUBLE AS score
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


SQL = _sql()
