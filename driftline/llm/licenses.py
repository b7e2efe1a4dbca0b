"""License scans by diagonal voting, in DataFrame functions only.

Base: places where the words of a fixed phrase stand. The method finds whole
notices and license texts, also with words changed: hashes of all rolling
``gram`` -word windows of all texts are joined with the windows of the
templates; a match at place p of the text and q of a template votes for the
diagonal p - q. Diagonals close to each other are merged, because a word more
or less shifts what follows. Spans with enough votes are verified on the words
of the text itself: twice the distinct words in common over the distinct words
of span and template together.

Votes are held by text, not by row, so copies of a text neither add votes nor
move. Templates are a parameter; they are broadcast up to
``broadcast_grams`` windows, and beyond that joined by a shuffle with salts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.spread import spread_join
from . import store
from .text import let, lower_ascii, text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and license texts that are found by default: (label, text).
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


@dataclass(frozen=True)
class LicenseRules:
    #: Words of a window.
    gram: int = 3
    #: Diagonals at most so far apart are one.
    slack: int = 4
    #: Least share of a template's windows that vote for a span.
    min_votes: float = 0.5
    #: Least share of words in common, when verified.
    min_words: float = 0.75
    broadcast_grams: int = 1_000_000
    #: So many texts with candidate spans may be broadcast.
    broadcast_texts: int = 50_000
    #: Parts of a window's votes, where templates are shuffled.
    salts: int = 16


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def phrase_places(word_list: Column, phrases: dict[str, str]) -> Column:
    """struct<n, first, last, labels> of the phrases' places. The words before
    each place are a piece of the joined text, so starts are counts of words."""
    line = F.concat(F.lit(" "), F.array_join(word_list, " "), F.lit(" "))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.array().cast("array<string>").alias("labels"))

    def found(line: Column) -> Column:
        pieces = F.split(line, f" (?=(?:{'|'.join(phrases)}) )", -1)
        count = lambda piece: F.regexp_count(piece, F.lit("[^ ]+")).cast("long")
        labels = F.array_compact(F.array(*[F.when(F.contains(line, F.lit(f" {p} ")), F.lit(label)) for p, label in phrases.items()]))
        at = lambda p: F.struct((F.size(p) - 1).cast("long").alias("n"), count(F.get(p, F.lit(0))).alias("first"), (F.size(word_list) - count(F.element_at(p, -1))).alias("last"), F.array_sort(F.array_distinct(labels)).alias("labels"))
        return F.when(F.size(labels) > 0, let(pieces, at)).otherwise(none)

    heads = F.array(*[F.lit(w) for w in sorted({p.split(" ")[-1] for p in phrases})])
    return F.when(F.arrays_overlap(word_list, heads), let(line, found)).otherwise(none)


def grams(word_list: Column, n: int) -> Column:
    """array<long>: a hash for each window of ``n`` words."""
    size = F.size(word_list)
    window = lambda i: F.xxhash64(*[F.get(word_list, i + k) for k in range(n)])
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), window)).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates, rules: LicenseRules) -> DataFrame:
    """(t, label, words, least): templates, and how many votes each asks for.
    Templates shorter than a window can't be found."""
    rows = spark.createDataFrame([(t, label, text) for t, (label, text) in enumerate(templates)], "t int, label string, text string")
    listed = rows.select("t", "label", words(F.col("text")).alias("words"))
    return listed.where(F.size("words") >= rules.gram).withColumn("least", F.lit(rules.min_votes) * (F.size("words") - rules.gram + 1))


def voted_spans(docs: DataFrame, templates: DataFrame, rules: LicenseRules) -> DataFrame:
    """(a, b, t, start, end) with enough votes, from (a, b, words) of each text."""
    table = store.written(templates.select("t", F.posexplode(grams(F.col("words"), rules.gram)).alias("q", "h")), "grams")
    found = docs.select("a", "b", F.posexplode(grams(F.col("words"), rules.gram)).alias("p", "h"))
    if table.count() <= rules.broadcast_grams:
        met = found.join(F.broadcast(table), "h")
    else:
        salted = table.withColumn("salt", F.explode(F.array(*map(F.lit, range(rules.salts)))))
        met = found.withColumn("salt", F.pmod(F.xxhash64("a", "p"), F.lit(rules.salts)).cast("int")).join(salted, ["h", "salt"])
    # copies of a text vote for the same places, which count once; a diagonal has as many as its template has windows
    diagonals = met.groupBy("a", "b", "t", (F.col("p") - F.col("q")).alias("d")).agg(F.collect_set("q").alias("q"))
    w = Window.partitionBy("a", "b", "t").orderBy("d")
    new = F.coalesce(F.col("d") - F.lag("d").over(w) > rules.slack, F.lit(True))
    merged = diagonals.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(w))
    low, high = F.min(F.col("d") + F.array_min("q")), F.max(F.col("d") + F.array_max("q")) + rules.gram
    spans = merged.groupBy("a", "b", "t", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("q")))).alias("votes"), low.alias("start"), high.alias("end"))
    return spans.join(F.broadcast(templates.select("t", "least")), "t").where("votes >= least").select("a", "b", "t", "start", "end")


def verified(docs: DataFrame, spans: DataFrame, templates: DataFrame, rules: LicenseRules) -> DataFrame:
    """(a, b, found): spans with label and share, of those whose words agree."""
    listed = spans.join(F.broadcast(templates.select("t", "label", F.col("words").alias("of"))), "t")
    by_text = store.written(listed.groupBy("a", "b").agg(F.collect_list(F.struct("start", "end", "label", "t", "of")).alias("spans")), "candidates")
    small = by_text.count() <= rules.broadcast_texts
    met = docs.join(F.broadcast(by_text) if small else by_text, ["a", "b"])

    def judged(s: Column) -> Column:
        mine, of = F.array_distinct(F.slice("words", s.start + 1, s.end - s.start)), F.array_distinct(s.of)
        share = 2.0 * F.size(F.array_intersect(mine, of)) / (F.size(mine) + F.size(of))
        return F.struct(s.start.cast("long").alias("start"), s.end.cast("long").alias("end"), s.label.alias("label"), share.alias("share"))

    found = F.filter(F.transform("spans", judged), lambda s: s.share >= rules.min_words)
    return met.select("a", "b", F.array_sort(found).alias("found")).groupBy("a", "b").agg(F.first("found").alias("found"))


def scan(docs: DataFrame, rules: LicenseRules = LicenseRules(), templates=TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels (array), spans (array of start, end in words, label, share, of
    whole notices) and score: the greatest share, 1 with a base phrase, else 0.

    Null texts are empty; texts without words have no labels. Very long texts
    take time in proportion to their words. Repeated rows each get a row.
    Templates without words or shorter than a window are never found. An empty
    table gives an empty result. Other columns of ``docs`` are ignored.
    """
    key = text_key(F.col(text_col))
    read = docs.select(F.col(id_col).alias("doc_id"), key.a.alias("a"), key.b.alias("b"), words(F.col(text_col)).alias("words"))
    rows = read.select("doc_id", "a", "b", F.size("words").cast("long").alias("n_words"), let(F.col("words"), lambda w: phrase_places(w, phrases)).alias("base"))
    rows = store.written(rows, "rows")
    table = store.written(template_table(docs.sparkSession, templates, rules), "templates")
    texts = read.select("a", "b", "words")
    verdict = verified(texts, store.written(voted_spans(texts, table, rules), "spans"), table, rules)
    copies = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    verdict = store.written(verdict.where(F.size("found") > 0).join(copies, ["a", "b"]), "verdicts")
    out = spread_join(rows, verdict, ["a", "b"], ["doc_id"], "left", total=rows.count())
    best = F.array_max(F.transform("found", lambda s: s.share))
    return out.select(
        "doc_id", "n_words", F.col("base.n").alias("n_base"), F.col("base.first").alias("first_word"), F.col("base.last").alias("last_word"), F.col("base.labels").alias("base_labels"),
        F.coalesce("found", F.array().cast("array<struct<start:bigint,end:bigint,label:string,share:double>>")).alias("spans"), F.when(F.col("base.n") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s.label)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score", F.size("spans").cast("long").alias("n_spans"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda text: f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    values = ", ".join(f"({t}, {quoted(label)}, {quoted(text)})" for t, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({quoted(p)}, {quoted(label)})" for p, label in PHRASES.items())
    r = LicenseRules()
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(r.gram))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {listed("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT t, label, {listed("x")} AS w FROM (VALUES {values}) AS v(t, label, x)),
ph AS (SELECT *, string_split(p, ' ') AS pw FROM (VALUES {phrases}) AS v(p, label)),
place AS (SELECT r, i - 1 AS i, label FROM ph, d, unnest(range(1, len(w) + 1)) AS u(i) WHERE list_has_all(w, pw) AND w[i] = pw[1] AND w[i:i + len(pw) - 1] = pw),
base AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, list_sort(list(DISTINCT label)) AS labels FROM place GROUP BY r),
tg AS (SELECT t, i - 1 AS q, {gram} AS g FROM t, unnest(range(1, len(w) - {r.gram - 2})) AS u(i)),
dg AS (SELECT r, i - 1 AS p, {gram} AS g FROM d, unnest(range(1, len(w) - {r.gram - 2})) AS u(i)),
dia AS (SELECT r, t, p - q AS d, q FROM dg JOIN tg USING (g)),
new AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, t ORDER BY d) <= {r.slack} THEN 0 ELSE 1 END AS new FROM dia),
span AS (SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY d, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM new),
voted AS (SELECT r, t, s, count(DISTINCT q) AS votes, min(d + q) AS a, max(d + q) + {r.gram} AS b FROM span GROUP BY r, t, s),
share AS (SELECT v.r, t.label, 2.0::DOUBLE * len(list_intersect(list_distinct(d.w[a + 1:b]), list_distinct(t.w))) / (len(list_distinct(d.w[a + 1:b])) + len(list_distinct(t.w))) AS share
  FROM voted v JOIN t USING (t) JOIN d ON d.r = v.r WHERE votes >= {r.min_votes}::DOUBLE * (len(t.w) - {r.gram - 1})),
found AS (SELECT r, max(share) AS best, count(*) AS n, list(DISTINCT label) AS labels FROM share WHERE share >= {r.min_words}::DOUBLE GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.first::BIGINT AS first_word, base.last::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(found.best, 0.0::DOUBLE) END AS score, coalesce(found.n, 0)::BIGINT AS n_spans
FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""


OP11_SQL = _sql()
