"""Quality rules by cross-document line frequency, in DataFrame functions only.

A line that many different documents of one host share is boilerplate. Lines
are normalised and hashed; each (host, line) gets the number of distinct
documents that hold it; lines above the limit are removed; a document that
loses most of its words that way is rejected. Exact copies of a text count as
one document of their host, so a page that was crawled a thousand times does
not make its own lines boilerplate.

What is shuffled: one row of line hashes per distinct text and host, then one
row per line hash. Texts move only if ``clean_text`` is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread_join
from . import store
from .text import SPACE, let, lower_ascii, text_key, words


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules."""

    min_words: int = 50
    #: Highest share, in percent, of words within repeated 3-word windows.
    max_repeat_percent: int = 50
    #: A line is removed if more than this share of its host's distinct
    #: documents hold it, and more than so few that chance may repeat it.
    max_line_share: float = 0.005
    max_line_docs: int = 5
    #: A document is depleted if less than this share of its words is left.
    min_left_share: float = 0.3


def n_repeat_words(word_list: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the list, each
    word once, the first occurrence of a window included."""
    size = F.size(word_list)

    def windows(i: Column) -> Column:
        return F.struct(F.xxhash64(F.get(word_list, i), F.get(word_list, i + 1), F.get(word_list, i + 2)).alias("h"), i.alias("i"))

    sorted_windows = F.when(size >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), size - 3), windows))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
        return F.sort_array(F.transform(same, lambda x: x.i))

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return let(let(sorted_windows, twice), covered).cast("long")


def normalised(line: Column) -> Column:
    """Lower-cased A-Z, single blanks, none at the ends."""
    return F.trim(F.regexp_replace(lower_ascii(line), SPACE + "+", " "))


def hashed_lines(text: Column) -> Column:
    """array<struct<h, w>>: the hash and the number of words of each line that
    has a word."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), normalised)
    kept = F.filter(lines, lambda x: x != "")
    return F.transform(kept, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))


def frequent_lines(lines: DataFrame, rules: LineRules) -> DataFrame:
    """(host, h, n_docs) of the lines above the limit. ``lines`` has a row
    (host, lines) for each distinct document of a host."""
    counts = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.h))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    hosts = lines.groupBy("host").agg(F.count("*").alias("host_docs"))
    # lines that few documents hold can't be removed, so few rows meet the hosts
    likely = counts.where(F.col("n_docs") > rules.max_line_docs)
    return likely.join(hosts, "host").where(F.col("n_docs") > F.col("host_docs") * F.lit(rules.max_line_share)).select("host", "h", "n_docs")


def line_quality(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the base statistics, ``base_failed``,
    ``removed_words``, ``clean_text`` (without the removed lines), ``kept``.

    Null and empty texts have no words and fail the base rule. Null hosts are
    one host. Repeated rows each get a row, but count as one document in line
    frequencies. An empty table gives an empty result. Other columns of
    ``docs`` are ignored unless named in ``keep``; those come back unchanged,
    in a struct ``row``, so that no name can clash.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(host_col).isNull(), F.col(host_col)).alias("host"),
        text_key(F.col(text_col)).alias("key"),
        F.struct(*[F.col(c) for c in keep or [id_col]]).alias("row"),
    )
    distinct = rows.groupBy("host", "key").agg(F.first(hashed_lines(F.col("text"))).alias("lines"), F.count("*").alias("n"))
    distinct = store.written(distinct, "lines")
    n_rows, n_lines = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    frequent = store.written(frequent_lines(distinct, rules), "frequent")
    lines = distinct.select("host", "key", "n", F.explode("lines").alias("line")).select("host", "key", "n", "line.h", "line.w")
    # a line that a third of all documents hold, and a text that a third of all rows have, are split
    removed = spread_join(lines.withColumnRenamed("n", "rows"), frequent, ["host", "h"], ["key"], n="n_docs", total=n_lines)
    lost = store.written(removed.groupBy("host", "key").agg(F.first("rows").alias("n"), F.sum("w").alias("removed_words"), F.collect_set("h").alias("removed_lines")), "lost")
    text = F.coalesce(F.col("text"), F.lit(""))
    stats = rows.select(
        "*",
        let(words(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            n_repeat_words(w).alias("n_repeat_words"),
        )).alias("s"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    judged = spread_join(stats, lost, ["host", "key"], ["doc_id"], "left", total=n_rows)
    n_words, removed = F.col("s.n_words"), F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    failed = (n_words < rules.min_words) | (100 * F.col("s.n_repeat_words") > rules.max_repeat_percent * n_words)
    depleted = (n_words - removed).cast("double") < n_words.cast("double") * F.lit(rules.min_left_share)
    clean = F.when(
        F.col("removed_lines").isNotNull(),
        F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("removed_lines", F.xxhash64(normalised(x)))), "\n"),
    ).otherwise(F.col("text"))
    return judged.select(
        "doc_id", n_words.alias("n_words"), F.col("s.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("s.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"), removed.alias("removed_words"), clean.alias("clean_text"), (~failed & ~depleted).alias("kept"), "row",
    )


def op2_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_quality(docs).drop("clean_text", "row")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, unnest([0, 1, 2]) AS u(o) GROUP BY doc_id),
raw AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d),
rl AS (SELECT * FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM rl GROUP BY doc_id),
nl AS (SELECT doc_id, source, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w,
  trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS l FROM rl),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
freq AS (SELECT nl.source, l, count(DISTINCT d.t) AS n FROM nl JOIN d USING (doc_id) GROUP BY nl.source, l),
bad AS (SELECT f.source, l FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 5 AND f.n > h.n * 0.005::DOUBLE),
lost AS (SELECT doc_id, sum(w)::BIGINT AS n FROM nl JOIN bad b ON nl.l = b.l AND nl.source IS NOT DISTINCT FROM b.source GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
  AND NOT ((n_words - removed_words)::DOUBLE < n_words::DOUBLE * 0.3::DOUBLE) AS kept
FROM s
"""
