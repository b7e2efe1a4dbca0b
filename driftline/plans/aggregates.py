"""Aggregations, filters, projections, orders and set operations over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import joins, medians, series, stats
from ..shared import new_path
from .registry import DAY, DAYS, EV, US, V, days, query, r, table

BY = "(PARTITION BY entity ORDER BY us)"


@query("count_by_key", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_key(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_type").agg(F.count("*").alias("n"))


@query("minmax_by_key", "SELECT event_type, min(props) AS first, max(props) AS last FROM events GROUP BY 1")
def minmax_by_key(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_type").agg(F.min("props").alias("first"), F.max("props").alias("last"))


@query("mean_median", f"{EV} SELECT entity, round(sum(round(value * 100)::BIGINT)::DOUBLE / count(*), 6) AS mean_cents, quantile_cont(value, 0.5) AS med FROM ev GROUP BY 1")
def mean_median(ev: DataFrame) -> DataFrame:
    cents = F.sum(F.round(V() * 100).cast("long")).cast("double") / F.count("*")
    return ev.groupBy("entity").agg(r(cents).alias("mean_cents"), stats.quantile(V(), 0.5).alias("med"))


@query("quantile_linear", f"{EV} SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.95), 6) AS p95 FROM ev GROUP BY 1")
def quantile_linear(ev: DataFrame) -> DataFrame:
    return stats.ranked_quantiles(ev, "value", {"q1": 0.25, "p95": 0.95}, ["event_type"]).select("event_type", r("q1").alias("q1"), r("p95").alias("p95"))


@query("quantile_exclusive", f"""{EV}, k AS (SELECT entity, event_type, us, value, row_number() OVER (PARTITION BY entity, event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY entity, event_type) AS n FROM ev),
p AS (SELECT *, least(greatest((n + 1) * 0.25::DOUBLE, 1), n) AS x, least(greatest((n + 1) * 0.75::DOUBLE, 1), n) AS z FROM k)
SELECT entity, event_type, max(n) AS n,
round(CASE WHEN max(n) < 4 THEN arg_min(value, us) ELSE sum(value * CASE WHEN k = floor(x) THEN 1 - (x - floor(x)) WHEN k = floor(x) + 1 THEN x - floor(x) ELSE 0 END) END, 6) AS q1,
round(CASE WHEN max(n) < 4 THEN arg_max(value, us) ELSE sum(value * CASE WHEN k = floor(z) THEN 1 - (z - floor(z)) WHEN k = floor(z) + 1 THEN z - floor(z) ELSE 0 END) END, 6) AS q3 FROM p GROUP BY 1, 2""")
def quantile_exclusive(ev: DataFrame) -> DataFrame:
    return series.outer_quartiles(ev, "value", ["entity", "event_type"]).select("entity", "event_type", "n", r("q1").alias("q1"), r("q3").alias("q3"))


@query("five_number_summary", f"""{EV} SELECT entity, count(*) AS n, min(value) AS lo, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS med, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS hi,
round(avg(value), 9) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM ev GROUP BY 1""")
def five_number_summary(ev: DataFrame) -> DataFrame:
    out = stats.five_numbers(ev, "value", ["entity"])
    return out.select("entity", "n", "lo", *[r(c).alias(c) for c in ("q1", "med", "q3")], "hi", r("mean", 9).alias("mean"), r("sd").alias("sd"), r("iqr").alias("iqr"))


@query("stddev_pop_vs_samp", f"{EV} SELECT entity, round(stddev_pop(value), 6) AS sd_pop, round(stddev_samp(value), 6) AS sd_samp FROM ev GROUP BY 1")
def stddev_pop_vs_samp(ev: DataFrame) -> DataFrame:
    return ev.groupBy("entity").agg(r(F.stddev_pop(V())).alias("sd_pop"), r(F.stddev_samp(V())).alias("sd_samp"))


@query("rms", f"{EV} SELECT entity, round(sqrt(avg(value * value)), 6) AS rms FROM ev GROUP BY 1")
def rms(ev: DataFrame) -> DataFrame:
    return ev.groupBy("entity").agg(r(stats.rms(V())).alias("rms"))


@query("time_bin_agg", f"""{EV}, o AS (SELECT *, floor(min(us) OVER (PARTITION BY entity) / 86400000000)::BIGINT * 86400000000 AS o, max(us) OVER (PARTITION BY entity) AS z FROM ev),
p AS (SELECT entity, value, least(floor((us - o) / 86400000000)::BIGINT, greatest(ceil((z - o) / 86400000000)::BIGINT - 1, 0)) AS b FROM o),
g AS (SELECT entity, unnest(range(0, max(b) + 1)) AS b FROM p GROUP BY entity), a AS (SELECT entity, b, sqrt(avg(value * value)) AS rms FROM p GROUP BY 1, 2)
SELECT g.entity, g.b, round(coalesce(rms, 0), 6) AS rms FROM g LEFT JOIN a ON g.entity = a.entity AND g.b = a.b""")
def time_bin_agg(ev: DataFrame) -> DataFrame:
    """From the midnight before an entity's first sample on."""
    day = DAY * series.S
    midnight = F.floor(F.min("us").over(Window.partitionBy("entity")) / day) * day
    return stats.time_bins(ev.withColumn("origin", midnight), DAY, stats.rms(V()), "rms", origin_us=F.col("origin")).select("entity", "b", r("rms").alias("rms"))


@query("bin_end_mean", f"{EV} SELECT entity, ceil(us / 86400000000)::BIGINT * 86400000000 AS end_us, round_even(avg(value), 0) AS mean FROM ev GROUP BY 1, 2")
def bin_end_mean(ev: DataFrame) -> DataFrame:
    return stats.bin_end_means(ev, DAY, V())


@query("mode_day_topk", f"{DAYS} SELECT k AS day, count(*) AS n, quantile_cont(value, 0.5) AS median_value FROM d GROUP BY 1 ORDER BY n DESC, day LIMIT 5", of=days)
def mode_day_topk(d: DataFrame) -> DataFrame:
    return stats.top_days(d, 5)


@query("distinct_count", f"{DAYS} SELECT event_type, count(DISTINCT entity) AS entities, count(DISTINCT k) AS days FROM d GROUP BY 1", of=days)
def distinct_count(d: DataFrame) -> DataFrame:
    return d.groupBy("event_type").agg(F.countDistinct("entity").alias("entities"), F.countDistinct("k").alias("days"))


@query("conditional_mean_gap", f"""{EV} SELECT entity, count(*) FILTER (event_type = 'view') AS n_high, count(*) FILTER (event_type = 'error') AS n_low,
round(CASE WHEN count(*) FILTER (event_type = 'view') >= 5 AND count(*) FILTER (event_type = 'error') >= 5 THEN avg(value) FILTER (event_type = 'view') - avg(value) FILTER (event_type = 'error') END, 9) AS separation FROM ev GROUP BY 1""")
def conditional_mean_gap(ev: DataFrame) -> DataFrame:
    out = stats.conditional_gap(ev, "value", F.col("event_type") == "view", F.col("event_type") == "error", 5, ["entity"])
    return out.select("entity", "n_high", "n_low", r("separation", 9).alias("separation"))


@query("coverage", f"{DAYS} SELECT entity, count(DISTINCT k) AS n_epochs, max(k) - min(k) + 1 AS span_epochs, round(count(DISTINCT k) / (max(k) - min(k) + 1), 6) AS contiguity FROM d GROUP BY 1", of=days)
def coverage(d: DataFrame) -> DataFrame:
    return stats.coverage(d).select("entity", "n_epochs", "span_epochs", r("contiguity").alias("contiguity"))


@query("onset_count", f"""{EV}, e AS (SELECT entity, event_type = 'error' AS x, lag(event_type = 'error') OVER {BY} AS b FROM ev)
SELECT entity, count(*) FILTER (x AND NOT b) AS onsets, count(*) FILTER (x AND (b IS NULL OR NOT b)) AS onsets_with_first FROM e GROUP BY 1""")
def onset_count(ev: DataFrame) -> DataFrame:
    x = F.col("event_type") == "error"
    marked = ev.withColumn("a", series.rising(x)).withColumn("b", series.rising(x, count_first=True))
    return marked.groupBy("entity").agg(F.count(F.when(F.col("a"), 1)).alias("onsets"), F.count(F.when(F.col("b"), 1)).alias("onsets_with_first"))


@query("run_count", f"{EV}, c AS (SELECT entity, event_type <> lag(event_type) OVER {BY} AS c FROM ev) SELECT entity, 1 + count(*) FILTER (c) AS runs FROM c GROUP BY 1")
def run_count(ev: DataFrame) -> DataFrame:
    return ev.withColumn("c", series.changed(F.col("event_type"))).groupBy("entity").agg((1 + F.count(F.when(F.col("c"), 1))).alias("runs"))


@query("within_group_spread", """o AS (SELECT o_custkey, o_totalprice AS x, abs(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey)) AS dev FROM orders)
SELECT o_custkey, count(*) AS n, round(stddev_samp(x), 4) AS sd, round((max(x) - min(x)) / 2, 4) AS half_range, round(max(dev), 7) AS max_dev FROM o GROUP BY 1 HAVING count(*) >= 2""", of=table("orders"))
def within_group_spread(o: DataFrame) -> DataFrame:
    out = stats.within_group_spread(o, "o_totalprice", "o_custkey")
    return out.select("o_custkey", "n", r("sd", 4).alias("sd"), r("half_range", 4).alias("half_range"), r("max_dev", 7).alias("max_dev"))


@query("share_by_class", f"""{EV}, f AS (SELECT entity, value > 80 AS failed, event_type IN ('error', 'purchase') AS hard FROM ev)
SELECT entity, count(*) AS n, count(*) FILTER (failed) AS fails, round(CASE WHEN count(*) FILTER (failed) > 0 THEN 100.0::DOUBLE * count(*) FILTER (failed AND hard) / count(*) FILTER (failed) END, 6) AS fail_share_pct, round(100.0::DOUBLE * count(*) FILTER (hard) / count(*), 6) AS row_share_pct FROM f GROUP BY 1""")
def share_by_class(ev: DataFrame) -> DataFrame:
    out = stats.share_by_class(ev, V() > 80, F.col("event_type").isin("error", "purchase"), ["entity"])
    return out.select("entity", "n", "fails", r("fail_share_pct").alias("fail_share_pct"), r("row_share_pct").alias("row_share_pct"))


@query("sum_and_count", f"{EV} SELECT entity, count(*) AS n, round(sum(value), 4) AS total FROM ev WHERE us BETWEEN 1704844800000000 AND 1705708800000000 GROUP BY 1")
def sum_and_count(ev: DataFrame) -> DataFrame:
    return ev.where(US().between(1_704_844_800_000_000, 1_705_708_800_000_000)).groupBy("entity").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("weighted_bincount", f"{EV} SELECT floor(value / 25)::BIGINT AS bin, count(*) AS n, round(sum(value), 3) AS total FROM ev GROUP BY 1")
def weighted_bincount(ev: DataFrame) -> DataFrame:
    return ev.groupBy(F.floor(V() / 25).alias("bin")).agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@query("histogram", f"{EV} SELECT floor(value / 10)::BIGINT AS bin, count(*) AS n FROM ev GROUP BY 1")
def histogram(ev: DataFrame) -> DataFrame:
    return stats.histogram(ev, "value", 10)


@query("prevalence", f"{EV} SELECT event_type, round(avg(CASE WHEN value < 34 THEN 1.0::DOUBLE ELSE 0 END), 9) AS below FROM ev GROUP BY 1")
def prevalence(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_type").agg(r(F.avg((V() < 34).cast("double")), 9).alias("below"))


CADENCE = f"""{EV}, g AS (SELECT entity, us, (us - lag(us) OVER {BY})::DOUBLE / 1e6 AS gap FROM ev),
c AS (SELECT entity, count(*) AS n, (max(us) - min(us))::DOUBLE / 1e6 / 60 AS span_min, quantile_cont(gap, 0.25) AS p25, quantile_cont(gap, 0.5) AS med, quantile_cont(gap, 0.75) AS p75, avg(gap) AS mean_gap FROM g GROUP BY 1)"""


def _cadence(ev: DataFrame) -> DataFrame:
    c = stats.cadence(ev)
    return c.select("entity", "n", r("span_min", 5).alias("span_min"), r("per_min", 9).alias("per_min"), *[r(f"{q}_gap_s", 9).alias(f"{q}_gap_s") for q in ("p25", "median", "p75")], r("mean_gap_s", 5).alias("mean_gap_s"))


CADENCE_OUT = "SELECT entity, n, round(span_min, 5) AS span_min, round(CASE WHEN n >= 2 AND span_min > 0 THEN n / span_min ELSE 0 END, 9) AS per_min, round(p25, 9) AS p25_gap_s, round(med, 9) AS median_gap_s, round(p75, 9) AS p75_gap_s, round(mean_gap, 5) AS mean_gap_s FROM c"


@query("cadence", f"{CADENCE} {CADENCE_OUT}")
def cadence(ev: DataFrame) -> DataFrame:
    return _cadence(ev)


KINDS = ("click", "error", "purchase", "signup", "view")


@query("corpus_inventory", f"""{CADENCE}, e AS (SELECT *, event_type = 'error' AND lag(event_type) OVER {BY} <> 'error' AS onset FROM ev),
s AS (SELECT entity, {", ".join(f"count(*) FILTER (event_type = '{x}') AS n_{x}" for x in KINDS)}, count(*) FILTER (onset) AS n_onsets, (min(us) - 1704067200000000)::DOUBLE / 1e6 AS off FROM e GROUP BY 1),
t AS (SELECT entity, n, CASE WHEN n >= 2 AND span_min > 0 THEN n / span_min ELSE 0 END AS per_min, med, {", ".join(f"n_{x}" for x in KINDS)}, n_onsets, off FROM c JOIN s USING (entity))
SELECT entity::VARCHAR AS entity, n, round(per_min, 9) AS per_min, round(med, 6) AS median_gap_s, {", ".join(f"n_{x}" for x in KINDS)}, n_onsets, round(off, 5) AS origin_offset_s FROM t
UNION ALL SELECT 'POOLED', sum(n)::BIGINT, round(avg(per_min), 9), round(quantile_cont(med, 0.5), 6), {", ".join(f"sum(n_{x})::BIGINT" for x in KINDS)}, sum(n_onsets)::BIGINT, round(quantile_cont(off, 0.5), 5) FROM t""")
def corpus_inventory(ev: DataFrame) -> DataFrame:
    """Cadence, stages, onsets and offset of each entity, and a row of all."""
    kinds = [F.count(F.when(F.col("event_type") == x, 1)).alias(f"n_{x}") for x in KINDS]
    marked = ev.withColumn("onset", series.rising(F.col("event_type") == "error"))
    counts = marked.groupBy("entity").agg(*kinds, F.count(F.when(F.col("onset"), 1)).alias("n_onsets"), ((F.min("us") - 1_704_067_200_000_000).cast("double") / 1e6).alias("off"))
    each = stats.cadence(ev).join(counts, "entity").select(F.col("entity").cast("string").alias("entity"), "n", "per_min", "median_gap_s", *[f"n_{x}" for x in KINDS], "n_onsets", "off")
    totals = [F.sum(c).alias(c) for c in (*[f"n_{x}" for x in KINDS], "n_onsets")]
    pooled = each.agg(F.lit("POOLED").alias("entity"), F.sum("n").alias("n"), F.avg("per_min").alias("per_min"), F.percentile("median_gap_s", F.lit(0.5)).alias("median_gap_s"), *totals, F.percentile("off", F.lit(0.5)).alias("off"))
    return each.unionByName(pooled).select("entity", "n", r("per_min", 9).alias("per_min"), r("median_gap_s").alias("median_gap_s"), *[f"n_{x}" for x in KINDS], "n_onsets", r("off", 5).alias("origin_offset_s"))


MEASURES = {"per_min": 9, "median_gap_s": 6, "offset_s": 5}


@query("inventory_distributions", f"""{CADENCE}, o AS (SELECT entity, (min(us) - 1704067200000000)::DOUBLE / 1e6 AS off FROM ev GROUP BY 1), t AS (SELECT CASE WHEN n >= 2 AND span_min > 0 THEN n / span_min ELSE 0 END AS per_min, med, off FROM c JOIN o USING (entity)),
""" + " UNION ALL ".join(f"SELECT '{m}' AS measure, count({x}) AS n, " + ", ".join(f"round({q}, {d}) AS {a}" for a, q in (("least", f"min({x})"), ("p25", f"quantile_cont({x}, 0.25)"), ("median", f"quantile_cont({x}, 0.5)"), ("p75", f"quantile_cont({x}, 0.75)"), ("most", f"max({x})"), ("mean", f"avg({x})"), ("abs_median", f"quantile_cont(abs({x}), 0.5)"))) + " FROM t" for (m, d), x in zip(MEASURES.items(), ("per_min", "med", "off"), strict=True)).join(["z AS (", ") SELECT * FROM z"]))
def inventory_distributions(ev: DataFrame) -> DataFrame:
    """How rates, median gaps and offsets are distributed over the entities."""
    each = stats.cadence(ev).join(ev.groupBy("entity").agg(((F.min("us") - 1_704_067_200_000_000).cast("double") / 1e6).alias("offset_s")), "entity")
    found = stats.distributions(each, list(MEASURES))
    digits = F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair])[F.col("measure")]
    return found.select("measure", "n", *[F.coalesce(*[F.when(digits == d, r(c, d)) for d in sorted(set(MEASURES.values()))]).alias(c) for c in found.columns[2:]])


@query("per_source_distribution", f"{EV}, x AS (SELECT event_type, floor(value * 10) AS d FROM ev) SELECT event_type, quantile_cont(d, 0.5) AS med, round(quantile_cont(d, 0.95), 6) AS p95 FROM x GROUP BY 1")
def per_source_distribution(ev: DataFrame) -> DataFrame:
    d = ev.select("event_type", F.floor(V() * 10).alias("d"))
    return stats.ranked_quantiles(d, "d", {"med": 0.5, "p95": 0.95}, ["event_type"]).select("event_type", "med", r("p95").alias("p95"))


@query("origin_offset", f"{EV} SELECT entity, round((min(us) - 1704067200000000)::DOUBLE / 1e6, 6) AS offset_s FROM ev GROUP BY 1")
def origin_offset(ev: DataFrame) -> DataFrame:
    return ev.groupBy("entity").agg(r((F.min("us") - 1_704_067_200_000_000).cast("double") / 1e6).alias("offset_s"))


@query("fold_spread", f"{EV}, f AS (SELECT entity, entity % 5 AS fold, avg(value) AS m FROM ev GROUP BY 1, 2) SELECT fold, count(m) AS folds, round(avg(m), 6) AS mean, round(min(m), 9) AS least, round(quantile_cont(m, 0.5), 6) AS median, round(max(m), 9) AS most FROM f GROUP BY 1")
def fold_spread(ev: DataFrame) -> DataFrame:
    from ..operators.evaluate import fold_spread as spread

    f = ev.groupBy("entity", (F.col("entity") % 5).alias("fold")).agg(F.avg("value").alias("m"))
    return spread(f, "m", ["fold"]).select("fold", "folds", r("mean").alias("mean"), r("least", 9).alias("least"), r("median").alias("median"), r("most", 9).alias("most"))


@query("pooled_rollup", f"{EV} SELECT coalesce(event_type, 'POOLED') AS event_type, count(*) AS n, round(max(value), 6) AS hi FROM ev GROUP BY ROLLUP (event_type)")
def pooled_rollup(ev: DataFrame) -> DataFrame:
    return ev.rollup("event_type").agg(F.count("*").alias("n"), r(F.max("value")).alias("hi")).select(F.coalesce("event_type", F.lit("POOLED")).alias("event_type"), "n", "hi")


# projections and filters


@query("to_relative_minutes", f"{EV} SELECT event_id, round((us - min(us) OVER (PARTITION BY entity))::DOUBLE / 1e6 / 60, 9) AS minutes FROM ev")
def to_relative_minutes(ev: DataFrame) -> DataFrame:
    since = (US() - F.min("us").over(Window.partitionBy("entity"))).cast("double") / 1e6
    return ev.select("event_id", r(scalar.relative_minutes(since, F.lit(0)), 9).alias("minutes"))


@query("vector_magnitude", "SELECT vec_id, round(sqrt(embedding[1]::DOUBLE * embedding[1] + embedding[2]::DOUBLE * embedding[2] + embedding[3]::DOUBLE * embedding[3]), 6) AS magnitude FROM embeddings", of=table("embeddings"))
def vector_magnitude(e: DataFrame) -> DataFrame:
    return e.select("vec_id", r(scalar.magnitude(*[F.get("embedding", F.lit(k)).cast("double") for k in range(3)])).alias("magnitude"))


@query("gravity_removed", f"{EV} SELECT event_id, round(value - quantile_cont(value, 0.5) OVER (PARTITION BY entity ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING), 6) AS rest FROM ev")
def gravity_removed(ev: DataFrame) -> DataFrame:
    day = DAY * series.S
    found = medians.sliding_median(ev.select("event_id", "entity", "us", "value"), "gravity", day, day)
    return found.select("event_id", r(V() - F.col("gravity")).alias("rest"))


@query("wrist_orientation", "SELECT vec_id, CASE WHEN embedding[1] < -0.1::FLOAT THEN 'down' ELSE 'up' END AS wrist FROM embeddings", of=table("embeddings"))
def wrist_orientation(e: DataFrame) -> DataFrame:
    return e.select("vec_id", scalar.wrist(F.get("embedding", F.lit(0)), F.lit(-0.1).cast("float")).alias("wrist"))


@query("instantaneous_rate", f"{EV} SELECT event_id, round(60000 / (value * 10), 6) AS rate FROM ev")
def instantaneous_rate(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", r(scalar.rate_of(V() * 10)).alias("rate"))


@query("epoch_index", f"{EV} SELECT event_id, floor((t - 1705000000.5::DOUBLE) / 3600)::BIGINT - 2 AS k FROM ev")
def epoch_index(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", scalar.epoch_index(F.col("t"), F.lit(1_705_000_000.5), 3600, 2).alias("k"))


@query("clip", f"{EV} SELECT event_id, least(greatest(value, 5), 150) AS clipped FROM ev")
def clip(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", scalar.clip(V(), 5.0, 150.0).alias("clipped"))


@query("prefix_strip", "SELECT o_orderkey, regexp_replace(o_orderpriority, '^(1-|2-|3-|4-|5-)', '') AS priority FROM orders", of=table("orders"))
def prefix_strip(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", scalar.prefix_strip(F.col("o_orderpriority"), "1-", "2-", "3-", "4-", "5-").alias("priority"))


@query("cohort_from_id", f"{EV} SELECT event_id, regexp_replace(event_type || entity, '[0-9]+$', '') AS cohort FROM ev")
def cohort_from_id(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", scalar.cohort(F.concat("event_type", F.col("entity").cast("string"))).alias("cohort"))


@query("stage_recode", f"{EV} SELECT event_id, CASE event_type WHEN 'error' THEN 'deep' WHEN 'view' THEN 'wake' ELSE event_type END AS stage, CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 0 ELSE 5 END::INT AS code FROM ev")
def stage_recode(ev: DataFrame) -> DataFrame:
    code = scalar.recode(F.col("event_type"), {"error": "3", "view": "0"}, F.lit("5")).cast("int")
    return ev.select("event_id", scalar.recode(F.col("event_type"), {"error": "deep", "view": "wake"}).alias("stage"), code.alias("code"))


@query("calibrate", f"{EV} SELECT event_id, round((value - 0) * ((1 - -1) / (500 - 0)::DOUBLE) + -1, 6) AS physical FROM ev")
def calibrate(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", r(scalar.calibrate(V(), F.lit(0.0), F.lit(500.0), F.lit(-1.0), F.lit(1.0))).alias("physical"))


DURATIONS = f"{EV}, x AS (SELECT event_id, value * 97 AS s FROM ev) SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.2fh', s / 3600) END AS text FROM x"


@query("fmt_duration_all", DURATIONS)
@query("fmt_duration", DURATIONS)
def fmt_duration(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", scalar.duration_text(V() * 97).alias("text"))


@query("nearest_clean_zone", f"""{EV}, z AS (SELECT unnest(list_concat(range(-720, 841, 60), [-570, -210, 210, 330, 570, 630, 345, 765])) AS m, unnest(range(0, 35)) AS i),
x AS (SELECT event_id, value * 200 - 40000 AS o FROM ev), p AS (SELECT event_id, m, o - 60 * m AS res, row_number() OVER (PARTITION BY event_id ORDER BY abs(o - 60 * m), i) AS k FROM x, z)
SELECT event_id, m::INT AS minutes, round(res, 6) AS residual_s FROM p WHERE k = 1""")
def nearest_clean_zone(ev: DataFrame) -> DataFrame:
    z = scalar.nearest_zone(V() * 200 - 40_000)
    return ev.select("event_id", z.minutes.alias("minutes"), r(z.residual_s).alias("residual_s"))


@query("densify_epochs", f"""{DAYS}, e AS (SELECT entity, round_even((k - min(k) OVER (PARTITION BY entity))::DOUBLE, 0)::BIGINT AS k, event_type FROM d), a AS (SELECT entity, k, min(CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 0 ELSE 1 END) AS stage FROM e GROUP BY 1, 2),
g AS (SELECT entity, unnest(range(0, max(k) + 1)) AS k FROM e GROUP BY 1) SELECT g.entity, g.k, coalesce(stage, 5)::INT AS stage FROM g LEFT JOIN a ON g.entity = a.entity AND g.k = a.k""", of=days)
def densify_epochs(d: DataFrame) -> DataFrame:
    from ..sources.text import dense_epochs

    code = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "view", 0).otherwise(1)
    marked = d.select(F.col("entity").alias("file"), (F.col("k") * DAY).cast("double").alias("t"), code.alias("stage"))
    return dense_epochs(marked, DAY, F.lit(1e18)).select(F.col("file").alias("entity"), "k", "stage")


@query("source_filter", "SELECT event_id FROM events WHERE lower(event_type || chr(160) || 'Robin') LIKE '%error' || chr(160) || 'robin%'")
def source_filter(ev: DataFrame) -> DataFrame:
    return ev.where(scalar.source_matches(F.concat("event_type", F.lit(" Robin")), "Error Robin")).select("event_id")


@query("watch_filter", "SELECT event_id FROM events WHERE props LIKE '%\"k\": 6%'")
def watch_filter(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("props").contains('"k": 6')).select("event_id")


@query("cutoff_filter", f"{EV} SELECT event_id FROM ev WHERE us + floor(value * 10)::BIGINT * 60000000 >= 1705708800000000")
def cutoff_filter(ev: DataFrame) -> DataFrame:
    return ev.where(US() + F.floor(V() * 10) * 60_000_000 >= 1_705_708_800_000_000).select("event_id")


@query("drop_unknown", "SELECT event_id FROM events WHERE event_type <> 'signup'")
def drop_unknown(ev: DataFrame) -> DataFrame:
    return ev.where("event_type <> 'signup'").select("event_id")


@query("in_window", f"{EV}, k AS (SELECT event_id, floor((us - 1704844800000000) / 86400000000)::BIGINT AS k FROM ev) SELECT event_id, k FROM k WHERE k >= 0 AND k < 10")
def in_window(ev: DataFrame) -> DataFrame:
    return ev.withColumn("k", F.floor((US() - 1_704_844_800_000_000) / 86_400_000_000)).where("k >= 0 AND k < 10").select("event_id", "k")


@query("record_exclusion", f"{EV}, x AS (SELECT entity, avg(CASE WHEN value > 60 THEN 1.0::DOUBLE ELSE 0 END) AS removed FROM ev GROUP BY 1) SELECT entity, round(removed, 9) AS removed FROM x WHERE removed <= 0.2::DOUBLE AND entity NOT IN (3, 7)")
def record_exclusion(ev: DataFrame) -> DataFrame:
    removed = ev.groupBy("entity").agg(F.avg((V() > 60).cast("double")).alias("removed"))
    return removed.where((F.col("removed") <= 0.2) & ~F.col("entity").isin(3, 7)).select("entity", r("removed", 9).alias("removed"))


@query("scorable", f"{EV}, x AS (SELECT entity, min(us) AS start_us, min(us) FILTER (event_type = 'error') AS event_us FROM ev GROUP BY 1) SELECT entity FROM x WHERE event_us IS NULL OR event_us - start_us >= 86400000000")
def scorable(ev: DataFrame) -> DataFrame:
    from ..operators.evaluate import scorable as keep

    return keep(ev.groupBy("entity").agg(F.min("us").alias("start_us"), F.min(F.when(F.col("event_type") == "error", US())).alias("event_us")), DAY).select("entity")


@query("min_group_size", f"{EV} SELECT entity, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) >= 70")
def min_group_size(ev: DataFrame) -> DataFrame:
    return ev.groupBy("entity").agg(F.count("*").alias("n")).where("n >= 70")


@query("device_match", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%' OR o_orderstatus = '1-'", of=table("orders"))
def device_match(o: DataFrame) -> DataFrame:
    return o.where(scalar.is_device(F.col("o_orderpriority"), F.col("o_orderstatus"), "1-")).select("o_orderkey")


# orders and sets


@query("sort_desc_by_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def sort_desc_by_count(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("top_k", "SELECT user_id AS entity, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, entity LIMIT 15")
def top_k(ev: DataFrame) -> DataFrame:
    return ev.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(15)


@query("most_recent_n", f"{EV} SELECT event_id, us FROM ev WHERE value > 100 ORDER BY us DESC, event_id LIMIT 8")
def most_recent_n(ev: DataFrame) -> DataFrame:
    return ev.where("value > 100").orderBy(F.desc("us"), "event_id").limit(8).select("event_id", "us")


RESOLVED = f"""{EV}, n AS (SELECT entity, event_type, us, row_number() OVER (PARTITION BY entity ORDER BY us DESC) AS k FROM ev), s AS (SELECT entity, arg_min(event_type, k) AS source FROM n WHERE k <= 20 AND event_type IN ('purchase', 'view') GROUP BY 1)"""


def _resolved(ev: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity").orderBy(F.desc("us"))
    newest = ev.withColumn("k", F.row_number().over(w)).where((F.col("k") <= 20) & F.col("event_type").isin("purchase", "view"))
    return newest.groupBy("entity").agg(F.min_by("event_type", "k").alias("source"))


@query("newest_first_match", f"{RESOLVED} SELECT entity, source FROM s")
def newest_first_match(ev: DataFrame) -> DataFrame:
    return _resolved(ev)


@query("source_resolution", f"{RESOLVED} SELECT event_id FROM ev LEFT JOIN s USING (entity) WHERE source IS NULL OR event_type = source")
def source_resolution(ev: DataFrame) -> DataFrame:
    return ev.join(_resolved(ev), "entity", "left").where("source IS NULL OR event_type = source").select("event_id")


@query("natural_sort", "SELECT entity, row_number() OVER (ORDER BY try_cast(entity AS INT), entity) AS place FROM (SELECT DISTINCT user_id::VARCHAR AS entity FROM events)")
def natural_sort(ev: DataFrame) -> DataFrame:
    # ranges are numbered each in its own task, from where the ones before end
    path = new_path(ev.sparkSession, "ranges")
    ids = ev.select(F.col("entity").cast("string").alias("entity")).distinct().withColumn("number", F.col("entity").try_cast("int"))
    ids.repartitionByRange("number", "entity").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranges = ev.sparkSession.read.schema("entity STRING, number INT, part INT").parquet(path)
    before, starts = 0, []
    for row in sorted(ranges.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts.append((row["part"], before))
        before += row["n"]
    placed = ranges.join(F.broadcast(ev.sparkSession.createDataFrame(starts, "part int, before long")), "part")
    place = F.row_number().over(Window.partitionBy("part").orderBy("number", "entity")) + F.col("before")
    return placed.select("entity", place.alias("place"))


@query("first_cross", f"{EV} SELECT entity, min(us) FILTER (value >= 120) AS cross_us FROM ev GROUP BY 1")
def first_cross(ev: DataFrame) -> DataFrame:
    return series.first_true(ev, V() >= 120, "cross_us")


@query("pooled_concat", "SELECT event_id AS id, value FROM events UNION ALL SELECT o_orderkey, o_totalprice FROM orders", of=lambda s, d: (s.read.parquet(f"{d}/events.parquet"), s.read.parquet(f"{d}/orders.parquet")))
def pooled_concat(two: tuple) -> DataFrame:
    return two[0].select(F.col("event_id").alias("id"), "value").unionByName(two[1].select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")))


@query("set_difference", "SELECT user_id AS entity FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE value > 150")
def set_difference(ev: DataFrame) -> DataFrame:
    return ev.where("event_type = 'view'").select("entity").subtract(ev.where("value > 150").select("entity"))


@query("label_set_union", "SELECT event_id FROM events WHERE event_type IN ('view', 'click', 'signup')")
def label_set_union(ev: DataFrame) -> DataFrame:
    strict = ("view", "click")
    return ev.where(F.col("event_type").isin(*strict, "signup")).select("event_id")


@query("distinct_sorted", "SELECT user_id AS entity, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def distinct_sorted(ev: DataFrame) -> DataFrame:
    return ev.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("param_grid", f"""{EV}, g AS (SELECT m, d FROM (VALUES (0), (20), (40), (60)) AS a(m), (VALUES (0), (5), (10)) AS b(d)) SELECT m, d, count(*) FILTER (value < m - d) AS below FROM ev, g GROUP BY 1, 2""")
def param_grid(ev: DataFrame) -> DataFrame:
    cells = [(m, d) for m in (0, 20, 40, 60) for d in (0, 5, 10)]
    row = ev.agg(F.count("*").alias("n"), *[F.count(F.when(V() < m - d, 1)).alias(f"c{k}") for k, (m, d) in enumerate(cells)])
    found = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.col(f"c{k}").alias("below")) for k, (m, d) in enumerate(cells)])
    return row.where("n > 0").select(F.explode(found).alias("c")).select("c.*")


@query("parabolic_peak", f"""{EV}, p AS (SELECT event_id, lag(value) OVER {BY} AS a, value AS b, lead(value) OVER {BY} AS c FROM ev)
SELECT event_id, round(CASE WHEN a - 2 * b + c = 0 THEN 0 ELSE least(greatest((a - c) / (2 * (a - 2 * b + c)), -0.5), 0.5) END, 6) AS shift FROM p WHERE b > a AND b > c""")
def parabolic_peak(ev: DataFrame) -> DataFrame:
    from ..operators.beats import parabolic_peak as peak

    w = series.along()
    near = ev.select("event_id", F.lag("value").over(w).alias("a"), V().alias("b"), F.lead("value").over(w).alias("c")).where("b > a AND b > c")
    return near.select("event_id", r(peak(F.col("a"), F.col("b"), F.col("c"))).alias("shift"))


@query("json_field", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_field(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("content_hash", "SELECT event_id, sha256(props) AS sha FROM events")
def content_hash(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", F.sha2("props", 256).alias("sha"))


@query("local_night", "SELECT event_id, strftime(ts - INTERVAL 12 HOUR, '%Y-%m-%d') AS night FROM events", of=table("events"))
def local_night(ev: DataFrame) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" -0800"))
    return ev.select("event_id", F.date_format(scalar.night_of(text), "yyyy-MM-dd").alias("night"))


@query("date_format", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS text FROM events", of=table("events"))
def date_format(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("text"))
