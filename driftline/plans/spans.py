"""Interval operators, lookups and alignment over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, compare, intervals, joins, medians, series, stats
from ..params import AlignmentRules, DensityGate
from .registry import DAY, DAYS, EV, IV, US, as_intervals, days, query, r
from .registry import intervals as iv_of

BY = "(PARTITION BY entity ORDER BY us)"
JOINED = f"""{IV}, m AS (SELECT *, max(end_us) OVER (PARTITION BY entity ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM iv),
n AS (SELECT *, CASE WHEN reached IS NULL OR start_us - reached > {{gap}} THEN 1 ELSE 0 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY start_us, end_us) AS island FROM n)"""


@query("interval_union", JOINED.format(gap=0) + """, u AS (SELECT entity, island, min(start_us) AS a, max(end_us) AS b FROM s GROUP BY ALL)
SELECT entity, round(sum(b - a)::DOUBLE / 1e6 / 60, 6) AS minutes FROM u GROUP BY entity""", of=iv_of)
def interval_union(iv: DataFrame) -> DataFrame:
    return intervals.union_minutes(iv, ["entity"]).select("entity", r("minutes").alias("minutes"))


@query("merge_by_tolerance", f"""{IV}, m AS (SELECT *, max(end_us) OVER (PARTITION BY entity, label ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM iv),
n AS (SELECT *, CASE WHEN reached IS NULL OR start_us - reached > 3600000000 THEN 1 ELSE 0 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY entity, label ORDER BY start_us, end_us) AS island FROM n)
SELECT entity, label, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM s GROUP BY entity, label, island""", of=iv_of)
def merge_by_tolerance(iv: DataFrame) -> DataFrame:
    return intervals.merged(iv, ["entity", "label"], 3600)


@query("merge_in_order", f"""{IV}, n AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY entity ORDER BY start_us, end_us) AND start_us - lag(end_us) OVER (PARTITION BY entity ORDER BY start_us, end_us) <= 3600000000 THEN 0 ELSE 1 END AS new FROM iv),
s AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY start_us, end_us) AS run FROM n) SELECT entity, label, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM s GROUP BY entity, run, label""", of=iv_of)
def merge_in_order(iv: DataFrame) -> DataFrame:
    return intervals.merged_in_order(iv, "label", 3600)


@query("sessionize", JOINED.format(gap=3_600_000_000) + " SELECT entity, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM s GROUP BY entity, island", of=iv_of)
def sessionize(iv: DataFrame) -> DataFrame:
    return intervals.merged(iv, ["entity"], 3600)


LABELS = ["click", "error", "purchase", "signup", "view"]
SUMMARY = JOINED.format(gap=3_600_000_000) + """, base AS (SELECT entity, island AS session, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS records, string_agg(DISTINCT label, ',' ORDER BY label) AS sources FROM s GROUP BY ALL),
lm AS (SELECT *, max(end_us) OVER (PARTITION BY entity, island, label ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lr FROM s),
li AS (SELECT *, sum(CASE WHEN lr IS NULL OR start_us > lr THEN 1 ELSE 0 END) OVER (PARTITION BY entity, island, label ORDER BY start_us, end_us) AS part FROM lm),
lu AS (SELECT entity, island, label, part, (max(end_us) - min(start_us))::DOUBLE / 60e6 AS m FROM li GROUP BY ALL),
pv AS (SELECT entity, island AS session, """ + ", ".join(f"coalesce(sum(m) FILTER (label = '{x}'), 0) AS {x}_min" for x in LABELS) + """ FROM lu GROUP BY ALL),
am AS (SELECT *, max(end_us) OVER (PARTITION BY entity, island ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lr FROM s WHERE label IN ('view', 'click')),
ai AS (SELECT *, sum(CASE WHEN lr IS NULL OR start_us > lr THEN 1 ELSE 0 END) OVER (PARTITION BY entity, island ORDER BY start_us, end_us) AS part FROM am),
au AS (SELECT entity, island, part, (max(end_us) - min(start_us))::DOUBLE / 60e6 AS m FROM ai GROUP BY ALL), asl AS (SELECT entity, island AS session, sum(m) AS asleep_min FROM au GROUP BY ALL)
SELECT entity, session::BIGINT AS session, records, sources, """ + ", ".join(f"round({x}_min, 5) AS {x}_min" for x in LABELS) + """, round(coalesce(asleep_min, 0), 5) AS asleep_min,
round(CASE WHEN end_us > start_us THEN 100 * coalesce(asleep_min, 0) / ((end_us - start_us)::DOUBLE / 60e6) END, 5) AS efficiency_pct FROM base JOIN pv USING (entity, session) LEFT JOIN asl USING (entity, session)"""


def _summary(iv: DataFrame) -> DataFrame:
    out = intervals.session_summary(iv.withColumn("source", F.col("label")), LABELS, ["view", "click"], 3600)
    return out.select("entity", "session", "records", "sources", *[r(f"{x}_min", 5).alias(f"{x}_min") for x in [*LABELS, "asleep"]], r("efficiency_pct", 5).alias("efficiency_pct"))


@query("session_summary", SUMMARY, of=iv_of)
def session_summary(iv: DataFrame) -> DataFrame:
    return _summary(iv)


@query("sleep_sessions", SUMMARY.replace("SELECT entity, session::BIGINT", "SELECT * FROM (SELECT entity, session::BIGINT", 1) + ") WHERE records >= 2", of=iv_of)
def sleep_sessions(iv: DataFrame) -> DataFrame:
    return _summary(iv).where("records >= 2")


@query("interval_clip", f"""{IV}, w AS (SELECT *, 1704844800000000 AS a, 1705708800000000 AS b FROM iv), c AS (SELECT *, end_us <= a OR start_us >= b AS outside FROM w)
SELECT event_id, outside, CASE WHEN NOT outside THEN greatest(start_us, a) END AS clip_start_us, CASE WHEN NOT outside THEN least(end_us, b) END AS clip_end_us FROM c""", of=iv_of)
def interval_clip(iv: DataFrame) -> DataFrame:
    a, b = F.lit(1_704_844_800_000_000), F.lit(1_705_708_800_000_000)
    return intervals.clipped(iv, a, b).select("event_id", "outside", "clip_start_us", "clip_end_us")


@query("interval_clip_stats", f"""{IV}, w AS (SELECT *, 1704844800000000 AS a, 1705708800000000 AS b FROM iv), c AS (SELECT *, end_us <= a OR start_us >= b AS outside FROM w)
SELECT entity, count(*) FILTER (NOT outside) AS kept, coalesce(sum(greatest(a - start_us, 0)) FILTER (NOT outside), 0)::BIGINT AS before_us, coalesce(sum(greatest(end_us - b, 0)) FILTER (NOT outside), 0)::BIGINT AS after_us, count(*) FILTER (outside) AS outside FROM c GROUP BY 1""", of=iv_of)
def interval_clip_stats(iv: DataFrame) -> DataFrame:
    return intervals.clip_statistics(iv, F.lit(1_704_844_800_000_000), F.lit(1_705_708_800_000_000), ["entity"])


PAIRS = f"""{IV}, l AS (SELECT * FROM iv WHERE label = 'error'), q AS (SELECT * FROM iv WHERE label = 'view'),
p AS (SELECT l.event_id AS l_id, q.event_id AS r_id, l.entity, least(l.end_us, q.end_us) - greatest(l.start_us, q.start_us) AS overlap_us FROM l JOIN q ON l.entity = q.entity AND l.start_us < q.end_us AND q.start_us < l.end_us)"""


def _two(iv: DataFrame) -> tuple[DataFrame, DataFrame]:
    return iv.where("label = 'error'"), iv.where("label = 'view'")


@query("overlap_pairs", f"{PAIRS} SELECT l_id, r_id, overlap_us FROM p WHERE overlap_us > 0", of=iv_of)
def overlap_pairs(iv: DataFrame) -> DataFrame:
    return intervals.overlaps(*_two(iv)).select(F.col("l_event_id").alias("l_id"), F.col("r_event_id").alias("r_id"), "overlap_us")


@query("best_overlap_match", f"""{PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY overlap_us DESC, r_id) AS k FROM p WHERE overlap_us > 0) SELECT l_id, r_id, overlap_us FROM k WHERE k = 1""", of=iv_of)
def best_overlap_match(iv: DataFrame) -> DataFrame:
    return intervals.best_overlap(*_two(iv), "event_id", "event_id").select(F.col("l_event_id").alias("l_id"), F.col("r_event_id").alias("r_id"), "overlap_us")


@query("nearest_session", f"""{IV}, l AS (SELECT * FROM iv WHERE label = 'error'), q AS (SELECT * FROM iv WHERE label = 'view'),
p AS (SELECT l.event_id AS l_id, q.event_id AS r_id, greatest(0, l.start_us - q.end_us, q.start_us - l.end_us) AS gap_us, q.start_us > l.start_us AS later, q.start_us, q.end_us FROM l JOIN q USING (entity)),
k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY gap_us, later, CASE WHEN NOT later THEN -end_us END, start_us, r_id) AS k FROM p) SELECT l_id, r_id, gap_us FROM k WHERE k = 1""", of=iv_of)
def nearest_session(iv: DataFrame) -> DataFrame:
    a, b = _two(iv)
    return intervals.nearest_by_gap(a.withColumnRenamed("event_id", "l_id"), b.withColumnRenamed("event_id", "r_id"), "l_id", "r_id")


COMPARE = f"""{IV}, nap AS (SELECT * FROM iv WHERE label = 'error'), o AS (SELECT *, max(end_us) OVER (PARTITION BY entity ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM iv WHERE label <> 'error'),
st AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_us - reached > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY start_us, end_us) AS session FROM o),
se AS (SELECT entity, session, min(start_us) AS s, max(end_us) AS e FROM st GROUP BY 1, 2),
p AS (SELECT nap.event_id, nap.entity, nap.start_us AS a, nap.end_us AS b, session, s, greatest(0, least(nap.end_us, e) - greatest(nap.start_us, s)) AS overlap_us, greatest(0, nap.start_us - e, s - nap.end_us) AS gap_us FROM nap JOIN se USING (entity)),
g AS (SELECT event_id, min(gap_us) AS gap_us FROM p GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap_us DESC, s) AS k FROM p WHERE overlap_us > 0), m AS (SELECT * FROM k WHERE k = 1),
c AS (SELECT m.event_id, a, b, st.start_us, st.end_us, st.end_us <= a OR st.start_us >= b AS outside FROM m JOIN st USING (entity, session)),
z AS (SELECT event_id, count(*) FILTER (NOT outside) AS kept, coalesce(sum(greatest(a - start_us, 0)) FILTER (NOT outside), 0)::BIGINT AS before_us, coalesce(sum(greatest(end_us - b, 0)) FILTER (NOT outside), 0)::BIGINT AS after_us, count(*) FILTER (outside) AS outside FROM c GROUP BY 1),
h AS (SELECT nap.event_id, count(ev.us) AS samples, quantile_cont(ev.value, 0.5) AS med FROM nap LEFT JOIN ev ON ev.entity = nap.entity AND ev.us BETWEEN nap.start_us AND nap.end_us GROUP BY 1)
SELECT nap.event_id, m.s AS session_us, m.overlap_us, g.gap_us, kept, before_us, after_us, outside, samples, round(med, 6) AS median_value FROM nap LEFT JOIN m USING (event_id) LEFT JOIN g USING (event_id) LEFT JOIN z USING (event_id) LEFT JOIN h USING (event_id)"""


@query("session_compare", COMPARE)
def session_compare(ev: DataFrame) -> DataFrame:
    """Each nap with the session that it shares the most with, or how far the
    nearest one is; that session's stages cut to the nap; and the nap's samples."""
    iv = as_intervals(ev)
    naps = iv.where("label = 'error'").select("event_id", "entity", "start_us", "end_us")
    stages = intervals.islands(iv.where("label <> 'error'").select("entity", "start_us", "end_us"), ["entity"], 3600).withColumnRenamed("island", "session")
    sessions = stages.groupBy("entity", "session").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    best = intervals.best_overlap(naps, sessions, "event_id", "start_us", width_s=7 * DAY)
    matched = best.select(F.col("l_event_id").alias("event_id"), F.col("l_entity").alias("entity"), F.col("l_start_us").alias("a"), F.col("l_end_us").alias("b"), F.col("r_session").alias("session"), F.col("r_start_us").alias("session_us"), "overlap_us")
    gaps = intervals.nearest_by_gap(naps, sessions, "event_id", "session").select("event_id", "gap_us")
    cuts = intervals.clip_statistics(stages.join(matched, ["entity", "session"]), F.col("a"), F.col("b"), ["event_id"])
    series_of = intervals.in_intervals(ev.select("entity", "us", "value"), naps, width_s=7 * DAY).groupBy("event_id").agg(F.count("*").alias("samples"), r(F.percentile("value", F.lit(0.5))).alias("median_value"))
    out = naps.select("event_id").join(matched.drop("entity", "a", "b", "session"), "event_id", "left").join(gaps, "event_id", "left").join(cuts, "event_id", "left").join(series_of, "event_id", "left")
    return out.withColumn("samples", F.coalesce("samples", F.lit(0).cast("long")))


NAP_SERIES = COMPARE[: COMPARE.index(",\nc AS (")] + """,
x AS (SELECT m.event_id, a, e.us, e.value, e.event_type FROM m JOIN ev e ON e.entity = m.entity AND e.us BETWEEN a AND b WHERE e.value IS NOT NULL),
rt AS (SELECT event_id, us - a AS off, value, quantile_cont(value, 0.5) OVER w AS med, stddev_pop(value) OVER w AS sd FROM x WHERE event_type <> 'click' WINDOW w AS (PARTITION BY event_id ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND 21600000000 FOLLOWING)),
gm AS (SELECT event_id, a, us, value - quantile_cont(value, 0.5) OVER (PARTITION BY event_id ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND 21600000000 FOLLOWING) AS rest, ceil((max(us) OVER (PARTITION BY event_id) - a) / 3600000000)::BIGINT AS bins FROM x WHERE event_type = 'click'),
f AS (SELECT event_id, least((us - a) // 3600000000, bins - 1) AS b, sqrt(avg(rest * rest)) AS rms FROM gm WHERE bins > 0 GROUP BY 1, 2),
al_b AS (SELECT DISTINCT event_id, unnest(range(bins)) AS b FROM gm WHERE bins > 0)
SELECT event_id, 'rate' AS kind, round(off::DOUBLE / 6e7, 6) AS at_min, value, round(med, 6) AS median, round(sd, 6) AS sd FROM rt
UNION ALL SELECT event_id, 'motion', round((b + 0.5) * 60, 6), round(coalesce(rms, 0), 6), NULL, NULL FROM al_b LEFT JOIN f USING (event_id, b)"""


@query("session_series", NAP_SERIES)
def session_series(ev: DataFrame) -> DataFrame:
    """Along each nap that a session meets: the value with its rolling median
    and spread, and the motion without its slow part in bins."""
    iv = as_intervals(ev)
    naps = iv.where("label = 'error'").select("event_id", "entity", "start_us", "end_us")
    sessions = intervals.merged(iv.where("label <> 'error'").select("entity", "start_us", "end_us"), ["entity"], 3600)
    met = intervals.best_overlap(naps, sessions, "event_id", "start_us", width_s=7 * DAY).select(F.col("l_event_id").alias("event_id"), F.col("l_entity").alias("entity"), F.col("l_start_us").alias("start_us"), F.col("l_end_us").alias("end_us"))
    inside = intervals.in_intervals(ev.select("entity", "us", "value", "event_type"), met, width_s=7 * DAY)
    rates = compare.rolling_along(inside.where("event_type <> 'click'"), DAY // 2, "event_id")
    motion = compare.binned_rms(inside.where("event_type = 'click'"), 3600, DAY // 2, "event_id")
    rates = rates.select("event_id", F.lit("rate").alias("kind"), r("at_min").alias("at_min"), "value", r("median").alias("median"), r("sd").alias("sd"))
    return rates.unionByName(motion.select("event_id", F.lit("motion").alias("kind"), r("at_min").alias("at_min"), r("rms").alias("value")), allowMissingColumns=True)


@query("last_ended", f"""{IV}, l AS (SELECT * FROM iv WHERE label = 'error'), q AS (SELECT * FROM iv WHERE label = 'view'),
p AS (SELECT l.event_id AS l_id, q.event_id AS r_id, l.start_us - q.end_us AS gap_us, row_number() OVER (PARTITION BY l.event_id ORDER BY q.end_us DESC, q.event_id DESC) AS k FROM l JOIN q ON l.entity = q.entity AND q.end_us <= l.start_us)
SELECT l_id, r_id, gap_us FROM p WHERE k = 1""", of=iv_of)
def last_ended(iv: DataFrame) -> DataFrame:
    a, b = _two(iv)
    return intervals.last_ended(a.withColumnRenamed("event_id", "l_id"), b.withColumnRenamed("event_id", "r_id"), "l_id", "r_id")


@query("sample_in_interval", f"""{IV} SELECT event_id FROM ev e WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM iv WHERE iv.label = 'error' AND iv.entity = e.entity AND e.us BETWEEN iv.start_us AND iv.end_us)""")
def sample_in_interval(ev: DataFrame) -> DataFrame:
    return intervals.in_intervals(ev.where("event_type = 'click'"), as_intervals(ev).where("label = 'error'"), how="semi").select("event_id")


@query("fire_in_interval", f"""{IV} SELECT i.event_id, count(e.us) AS fires, min(e.us) AS first_us FROM iv i LEFT JOIN ev e ON e.entity = i.entity AND e.value > 60 AND e.us >= i.start_us AND e.us < i.end_us WHERE i.label = 'error' GROUP BY 1""")
def fire_in_interval(ev: DataFrame) -> DataFrame:
    spans = as_intervals(ev).where("label = 'error'")
    found = intervals.in_intervals(ev.where("value > 60").select("entity", "us"), spans, half_open=True)
    per = found.groupBy("event_id").agg(F.count("*").alias("fires"), F.min("us").alias("first_us"))
    return spans.select("event_id").join(per, "event_id", "left").select("event_id", F.coalesce("fires", F.lit(0).cast("long")).alias("fires"), "first_us")


@query("grid_label_interval", f"""{IV}, g AS (SELECT DISTINCT entity, unnest(range(ceil((start_us - 10800000000) / 21600000000)::BIGINT, ceil((end_us - 10800000000) / 21600000000)::BIGINT)) AS k FROM iv WHERE label = 'error') SELECT entity, k FROM g""", of=iv_of)
def grid_label_interval(iv: DataFrame) -> DataFrame:
    return intervals.epochs_in(iv.where("label = 'error'"), DAY // 4)


@query("epochs_to_intervals", f"{DAYS} SELECT event_id, k, k * 86400000000 AS start_us, (k + 1) * 86400000000 AS end_us FROM d", of=days)
def epochs_to_intervals(d: DataFrame) -> DataFrame:
    return intervals.epochs_to_intervals(d, DAY, F.lit(0)).select("event_id", "k", "start_us", "end_us")


TAU = "(min(CASE WHEN event_type = 'error' THEN us END) OVER (PARTITION BY entity ORDER BY us RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - us)::DOUBLE / 1e6"


@query("next_event_asof", f"{EV} SELECT event_id, round({TAU}, 6) AS tau FROM ev")
def next_event_asof(ev: DataFrame) -> DataFrame:
    return joins.next_event(ev, F.col("event_type") == "error").select("event_id", r("tau").alias("tau"))


@query("nearest_asof", f"""{EV}, e AS (SELECT entity, us FROM ev WHERE event_type = 'error'), p AS (SELECT v.event_id, e.us AS near_us, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(e.us - v.us), e.us) AS k FROM ev v LEFT JOIN e ON e.entity = v.entity WHERE v.event_type = 'view')
SELECT event_id, near_us FROM p WHERE k = 1""")
def nearest_asof(ev: DataFrame) -> DataFrame:
    return joins.nearest_event(ev.where("event_type = 'view'"), ev.where("event_type = 'error'")).select("event_id", "near_us")


COIN = f"""{EV}, b AS (SELECT entity, floor(us / 21600000000)::BIGINT * 21600000000 AS us, sqrt(avg(value * value)) AS v FROM ev WHERE event_type = 'click' GROUP BY 1, 2), q AS (SELECT entity, quantile_cont(v, 0.9) AS level FROM b GROUP BY 1),
h AS (SELECT e.event_id, e.entity, e.us, max(b.v) AS peak FROM ev e JOIN b ON e.entity = b.entity AND abs(b.us - e.us) <= 43200000000 WHERE e.event_type = 'signup' GROUP BY 1, 2, 3),
c AS (SELECT h.*, row_number() OVER (PARTITION BY h.entity ORDER BY h.us) = 1 AS first FROM h JOIN q USING (entity) WHERE peak >= level)"""


def _coincide(ev: DataFrame) -> DataFrame:
    """Events within half a day of a bin whose motion is in the series' upper
    tenth, the entity's first one marked."""
    bins = ev.where("event_type = 'click'").groupBy("entity", (F.floor(US() / 21_600_000_000) * 21_600_000_000).alias("us")).agg(stats.rms(F.col("value")).alias("value"))
    levels = bins.groupBy("entity").agg(F.percentile("value", F.lit(0.9)).alias("level"))
    wakes = ev.where("event_type = 'signup'").select("event_id", "entity", "us").join(levels, "entity")
    first = F.row_number().over(series.along()) == 1
    return joins.coincidences(wakes, bins, F.col("level"), DAY / 2).withColumn("first", first)


@query("event_coincidence", f"{COIN} SELECT event_id, round(peak, 6) AS peak, first FROM c")
def event_coincidence(ev: DataFrame) -> DataFrame:
    return _coincide(ev).select("event_id", r("peak").alias("peak"), "first")


@query("detect_arousal", f"""{COIN}, w AS (SELECT entity, us, quantile_cont(value, 0.5) OVER (PARTITION BY entity ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING) AS med FROM ev WHERE event_type <> 'click'),
n AS (SELECT c.entity, c.us, w.med, row_number() OVER (PARTITION BY c.entity ORDER BY abs(w.us - c.us), w.us) AS k FROM c JOIN w ON w.entity = c.entity WHERE first) SELECT entity, us, round(med, 6) AS value FROM n WHERE k = 1""")
def detect_arousal(ev: DataFrame) -> DataFrame:
    """The first waking event with a burst of motion, and the smoothed value
    nearest to it."""
    found = _coincide(ev).where("first").select("entity", "us")
    day = DAY * series.S
    rest = medians.sliding_median(ev.where("event_type <> 'click'").select("entity", "us", "value"), "med", day, day)
    near = joins.nearest_event(found, rest.select("entity", "us"))
    return near.join(rest.withColumnRenamed("us", "near_us"), ["entity", "near_us"]).select("entity", "us", r("med").alias("value"))


@query("anchor_lookup", f"""{EV}, a AS (SELECT entity, min(us) AS anchor_us FROM ev WHERE event_type = 'signup' AND value > 100 GROUP BY 1)
SELECT event_id, anchor_us, CASE WHEN anchor_us IS NULL THEN 'no anchor' END AS note FROM ev LEFT JOIN a USING (entity)""")
def anchor_lookup(ev: DataFrame) -> DataFrame:
    anchors = ev.where("event_type = 'signup' AND value > 100").groupBy("entity").agg(F.min("us").alias("anchor_us"))
    return ev.join(anchors, "entity", "left").select("event_id", "anchor_us", F.when(F.col("anchor_us").isNull(), "no anchor").alias("note"))


@query("anti_lost_groups", f"{EV} SELECT DISTINCT entity FROM ev WHERE entity NOT IN (SELECT entity FROM ev WHERE value > 200)")
def anti_lost_groups(ev: DataFrame) -> DataFrame:
    return joins.lost_groups(ev, ev.where("value > 200"), ["entity"])


@query("covered_pair_semi", f"{DAYS}, c AS (SELECT DISTINCT entity, k FROM d WHERE event_type <> 'error') SELECT DISTINCT entity, k FROM d WHERE event_type = 'error' AND (entity, k) IN (SELECT entity, k FROM c) AND (entity, k - 1) IN (SELECT entity, k FROM c)", of=days)
def covered_pair_semi(d: DataFrame) -> DataFrame:
    onsets = d.where("event_type = 'error'").select("entity", "k").distinct()
    return joins.with_both_epochs(onsets, d.where("event_type <> 'error'"))


@query("sample_to_epoch", f"{DAYS}, l AS (SELECT entity, k, min(event_type) AS label FROM d GROUP BY 1, 2) SELECT d.event_id, l.label FROM d JOIN l USING (entity, k)")
def sample_to_epoch(ev: DataFrame) -> DataFrame:
    k = F.floor(US() / (DAY * series.S))
    labels = ev.groupBy("entity", k.alias("k")).agg(F.min("event_type").alias("label"))
    return joins.at_epoch(ev, labels, k).select("event_id", "label")


@query("usable_broadcast", f"{EV}, u AS (SELECT entity FROM ev GROUP BY 1 HAVING count(*) >= 60) SELECT event_id FROM ev JOIN u USING (entity)")
def usable_broadcast(ev: DataFrame) -> DataFrame:
    return ev.join(ev.groupBy("entity").count().where("count >= 60").select("entity"), "entity").select("event_id")


RULES = AlignmentRules(epoch_s=DAY, reach=7, min_samples=3, plateau_share=0.95, max_plateau_s=2 * DAY, min_separation=5.0)
SWEEP = f"""{DAYS}, l AS (SELECT entity, k, min(event_type) AS label FROM d GROUP BY 1, 2), s AS (SELECT entity, k, sum(value) AS s, count(*) AS n FROM d GROUP BY 1, 2),
x AS (SELECT s.entity, m, s.s, s.n, l.label FROM s, range(-7, 8) AS g(m), l WHERE l.entity = s.entity AND l.k = s.k - m AND label IN ('click', 'error')),
c AS (SELECT entity, m, coalesce(sum(n) FILTER (label = 'click'), 0)::BIGINT AS n_high, coalesce(sum(n) FILTER (label = 'error'), 0)::BIGINT AS n_low, sum(s) FILTER (label = 'click') AS sh, sum(s) FILTER (label = 'error') AS sl FROM x GROUP BY 1, 2),
w AS (SELECT entity, m, n_high, n_low, CASE WHEN n_high >= 3 AND n_low >= 3 THEN sh / n_high - sl / n_low END AS separation FROM c)"""
BEST = SWEEP + """, t AS (SELECT *, max(separation) OVER (PARTITION BY entity) AS best FROM w WHERE separation IS NOT NULL),
b AS (SELECT entity, min(m) FILTER (separation = best) AS best_m, max(best) AS best, max(separation) FILTER (m = 0) AS at_zero, max(m) FILTER (separation >= 0.95 * best) - min(m) FILTER (separation >= 0.95 * best) AS plateau_epochs FROM t GROUP BY 1),
u AS (SELECT *, plateau_epochs > 2 AS wide, best < 5 AS flat FROM b)"""


def _swept(d: DataFrame) -> DataFrame:
    labels = d.groupBy("entity", "k").agg(F.min("event_type").alias("label"))
    return align.sweep(d.select("entity", "k", "value"), labels, F.col("label") == "click", F.col("label") == "error", RULES)


@query("offset_search_join", f"{SWEEP} SELECT entity, m, n_high, n_low, round(separation, 9) AS separation FROM w", of=days)
def offset_search_join(d: DataFrame) -> DataFrame:
    return _swept(d).select("entity", "m", F.col("n_high").cast("long").alias("n_high"), F.col("n_low").cast("long").alias("n_low"), r("separation", 9).alias("separation"))


@query("argmax_plateau", f"{BEST} SELECT entity, best_m, round(best, 9) AS best, round(at_zero, 9) AS at_zero, plateau_epochs FROM u", of=days)
def argmax_plateau(d: DataFrame) -> DataFrame:
    return align.best_shift(_swept(d), RULES).select("entity", "best_m", r("best", 9).alias("best"), r("at_zero", 9).alias("at_zero"), "plateau_epochs")


GATE = DensityGate(0.0015, 26_000)
ALIGN_RULES = AlignmentRules(epoch_s=DAY, reach=7, min_samples=3, plateau_share=0.95, max_plateau_s=2 * DAY, min_separation=1.5)
#: The sweep on trailing spreads instead of raw values.
SPREADS = "sdv AS (SELECT entity, us, k, stddev_samp(value) OVER (PARTITION BY entity ORDER BY us RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS sd FROM d)"
TABLE = BEST.replace("sum(value) AS s, count(*) AS n FROM d", "sum(sd) AS s, count(sd) AS n FROM sdv WHERE sd IS NOT NULL").replace(DAYS, f"{DAYS}, {SPREADS}") + f""",
cnt AS (SELECT entity, count(sd) AS known FROM sdv GROUP BY 1), sp AS (SELECT entity, min(k) AS k0, max(k) - min(k) + 1 AS n_ep FROM l GROUP BY 1), pb AS (SELECT b.*, k0, n_ep FROM b JOIN cnt USING (entity) JOIN sp USING (entity) WHERE known >= 3),
sh AS (SELECT sdv.entity, us, k - best_m - k0 AS e FROM sdv JOIN pb USING (entity) WHERE k - best_m - k0 >= 0 AND k - best_m - k0 < n_ep),
ga AS (SELECT entity, us, (us - lag(us) OVER {BY})::DOUBLE / 1e6 AS gap FROM sh),
ra AS (SELECT entity, CASE WHEN count(*) >= 2 AND max(us) > min(us) THEN count(*) / ((max(us) - min(us))::DOUBLE / 1e6 / 60) ELSE 0 END AS rate, quantile_cont(gap, 0.5) AS gap FROM ga GROUP BY 1),
cv AS (SELECT DISTINCT entity, e FROM sh), co AS (SELECT entity, count(*) AS n, max(e) - min(e) + 1 AS span FROM cv GROUP BY 1), lo AS (SELECT l.entity, k - k0 AS e FROM l JOIN sp USING (entity) WHERE label = 'error'),
ons AS (SELECT entity, e FROM lo WHERE e > 0 AND (entity, e - 1) NOT IN (SELECT entity, e FROM lo)),
oc AS (SELECT o.entity, count(*) AS n_on, count(*) FILTER (a.e IS NOT NULL AND z.e IS NOT NULL) AS n_cov, min(o.e) AS first FROM ons o LEFT JOIN cv a ON a.entity = o.entity AND a.e = o.e LEFT JOIN cv z ON z.entity = o.entity AND z.e = o.e - 1 GROUP BY 1),
tb AS (SELECT cnt.entity, known, best_m IS NOT NULL AS seen, best_m, best, at_zero, plateau_epochs * 86400 AS plateau_s, coalesce(rate, 0) AS rate, gap, coalesce(co.n / n_ep, 0) AS cover, coalesce(co.n / span, 0) AS contig, n_on, n_cov, first
FROM cnt LEFT JOIN pb USING (entity) LEFT JOIN ra USING (entity) LEFT JOIN co USING (entity) LEFT JOIN oc USING (entity)),
al AS (SELECT entity, coalesce(seen AND NOT best < 1.5 AND NOT plateau_s > 172800 AND NOT (rate < 0.0015 OR gap IS NULL OR gap > 26000), false) AS usable,
CASE WHEN seen THEN concat_ws('; ', CASE WHEN best < 1.5 THEN 'sep ' || printf('%.2f', best) || '<1.5' END, CASE WHEN plateau_s > 172800 THEN 'plateau ' || printf('%.0f', plateau_s::DOUBLE) || 's>172800s' END,
CASE WHEN rate < 0.0015 OR gap IS NULL OR gap > 26000 THEN 'density rate=' || printf('%.1f', rate) || '/min gap=' || coalesce(printf('%.1f', gap), 'inf') || 's' END)
WHEN known < 3 THEN 'too_few_HR_samples' ELSE 'no_probe(insufficient N3/Wake coverage at any offset)' END AS reject, best_m, best, at_zero, plateau_s, CASE WHEN seen THEN rate ELSE 0 END AS in_rate, gap AS in_gap_s, cover, contig AS contiguity,
CASE WHEN seen THEN coalesce(n_on, 0) ELSE 0 END AS n_onsets, CASE WHEN seen THEN coalesce(n_cov, 0) ELSE 0 END AS n_covered, CASE WHEN seen THEN coalesce(first, -1) ELSE -1 END AS first_onset FROM tb)"""


def _aligned(d: DataFrame) -> DataFrame:
    labels = d.groupBy("entity", "k").agg(F.min("event_type").alias("label"))
    samples = d.select("entity", "us", "k", series.trailing_sd(F.col("value"), series.trailing(3 * DAY)).alias("value"))
    return align.alignment_table(samples, labels, F.col("label") == "click", F.col("label") == "error", ALIGN_RULES, GATE)


@query("usable_gate", f"{TABLE} SELECT entity, usable, reject FROM al", of=days)
def usable_gate(d: DataFrame) -> DataFrame:
    return _aligned(d).select("entity", "usable", "reject")


@query("alignment_sweep", f"""{TABLE} SELECT entity, usable, reject, best_m, round(best, 6) AS best, round(at_zero, 6) AS at_zero, plateau_s, round(in_rate, 9) AS in_rate, round(in_gap_s, 5) AS in_gap_s, round(cover, 9) AS cover, round(contiguity, 9) AS contiguity, n_onsets, n_covered, first_onset FROM al""", of=days)
def alignment_sweep(d: DataFrame) -> DataFrame:
    """The whole alignment table: probed on trailing spreads, gated by density."""
    rounded = {"best": 6, "at_zero": 6, "in_rate": 9, "in_gap_s": 5, "cover": 9, "contiguity": 9}
    out = _aligned(d)
    return out.select(*[r(c, rounded[c]).alias(c) if c in rounded else c for c in out.columns])


@query("reason_tally", f"{TABLE} SELECT regexp_replace(trim(string_split(reject, ';')[1]), '[0-9.]+', '#', 'g') AS reason, count(*) AS n FROM al WHERE NOT usable GROUP BY 1", of=days)
def reason_tally(d: DataFrame) -> DataFrame:
    return stats.reason_tally(_aligned(d).where("NOT usable"), "reject")


@query("alignment_verdict", f"""{TABLE}, v AS (SELECT count(*) AS n, count(at_zero) AS n_zero, coalesce(bool_and(at_zero > 0), true) AS all_positive, quantile_cont(at_zero, 0.5) AS median_zero, quantile_cont(best - at_zero, 0.5) AS median_gain,
max(best_m) - min(best_m) AS spread_epochs, quantile_cont(best_m::DOUBLE, 0.5) AS median_m FROM al WHERE best_m IS NOT NULL)
SELECT n, n_zero, all_positive, round(median_zero, 6) AS median_zero, round(median_gain, 6) AS median_gain, spread_epochs, median_m,
CASE WHEN n = 0 THEN 'none' WHEN all_positive AND median_gain < 0.1 * abs(median_zero + 1e-9) THEN 'clean' WHEN spread_epochs * 86400 <= 172800 THEN 'constant' ELSE 'per entity' END AS verdict FROM v""", of=days)
def alignment_verdict(d: DataFrame) -> DataFrame:
    out = align.verdict(_aligned(d), ALIGN_RULES, 2 * DAY)
    return out.withColumns({c: r(c) for c in ("median_zero", "median_gain")})


#: Days stand for epochs, so that five of them stand for an hour.
ZONE_S = 5 * DAY


@query("zone_check", f"""{TABLE}, z AS (SELECT abs(best_m * 86400 - round_even(best_m * 86400 / {ZONE_S}, 0) * {ZONE_S}) AS residual FROM al WHERE best_m IS NOT NULL)
SELECT count(*) AS n, max(residual)::DOUBLE AS max_residual_s, max(residual) <= 60 AS zone FROM z""", of=days)
def zone_check(d: DataFrame) -> DataFrame:
    """Whether all best shifts lie on whole hours, as those of a wrong zone do."""
    return align.zone_check(_aligned(d), DAY, ZONE_S)


@query("density_gate", f"""{EV}, g AS (SELECT entity, us, (us - lag(us) OVER {BY})::DOUBLE / 1e6 AS gap FROM ev),
c AS (SELECT entity, count(*) AS n, (max(us) - min(us))::DOUBLE / 6e7 AS span, quantile_cont(gap, 0.5) AS med FROM g GROUP BY 1), q AS (SELECT *, CASE WHEN n >= 2 AND span > 0 THEN n / span ELSE 0 END AS per_min FROM c)
SELECT entity, NOT (per_min < 0.0015) AND NOT (med IS NULL OR med > 26000) AS dense, CASE WHEN per_min < 0.0015 THEN 'rate ' || printf('%.2f', per_min) || '/min < 0.0/min required' WHEN med IS NULL OR med > 26000 THEN 'median gap ' || coalesce(printf('%.1f', med), 'inf') || 's > 26000s required' ELSE '' END AS reason FROM q""")
def density_gate(ev: DataFrame) -> DataFrame:
    return stats.density_gate(stats.cadence(ev), GATE).select("entity", "dense", "reason")
