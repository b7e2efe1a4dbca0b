"""Report queries: nightly content, shapes around onsets, low episodes, and a
replayed trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import inflection, intervals, joins, series
from ..params import InflectionRules
from .recordings import resample_offsets
from .registry import DAY, DAYS, EV, IV, SQL, US, V, as_intervals, days, query, r

BY = "(PARTITION BY entity ORDER BY us)"
W3 = "(PARTITION BY entity ORDER BY us RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW)"
SD = f"s AS (SELECT *, stddev_samp(value) OVER {W3} AS sd, avg(value) OVER {W3} AS mean3 FROM ev)"


def _with_sd(ev: DataFrame) -> DataFrame:
    w = series.trailing(3 * DAY)
    return ev.withColumn("sd", series.trailing_sd(V(), w)).withColumn("mean3", F.avg("value").over(w))


@query("hrv_ceiling", f"{DAYS}, m AS (SELECT entity, k, max(value) AS top FROM d GROUP BY 1, 2) SELECT entity, count(*) AS days, max(top) AS ceiling, round(quantile_cont(top, 0.95), 6) AS p95 FROM m GROUP BY 1", of=days)
def hrv_ceiling(d: DataFrame) -> DataFrame:
    tops = d.groupBy("entity", "k").agg(F.max("value").alias("top"))
    return tops.groupBy("entity").agg(F.count("*").alias("days"), F.max("top").alias("ceiling"), r(F.percentile("top", F.lit(0.95))).alias("p95"))


@query("quiet_frequency", f"""{EV}, q AS (SELECT entity, us, CASE WHEN us - lag(us) OVER {BY} <= 86400000000 THEN 0 ELSE 1 END AS new FROM ev WHERE value < 50), g AS (SELECT *, sum(new) OVER {BY} AS g FROM q),
u AS (SELECT entity, g, min(us) AS a, max(us) AS b FROM g GROUP BY 1, 2) SELECT floor(a / 604800000000)::BIGINT AS week, count(*) AS runs, count(DISTINCT entity) AS entities FROM u WHERE b - a >= 43200000000 GROUP BY 1""")
def quiet_frequency(ev: DataFrame) -> DataFrame:
    points = ev.where(V() < 50).select("entity", US().alias("start_us"), US().alias("end_us"))
    quiet = intervals.merged(points, ["entity"], DAY).where(F.col("end_us") - F.col("start_us") >= DAY // 2 * series.S)
    return quiet.groupBy(F.floor(F.col("start_us") / (7 * DAY * series.S)).alias("week")).agg(F.count("*").alias("runs"), F.countDistinct("entity").alias("entities"))


@query("sleep_content", f"""{IV}, n AS (SELECT *, floor(start_us / 86400000000)::BIGINT AS night FROM iv), m AS (SELECT *, max(end_us) OVER (PARTITION BY entity, night, label ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM n),
i AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_us > reached THEN 1 ELSE 0 END) OVER (PARTITION BY entity, night, label ORDER BY start_us, end_us) AS island FROM m),
u AS (SELECT entity, night, label, island, max(end_us) - min(start_us) AS d FROM i GROUP BY ALL), t AS (SELECT entity, night, sum(d) AS d, count(DISTINCT label) AS labels FROM u GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY night DESC) AS k FROM t WHERE d >= 7200000000) SELECT entity, night, labels, round(d::DOUBLE / 6e7, 6) AS minutes FROM k WHERE k <= 8""")
def sleep_content(ev: DataFrame) -> DataFrame:
    nights = as_intervals(ev).withColumn("night", F.floor(F.col("start_us") / (DAY * series.S)))
    parts = intervals.merged(nights, ["entity", "night", "label"])
    total = parts.groupBy("entity", "night").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("d"), F.countDistinct("label").alias("labels")).where(F.col("d") >= 7200 * series.S)
    newest = Window.partitionBy("entity").orderBy(F.desc("night"))
    return total.withColumn("k", F.row_number().over(newest)).where("k <= 8").select("entity", "night", "labels", r(F.col("d").cast("double") / 6e7).alias("minutes"))


@query("shape_inflection_lag", f"""{EV}, {SD}, o AS (SELECT entity, min(us) AS o FROM ev WHERE event_type = 'error' AND value > 60 GROUP BY 1),
g AS (SELECT entity, us, round(value - lag(value) OVER {BY}, 6) AS dv, round(sd - lag(sd) OVER {BY}, 6) AS ds FROM s), n AS (SELECT g.* FROM g JOIN o USING (entity) WHERE us BETWEEN o - 432000000000 AND o + 432000000000)
SELECT entity, round((arg_min(us, struct_pack(a := ds, b := us)) FILTER (ds IS NOT NULL) - arg_min(us, struct_pack(a := dv, b := us)) FILTER (dv IS NOT NULL))::DOUBLE / 1e6, 6) AS lag_s FROM n GROUP BY 1""")
def shape_inflection_lag(ev: DataFrame) -> DataFrame:
    """How long after the steepest fall of the value that of its spread comes,
    around the entity's first onset."""
    w = series.along()
    steps = _with_sd(ev).select("entity", "us", r(V() - F.lag("value").over(w)).alias("dv"), r(F.col("sd") - F.lag("sd").over(w)).alias("ds"))
    onset = ev.where("event_type = 'error' AND value > 60").groupBy("entity").agg(F.min("us").alias("o"))
    near = steps.join(onset, "entity").where(F.abs(US() - F.col("o")) <= 5 * DAY * series.S)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(c, "us")))["us"]
    return near.groupBy("entity").agg(first("ds").alias("s"), first("dv").alias("v")).select("entity", r((F.col("s") - F.col("v")).cast("double") / series.S).alias("lag_s"))


#: Six hours stand for a second, five days for the window on either side.
INFLECTION = InflectionRules(step_s=DAY // 4, half_s=5 * DAY, digits=6)
STEP = 21_600_000_000
GB = "(PARTITION BY entity ORDER BY k)"


def _smooth(c: str) -> str:
    return f"(sum({c}) OVER (PARTITION BY entity ORDER BY k ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) + greatest(8 - i, 0) * a_{c} + greatest(7 - n + i, 0) * z_{c}) / 15 AS {c}"


def _slope(c: str) -> str:
    return f"round(coalesce((lead({c}) OVER {GB} - lag({c}) OVER {GB}) / 2, lead({c}) OVER {GB} - {c}, {c} - lag({c}) OVER {GB}), 6) AS d_{c}"


@query("inflection_lags", f"""{EV}, {SD}, h AS (SELECT entity, us, value AS v, coalesce(sd, avg(sd) OVER (PARTITION BY entity), 0) AS s FROM s),
p AS (SELECT *, lead(us) OVER {BY} AS u2, lead(v) OVER {BY} AS v2, lead(s) OVER {BY} AS s2 FROM h),
x AS (SELECT entity, k, us, v, s, u2, v2, s2 FROM p, unnest(range(ceil(us / {STEP})::BIGINT, CASE WHEN u2 IS NULL THEN ceil(us / {STEP})::BIGINT + CASE WHEN us % {STEP} = 0 THEN 1 ELSE 0 END ELSE ceil(u2 / {STEP})::BIGINT END)) AS t(k)),
q AS (SELECT entity, k, CASE WHEN u2 IS NULL THEN v ELSE v + (v2 - v) * ((k * {STEP} - us) / (u2 - us)) END AS v, CASE WHEN u2 IS NULL THEN s ELSE s + (s2 - s) * ((k * {STEP} - us) / (u2 - us)) END AS s FROM x),
b AS (SELECT *, row_number() OVER {GB} AS i, count(*) OVER (PARTITION BY entity) AS n FROM q), ends AS (SELECT entity, arg_min(v, k) AS a_v, arg_max(v, k) AS z_v, arg_min(s, k) AS a_s, arg_max(s, k) AS z_s FROM q GROUP BY 1),
sm AS (SELECT entity, k, {_smooth('v')}, {_smooth('s')} FROM b JOIN ends USING (entity)), sl AS (SELECT entity, k, {_slope('v')}, {_slope('s')} FROM sm),
o AS (SELECT entity, us AS o FROM (SELECT *, lag(event_type) OVER {BY} AS before FROM ev) WHERE event_type = 'error' AND before IS DISTINCT FROM 'error'),
w AS (SELECT entity, o, count(*) AS n, min(struct_pack(d := d_v, k := k)).k * {STEP} AS v, min(struct_pack(d := d_s, k := k)).k * {STEP} AS s FROM sl JOIN o USING (entity) WHERE k * {STEP} BETWEEN o - 432000000000 AND o + 432000000000 GROUP BY 1, 2)
SELECT entity, o AS onset_us, v AS value_us, s AS sd_us, (s - v)::DOUBLE / 1e6 AS lag_s FROM w WHERE n >= 28""")
def inflection_lags(ev: DataFrame) -> DataFrame:
    """For every change to deep, on the smoothed grid, how long after the
    steepest fall of the value that of its spread comes."""
    slopes = inflection.smoothed_slopes(_with_sd(ev), INFLECTION)
    onsets = ev.withColumn("on", series.rising(F.col("event_type") == "error", count_first=True)).where("on")
    return inflection.inflection_lags(slopes, onsets, INFLECTION)


@query("low_episodes", f"""{EV}, {SD}, f AS (SELECT *, coalesce(sd < 20, false) AS o FROM s), g AS (SELECT *, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER {BY} AS g FROM f)
SELECT entity, min(us) AS start_us, max(us) AS end_us, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_deep FROM g WHERE o GROUP BY entity, g HAVING count(*) >= 3""")
def low_episodes(ev: DataFrame) -> DataFrame:
    """Runs of low spread, and how many of their samples are deep."""
    marked = _with_sd(ev)
    found = series.runs(marked, F.col("sd") < 20).where("n >= 3")
    inside = intervals.in_intervals(ev.where("event_type = 'error'").select("entity", "us"), found, width_s=7 * DAY)
    deep = inside.groupBy("entity", "start_us").agg(F.count("*").alias("n_deep"))
    return found.join(deep, ["entity", "start_us"], "left").withColumn("n_deep", F.coalesce("n_deep", F.lit(0).cast("long"))).select("entity", "start_us", "end_us", "n", "n_deep")


LIGHT = f"""v AS (SELECT *, max(end_us) OVER (PARTITION BY entity ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM iv WHERE label = 'view'),
vi AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_us - reached > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY start_us, end_us) AS island FROM v), st AS (SELECT entity, min(start_us) AS a, max(end_us) AS b FROM vi GROUP BY entity, island),
pk AS (SELECT entity, coalesce(min(struct_pack(a := a, b := b)) FILTER (b - a >= 36000000000), min(struct_pack(a := a, b := b))) AS p FROM st GROUP BY 1),
lr AS (SELECT ev.entity, coalesce(quantile_cont(value, 0.5) FILTER (us BETWEEN p.a AND p.b), quantile_cont(value, 0.5)) AS ref FROM ev LEFT JOIN pk USING (entity) GROUP BY 1)"""


@query("dual_trigger_replay", f"""{IV}, {SD}, {LIGHT},
tg AS (SELECT s.*, mean3 <= ref - 5 AND sd < 40 AS o FROM s JOIN lr USING (entity)), f AS (SELECT *, coalesce(o, false) AS p FROM tg), g AS (SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER {BY} AS g FROM f),
k AS (SELECT entity, us, row_number() OVER (PARTITION BY entity, g ORDER BY us) AS k FROM g WHERE p), fi AS (SELECT entity, min(us) AS fire_us FROM k WHERE k = 2 GROUP BY 1)
SELECT fi.entity, fire_us, count(ev.us) > 0 AS caught FROM fi LEFT JOIN ev ON ev.entity = fi.entity AND event_type = 'error' AND ev.us > fire_us AND ev.us <= fire_us + 259200000000 GROUP BY 1, 2""")
def dual_trigger_replay(ev: DataFrame) -> DataFrame:
    """The first sample at which the value has been below a reference, with a
    small spread, for two samples in a row; and whether an onset follows. The
    reference is the median of the first light stretch that is long enough, or
    else of the first, or of the whole series."""
    stretch = F.struct(F.col("start_us").alias("a"), F.col("end_us").alias("b"))
    light = intervals.merged(as_intervals(ev).where("label = 'view'"), ["entity"], 3600)
    first = light.groupBy("entity").agg(F.coalesce(F.min(F.when(F.col("end_us") - F.col("start_us") >= 10 * 3600 * series.S, stretch)), F.min(stretch)).alias("p"))
    mid = lambda x: F.percentile(x, F.lit(0.5))
    ref = ev.join(first, "entity", "left").groupBy("entity").agg(F.coalesce(mid(F.when(US().between(F.col("p.a"), F.col("p.b")), V())), mid(V())).alias("ref"))
    on = F.coalesce((F.col("mean3") <= F.col("ref") - 5) & (F.col("sd") < 40), F.lit(False))
    marked = _with_sd(ev).join(ref, "entity").withColumn("on", on)
    second = marked.withColumn("fires", F.col("on") & F.lag("on", 1, False).over(series.along()))
    tau = joins.next_event(second, F.col("event_type") == "error")
    fired = tau.where("fires").groupBy("entity").agg(F.min(F.struct("us", "tau")).alias("f"))
    return fired.select("entity", F.col("f.us").alias("fire_us"), F.coalesce(F.col("f.tau") <= 3 * DAY, F.lit(False)).alias("caught"))


@query("shape_overlay", "WITH x AS (" + SQL["resample_offsets"] + ") SELECT entity, k, round(CASE WHEN stddev_pop(value) OVER p > 0 THEN (value - avg(value) OVER p) / stddev_pop(value) OVER p ELSE value - avg(value) OVER p END, 3) AS z FROM x WINDOW p AS (PARTITION BY entity)")
def shape_overlay(ev: DataFrame) -> DataFrame:
    """The series around each onset on one grid of offsets, z-normalised."""
    grid = resample_offsets(ev)
    return grid.select("entity", "k", r(series.z_normalized(F.col("value"), Window.partitionBy("entity")), 3).alias("z"))
