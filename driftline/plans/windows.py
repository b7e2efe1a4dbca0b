"""Window operators over the event series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import beats, medians, series
from ..operators.chunks import long_groups, widened
from ..params import BeatRules, FeatureWindows
from .registry import DAY, EV, US, V, query, r

W3 = "(PARTITION BY entity ORDER BY us RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW)"
W7 = "(PARTITION BY entity ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)"
W3_US, W7_US = 3 * DAY * series.S, 7 * DAY * series.S
BY = "(PARTITION BY entity ORDER BY us)"


@query("trailing_sd", f"{EV} SELECT event_id, round(stddev_samp(value) OVER {W3}, 6) AS sd FROM ev")
def trailing_sd(ev: DataFrame) -> DataFrame:
    found = widened(ev, lambda by: {"sd": series.trailing_sd(V(), series.trailing(3 * DAY, by))}, W3_US)
    return found.select("event_id", r("sd").alias("sd"))


@query("centred_rolling", f"""{EV} SELECT event_id, round(quantile_cont(value, 0.5) OVER w, 6) AS med, round(stddev_pop(value) OVER w, 6) AS sd FROM ev
WINDOW w AS (PARTITION BY entity ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING)""")
def centred_rolling(ev: DataFrame) -> DataFrame:
    day = DAY * series.S
    cuts = long_groups(ev, ["entity"], "us")
    spreads = widened(ev.select("event_id", "entity", "us", "value"), lambda by: {"sd": F.stddev_pop(V()).over(series.centred(2 * DAY, by))}, day, day, cuts=cuts)
    found = medians.sliding_median(spreads, "med", day, day, cuts=cuts)
    return found.select("event_id", r("med").alias("med"), r("sd").alias("sd"))


@query("trailing_mean_pair", f"""{EV} SELECT event_id, round(CASE WHEN count(*) OVER {W3} >= 3 AND count(*) OVER {W7} >= 5 THEN avg(value) OVER {W3} - avg(value) OVER {W7} END, 6) AS drop_vs_base FROM ev""")
def trailing_mean_pair(ev: DataFrame) -> DataFrame:
    found = widened(ev, lambda by: {"d": series.counted_mean(V(), series.trailing(3 * DAY, by), 3) - series.counted_mean(V(), series.trailing(7 * DAY, by), 5)}, W7_US)
    return found.select("event_id", r("d").alias("drop_vs_base"))


SLOPE = f"""CASE WHEN count(*) OVER {W3} >= 4 AND us - min(us) OVER {W3} >= 129600000000 THEN regr_slope(value, t) OVER {W3} * 86400 END"""


@query("trailing_ols_slope", f"{EV} SELECT event_id, round({SLOPE}, 6) AS slope FROM ev")
def trailing_ols_slope(ev: DataFrame) -> DataFrame:
    found = widened(ev, lambda by: {"slope": series.ols_slope(V(), US(), series.trailing(3 * DAY, by), 4, 1.5 * DAY, DAY)}, W3_US)
    return found.select("event_id", r("slope").alias("slope"))


@query("trailing_min_sustain", f"""{EV} SELECT event_id, min(value) OVER w AS held, us - min(us) OVER w >= 129600000000 AS ok FROM ev
WINDOW w AS (PARTITION BY entity ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)""")
def trailing_min_sustain(ev: DataFrame) -> DataFrame:
    found = widened(ev, lambda by: dict(zip(("held", "ok"), series.sustained_min(V(), US(), 2 * DAY, DAY / 2, by), strict=True)), 2 * DAY * series.S)
    return found.select("event_id", "held", "ok")


@query("running_max_records", f"""{EV}, m AS (SELECT *, max(value) OVER (PARTITION BY entity ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev)
SELECT entity, us, value FROM m WHERE top IS NULL OR value > top""")
def running_max_records(ev: DataFrame) -> DataFrame:
    return series.record_highs(ev).select("entity", "us", "value")


@query("lag1_autocorr", f"""{EV}, l AS (SELECT event_id, list(value) OVER {W7} AS x FROM ev), m AS (SELECT *, list_sum(x) / len(x) AS a FROM l),
e AS (SELECT event_id, [v - a for v in x] AS d FROM m)
SELECT event_id, round(CASE WHEN len(d) >= 6 AND list_sum([v * v for v in d]) > 0 THEN list_sum([d[i] * d[i - 1] for i in range(2, len(d) + 1)]) / list_sum([v * v for v in d]) END, 6) AS ac1 FROM e""")
def lag1_autocorr(ev: DataFrame) -> DataFrame:
    return series.lag1_autocorrelation(ev, "value", 7 * DAY, "ac1").select("event_id", r("ac1").alias("ac1"))


@query("reversal_rate", f"""{EV}, l AS (SELECT event_id, list(value) OVER {W7} AS x FROM ev),
s AS (SELECT event_id, [v for v in [sign(x[i] - x[i - 1]) for i in range(2, len(x) + 1)] if v != 0] AS s FROM l)
SELECT event_id, round(CASE WHEN len(s) >= 2 THEN len([1 for i in range(2, len(s) + 1) if s[i] != s[i - 1]]) / (len(s) - 1) END, 6) AS reversals FROM s""")
def reversal_rate(ev: DataFrame) -> DataFrame:
    return series.reversal_rate(ev, "value", 7 * DAY, "reversals").select("event_id", r("reversals").alias("reversals"))


@query("quad_coeff", f"""{EV}, l AS (SELECT event_id, us, list(us) OVER {W7} AS u, list(value) OVER {W7} AS v FROM ev),
x AS (SELECT event_id, v, [(a - us)::DOUBLE / 86400000000 for a in u] AS x FROM l),
m AS (SELECT event_id, len(x)::DOUBLE AS n, list_sum(x) AS x1, list_sum([a*a for a in x]) AS x2, list_sum([a*a*a for a in x]) AS x3, list_sum([a*a*a*a for a in x]) AS x4,
 list_sum(v) AS y0, list_sum([x[i]*v[i] for i in range(1, len(x)+1)]) AS y1, list_sum([x[i]*x[i]*v[i] for i in range(1, len(x)+1)]) AS y2 FROM x),
d AS (SELECT *, n*(x2*x4-x3*x3) - x1*(x1*x4-x2*x3) + x2*(x1*x3-x2*x2) AS det FROM m)
SELECT event_id, round(CASE WHEN n >= 6 AND abs(det) > 1e-9 THEN (n*(x2*y2-y1*x3) - x1*(x1*y2-y1*x2) + y0*(x1*x3-x2*x2)) / det END, 4) AS curvature FROM d""")
def quad_coeff(ev: DataFrame) -> DataFrame:
    return series.quadratic(ev, "value", 7 * DAY, "curvature", scale_s=DAY).select("event_id", r("curvature", 4).alias("curvature"))


@query("half_open_trailing", f"""{EV} SELECT event_id, count(*) OVER (PARTITION BY entity ORDER BY us RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW) AS n FROM ev""")
def half_open_trailing(ev: DataFrame) -> DataFrame:
    return widened(ev, lambda by: {"n": F.count("*").over(series.trailing(3 * DAY, by, closed=False))}, W3_US).select("event_id", "n")


RULES = BeatRules(min_rr_ms=20, max_rr_ms=2000, window_s=10 * DAY, min_coverage=0.0, max_deviation=0.8)
RR = f"""{EV}, b AS (SELECT *, value * 10 AS rr, row_number() OVER {BY} AS i FROM ev), g AS (SELECT * FROM b WHERE rr BETWEEN 20 AND 2000),
j AS (SELECT *, count(rr) OVER w AS n, quantile_cont(rr, 0.5) OVER w AS med FROM g WINDOW w AS (PARTITION BY entity ORDER BY us ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING)),
kept AS (SELECT event_id, entity, us, i, rr, n < 11 OR abs(rr - med) <= 0.8::DOUBLE * med AS keep FROM j UNION ALL SELECT event_id, entity, us, i, rr, false FROM b WHERE rr NOT BETWEEN 20 AND 2000)"""


def _beats(ev: DataFrame) -> DataFrame:
    return beats.ectopic_filter(ev.select("event_id", "entity", "us", (V() * 10).alias("rr"), F.row_number().over(series.along()).alias("i")), RULES)


@query("ectopic_filter", f"{RR} SELECT event_id, keep FROM kept")
def ectopic_filter(ev: DataFrame) -> DataFrame:
    return _beats(ev).select("event_id", "keep")


HRV = f"""{RR}, p AS (SELECT *, CASE WHEN keep THEN rr END AS nn, CASE WHEN keep AND lag(keep) OVER {BY} AND i - lag(i) OVER {BY} = 1 THEN rr - lag(rr) OVER {BY} END AS df FROM kept),
q AS (SELECT *, df * df AS d2 FROM p),
f AS (SELECT event_id, count(d2) OVER w - CASE WHEN first_value(d2) OVER w IS NULL THEN 0 ELSE 1 END AS np, sum(d2) OVER w - coalesce(first_value(d2) OVER w, 0) AS tot, sum(nn) OVER w AS cov, count(nn) OVER w AS nnn, stddev_samp(nn) OVER w AS sd FROM q
 WINDOW w AS (PARTITION BY entity ORDER BY us RANGE BETWEEN 863999999999 PRECEDING AND CURRENT ROW))"""


@query("rmssd", f"{HRV} SELECT event_id, round(CASE WHEN np >= 2 AND cov >= 0 AND tot > 1e-6 THEN ln(sqrt(tot / np)) END, 5) AS ln_rmssd FROM f")
def rmssd(ev: DataFrame) -> DataFrame:
    return beats.variability(_beats(ev), RULES).select("event_id", r("ln_rmssd", 5).alias("ln_rmssd"))


@query("sdnn", f"{HRV} SELECT event_id, round(CASE WHEN nnn >= 3 AND cov >= 0 THEN sd END, 5) AS sdnn FROM f")
def sdnn(ev: DataFrame) -> DataFrame:
    return beats.variability(_beats(ev), RULES).select("event_id", r("sdnn", 5).alias("sdnn"))


@query("hrv_features", f"""{HRV} SELECT event_id, round(CASE WHEN np >= 2 AND cov >= 0 AND tot > 1e-6 THEN ln(sqrt(tot / np)) END, 5) AS ln_rmssd, round(CASE WHEN nnn >= 3 AND cov >= 0 THEN sd END, 5) AS sdnn FROM f""")
def hrv_features(ev: DataFrame) -> DataFrame:
    return beats.variability(_beats(ev), RULES).select("event_id", r("ln_rmssd", 5).alias("ln_rmssd"), r("sdnn", 5).alias("sdnn"))


@query("physiologic_range", f"{EV} SELECT event_id, value * 10 BETWEEN 300 AND 2000 AS ok FROM ev")
def physiologic_range(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", beats.in_range(V() * 10).alias("ok"))


SPECTRAL = BeatRules(min_rr_ms=20, max_rr_ms=2000, window_s=20, min_coverage=0.0, max_deviation=0.8, nperseg=64)


def _spectra(ev: DataFrame) -> DataFrame:
    """At each beat, on a clock on which a day is a second, so that there are
    bands to see."""
    b = _beats(ev).withColumn("us", F.floor(F.col("us") / DAY))
    return beats.spectra(b, b, SPECTRAL, chunk_s=40)


@query("spectral_bands")
def spectral_bands(ev: DataFrame) -> DataFrame:
    return _spectra(ev)


@query("hrv_all_features")
def hrv_all_features(ev: DataFrame) -> DataFrame:
    """All four features of the trailing window at each beat."""
    timed = beats.variability(_beats(ev), RULES).select("event_id", "entity", F.floor(F.col("us") / DAY).alias("us"), "ln_rmssd", "sdnn")
    return timed.join(_spectra(ev), ["entity", "us"], "left").select("event_id", "ln_rmssd", "sdnn", "ln_hf", "ln_lf_hf")


INGEST = BeatRules(min_rr_ms=100, max_rr_ms=4000, max_deviation=0.8)
PEAKS = f"""{EV}, nb AS (SELECT entity, us, value, lag(value) OVER {BY} AS a, lead(value) OVER {BY} AS c, lag(us) OVER {BY} AS u0, lead(us) OVER {BY} AS u2 FROM ev),
pk AS (SELECT entity, us + CASE WHEN a - 2 * value + c = 0 THEN 0 ELSE least(greatest((a - c) / (2 * (a - 2 * value + c)), -0.5), 0.5) END * ((u2 - u0) // 2) AS pu FROM nb WHERE value > a AND value > c),
bt AS (SELECT entity, round(pu / 86400)::BIGINT AS us FROM pk), b AS (SELECT * FROM (SELECT entity, us, (us - lag(us) OVER {BY}) / 1e3::DOUBLE AS rr, row_number() OVER {BY} AS i FROM bt) WHERE rr IS NOT NULL),
g AS (SELECT * FROM b WHERE rr BETWEEN 100 AND 4000), j AS (SELECT *, count(rr) OVER w AS n, quantile_cont(rr, 0.5) OVER w AS med FROM g WINDOW w AS (PARTITION BY entity ORDER BY us ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING)),
kept AS (SELECT entity, us, rr, n < 11 OR abs(rr - med) <= 0.8::DOUBLE * med AS keep FROM j UNION ALL SELECT entity, us, rr, false FROM b WHERE rr NOT BETWEEN 100 AND 4000),
sp AS (SELECT entity, floor(min(us) / 86400)::BIGINT AS s0, floor(max(us) / 86400)::BIGINT AS s1 FROM ev WHERE event_type = 'view' GROUP BY 1)"""


@query("beat_ingest", f"""{PEAKS}, m AS (SELECT entity, ceil(us / 5000000)::BIGINT * 5000000 AS end_us, round_even(avg(60000 / rr), 0) AS mean FROM kept WHERE keep GROUP BY 1, 2),
s AS (SELECT k.entity, count(*) AS n_beats, round(avg(CASE WHEN keep THEN 0.0::DOUBLE ELSE 1 END), 6) AS removed, round(avg(CASE WHEN keep THEN 0.0::DOUBLE ELSE 1 END) FILTER (us >= s0 AND us < s1), 6) AS removed_scored FROM kept k JOIN sp USING (entity) GROUP BY 1)
SELECT m.*, n_beats, removed, removed_scored FROM m JOIN s USING (entity) WHERE removed_scored <= 0.2""")
def beat_ingest(ev: DataFrame) -> DataFrame:
    """From a signal to rates: refined peaks are beats, on a clock on which a
    day is a second; beats out of range or off their predecessors' median go;
    records that lose too many within the labelled time go; rates come in bins
    of five seconds."""
    from ..operators.stats import bin_end_means

    w = series.along()
    near = ev.select("entity", "us", F.lag("value").over(w).alias("a"), V().alias("b"), F.lead("value").over(w).alias("c"), F.floor((F.lead("us").over(w) - F.lag("us").over(w)) / 2).alias("half"))
    shift = beats.parabolic_peak(F.col("a"), F.col("b"), F.col("c"))
    at = near.where("b > a AND b > c").select("entity", F.round((US() + shift * F.col("half")) / 86400).cast("long").alias("us"))
    rr = ((US() - F.lag("us").over(w)) / 1e3).alias("rr")
    b = at.select("entity", "us", rr, F.row_number().over(w).alias("i")).where("rr IS NOT NULL")
    judged = beats.ectopic_filter(b, INGEST)
    labelled = ev.where("event_type = 'view'").groupBy("entity").agg(F.floor(F.min("us") / 86400).alias("s0"), F.floor(F.max("us") / 86400).alias("s1"))
    off = F.when(F.col("keep"), 0.0).otherwise(1.0)
    inside = (US() >= F.col("s0")) & (US() < F.col("s1"))
    s = judged.join(labelled, "entity").groupBy("entity").agg(F.count("*").alias("n_beats"), r(F.avg(off)).alias("removed"), r(F.avg(F.when(inside, off))).alias("removed_scored"))
    rates = bin_end_means(judged.where("keep").withColumn("rate", F.lit(60000) / F.col("rr")), 5, F.col("rate"))
    return rates.join(s, "entity").where("removed_scored <= 0.2")


@query("lag_delta", f"{EV} SELECT event_id, round((us - lag(us) OVER {BY})::DOUBLE / 1e6, 6) AS gap_s FROM ev")
def lag_delta(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", r(series.lag_gap(US())).alias("gap_s"))


@query("rising_edge", f"{EV} SELECT event_id FROM (SELECT *, event_type = 'error' AND lag(event_type) OVER {BY} <> 'error' AS e FROM ev) WHERE e")
def rising_edge(ev: DataFrame) -> DataFrame:
    return ev.withColumn("e", series.rising(F.col("event_type") == "error")).where("e").select("event_id")


@query("change_point", f"{EV} SELECT event_id, event_type FROM (SELECT *, event_type <> lag(event_type) OVER {BY} AS c FROM ev) WHERE c")
def change_point(ev: DataFrame) -> DataFrame:
    return ev.withColumn("c", series.changed(F.col("event_type"))).where("c").select("event_id", "event_type")


RUNS = f"""{EV}, o AS (SELECT *, value > 34 AS o FROM ev), g AS (SELECT *, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER {BY} AS g FROM o),
runs AS (SELECT entity, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM g WHERE o GROUP BY entity, g)"""


@query("true_runs", f"{RUNS} SELECT * FROM runs WHERE n >= 2")
def true_runs(ev: DataFrame) -> DataFrame:
    return series.runs(ev, V() > 34).where("n >= 2")


@query("consecutive_run_ge3", f"{RUNS} SELECT entity, min(start_us) AS start_us FROM runs WHERE n >= 3 GROUP BY entity")
def consecutive_run_ge3(ev: DataFrame) -> DataFrame:
    return series.runs(ev, V() > 34).where("n >= 3").groupBy("entity").agg(F.min("start_us").alias("start_us"))


@query("quiet_runs", f"""{EV}, q AS (SELECT entity, us, CASE WHEN us - lag(us) OVER {BY} <= 86400000000 THEN 0 ELSE 1 END AS new FROM (SELECT *, value < 50 AS o FROM ev) WHERE o),
g AS (SELECT *, sum(new) OVER {BY} AS g FROM q), u AS (SELECT entity, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM g GROUP BY entity, g)
SELECT * FROM u WHERE end_us - start_us >= 43200000000""")
def quiet_runs(ev: DataFrame) -> DataFrame:
    from ..operators.intervals import merged

    points = ev.where(V() < 50).select("entity", US().alias("start_us"), US().alias("end_us"))
    return merged(points, ["entity"], DAY).where(F.col("end_us") - F.col("start_us") >= DAY // 2 * series.S)


@query("round_trips", f"""{EV}, e AS (SELECT *, value > 50 AND lag(value) OVER {BY} <= 50 AS up, value <= 50 AND lag(value) OVER {BY} > 50 AS down FROM ev),
n AS (SELECT *, min(CASE WHEN down THEN us END) OVER (PARTITION BY entity ORDER BY us RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM e)
SELECT entity, count(*) AS trips FROM n WHERE up AND back - us <= 86400000000 GROUP BY entity""")
def round_trips(ev: DataFrame) -> DataFrame:
    from ..operators.joins import next_event

    edges = ev.withColumn("up", series.rising(V() > 50)).withColumn("down", series.rising(V() <= 50))
    return next_event(edges, F.col("down"), "back_s").where(F.col("up") & (F.col("back_s") <= DAY)).groupBy("entity").agg(F.count("*").alias("trips"))


@query("gradient", f"""{EV} SELECT event_id, round(coalesce((lead(value) OVER {BY} - lag(value) OVER {BY}) / 2, lead(value) OVER {BY} - value, value - lag(value) OVER {BY}), 6) AS gradient FROM ev""")
def gradient(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", r(series.gradient(V())).alias("gradient"))


@query("boxcar15", f"""{EV}, b AS (SELECT event_id, value, row_number() OVER {BY} AS i, count(*) OVER (PARTITION BY entity) AS n, entity FROM ev),
ends AS (SELECT entity, max(value) FILTER (i = 1) AS a, max(value) FILTER (i = n) AS z FROM b GROUP BY entity)
SELECT event_id, round((sum(value) OVER (PARTITION BY entity ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) + greatest(8 - i, 0) * a + greatest(7 - n + i, 0) * z) / 15, 6) AS smooth FROM b JOIN ends USING (entity)""")
def boxcar15(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", r(series.boxcar(V())).alias("smooth"))


@query("baseline_window", f"""{EV}, f AS (SELECT *, us - min(us) OVER (PARTITION BY entity) <= 432000000000 AND value < 100 AS early FROM ev)
SELECT entity, round(coalesce(quantile_cont(value, 0.5) FILTER (early), quantile_cont(value, 0.5)), 6) AS baseline FROM f GROUP BY entity""")
def baseline_window(ev: DataFrame) -> DataFrame:
    early = (US() - F.col("first") <= 5 * DAY * series.S) & (V() < 100)
    first = ev.withColumn("first", F.min("us").over(Window.partitionBy("entity")))
    q = lambda x: F.percentile(x, F.lit(0.5))
    return first.groupBy("entity").agg(r(F.coalesce(q(F.when(early, V())), q(V()))).alias("baseline"))


@query("deviation_from_own_mean", f"{EV} SELECT event_id, round(avg(value) OVER (PARTITION BY entity) - value, 9) AS dev FROM ev")
def deviation_from_own_mean(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", r(F.avg("value").over(Window.partitionBy("entity")) - V(), 9).alias("dev"))


@query("z_normalize", f"{EV} SELECT event_id, round(CASE WHEN stddev_pop(value) OVER p > 0 THEN (value - avg(value) OVER p) / stddev_pop(value) OVER p ELSE value - avg(value) OVER p END, 6) AS z FROM ev WINDOW p AS (PARTITION BY entity)")
def z_normalize(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", r(series.z_normalized(V(), Window.partitionBy("entity"))).alias("z"))


@query("epoch_gap", f"""{EV}, g AS (SELECT entity, lead(us) OVER {BY} - us - floor(value * 10)::BIGINT * 60000000 AS gap FROM ev)
SELECT entity, count(*) FILTER (abs(gap) > 500000) AS n_gaps, round(max(gap)::DOUBLE / 1e6, 6) AS max_gap_s FROM g GROUP BY entity""")
def epoch_gap(ev: DataFrame) -> DataFrame:
    gap = F.lead("us").over(series.along()) - US() - F.floor(V() * 10) * 60_000_000
    g = ev.select("entity", gap.alias("gap"))
    return g.groupBy("entity").agg(F.count(F.when(F.abs("gap") > 500_000, 1)).alias("n_gaps"), r(F.max("gap").cast("double") / 1e6).alias("max_gap_s"))


GRID = f"""{EV}, p AS (SELECT entity, us, value AS v, lead(us) OVER {BY} AS u2, lead(value) OVER {BY} AS v2, min(us) OVER (PARTITION BY entity) AS u0 FROM ev),
g AS (SELECT entity, us, v, u2, v2, u0 + k * 86400000000 AS gt FROM p, unnest(range(ceil((us - u0) / 86400000000)::BIGINT, CASE WHEN u2 IS NULL THEN ceil((us - u0) / 86400000000)::BIGINT + CASE WHEN (us - u0) % 86400000000 = 0 THEN 1 ELSE 0 END ELSE ceil((u2 - u0) / 86400000000)::BIGINT END)) AS x(k))
SELECT entity, gt AS us, round(CASE WHEN u2 IS NULL THEN v ELSE v + (v2 - v) * ((gt - us) / (u2 - us)) END, 6) AS value FROM g"""


@query("interpolate_grid", GRID)
def interpolate_grid(ev: DataFrame) -> DataFrame:
    return series.grid(ev, DAY).select("entity", "us", r("value").alias("value"))


FEATURES = FeatureWindows(spread_s=3 * DAY, short_s=3 * DAY, base_s=7 * DAY, slope_s=3 * DAY, warm_up_s=2 * DAY)
DECISIONS = f"""{EV}, f AS (SELECT *, stddev_samp(value) OVER {W3} AS sd, CASE WHEN count(*) OVER {W3} >= 3 AND count(*) OVER {W7} >= 5 THEN avg(value) OVER {W3} - avg(value) OVER {W7} END AS drop_vs_base, {SLOPE} AS slope,
us - min(us) OVER (PARTITION BY entity) >= 172800000000 AS warm, (min(CASE WHEN event_type = 'error' THEN us END) OVER (PARTITION BY entity ORDER BY us RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - us)::DOUBLE / 1e6 AS tau FROM ev)
, ready AS (SELECT event_id, entity, us, event_type, sd, drop_vs_base, slope, tau, coalesce(tau <= 259200, false)::INT AS y FROM f WHERE warm AND sd IS NOT NULL AND drop_vs_base IS NOT NULL AND slope IS NOT NULL AND event_type <> 'error')"""


def points(ev: DataFrame) -> DataFrame:
    """Decision points: causal features, seconds to the next error, and the
    label of three days' lead; rows that are errors themselves decide nothing."""
    from ..operators.joins import next_event

    found = next_event(series.features(ev, FEATURES), F.col("event_type") == "error").where("ready AND event_type <> 'error'")
    return found.select("event_id", "entity", "us", "event_type", "sd", F.col("drop").alias("drop_vs_base"), (F.col("slope") / 60 * DAY).alias("slope"), "tau", F.coalesce(F.col("tau") <= 3 * DAY, F.lit(False)).cast("int").alias("y"))


@query("decision_points", f"{DECISIONS} SELECT event_id, round(sd, 6) AS sd, round(drop_vs_base, 6) AS drop_vs_base, round(slope, 5) AS slope, round(tau, 6) AS tau, y FROM ready")
def decision_points(ev: DataFrame) -> DataFrame:
    return points(ev).select("event_id", r("sd").alias("sd"), r("drop_vs_base").alias("drop_vs_base"), r("slope", 5).alias("slope"), r("tau").alias("tau"), "y")
