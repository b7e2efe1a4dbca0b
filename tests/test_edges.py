"""Small cases worked out by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from driftline.functions import scalar
from driftline.operators import beats, evaluate, firing, intervals, series
from driftline.params import BeatRules, FiringRules

S = 1_000_000


def at(spark, *pairs, **more):
    return spark.createDataFrame([(1, int(t * S), float(v)) for t, v in pairs], "entity int, us long, value double")


def spans(spark, *pairs, minutes=False, label="x"):
    unit = 60 * S if minutes else S
    return spark.createDataFrame([(1, int(a * unit), int(b * unit), label) for a, b in pairs], "entity int, start_us long, end_us long, label string")


def column(df, c, order="us"):
    return [r[0] for r in df.orderBy(order).select(c).collect()]


def test_trailing_sd_is_closed(spark):
    df = at(spark, (0, 1), (60, 3), (121, 5)).withColumn("sd", series.trailing_sd(F.col("value"), series.trailing(60)))
    a, b, c = column(df, "sd")
    assert a is None and math.isclose(b, math.sqrt(2)) and c is None


def test_half_open_window(spark):
    df = at(spark, (0, 1), (60, 1)).withColumn("n", F.count("*").over(series.trailing(60, closed=False)))
    assert column(df, "n") == [1, 1]


def test_union_merges_touching_and_nested(spark):
    out = intervals.union_minutes(spans(spark, (0, 10), (10, 20), (30, 40), (32, 35), minutes=True), ["entity"])
    assert out.first()["minutes"] == 30


def test_sessions_chain_over_an_hour(spark):
    assert intervals.merged(spans(spark, (0, 10), (70, 80), (141, 150), minutes=True), ["entity"], 3600).count() == 2
    assert intervals.merged(spans(spark, (0, 100), (10, 20), (150, 160), minutes=True), ["entity"], 3600).count() == 1


def test_rising_edges(spark):
    df = at(spark, *enumerate([3, 3, 2, 3, 3, 0, 3]))
    on = F.col("value") == 3
    edges = lambda first: [t for t, e in df.withColumn("e", series.rising(on, count_first=first)).orderBy("us").select(F.col("us") / S, "e").collect() if e]
    assert edges(False) == [3, 6] and edges(True) == [0, 3, 6]


def test_first_sustained_run(spark):
    out = series.runs(at(spark, *enumerate([1, 1, 0, 1, 1, 1])), F.col("value") == 1).where("n >= 3")
    assert out.first()["start_us"] == 3 * S


def test_next_event_is_strictly_after(spark):
    from driftline.operators.joins import next_event_of

    samples = spark.createDataFrame([(1, 100 * S)], "entity int, us long")
    events = spark.createDataFrame([(1, 100 * S), (1, 130 * S)], "entity int, us long")
    assert next_event_of(samples, events).first()["tau"] == 30


def test_no_event_is_never_positive(spark):
    df = spark.createDataFrame([(None,), (200.0,)], "tau double")
    assert sorted(r["y"] for r in evaluate.lead_labels(df, [240.0]).collect()) == [0, 1]


def test_record_highs_and_fire_times(spark):
    highs = series.record_highs(at(spark, (0, 0.2), (1, 0.1), (2, 0.2), (3, 0.5), (4, 0.4), (5, 0.6)))
    assert column(highs, "value") == [0.2, 0.5, 0.6]
    th = spark.createDataFrame([(0.5,), (0.55,), (0.7,)], "threshold double")
    fired = {r["threshold"]: r["fire_us"] // S for r in firing.fire_times(highs.withColumnRenamed("value", "high"), th).collect()}
    assert fired == {0.5: 3, 0.55: 5}


def test_outcomes(spark):
    rows = spark.createDataFrame([(579,), (580,), (1060,), (1061,), (None,)], "t long")
    got = [r[0] for r in rows.select(firing.outcome(F.col("t") * S, F.lit(1000 * S), 420, 60)).collect()]
    assert got == ["early", "hit", "hit", "late", "nofire"]


def test_sustain_needs_most_of_its_span(spark):
    rules = FiringRules(sustain_s=30, tolerance_s=10)
    for span, kept in ((19.9, 1), (20.0, 2)):
        df = at(spark, (0, 1), (span, 2)).withColumnRenamed("value", "score")
        held, ok = series.sustained_min(F.col("score"), F.col("us"), rules.sustain_s, rules.tolerance_s)
        assert df.select(ok.alias("ok")).where("ok").count() == kept - 1


def test_bin_ends_and_half_even(spark):
    from driftline.operators.stats import bin_end_means

    out = bin_end_means(at(spark, (5.0, 60), (5.1, 61)), 5, F.col("value"))
    assert {(r["end_us"] // S, r["mean"]) for r in out.collect()} == {(5, 60.0), (10, 61.0)}
    half = spark.createDataFrame([(62.5,), (63.5,)], "x double")
    assert [r[0] for r in half.select(F.bround("x")).collect()] == [62.0, 64.0]


def test_bin_means_are_sums_in_the_order_of_time(spark):
    """Just a half in that order, a little more in another one, however the rows are dealt."""
    from driftline.operators.stats import bin_end_means

    values = [60.66, 24.42, 86.24, 42.68]
    for order, want in ((values, 54.0), (values[::-1], 53.0)):
        rows = [(1, k, v) for k, v in enumerate(order, 1)]
        for dealt in (rows, rows[::-1]):
            df = spark.createDataFrame(dealt, "entity int, us long, value double").coalesce(1)
            assert [r["mean"] for r in bin_end_means(df, 5, F.col("value")).collect()] == [want]


def test_rates_without_a_gap_are_infinite(spark):
    gaps = spark.createDataFrame([(0.0,), (-0.0,), (None,), (1000.0,)], "x double")
    assert [r[0] for r in gaps.select(scalar.rate_of(F.col("x"))).collect()] == [math.inf, -math.inf, None, 60.0]


def test_ectopic_beats(spark):
    def kept(last):
        rows = [(1, i, i * S, v) for i, v in enumerate([1000.0] * 11 + [last, 1000.0])]
        return [r["keep"] for r in beats.ectopic_filter(spark.createDataFrame(rows, "entity int, i int, us long, rr double")).orderBy("i").collect()]

    assert kept(1201.0) == [True] * 11 + [False, True]
    assert all(kept(1200.0))
    few = spark.createDataFrame([(1, i, i * S, v) for i, v in enumerate([1000.0] * 5 + [1900.0])], "entity int, i int, us long, rr double")
    assert all(r["keep"] for r in beats.ectopic_filter(few, BeatRules()).collect())


def test_durations_are_rounded_by_their_binary_value(spark):
    """As f"{x:.1f}" does it: 69 s is 1.1499999999999999 minutes, 63 s is 1.05000000000000004."""
    cases = [0.0, 0.25, 0.35, 12.0, 59.94, 59.96, 60.0, 63.0, 69.0, 75.0, 81.0, 3599.0, 3600.0, 3618.0, 3654.0, 5418.0, 86400.0]
    df = spark.createDataFrame([(x,) for x in cases], "s double")
    want = [f"{x:.1f}s" if x < 60 else f"{x / 60:.1f}m" if x < 3600 else f"{x / 3600:.2f}h" for x in cases]
    assert [r[0] for r in df.select(scalar.duration_text(F.col("s"))).collect()] == want
    assert want[3] == "12.0s" and want[7] == "1.1m" and want[8] == "1.1m"


def test_fixed_text_is_what_python_prints(spark):
    import random

    rng = random.Random(4)
    cases = [rng.uniform(-1000, 1000) for _ in range(300)] + [k / 8 for k in range(-80, 80)] + [k / 1000 for k in range(0, 3000, 5)] + [0.05, 0.15, 0.25, 2.675, 1e9 + 0.5]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x double")
    for digits in (0, 1, 2, 4):
        got = {r["i"]: r["t"] for r in df.select("i", scalar.fixed_text(F.col("x"), digits).alias("t")).collect()}
        assert all(got[i] == f"{x:.{digits}f}" for i, x in enumerate(cases))


def test_offsets_and_zones(spark):
    cases = [(3723.25, "+1h02m03.25s"), (-59.0, "-0h00m59.00s"), (0.0, "+0h00m00.00s"), (35_999.5, "+9h59m59.50s")]
    df = spark.createDataFrame(cases, "s double, t string")
    assert all(r[0] == r[1] for r in df.select(scalar.offset_text(F.col("s")), "t").collect())
    # 35 zones: 4:30, 6:30 and 8:45 are none; of two as near the whole hour counts
    zones = [(270 * 60.0, 240), (390 * 60.0, 360), (525 * 60.0, 540), (345 * 60.0, 345), (-570 * 60.0, -570), (225 * 60.0, 240), (15 * 3600.0, 840), (30 * 60.0, 0), (337.5 * 60.0, 330)]
    df = spark.createDataFrame(zones, "s double, m int")
    assert len(scalar.ZONE_MINUTES) == 35
    assert all(r[0] == r[1] for r in df.select(scalar.nearest_zone(F.col("s")).minutes, "m").collect())


def test_full_width_names_match(spark):
    df = spark.createDataFrame([("Ｆｉｅｌｄ\u2009Ｗatch",)], "s string")
    assert df.select(scalar.source_matches(F.col("s"), "field\u00a0WATCH")).first()[0]


def test_quartiles_of_few_values_are_the_ends_in_time(spark):
    rows = [(1, 0, 9.0), (1, 1, 3.0), (1, 2, 5.0), (2, 0, 4.0), *[(3, k, v) for k, v in enumerate((4.0, 1.0, 3.0, 2.0))]]
    df = spark.createDataFrame(rows, "g int, us long, value double")
    got = {r["g"]: (r["q1"], r["q3"]) for r in series.outer_quartiles(df, "value", ["g"]).collect()}
    assert got == {1: (9.0, 5.0), 2: (4.0, 4.0), 3: (1.25, 3.75)}


def test_z_of_a_flat_series_is_the_deviation(spark):
    from pyspark.sql import Window

    df = at(spark, (0, 7), (1, 7)).withColumn("z", series.z_normalized(F.col("value"), Window.partitionBy("entity")))
    assert column(df, "z") == [0.0, 0.0]


def test_the_first_clock_may_be_past_midnight(spark):
    from driftline.sources import text

    rows = spark.createDataFrame([("a", 0, "00:10:00"), ("a", 1, "23:50:00"), ("a", 2, "00:05:00"), ("b", 0, "21:40:00"), ("b", 1, "22:00:00")], "file string, line int, clock string")
    got = [r["t"] for r in text.clock_times(rows, start_s=F.lit(22 * 3600)).orderBy("file", "line").collect()]
    # half an hour before the start is no midnight
    assert got == [86_400 + 600, 86_400 + 85_800, 2 * 86_400 + 300, 78_000, 79_200]


def test_last_bin_takes_a_sample_on_its_end(spark):
    from driftline.operators.stats import rms, time_bins

    out = time_bins(at(spark, (0, 3), (4, 4), (12, 5), (15, 12)), 5, rms(F.col("value")), "rms", origin_us=F.lit(0))
    assert {r["b"]: round(r["rms"], 9) for r in out.collect()} == {0: round(12.5**0.5, 9), 1: 0.0, 2: round(84.5**0.5, 9)}


def test_density_reason_is_the_first_one_with_its_figures(spark):
    from driftline.operators.stats import cadence, density_gate

    slow = [(1, k * 30 * S) for k in range(11)]
    bursts = [(2, k * 20 * S + j) for k in range(10) for j in (0, 1)] + [(2, 200 * S)]
    gappy = [(3, k * 16 * S) for k in range(6)] + [(3, 80 * S + k) for k in range(1, 5)]
    df = spark.createDataFrame([*slow, *bursts, *gappy, (4, 0)], "entity int, us long")
    got = {r["entity"]: r["reason"] for r in density_gate(cadence(df)).collect()}
    assert got == {1: "rate 2.20/min < 4.0/min required", 2: "", 3: "median gap 16.0s > 15s required", 4: "rate 0.00/min < 4.0/min required"}


def test_quantiles(spark):
    df = at(spark, *enumerate([1, 2, 3, 4]))
    assert df.agg(F.percentile("value", F.lit(0.25))).first()[0] == 1.75
    assert series.ranked_quantile(df, "value", 0.25, "q", ["entity"]).first()["q"] == 1.25


def test_best_overlap_takes_the_first_of_equals(spark):
    left = spans(spark, (0, 100)).withColumn("id", F.lit(1))
    right = spark.createDataFrame([(1, 0, 10 * S, "b", 2), (1, 50 * S, 60 * S, "a", 1)], "entity int, start_us long, end_us long, label string, id int")
    assert intervals.best_overlap(left, right, "id", "id").first()["r_id"] == 1


def test_clip(spark):
    rows = intervals.clipped(spans(spark, (-5, 10), (60, 70)), F.lit(0), F.lit(60 * S)).orderBy("start_us").collect()
    assert (rows[0]["clip_start_us"], rows[0]["clip_end_us"], rows[0]["outside"]) == (0, 10 * S, False)
    assert rows[1]["outside"]


def test_epoch_index_floors(spark):
    assert spark.range(1).select(scalar.epoch_index(F.lit(-0.5), F.lit(0.0), 30)).first()[0] == -1


def test_nearest_interval_by_gap(spark):
    naps = spans(spark, (100, 110), (200, 210), (0, 1)).withColumn("id", (F.col("start_us") / S).cast("long"))
    sessions = spark.createDataFrame([(1, a * S, b * S, i) for a, b, i in ((10, 90, 1), (20, 95, 2), (118, 130, 3), (205, 300, 4), (208, 220, 5))], "entity int, start_us long, end_us long, id long")
    got = {r["l"]: (r["r"], r["gap_us"] // S) for r in intervals.nearest_by_gap(naps.withColumnRenamed("id", "l"), sessions.withColumnRenamed("id", "r"), "l", "r").collect()}
    assert got == {100: (2, 5), 200: (4, 0), 0: (1, 9)}


def test_clip_statistics(spark):
    out = intervals.clip_statistics(spans(spark, (-5, 10), (50, 75), (60, 70), (-9, 0)), F.lit(0), F.lit(60 * S), ["entity"]).first()
    assert tuple(out)[1:] == (2, 5 * S, 15 * S, 2)


def test_alignment_table_by_hand(spark):
    """Labels that lie an epoch late; and entities without enough to probe."""
    from driftline.operators.align import alignment_table, verdict
    from driftline.params import AlignmentRules, DensityGate

    rules = AlignmentRules(epoch_s=30, reach=3, min_samples=2, max_plateau_s=30, min_separation=1.5)
    labels = [(1, k, x) for k, x in enumerate("wwwnnnwwnn")] + [(2, 0, "w"), (3, 0, "w"), (3, 1, "w")]
    value = {"w": 5.0, "n": 1.0}
    samples = [(1, (k + 1) * 30 * S + j * 5 * S, k + 1, value[x]) for k, x in enumerate("wwwnnnwwnn") for j in range(6)]
    samples += [(2, 0, 0, 1.0), (3, 0, 0, 1.0), (3, S, 0, 2.0), (3, 2 * S, 0, None)]
    table = alignment_table(spark.createDataFrame(samples, "entity int, us long, k long, value double"), spark.createDataFrame(labels, "entity int, k long, label string"), F.col("label") == "w", F.col("label") == "n", rules, DensityGate())
    rows = {r["entity"]: r for r in table.collect()}
    one = rows[1]
    assert (one["usable"], one["reject"], one["best_m"], one["best"], one["plateau_s"]) == (True, "", 1, 4.0, 0)
    assert (one["n_onsets"], one["n_covered"], one["first_onset"], one["cover"], one["contiguity"], one["in_gap_s"]) == (2, 2, 3, 1.0, 1.0, 5.0)
    assert rows[2]["reject"] == "too_few_HR_samples" and rows[3]["reject"].startswith("no_probe(") and not rows[3]["usable"] and rows[3]["first_onset"] == -1
    assert verdict(table, rules).first()["verdict"] == "constant"


def test_alignment_reasons_in_their_order(spark):
    from driftline.operators.align import alignment_table
    from driftline.params import AlignmentRules, DensityGate

    rules = AlignmentRules(epoch_s=30, reach=2, min_samples=2, max_plateau_s=60, min_separation=1.5)
    labels = spark.createDataFrame([(1, k, "w" if k < 10 else "n") for k in range(20)], "entity int, k long, label string")
    samples = spark.createDataFrame([(1, k * 30 * S, k, 2.25 if k < 10 else 1.0) for k in range(20)], "entity int, us long, k long, value double")
    row = alignment_table(samples, labels, F.col("label") == "w", F.col("label") == "n", rules, DensityGate()).first()
    assert row["reject"].split("; ") == ["sep 1.25<1.5", "density rate=2.1/min gap=30.0s"] or row["reject"].startswith("sep 1.25<1.5; plateau ")


def test_alignment_verdicts(spark):
    from driftline.operators.align import verdict
    from driftline.params import AlignmentRules

    def of(*rows):
        return verdict(spark.createDataFrame(list(rows), "best_m long, best double, at_zero double"), AlignmentRules(epoch_s=30)).first()["verdict"]

    assert of((0, 3.0, 3.0), (4, 3.1, 3.0)) == "clean"  # positive at 0, and hardly better elsewhere
    assert of((4, 3.0, 1.0), (5, 3.0, 1.0)) == "constant"
    assert of((4, 3.0, -1.0), (40, 3.0, 1.0)) == "per entity"
    assert of((None, None, None)) == "none"


def test_plateau_spans_all_near_shifts(spark):
    from driftline.operators.align import best_shift
    from driftline.params import AlignmentRules

    swept = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.95), (1, 2, 0.1), (1, 3, 1.91)], "entity int, m int, separation double")
    out = best_shift(swept, AlignmentRules()).first()
    assert (out["best_m"], out["plateau_epochs"]) == (0, 3)


def test_lift_verdict(spark):
    """PASS from 0.04 with all folds up; FAIL below 0.02, or with two folds not up."""
    lifts = {1: (0.040, -0.026, 0.037, 0.030, 0.040), 2: (0.05, 0.04, 0.04, 0.04, 0.04), 3: (0.03, 0.03, 0.03, 0.03, 0.03), 4: (0.01, 0.02, 0.02, 0.01, 0.02), 5: (0.2, 0.2, 0.2, 0.0, -0.01), 6: (0.2, 0.2, 0.2, 0.2, 0.0)}
    rows = [(g, 0.6, 0.6 + d) for g, ds in lifts.items() for d in ds]
    out = {r["g"]: r for r in evaluate.lift_verdict(spark.createDataFrame(rows, "g int, a double, b double"), "a", "b", ["g"]).collect()}
    assert {g: r["verdict"] for g, r in out.items()} == {1: "INCONCLUSIVE", 2: "PASS", 3: "INCONCLUSIVE", 4: "FAIL", 5: "FAIL", 6: "INCONCLUSIVE"}
    assert out[1]["gains"] == 4


def test_source_names_match(spark):
    df = spark.createDataFrame([(f"Robin's Field{chr(0xA0)}Watch",)], "s string")
    assert df.select(scalar.source_matches(F.col("s"), "field watch")).first()[0]


def test_local_night(spark):
    df = spark.createDataFrame([("2026-05-15 00:30:00 -0800",)], "s string")
    assert str(df.select(scalar.night_of(F.col("s"))).first()[0]) == "2026-05-14"


def test_auroc_with_ties_and_monotone_transform(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)]
    df = spark.createDataFrame(rows, "s double, y int").withColumn("g", F.lit(1))
    a = evaluate.auroc(df, "s", "y", ["g"]).first()["auroc"]
    assert a == 0.875
    assert evaluate.auroc(df.withColumn("s", F.exp("s") * 3), "s", "y", ["g"]).first()["auroc"] == a


def test_splines_and_spectra():
    import numpy as np

    x = np.array([0.0, 1, 2.5, 4, 5, 7])
    cubic = lambda t: t**3 - 2 * t**2 + 3
    at_points = np.linspace(0, 7, 50)
    assert np.allclose(beats.not_a_knot(x, cubic(x), at_points), cubic(at_points))
    f, p = beats.welch(np.sin(2 * np.pi * 0.25 * np.arange(4096) / 4), 4.0)
    assert abs(f[p.argmax()] - 0.25) < 0.01 and abs(p.sum() * (f[1] - f[0]) - 0.5) < 0.02


def test_group_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(g,) for g in range(9) for _ in range(g + 1)], "g int")
    folds = {r["g"]: r["fold"] for r in evaluate.group_folds(df, "g", 3).collect()}
    loads = [sum(g + 1 for g, f in folds.items() if f == k) for k in range(3)]
    assert len(folds) == 9 and max(loads) - min(loads) <= 3


def test_group_folds_are_even_beyond_what_the_driver_places_one_by_one(spark):
    from pyspark.sql import functions as F

    many = spark.range(120_000).select(F.col("id").alias("g"))
    one = spark.range(60_000).select(F.lit(-1).cast("long").alias("g"))
    df = many.unionByName(one)
    placed = evaluate.group_folds(df, "g", 3)
    assert placed.count() == 120_001
    loads = [r["count"] for r in df.join(placed, "g").groupBy("fold").count().collect()]
    assert len(loads) == 3 and max(loads) - min(loads) < 1_000


def test_quantiles_of_huge_groups_by_rank(spark):
    import random

    from driftline.operators.stats import ranked_quantiles

    rng = random.Random(8)
    rows = [(g, rng.choice([None, rng.random(), rng.randint(0, 5) * 1.0])) for g in range(3) for _ in range(900)] + [(7, 2.5), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    ps = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.995, "e": 1.0}
    got = {r["g"]: tuple(r)[1:] for r in ranked_quantiles(df, "v", ps, ["g"]).collect()}
    want = {r["g"]: tuple(r["q"]) for r in df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", list(ps.values())).alias("q")).collect()}
    assert got.keys() == want.keys() == {0, 1, 2, 7}
    assert all(math.isclose(x, y) for g in want for x, y in zip(got[g], want[g], strict=True))


def test_session_summary_of_overlapping_labels(spark):
    rows = [(1, 0, 60, "a"), (1, 30, 50, "a"), (1, 40, 90, "b"), (1, 100, 110, "a"), (1, 800, 810, "b")]
    df = spark.createDataFrame([(e, a * 60 * S, b * 60 * S, x, x) for e, a, b, x in rows], "entity int, start_us long, end_us long, label string, source string")
    one, two = intervals.session_summary(df, ["a", "b"], ["a", "b"], 3600).orderBy("start_us").collect()
    assert (one["a_min"], one["b_min"], one["asleep_min"], one["duration_min"], one["records"], one["sources"]) == (70, 50, 100, 110, 4, "a,b")
    assert (two["a_min"], two["b_min"], two["asleep_min"]) == (0, 10, 10)


def test_offset_sweep_of_all_shifts_against_a_plain_one(spark, monkeypatch):
    """1,441 shifts by transforms, over one and over many chunks of epochs."""
    import numpy as np

    from driftline.operators import align
    from driftline.params import AlignmentRules

    rng = np.random.default_rng(2)
    samples, labels = [], []
    for e in (1, 2, None):
        own = np.unique(rng.integers(-900, 1_900, 700))
        samples += [(e, int(k), float(v)) for k in own for v in rng.normal(60, 9, rng.integers(1, 4))] + [(e, 5, None)]
        labels += [(e, int(k), str(rng.choice(["N3", "W", "R"]))) for k in np.unique(rng.integers(0, 960, 500))]
    samples.append((3, 0, 1.0))
    labels.append((4, 0, "N3"))
    s_df, l_df = spark.createDataFrame(samples, "entity long, k long, value double"), spark.createDataFrame(labels, "entity long, k long, label string")
    rules = AlignmentRules(min_samples=30)
    want = {}
    for e in (1, 2):
        high, low = ({k for x, k, c in labels if x == e and c == name} for name in ("N3", "W"))
        for m in range(-720, 721):
            a, b = ([v for x, k, v in samples if x == e and v is not None and k - m in which] for which in (high, low))
            if a or b:
                want[e, m] = (len(a), len(b), np.mean(a) - np.mean(b) if min(len(a), len(b)) >= 30 else None)
    for chunk in (16_384, 100):
        monkeypatch.setattr(align, "CHUNK", chunk)
        got = {(r["entity"], r["m"]): (r["n_high"], r["n_low"], r["separation"]) for r in align.sweep(s_df, l_df, F.col("label") == "N3", F.col("label") == "W", rules).collect()}
        assert got.keys() == want.keys()
        for key, (n, k, x) in want.items():
            assert got[key][:2] == (n, k) and (got[key][2] is None) == (x is None) and (x is None or abs(got[key][2] - x) < 1e-9)
