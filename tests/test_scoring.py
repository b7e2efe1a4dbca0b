"""Scoring queries that SQL can't say, against plain expectations."""

from __future__ import annotations

import math
import random

from driftline import plans
from driftline.operators import evaluate, firing, models
from driftline.plans import scoring


def test_forest_is_scored_over_five_folds(spark, sf_dir):
    found = plans.queries()["random_forest_auroc"](spark, sf_dir).collect()
    assert sorted(r["fold"] for r in found) == [0, 1, 2, 3, 4]


def test_forward_selection_fits_models_and_offers_shapes(spark, sf_dir, monkeypatch):
    seen, fits = [], []

    def measure(candidates, fixed, evaluator):
        seen.extend([*fixed, *candidates])
        for mean, least in evaluator([["sd"], ["sd", "ac1"]]):
            assert 0 <= least <= mean <= 1
        return fixed

    whole = models.fit_logistic
    monkeypatch.setattr(evaluate, "forward_selection", measure)
    monkeypatch.setattr(models, "fit_logistic", lambda df, sets, targets, *rest: fits.append((len(sets), len(targets))) or whole(df, sets, targets, *rest))
    plans.queries()["forward_selection"](spark, sf_dir)
    assert fits == [(2, len(scoring.READ_LEADS))]  # both sets at all leads in one fit
    assert set(seen) == {"sd", "drop_vs_base", "slope", "ac1", "curvature", "reversals"}


def test_forward_selection_stops():
    value = {("a",): (0.60, 0.55), ("a", "b"): (0.64, 0.56), ("a", "c"): (0.62, 0.56), ("a", "b", "c"): (0.70, 0.50)}
    asked = []
    kept = evaluate.forward_selection(["b", "c"], ["a"], lambda sets: asked.append(len(sets)) or [value[tuple(x)] for x in sets])
    assert kept == ["a", "b"] and asked == [1, 2, 1]


def test_learnability_models_have_a_row_for_each_lead_and_fold(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(scoring, "SMALL_FOREST", models.ForestRules(trees=5, depth=4))
    found = plans.queries()["learnability_models"](spark, sf_dir).collect()
    assert {(r["lead_s"], r["fold"]) for r in found if r["model"] == "logistic"} == {(lead, k) for lead in scoring.SWEPT for k in range(5)}
    assert {r["lead_s"] for r in found if r["model"] == "forest"} == set(scoring.READ_LEADS)
    assert all(0 < r["auprc"] <= 1 for r in found if r["positives"])


def test_treatment_models_give_folds_and_one_verdict(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(scoring, "SMALL_FOREST", models.ForestRules(trees=5, depth=4))
    rows = plans.queries()["treatment_models"](spark, sf_dir).collect()
    assert {(r["arm"], r["model"]) for r in rows} == {("all", "lr"), ("all", "rf"), ("subset", "lr")} and len({r["verdict"] for r in rows}) == 1
    lr = [r["lift"] for r in rows if (r["arm"], r["model"]) == ("all", "lr")]
    passed = sum(lr) / len(lr) >= 0.04 and all(x > 0 for x in lr)
    assert len(lr) == 5 and passed == (rows[0]["verdict"] == "PASS")


def test_folds_and_models_have_plausible_values(spark, sf_dir):
    found = plans.queries()
    folds = found["group_kfold"](spark, sf_dir).collect()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert sum(r["n"] for r in folds) == events.count() and sum(r["entities"] for r in folds) == events.select("user_id").distinct().count() and len(folds) == 5
    logreg = found["logreg_auroc"](spark, sf_dir).collect()
    assert len(logreg) == 5 and all(0 <= r["auroc"] <= 1 for r in logreg if r["auroc"] is not None)


def plain_auroc(rows):
    up, down = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down)) if up and down else None


def plain_auprc(rows):
    positives = sum(y for _, y in rows)
    area = seen = tp = 0
    for score in sorted({s for s, _ in rows}, reverse=True):
        here = [y for s, y in rows if s == score]
        tp, seen = tp + sum(here), seen + len(here)
        area += sum(here) * tp / seen
    return area / positives if positives else None


def test_ranking_metrics_against_all_pairs(spark):
    """Many distinct scores and ties, over several parts of their range."""
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), rng.randint(0, 9) / 10]), int(rng.random() < 0.3)) for g in range(3) for _ in range(700)] + [(9, 0.5, 1)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    area = {r["g"]: r["auroc"] for r in evaluate.auroc(df, "s", "y", ["g"]).collect()}
    precision = {r["g"]: r["auprc"] for r in evaluate.auprc(df, "s", "y", ["g"]).collect()}
    for g in range(3):
        own = [(s, y) for k, s, y in rows if k == g]
        assert math.isclose(area[g], plain_auroc(own)) and math.isclose(precision[g], plain_auprc(own))
    assert area[9] is None and precision[9] == 1


def test_treatment_verdicts(spark):
    def of(lr, rf, subset):
        rows = [("all", k, 0.6, 0.6 + a, 0.6, 0.6 + b) for k, (a, b) in enumerate(zip(lr, rf, strict=True))] + [("subset", k, 0.6, 0.6 + c, 0.6, 0.6) for k, c in enumerate(subset)]
        r = evaluate.treatment_verdict(spark.createDataFrame(rows, "arm string, fold int, lr_base double, lr_treated double, rf_base double, rf_treated double")).first()
        return r["verdict"], r["gap_grows"]

    good, fair, bad = [0.05] * 5, [0.03] * 5, [0.0] * 5
    assert of(good, bad, bad) == ("PASS", False)
    assert of(fair, good, bad) == ("INCONCLUSIVE (nonlinear signal)", False)
    assert of(bad, fair, good) == ("FAIL + INCONCLUSIVE (subset)", True)
    assert of(bad, [0.04, 0.04, 0.04, 0.04, -0.01], bad) == ("FAIL", True)
    assert of(good, good, good) == ("PASS", False)


# surfaces against loops over entities

DAY_US = 86_400_000_000


def random_naps(seed=5, n=40):
    rng = random.Random(seed)
    naps, rows = [], []
    for e in range(n):
        onset = None if rng.random() < 0.3 else int(rng.uniform(3, 25) * DAY_US)
        naps.append((e, e % 5, 0, onset, int(rng.uniform(0, 3) * DAY_US)))
        times = sorted({int(rng.uniform(0, 30) * DAY_US) for _ in range(40)})
        rows += [(e, t, rng.random()) for t in times]
    return naps, rows


def held_plain(series, s):
    """(t, least score of the sustain) where its window spans enough."""
    out = []
    for i, (t, x) in enumerate(series):
        if s == 0:
            out.append((t, x))
            continue
        window = [(u, v) for u, v in series[: i + 1] if t - u <= s * 1_000_000]
        if t - window[0][0] >= (s - scoring.TOLERANCE) * 1_000_000:
            out.append((t, min(v for _, v in window)))
    return out


def first_at(held, threshold, low=-1, high=1 << 62):
    return next((t for t, x in held if x >= threshold and low <= t <= high), None)


def quantile(xs, p):
    xs = sorted(xs)
    at = (len(xs) - 1) * p
    return xs[int(at)] + (xs[min(int(at) + 1, len(xs) - 1)] - xs[int(at)]) * (at - int(at))


def test_surfaces_against_loops(spark):
    naps, rows = random_naps()
    series = {e: [(t, x) for k, t, x in rows if k == e] for e, *_ in naps}
    held = {(s, e): held_plain(series[e], s) for s in scoring.SUSTAINS for e in series}
    us = lambda s: s * 1_000_000
    early = lambda fire, onset, e: fire is not None and (onset is None or fire < onset - us(e))
    hit = lambda fire, onset, e, v: fire is not None and onset is not None and onset - us(e) <= fire <= onset + us(v)
    n_df = spark.createDataFrame(naps, "entity int, fold int, start_us long, onset_us long, sleep_us long")
    h_df = firing.held_scores(spark.createDataFrame(rows, "entity int, us long, score double"), scoring.SUSTAINS, scoring.TOLERANCE)
    # frontier
    got = {tuple(r)[:4]: tuple(r)[4:] for r in firing.frontier(firing.fire_steps(h_df, scoring.GRID), n_df, scoring.GRID, scoring.SUSTAINS, scoring.EARLIES, scoring.LATES).collect()}
    assert len(got) == 3 * 3 * 4 * 101
    onsets = sum(n[3] is not None for n in naps)
    for (s, e, v, threshold), (ff, hits) in got.items():
        if threshold * 100 % 10 > 0.5:
            continue
        fires = [(first_at(held[s, n[0]], threshold), n[3]) for n in naps]
        assert math.isclose(ff, sum(early(f, o, e) for f, o in fires) / len(naps)) and math.isclose(hits, sum(hit(f, o, e, v) for f, o in fires) / onsets)
    # thresholds of the other folds
    records = firing.records(h_df)
    limits = firing.guarded_thresholds(records, n_df, scoring.EARLIES, scoring.BUDGETS, 5)
    want = {}
    for s in scoring.SUSTAINS:
        for e in scoring.EARLIES:
            for fold in range(5):
                tops = [[x for t, x in held[s, n[0]] if n[3] is None or t < n[3] - us(e)] for n in naps if n[1] != fold]
                for b in scoring.BUDGETS:
                    want[s, e, b, fold] = quantile([max(x) for x in tops if x], 1 - b)
    found = {tuple(r)[:4]: r["threshold"] for r in limits.collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k]) for k in want)
    # the surface
    cells = {tuple(r)[:4]: tuple(r)[4:] for r in firing.event_surface(records, n_df, limits, scoring.LATES).collect()}
    assert len(cells) == 108
    for (s, e, v, b), values in cells.items():
        rates, falses = [], []
        for fold in range(5):
            own = [n for n in naps if n[1] == fold]
            fires = [(first_at(held[s, n[0]], found[s, e, b, fold]), n[3]) for n in own]
            events = sum(o is not None for _, o in fires)
            rates += [sum(hit(f, o, e, v) for f, o in fires) / events] if events else []
            falses.append(sum(early(f, o, e) for f, o in fires) / len(own))
        expected = (sum(rates) / len(rates), min(rates), max(rates), sum(falses) / 5)
        assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(values, expected, strict=True))
    # floor and ceiling
    anchor = limits.where("sustain_s = 172800 AND early_s = 345600").select("budget", "fold", "threshold")
    table = firing.floor_ceiling(h_df.where("sustain_s = 172800"), n_df, anchor, scoring.FLOORS, scoring.CEILINGS, scoring.RULES).collect()
    assert len(table) == 36
    for r in table:
        low, high, b = r["floor_s"], r["ceil_s"], r["budget"]
        fires = [(n, first_at(held[172800, n[0]], found[172800, 345600, b, n[1]]), first_at(held[172800, n[0]], found[172800, 345600, b, n[1]], n[4] + us(low), n[4] + us(high))) for n in naps]
        false = [(n, f) for n, f, _ in fires if early(f, n[3], 345600)]
        assert (r["orig_ff_n"], r["ff_removed_floor"], r["ff_removed_ceil"]) == (len(false), sum(f < n[4] + us(low) for n, f in false), sum(f > n[4] + us(high) for n, f in false))
        assert r["early_deep_fail_n"] == sum(n[3] is not None and n[3] < n[4] + us(low) for n in naps) and r["n_scorable"] == 40
        by_fold = [[g for n, _, g in fires if n[1] == k] for k in range(5)]
        gated = [sum(early(g, n[3], 345600) for n, _, g in fires if n[1] == k) / len(by_fold[k]) for k in range(5)]
        caught = [sum(hit(g, n[3], 345600, 86400) for n, _, g in fires if n[1] == k) / len(by_fold[k]) for k in range(5)]
        assert math.isclose(r["gated_ff_mean"], sum(gated) / 5, abs_tol=1e-12) and math.isclose(r["gated_catch_max"], max(caught), abs_tol=1e-12)


def test_surface_of_fitted_scores(spark, sf_dir):
    rows = plans.queries()["event_surface_models"](spark, sf_dir).collect()
    assert len(rows) == 108 and all(0 <= r["ff_mean"] <= 1 for r in rows)


def test_depth_costs_by_hand(spark):
    # customer 1 swings by 14.1 around 20, customer 2 by 1.4 around 11
    nights = [(1, 1, 100_000.0), (1, 2, 300_000.0), (2, 3, 100_000.0), (2, 4, 120_000.0)]
    o = spark.createDataFrame(nights, "o_custkey long, o_orderkey long, o_totalprice double")
    found = {(r["m"], r["d"]): r for r in scoring.depth_costs(o).collect()}
    assert len(found) == 20
    one = found[0, 0]
    assert (one["nights"], one["fails"], one["depth_median"], one["depth_max"]) == (4, 2, 5.5, 10.0)
    assert (one["sacrifice_nonfail"], one["sacrifice_all"], one["hard_share_pct"], one["hard_nights_pct"]) == (5.5, 2.75, 50.0, 50.0)
    assert (found[4, 3]["fails"], found[4, 3]["hard_share_pct"], found[4, 3]["depth_max"]) == (1, 100.0, 6.0)
    assert (one["before"], one["in_band"]) == (2, 0)
