"""The phase machine, timers and the session's life, step by step and against
a version that keeps every sample."""

from __future__ import annotations

import math
import random
from statistics import median, stdev

import pandas as pd

from driftline import plans
from driftline.params import PhaseRules
from driftline.streaming import phase

RULES = PhaseRules()


def decided(rows, rules=RULES):
    p = phase.Phase()
    return [(d["us"] // 1_000_000, d["reason"]) for t, kind, x in rows for d in phase.step(p, t, kind, x, rules)]


def plainly(rows, rules):
    """Keeps all samples and looks through them at each one."""
    hr, motion, out = [], [], []
    s = {"phase": "settling", "start": None, "awake": None, "onset": None, "light": None, "hold": None, "confirm": None, "logged": False, "stopped": False}
    for t, kind, x in rows:
        if kind == "start":
            hr, motion = [], []
            s = {k: None for k in s} | {"phase": "settling", "start": t, "logged": False, "stopped": False}
            continue
        if kind == "stop":
            s["stopped"] = True
        if s["stopped"] or s["phase"] == "wake_fired":
            continue
        if kind == "motion":
            motion.append((t, x))
            continue
        s["start"] = t if s["start"] is None else s["start"]
        hr.append((t, x))
        if s["phase"] == "settling":
            first = [v for u, v in hr if u - s["start"] <= rules.reference_s]
            if t - s["start"] < rules.reference_s or (s["awake"] is None and not first):
                continue
            s["awake"] = median(first) if s["awake"] is None else s["awake"]
            still = [m for u, m in motion if t - u <= rules.onset_window_s]
            if not still:
                if not s["logged"]:
                    out.append((t, "phase1_motion_unavailable"))
                s["logged"] = True
                continue
            if s["logged"]:
                out.append((t, "phase1_motion_resumed"))
                s["logged"] = False
            near = [v for u, v in hr if t - u <= rules.onset_window_s]
            if sum(near) / len(near) <= s["awake"] - rules.onset_drop and math.sqrt(sum(m * m for m in still) / len(still)) < rules.motion_rms:
                s["onset"], s["phase"] = t, "asleep"
                out.append((t, "onset_detected"))
        elif s["light"] is None:
            if t - s["onset"] >= rules.reference_s:
                s["light"] = median(v for u, v in hr if s["onset"] <= u <= s["onset"] + rules.reference_s)
                out.append((t, "light_reference_captured"))
        else:
            near, wide = ([v for u, v in hr if t - u <= w] for w in (rules.mean_window_s, rules.spread_window_s))
            deep = sum(near) / len(near) <= s["light"] - rules.deep_drop and (stdev(wide) if len(wide) > 1 else 0) <= rules.max_spread
            if s["phase"] == "asleep":
                if not deep:
                    s["hold"] = None
                elif s["hold"] is None:
                    s["hold"] = t
                elif t - s["hold"] >= rules.hold_s:
                    s["phase"], s["confirm"] = "confirming", t
                    out.append((t, "deepening_pattern_sustained"))
            elif not deep:
                s["phase"], s["hold"] = "asleep", None
                out.append((t, "confirmation_failed"))
            elif t - s["confirm"] >= rules.confirm_s:
                s["phase"] = "wake_fired"
                out.append((t, "wake_fired"))
    return out


def test_samples_far_apart():
    """Gaps longer than every window: each window holds the sample that asks."""
    assert decided([(0, "value", 60), (5, "value", 60), (10, "value", 60), (1000, "value", 60)]) == [(1000, "phase1_motion_unavailable")]
    asleep = [(0, "start", None), (10, "value", 60), (200, "motion", 0.0), (210, "value", 50)]
    assert decided(asleep) == [(210, "onset_detected")]
    assert decided([*asleep, (1210, "value", 44)]) == [(210, "onset_detected"), (1210, "light_reference_captured")]


def test_a_sample_captures_the_reference_or_deepens():
    """The capturing sample starts no hold: deep from 390 on, held since 400, confirming from 460, fired at 490."""
    rows = [(0, "start", None), (0, "value", 60)] + [(t, k, v) for t in range(10, 600, 10) for k, v in (("motion", 0.0), ("value", 60 if t < 200 else 50 if t < 390 else 44))]
    seen = decided(rows)
    onset = next(t for t, r in seen if r == "onset_detected")
    assert [r for _, r in seen] == ["onset_detected", "light_reference_captured", "deepening_pattern_sustained", "wake_fired"]
    assert seen[1][0] == onset + 180 and seen[3][0] - seen[2][0] == 30
    assert decided(rows, PhaseRules(observe_only=True))[-1][1] == "wake_fired_observe_only"


def test_without_a_value_in_the_first_minutes_nothing_is_decided():
    rows = [(0, "start", None)] + [(t, k, v) for t in range(200, 900, 10) for k, v in (("motion", 0.0), ("value", 50))]
    assert decided(rows) == []


def test_stop_and_start_anew():
    rows = [(0, "value", 60), (200, "value", 60), (201, "stop", None), (300, "motion", 0.0), (300, "value", 60), (1000, "start", None), (1010, "value", 60), (1200, "value", 60)]
    assert decided(rows) == [(200, "phase1_motion_unavailable"), (1200, "phase1_motion_unavailable")]


def test_like_a_version_that_keeps_every_sample():
    rules = PhaseRules(reference_s=60, onset_window_s=30, mean_window_s=20, spread_window_s=25, hold_s=20, confirm_s=10, motion_rms=0.5, max_spread=2.0, deep_drop=3.0)
    reasons = set()
    for seed in range(300):
        rng = random.Random(seed)
        t, rows = 0.0, [(0.0, "start", None)] if seed % 2 else []
        level = 60.0
        for _ in range(rng.randint(5, 250)):
            t += rng.choice([1, 2, 5, 5, 5, 10, 200 if rng.random() < 0.05 else 5])
            level = max(40.0, level - rng.random() * 0.35 + (3 if rng.random() < 0.02 else 0))
            rows.append((t, "motion", rng.random() * 0.4) if rng.random() < 0.4 else (t, "value", level + rng.random()))
            if rng.random() < 0.004:
                rows.append((t, rng.choice(["stop", "start"]), None))
        want = plainly(rows, rules)
        assert decided(rows, rules) == [(int(u), r) for u, r in want]
        reasons |= {r for _, r in want}
    assert len(reasons) == 7


def test_late_samples_like_a_version_that_keeps_every_sample():
    """Samples from before the onset that come after it aren't part of the light
    reference, and a late sample finds its own window."""
    rules = PhaseRules(reference_s=60, onset_window_s=30, mean_window_s=20, spread_window_s=25, hold_s=20, confirm_s=10, motion_rms=0.5, max_spread=2.0, deep_drop=3.0)
    reasons = set()
    for seed in range(300):
        rng = random.Random(seed)
        t, rows, level = 0.0, [(0.0, "start", None)] if seed % 2 else [], 60.0
        for _ in range(rng.randint(30, 250)):
            t += rng.choice([1, 2, 5, 5])
            level = max(40.0, level - rng.random() * 0.35)
            at = max(0.0, t - rng.choice([3, 20, 60, 100])) if rng.random() < 0.2 else t
            rows.append((at, "motion", rng.random() * 0.4) if rng.random() < 0.4 else (at, "value", level + rng.random()))
        want = plainly(rows, rules)
        assert decided(rows, rules) == [(int(u), r) for u, r in want]
        reasons |= {r for _, r in want}
    assert {"onset_detected", "light_reference_captured", "wake_fired"} <= reasons


def test_the_light_reference_begins_at_the_onset():
    p = phase.Phase()
    rows = [(0, "start", None), (0, "value", 60)] + [(t, k, v) for t in range(10, 200, 10) for k, v in (("motion", 0.0), ("value", 60 if t < 180 else 40))]
    for t, kind, x in [*rows, (200, "value", 40), (210, "value", 40), *[(u, "value", 60) for u in range(100, 180, 4)], (300, "value", 40), (400, "value", 40)]:
        phase.step(p, t, kind, x, RULES)
    assert p.light == 40 and p.light_sd == 0 and p.onset >= 180


def test_batch_and_stream_decide_alike(spark, sf_dir):
    found = plans.queries()
    batch = sorted(map(tuple, found["phase_machine"](spark, sf_dir).collect()))
    assert batch == sorted(map(tuple, found["phase_machine_stream"](spark, sf_dir).collect()))
    assert {r[4] for r in batch} >= {"phase1_motion_unavailable", "onset_detected", "light_reference_captured"}


def test_lifecycle_like_a_plain_loop(spark, sf_dir):
    from driftline.plans.recordings import ACTIONS

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("user_id", "ts").collect()
    state, want = {}, []
    moves = {("idle", "start"): ["starting", "recording"], ("idle", "failed"): ["starting", "idle"], ("recording", "stop"): ["stopping", "awaiting_rating"], ("awaiting_rating", "rate"): ["idle"]}
    for r in rows:
        now = state.get(r["user_id"], "idle")
        for to in moves.get((now, ACTIONS.get(r["event_type"], r["event_type"])), []):
            want.append((r["user_id"], now, to))
            now = to
        state[r["user_id"]] = now
    got = plans.queries()["session_lifecycle"](spark, sf_dir).collect()
    assert sorted((r["entity"], r["state_from"], r["state_to"]) for r in got) == sorted(want)
    assert {to for _, _, to in want} == {"starting", "recording", "stopping", "awaiting_rating", "idle"}


def test_timers_fire_once_and_only_when_due(spark, tmp_path):
    from driftline.plans.formats import _drained

    day = 86_400_000_000
    schema = "entity long, id long, us long"
    source = str(tmp_path / "ratings")
    spark.createDataFrame([(1, 10, day), (2, 20, day + 5), (1, 11, 3 * day), (3, 30, 9 * day)], schema).write.parquet(source)
    live = spark.readStream.schema(schema).parquet(source)
    got = sorted((r["id"], r["due_us"]) for r in _drained(phase.due_timers(live, 86_400)).collect())
    assert got == [(10, 2 * day), (11, 4 * day), (20, 2 * day + 5)]


def test_rows_of_one_time_are_ordered_by_kind():
    rows = pd.DataFrame({"us": [5, 5, 5, 5, 1], "kind": ["stop", "value", "motion", "start", "value"], "value": [None, 1.0, 1.0, None, 2.0]})
    assert phase.in_order(rows)["kind"].tolist() == ["value", "start", "motion", "value", "stop"]
