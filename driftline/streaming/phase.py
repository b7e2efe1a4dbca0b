"""A phase machine over a live series: settling, asleep, confirming, fired.

One function steps the machine; the stateful stream and the batch operator
both call it, for each row in its order of arrival. Rows have kind ``value``,
``motion``, ``start`` or ``stop``; motion only updates the state, ``start``
begins a session anew, and without it the first value does. State holds the
samples of the running windows and of the reference that is being taken, and
nothing that a gap could empty: a window ends with the sample that asks. A
sample that comes late asks for its own, earlier window; samples are kept for
those that are up to ``max_late_s`` late, and later ones see what is left.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import PhaseRules

DECISIONS = "entity {id}, us long, phase_from string, phase_to string, reason string, awake_reference double, light_reference double, light_sd double, current_mean double, current_sd double"


@dataclass
class Phase:
    name: str = "settling"
    start: float | None = None
    awake: float | None = None
    onset: float | None = None
    light: float | None = None
    light_sd: float | None = None
    hold_since: float | None = None
    confirm_since: float | None = None
    motion_missing: bool = False
    stopped: bool = False
    #: The newest time so far, from which windows are pruned.
    newest: float = -math.inf
    #: Values of the first ``reference_s`` seconds, until the awake reference is taken.
    early: list = field(default_factory=list)
    #: Values from the onset on, until the light reference is taken.
    after_onset: list = field(default_factory=list)
    #: Samples of the running windows.
    values: list = field(default_factory=list)
    motion: list = field(default_factory=list)


def spread(xs: list[float]) -> float:
    """Sample SD; 0 for a single sample."""
    if len(xs) < 2:
        return 0.0
    m = sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / (len(xs) - 1))


def recent(samples: list, t: float, width: float) -> list[float]:
    return [x for u, x in samples if t - u <= width]


def dropped_before(samples: list, t: float) -> None:
    """Removes samples at the front that are older than ``t``."""
    n = 0
    while n < len(samples) and samples[n][0] < t:
        n += 1
    del samples[:n]


def step(p: Phase, t: float, kind: str, x: float | None, rules: PhaseRules) -> list[dict]:
    """Takes one row in; returns the decisions that it causes."""
    if kind == "start":
        p.__dict__.update(asdict(Phase(start=t)))
        return []
    if kind == "stop":
        p.stopped = True
    if p.stopped or p.name == "wake_fired" or x is None:
        return []
    if kind == "motion":
        p.motion.append((t, x))
        p.newest = max(p.newest, t)
        dropped_before(p.motion, p.newest - rules.onset_window_s - rules.max_late_s)
        return []
    p.start = t if p.start is None else p.start
    p.values.append((t, x))
    p.newest = max(p.newest, t)
    dropped_before(p.values, p.newest - max(rules.onset_window_s, rules.mean_window_s, rules.spread_window_s) - rules.max_late_s)
    out: list[dict] = []

    def decide(to: str, reason: str, mean: float | None = None, sd: float | None = None) -> None:
        out.append({"us": round(t * 1e6), "phase_from": p.name, "phase_to": to, "reason": reason, "awake_reference": p.awake, "light_reference": p.light, "light_sd": p.light_sd, "current_mean": mean, "current_sd": sd})
        p.name = to

    if p.name == "settling":
        settle(p, t, x, rules, decide)
    elif p.light is None:
        if p.onset <= t <= p.onset + rules.reference_s:
            p.after_onset.append(x)
        if t - p.onset >= rules.reference_s:
            p.light, p.light_sd = median(p.after_onset), spread(p.after_onset)
            p.after_onset = []
            decide("asleep", "light_reference_captured")
    else:
        deepen(p, t, rules, decide)
    return out


def settle(p: Phase, t: float, x: float, rules: PhaseRules, decide) -> None:
    if p.awake is None and t - p.start <= rules.reference_s:
        p.early.append(x)
    if t - p.start < rules.reference_s or (p.awake is None and not p.early):
        return
    if p.awake is None:
        p.awake, p.early = median(p.early), []
    still = recent(p.motion, t, rules.onset_window_s)
    if not still:
        if not p.motion_missing:
            p.motion_missing = True
            decide("settling", "phase1_motion_unavailable")
        return
    if p.motion_missing:
        p.motion_missing = False
        decide("settling", "phase1_motion_resumed")
    near = recent(p.values, t, rules.onset_window_s)
    mean = sum(near) / len(near)
    if mean <= p.awake - rules.onset_drop and math.sqrt(sum(m * m for m in still) / len(still)) < rules.motion_rms:
        p.onset = t
        p.after_onset = [v for u, v in p.values if t <= u <= t + rules.reference_s]
        decide("asleep", "onset_detected", mean, spread(near))


def deepen(p: Phase, t: float, rules: PhaseRules, decide) -> None:
    near, wide = recent(p.values, t, rules.mean_window_s), recent(p.values, t, rules.spread_window_s)
    mean, sd = sum(near) / len(near), spread(wide)
    deep = mean <= p.light - rules.deep_drop and sd <= rules.max_spread
    if p.name == "asleep":
        if not deep:
            p.hold_since = None
        elif p.hold_since is None:
            p.hold_since = t
        elif t - p.hold_since >= rules.hold_s:
            p.confirm_since = t
            decide("confirming", "deepening_pattern_sustained", mean, sd)
    elif not deep:
        p.hold_since = p.confirm_since = None
        decide("asleep", "confirmation_failed", mean, sd)
    elif t - p.confirm_since >= rules.confirm_s:
        decide("wake_fired", "wake_fired_observe_only" if rules.observe_only else "wake_fired", mean, sd)


#: Rows of one time: control rows come first, then motion.
ORDER = {"start": 0, "motion": 1, "value": 2, "stop": 3}


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(_k=rows["kind"].map(ORDER)).sort_values(["us", "_k"], kind="stable")


def run(rows: pd.DataFrame, p: Phase, rules: PhaseRules) -> list[dict]:
    out: list[dict] = []
    for us, kind, x in zip(rows["us"], rows["kind"], rows["value"], strict=True):
        out += step(p, us / 1e6, kind, None if pd.isna(x) else float(x), rules)
    return out


def _frame(entity, found: list[dict]) -> pd.DataFrame:
    columns = ["entity", "us", "phase_from", "phase_to", "reason", "awake_reference", "light_reference", "light_sd", "current_mean", "current_sd"]
    return pd.DataFrame([{"entity": entity, **d} for d in found], columns=columns)


def phase_decisions(samples: DataFrame, rules: PhaseRules = PhaseRules()) -> DataFrame:
    """Batch twin: decisions per entity, which stands for one device, from
    (entity, us, kind, value) in the order of time. Samples with a null value
    and rows with a null time are left out."""
    kind = dict(samples.dtypes)["entity"]

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        return _frame(rows["entity"].iloc[0], run(in_order(rows), Phase(), rules))

    return samples.where("us IS NOT NULL").groupBy("entity").applyInPandas(decide, DECISIONS.format(id=kind))


def phase_stream(samples: DataFrame, rules: PhaseRules = PhaseRules()) -> DataFrame:
    """The same on a stream. Each batch is sorted by time; there is no
    reordering across batches: late samples are taken as they come."""
    kind = dict(samples.dtypes)["entity"]

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = Phase(**json.loads(state.get[0])) if state.exists else Phase()
        found = run(in_order(pd.concat(list(batches))), p, rules)
        state.update((json.dumps(asdict(p)),))
        yield _frame(key[0], found)

    return samples.where("us IS NOT NULL").groupBy("entity").applyInPandasWithState(decide, DECISIONS.format(id=kind), "state string", "append", GroupStateTimeout.NoTimeout)


def one_each(samples: DataFrame, id_col: str = "id", time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Samples by identity: exact without a time column, with state that grows;
    within a watermark with one."""
    if time_col is None:
        return samples.dropDuplicates([id_col])
    return samples.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def timers(ratings: DataFrame, delay_s: float) -> DataFrame:
    """When a follow-up to each rating is due."""
    return ratings.withColumn("due_us", F.col("us") + int(delay_s * 1e6))


def due_timers(ratings: DataFrame, delay_s: float, late: str = "0 seconds") -> DataFrame:
    """(entity, id, due_us) of a stream (entity, id, us): a row once the
    stream's time has passed what was asked for ``delay_s`` before. Waiting
    timers are state; a timer that is asked for again fires again."""
    kind, id_kind = (dict(ratings.dtypes)[c] for c in ("entity", "id"))
    timed = ratings.select("entity", "id", "us", F.timestamp_micros("us").alias("at")).withWatermark("at", late)

    def wait(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = json.loads(state.get[0]) if state.exists else []
        waiting += [[i, int(us) + int(delay_s * 1e6)] for rows in batches for i, us in zip(rows["id"].tolist(), rows["us"], strict=True)]
        now_ms = state.getCurrentWatermarkMs()
        due = sorted((w for w in waiting if w[1] // 1000 < now_ms), key=lambda w: w[1])
        waiting = [w for w in waiting if w[1] // 1000 >= now_ms]
        state.update((json.dumps(waiting),))
        if waiting:
            state.setTimeoutTimestamp(max(now_ms + 1, min(w[1] for w in waiting) // 1000))
        elif due:
            state.remove()
        yield pd.DataFrame({"entity": [key[0]] * len(due), "id": [w[0] for w in due], "due_us": [w[1] for w in due]})

    return timed.groupBy("entity").applyInPandasWithState(wait, f"entity {kind}, id {id_kind}, due_us long", "waiting string", "append", GroupStateTimeout.EventTimeTimeout)


#: What an action does to a session in a state: the states that it passes.
MOVES = {
    ("idle", "start"): ("starting", "recording"),
    ("idle", "failed"): ("starting", "idle"),
    ("recording", "stop"): ("stopping", "awaiting_rating"),
    ("awaiting_rating", "rate"): ("idle",),
}


def lifecycle(actions: DataFrame) -> DataFrame:
    """(entity, us, state_from, state_to) of a stream of control rows (entity,
    us, action): start, failed (a start that fails), stop and rate. Actions
    that the state doesn't allow change nothing."""
    kind = dict(actions.dtypes)["entity"]

    def move(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "idle"
        rows = pd.concat(list(batches)).sort_values("us", kind="stable")
        out = []
        for us, action in zip(rows["us"], rows["action"], strict=True):
            for to in MOVES.get((now, action), ()):
                out.append((key[0], us, now, to))
                now = to
        state.update((now,))
        yield pd.DataFrame(out, columns=["entity", "us", "state_from", "state_to"])

    return actions.groupBy("entity").applyInPandasWithState(move, f"entity {kind}, us long, state_from string, state_to string", "state string", "append", GroupStateTimeout.NoTimeout)


def edges(states: DataFrame) -> DataFrame:
    """(entity, event_id, us, before, state): the rows of a stream at which an
    entity's state differs from the one before; the first row counts, with
    null before it. Each batch is sorted by time."""
    kind = dict(states.dtypes)["entity"]

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("us", kind="stable")
        before = rows["state"].shift(1).astype(object)
        before.iloc[0] = state.get[0] if state.exists else None
        rows = rows.assign(before=before.where(before.notna(), None))
        out = rows[(rows["state"] != before).to_numpy()]
        state.update((rows["state"].iloc[-1],))
        yield out[["entity", "event_id", "us", "before", "state"]]

    return states.groupBy("entity").applyInPandasWithState(decide, f"entity {kind}, event_id long, us long, before string, state string", "last string", "append", GroupStateTimeout.NoTimeout)
