"""Beats of synthetic recordings, with noise and drift, whole and in chunks."""

from __future__ import annotations

import numpy as np
import pytest

from driftline import plans
from driftline.operators import ecg
from driftline.params import BeatRules

RATE = 200


def recording(seed, minutes=12, noise=0.05, flip=False):
    rng = np.random.default_rng(seed)
    rr = np.clip(rng.normal(0.85, 0.05, int(minutes * 60 / 0.8)) + 0.15 * np.sin(np.arange(int(minutes * 60 / 0.8)) / 40), 0.45, 1.6)
    beat = 0.7 + np.cumsum(rr)
    beat = beat[beat < minutes * 60 - 1]
    t = np.arange(minutes * 60 * RATE) / RATE
    x = 0.5 * np.sin(2 * np.pi * 0.25 * t) + 0.3 * np.sin(2 * np.pi * 0.03 * t) + noise * rng.normal(size=len(t))
    for b in beat:
        near = slice(max(0, int((b - 0.3) * RATE)), int((b + 0.5) * RATE))
        s = t[near] - b
        x[near] += np.exp(-((s / 0.013) ** 2)) - 0.2 * np.exp(-(((s - 0.035) / 0.012) ** 2)) + 0.3 * np.exp(-(((s - 0.25) / 0.05) ** 2)) + 0.1 * np.exp(-(((s + 0.16) / 0.03) ** 2))
    return (-x if flip else x), beat


def matched(found, beat, within=0.03):
    near = np.searchsorted(beat, found)
    gap = np.minimum(np.abs(found - beat[np.clip(near, 0, len(beat) - 1)]), np.abs(found - beat[np.clip(near - 1, 0, len(beat) - 1)]))
    hits = (gap < within).sum()
    return hits / len(beat), hits / max(1, len(found)), np.median(gap)


@pytest.mark.parametrize(("seed", "noise", "flip"), [(1, 0.02, False), (2, 0.05, False), (3, 0.1, True)])
def test_peaks_are_found_and_nothing_else(seed, noise, flip):
    x, beat = recording(seed, noise=noise, flip=flip)
    sensitivity, precision, gap = matched(ecg.found_peaks(x, RATE, 0, ecg.PeakRules()) / RATE, beat)
    assert sensitivity >= 0.99 and precision >= 0.99 and gap < 0.003


def test_an_artefact_costs_only_its_surroundings():
    x, beat = recording(4)
    x[100 * RATE : 101 * RATE] += 40 * np.sin(np.arange(RATE))
    x[300 * RATE : 310 * RATE] = 0
    sensitivity, precision, _ = matched(ecg.found_peaks(x, RATE, 0, ecg.PeakRules()) / RATE, beat)
    assert sensitivity >= 0.97 and precision >= 0.97


def leads_of(spark, signals, per_record):
    rows = [(name, float(RATE), k, per_record, x[k * per_record : (k + 1) * per_record].tolist()) for name, x in signals.items() for k in range(len(x) // per_record)]
    return spark.createDataFrame(rows, "file string, rate double, record long, per_record int, samples array<double>")


def test_chunks_find_what_the_whole_finds(spark):
    signals = {"a": recording(5)[0], "b": recording(6, minutes=3)[0], "flat": np.zeros(2_000), "tiny": np.zeros(10)}
    for per_record in (10, 330):
        leads = leads_of(spark, signals, per_record)
        for chunk_s in (20, 77, 10_000):
            found = ecg.peaks(leads, ecg.PeakRules(chunk_s=chunk_s)).collect()
            for name, x in signals.items():
                whole = x[: len(x) // per_record * per_record]
                want = np.round(ecg.found_peaks(whole, RATE, 0, ecg.PeakRules()) / RATE * 1e6)
                got = np.array(sorted(r["us"] for r in found if r["file"] == name))
                assert len(got) == len(want) and np.allclose(got, want, atol=1)


def test_leads(spark):
    rows = [("two", 1, "ECG2", 0, [1.0, 2.0]), ("two", 0, "ecg1", 0, [5.0, 5.0]), ("one", 3, "EKG dx", 0, [7.0]), ("one", 5, "ECG-V", 0, [9.0]), ("one", 0, "EEG", 0, [0.0]), ("none", 0, "EMG", 0, [1.0])]
    df = spark.createDataFrame([(f, s, label, 2.0, k, x) for f, s, label, k, x in rows], "file string, signal int, label string, rate double, record long, samples array<float>")
    assert {r["file"]: list(r["samples"]) for r in ecg.lead(df).collect()} == {"two": [4.0, 3.0], "one": [7.0]}


def test_ingest_of_a_recording(spark):
    x, beat = recording(8, minutes=3, noise=0.02)
    leads = leads_of(spark, {"a": x}, RATE).cache()
    labels = spark.createDataFrame([("a", int((k * 30 - 15) * 1e6), 3 if k in (2, 3, 5) else 1) for k in range(7)], "file string, us long, stage int")
    found = ecg.peaks(leads).cache()
    judged = ecg.intervals_of(found).cache()
    rates, summary = ecg.ingest(leads, labels, found, judged)
    r = summary.first()
    rr = np.diff(beat) * 1000
    assert (r["n_beats"], r["epochs"], r["epochs_trimmed"], r["deep_onsets"], r["hours"], r["excluded"]) == (len(beat), 5, 2, 2, 0.05, False)
    assert abs(r["median_rr_ms"] - np.median(rr)) < 5 and r["pct_removed_all"] < 1 and r["hr_bins"] == 36
    means = {q["end_us"]: q["mean"] for q in rates.collect()}
    inside = (beat[1:] > 50) & (beat[1:] <= 55)
    assert abs(means[55_000_000] - np.mean(60_000 / rr[inside])) <= 1.0
    assert ecg.intervals_of(found, BeatRules(), rows=20).where("keep").count() == judged.where("keep").count()


def test_ingest_query_counts_the_rendered_beats(spark, sf_dir):
    found = {r["entity"]: r for r in plans.queries()["ecg_ingest"](spark, sf_dir).collect()}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().collect()
    assert found.keys() == {e["user_id"] for e in events}
    assert all(r["n_beats"] == e["count"] + 1 for e in events for r in [found[e["user_id"]]])
    assert all(600 <= r["median_rr_ms"] <= 1400 for r in found.values() if r["n_beats"] > 2)
