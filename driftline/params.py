"""Parameters of the operators, in one place; all are fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureWindows:
    """Trailing windows of the decision points, in seconds, and the counts and
    spans below which a feature is null."""

    spread_s: float = 60
    short_s: float = 60
    base_s: float = 300
    slope_s: float = 120
    min_short: int = 3
    min_base: int = 5
    min_slope: int = 4
    min_slope_share: float = 0.5
    warm_up_s: float = 300


@dataclass(frozen=True)
class DensityGate:
    min_per_minute: float = 4.0
    max_median_gap_s: float = 15.0


@dataclass(frozen=True)
class AlignmentRules:
    """Search grid in epochs of ``epoch_s``, and what makes a night usable."""

    epoch_s: float = 30
    reach: int = 720
    min_samples: int = 30
    plateau_share: float = 0.95
    max_plateau_s: float = 60
    min_separation: float = 1.5


@dataclass(frozen=True)
class FiringRules:
    sustain_s: float = 30
    tolerance_s: float = 10
    early_s: float = 420
    late_s: float = 60


@dataclass(frozen=True)
class PhaseRules:
    """Constants of the phase machine, in seconds and beats a minute."""

    reference_s: float = 180
    onset_drop: float = 2.0
    onset_window_s: float = 90
    motion_rms: float = 0.005
    mean_window_s: float = 60
    spread_window_s: float = 60
    deep_drop: float = 5.0
    max_spread: float = 0.8
    hold_s: float = 60
    confirm_s: float = 30
    #: How late a sample may come and still find its whole window.
    max_late_s: float = 120
    #: Whether firing only says so in its reason.
    observe_only: bool = False


@dataclass(frozen=True)
class BeatRules:
    min_rr_ms: float = 300
    max_rr_ms: float = 2000
    history: int = 11
    max_deviation: float = 0.20
    window_s: float = 300
    min_coverage: float = 0.80
    #: Spectra: samples a second, and samples of each Welch window.
    rate: float = 4.0
    nperseg: int = 512
    min_beats: int = 8
    grid: tuple[float, ...] = field(default=(5.0,))


@dataclass(frozen=True)
class InflectionRules:
    """Grid, smoothing and windows around onsets, in seconds and rows."""

    step_s: float = 1
    smooth: int = 15
    half_s: float = 180
    share: float = 0.7
    #: Places to which slopes are compared.
    digits: int = 9
