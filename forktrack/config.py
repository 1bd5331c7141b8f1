"""Every threshold of the analyses, as parameters with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ForkConfig:
    """Thresholds from labelling to stall scores; coordinates are in bases."""

    call_threshold: float = 0.5
    radius: int = 500
    density_floor: float = 0.1
    min_segment: int = 1000
    trim_span: int = 5000
    stitch_gap: int = 3000
    pair_gap: int = 5000
    min_calls: int = 2000
    stall_rows: int = 2000
    stall_radius: int = 2000
    stall_attempts: int = 50
    stall_near: float = 0.2
    stall_beta: float = 1.0
    fraction_span: int = 2000
    fraction_calls: int = 200
    least_windows: int = 10

    def __post_init__(self):
        if not 0 <= self.call_threshold < 1 or self.radius <= 0 or self.min_segment < 0:
            raise ValueError("thresholds must be positive, and a call's a probability")


@dataclass(frozen=True)
class BreakConfig:
    """Run-off boundary and the tolerances that are swept, with a flow cell's own start."""

    boundary: int = 2000
    tolerances: tuple[int, ...] = (250, 300, 350, 400, 450, 500)
    legacy_tolerances: tuple[int, ...] = (500, 550, 600, 650, 700, 750)
    min_forks: int = 1


@dataclass(frozen=True)
class AlignmentFilter:
    """Least mapping quality and reference length of an alignment that is used."""

    min_quality: int = 20
    min_length: int = 1000

    def __post_init__(self):
        if self.min_quality < 0 or self.min_length < 0:
            raise ValueError("quality and length can't be negative")


@dataclass(frozen=True)
class HmmConfig:
    """Transition probabilities of the alignment model; internal match stays by events per base."""

    del_to_del: float = 0.3
    del_to_match: float = 0.7
    ins_to_match: float = 0.999
    match_to_del: float = 0.0025
    match_to_ins: float = 0.001
    ins_to_ins: float = 0.001


@dataclass(frozen=True)
class EventConfig:
    """Windows, thresholds and peak height of event detection."""

    short_window: int = 3
    long_window: int = 6
    short_threshold: float = 1.4
    long_threshold: float = 9.0
    peak_height: float = 0.2


@dataclass(frozen=True)
class BandConfig:
    """Banded alignment and its quality limits."""

    bandwidth: int = 100
    min_average_log: float = -2.0
    max_gap: int = 5
    min_events: int = 1000


@dataclass(frozen=True)
class GmmConfig:
    """Noise filter and mixture fit of each k-mer's levels."""

    max_events: int = 10_000
    min_events: int = 200
    eps: float = 0.5
    min_points: float = 0.025
    min_kept: int = 50
    tolerance: float = 0.01
    iterations: int = 100
    weight: float = 0.5
