"""Analysis settings, held on the driver and folded into plans as literals.

The canonical JSON of the settings is hashed into every analysis identity, so
field names and defaults below are part of the data contract.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

SCHEMA_VERSION = "1.0"


@dataclass(frozen=True)
class Limits:
    max_upload_bytes: int = 1_073_741_824
    max_duration_ms: int = 1_200_000
    max_width: int = 4096
    max_height: int = 2160


@dataclass(frozen=True)
class Shots:
    backend: str = "pyscenedetect"
    detector: str = "adaptive"
    min_shot_ms: int = 300
    working_width: int = 320
    threshold: float = 3.0
    min_content_val: float = 15.0
    debug: bool = False


@dataclass(frozen=True)
class LightingKey:
    low_median_lstar: float = 40.0
    low_spread_lstar: float = 45.0
    low_shadow_ratio: float = 0.40
    high_median_lstar: float = 65.0
    high_spread_lstar: float = 45.0
    high_shadow_ratio: float = 0.10


@dataclass(frozen=True)
class Chromatic:
    samples_per_shot: int = 3
    max_pixels_per_shot: int = 50_000
    clusters: int = 5
    random_seed: int = 42
    working_max_side: int = 640
    kmeans_batch_size: int = 1024
    kmeans_n_init: int = 3
    delta_e_merge: float = 3.0
    letterbox_lstar_max: float = 8.0
    letterbox_coverage: float = 0.92
    min_usable_pixel_ratio: float = 0.05
    shadow_lstar: float = 20.0
    highlight_lstar: float = 80.0
    min_swatch_proportion: float = 0.02
    lighting_key_rules: LightingKey = field(default_factory=LightingKey)


@dataclass(frozen=True)
class TrackWeights:
    coverage: float = 0.45
    median_area: float = 0.35
    median_confidence: float = 0.20


@dataclass(frozen=True)
class Framing:
    version: str = "framing_rules_v1"
    min_track_coverage: float = 0.40
    extreme_wide_height_max: float = 0.18
    wide_height_max: float = 0.38
    medium_height_max: float = 0.62
    close_up_height_max: float = 0.85
    edge_truncation: float = 0.02
    disagreement_fraction: float = 0.40


@dataclass(frozen=True)
class Spatial:
    backend: str = "none"
    checkpoint: str | None = None
    sample_fps: float = 2.0
    person_confidence: float = 0.35
    thirds_sigma: float = 0.18
    track_iou_min: float = 0.30
    primary_track_weights: TrackWeights = field(default_factory=TrackWeights)
    framing_rules: Framing = field(default_factory=Framing)


@dataclass(frozen=True)
class DenseFlow:
    pyr_scale: float = 0.5
    levels: int = 3
    winsize: int = 15
    iterations: int = 3
    poly_n: int = 5
    poly_sigma: float = 1.2


@dataclass(frozen=True)
class Motion:
    sample_fps: float = 6.0
    working_max_side: int = 320
    discontinuity_diag_per_s: float = 1.5
    farneback: DenseFlow = field(default_factory=DenseFlow)


@dataclass(frozen=True)
class Audio:
    sample_rate_hz: int = 22_050
    window_ms: int = 1000


@dataclass(frozen=True)
class TensionWeights:
    cut_activity: float = 0.35
    audio_activity: float = 0.30
    motion: float = 0.35


@dataclass(frozen=True)
class Tension:
    weights: TensionWeights = field(default_factory=TensionWeights)
    hop_ms: int = 500
    cut_sigma_ms: int = 750
    cut_reference: float = 3.0
    percentile_low: float = 10.0
    percentile_high: float = 90.0
    epsilon: float = 1e-6


@dataclass(frozen=True)
class Critic:
    enabled: bool = False


@dataclass(frozen=True)
class AnalysisConfig:
    schema_version: str = SCHEMA_VERSION
    pipeline_version: str = "0.1.0"
    limits: Limits = field(default_factory=Limits)
    shots: Shots = field(default_factory=Shots)
    chromatic: Chromatic = field(default_factory=Chromatic)
    spatial: Spatial = field(default_factory=Spatial)
    motion: Motion = field(default_factory=Motion)
    audio: Audio = field(default_factory=Audio)
    tension: Tension = field(default_factory=Tension)
    critic: Critic = field(default_factory=Critic)

    def canonical_json(self) -> str:
        return canonical_json(asdict(self))

    def hash(self) -> str:
        return hashlib.sha256(self.canonical_json().encode()).hexdigest()

    def problems(self) -> list[str]:
        """Weight sums and threshold order (rule set DQ-13)."""
        found = []
        t, p, f = self.tension.weights, self.spatial.primary_track_weights, self.spatial.framing_rules
        if abs(t.cut_activity + t.audio_activity + t.motion - 1.0) > 1e-9:
            found.append("tension_weights_sum")
        if abs(p.coverage + p.median_area + p.median_confidence - 1.0) > 1e-9:
            found.append("track_weights_sum")
        bounds = [f.extreme_wide_height_max, f.wide_height_max, f.medium_height_max, f.close_up_height_max]
        if any(a >= b for a, b in zip(bounds, bounds[1:])):
            found.append("framing_thresholds_order")
        return found


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, ASCII only: the text every digest is taken over."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


DEFAULT_CONFIG = AnalysisConfig()
