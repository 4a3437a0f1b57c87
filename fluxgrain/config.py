"""Defaults of the spectral pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

EPSILON, BANDS = 1e-10, 3
BENIGN, ATTACK = "BENIGN", "ATTACK"
CHANNELS = ("total_bytes", "total_packets", "mean_duration")
LOG_CHANNELS = ("total_bytes", "total_packets")


@dataclass(frozen=True)
class Spectral:
    bin_seconds: int = 1
    window: int = 64
    overlap: int = 32
    window_function: str = "hann"
    rolloff: tuple[float, ...] = (0.85, 0.95)
    deltas: bool = True
    channels: tuple[str, ...] = CHANNELS
    log_channels: tuple[str, ...] = LOG_CHANNELS
    slow_window: int = 256
    slow_overlap: int = 0

    @property
    def hop(self) -> int:
        if self.window < 4 or self.overlap >= self.window:
            raise ValueError("a window has 4 bins at least, and overlaps by less than its length")
        return self.window - self.overlap


@dataclass(frozen=True)
class Evaluation:
    rule: str = "majority"
    attack_share: float = 0.5
    holdout: float = 0.30
    seed: int = 42
    methods: tuple[str, ...] = ("f1_optimal", "youden_j", "fpr_0.05", "fpr_0.10")
    fusion_weights: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.5)
    weights: dict[str, float] = field(default_factory=lambda: {"ecod": 0.7, "iforest": 0.3})


def from_settings(settings: dict) -> tuple[Spectral, Evaluation, dict[str, float]]:
    """Spectral and evaluation settings and ensemble weights of a settings file; defaults stand for
    what it leaves out."""
    s, e = settings.get("spectral", {}), settings.get("evaluation", {})
    slow = s.get("multi_scale", {})
    one, two = Spectral(), Evaluation()
    spectral = Spectral(
        s.get("bin_size_seconds", one.bin_seconds), s.get("window_size", one.window), s.get("overlap", one.overlap), s.get("window_function", one.window_function),
        tuple(s.get("rolloff_percentages", one.rolloff)), s.get("delta_features", one.deltas), tuple(s.get("input_series", one.channels)), tuple(s.get("log_transform_channels", one.log_channels)),
        slow.get("slow_window_size", one.slow_window), slow.get("slow_overlap", one.slow_overlap),
    )
    evaluation = Evaluation(
        e.get("window_label_rule", two.rule), two.attack_share, e.get("benign_test_frac", two.holdout), two.seed, tuple(e.get("threshold_methods", two.methods)), two.fusion_weights,
    )
    return spectral, evaluation, dict(settings.get("models", {}).get("ensemble", {}).get("weights") or two.weights)
