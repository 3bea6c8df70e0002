"""Detection parameters; the defaults are fixed values of the published program."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectionConfig:
    filter_low: float = 500.0
    filter_high_factor: float = 0.95 * 0.5  # times the sample rate
    filter_butter_order: int = 3
    chunk_size_seconds: float = 1.0
    chunk_overlap_seconds: float = 0.015
    n_excerpts: int = 50  # used where thresholds are asked for from excerpts
    excerpt_size_seconds: float = 1.0
    use_single_threshold: bool = True
    threshold_strong_std_factor: float = 4.5
    threshold_weak_std_factor: float = 2.0
    detect_spikes_symbol: int = -1  # 1 positive, 0 both, -1 negative
    connected_component_join_size: int = 1
    extract_s_before: int = 16
    extract_s_after: int = 16
    weight_power: int = 2
    n_features_per_channel: int = 3
    pca_n_waveforms_max: int = 10000  # read for compatibility; the axes come from all waveforms
    random_seed: int = 1

    def chunk_samples(self, rate: float) -> tuple[int, int]:
        """Chunk length and overlap in samples."""
        return max(1, round(self.chunk_size_seconds * rate)), round(self.chunk_overlap_seconds * rate)
