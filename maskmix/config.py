"""Parameters of a clustering run."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class MixtureConfig:
    """Defaults are fixed values: they must agree with the published program."""

    # input selection
    file_base: str = "electrode"
    elec_no: int = 1
    use_features: str = ""
    drop_last_n_features: int = 0
    normalise: bool = True

    # False: every value counts in full, covariances are full and the penalty is that of a plain mixture
    use_masks: bool = True

    # model search
    mask_starts: int = 500
    min_clusters: int = 100
    max_clusters: int = 110
    max_possible_clusters: int = 1000
    n_starts: int = 1
    subset: int = 1
    random_seed: int = 1
    use_masked_initial_conditions: bool = False  # starts from masks also where mask_starts is 0
    assign_to_first_closest_mask: bool = False

    # score
    penalty_k: float = 0.0
    penalty_k_log_n: float = 1.0
    prior_point: float = 1.0
    noise_point: float = 1.0
    points_for_cluster_mask: float = 10.0
    min_mask_overlap: float = 0.0
    huge_score: float = 1e30

    # loop control
    full_step_every: int = 20
    max_iter: int = 10000
    changed_thresh: float = 0.05
    dist_thresh: float = math.log(1000.0)

    # splitting: "off" is what the program does in effect, "seeded" what it means to do
    split: str = "off"
    split_first: int = 20
    split_every: int = 40
    always_split_bimodal: bool = False

    # output
    verbose: int = 1
    save_temp_every_iter: bool = False
    save_sorted: bool = False
    save_covariance_means: bool = False
    dist_dump: bool = False

    # how steps are computed; classes and scores do not depend on it
    bounded_steps: bool = True
    differences: str = "auto"  # M-step from moved points only: "auto" where that reads less, "always", "never"
    recount_every: int = 20
    together: bool = True  # runs of a search share their passes over the points

    # largest slice of the cluster model sent to executors at once
    model_broadcast_bytes: int = 512 * 1024 * 1024

    def __post_init__(self):
        if self.split != "off" and not self.use_masks:
            raise ValueError("splits are decided with the penalties of masks; use_masks=False needs split='off'")
        if self.differences not in ("auto", "always", "never"):
            raise ValueError(f"differences is 'auto', 'always' or 'never', not {self.differences!r}")

    @property
    def starts_from_masks(self) -> bool:
        return self.use_masks and (self.mask_starts > 0 or self.use_masked_initial_conditions)

    def starting_clusters(self) -> range:
        """Cluster counts to try; mask starts override the min/max range."""
        if self.mask_starts > 0:
            return range(self.mask_starts, self.mask_starts + 1)
        return range(self.min_clusters, self.max_clusters + 1)
