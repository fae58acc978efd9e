"""Run settings, carried unchanged into the run report."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    dataset: str = ""
    ngram_min: int = 1
    ngram_max: int = 2
    #: Keep only the n-grams found in most traces; all of them by default.
    max_features: int | None = None
    #: Axes of the projected n-grams that prefixes are routed by.
    svd_components: int = 200
    #: Fit the prefix classifiers of a candidate on so many variants only, those of smallest hash; on all of them by default.
    router_rows: int | None = None
    prob_building: float = 0.8
    prob_training: float = 0.2
    ratio_validation: float = 0.1
    min_cluster_size_end: int = 11
    end_inclusive: bool = False
    seed: int = 1
    #: States handed to one Python group of the predictor; larger models are split over groups.
    states_per_group: int = 2_000

    def candidates(self) -> list[int]:
        """Minimum cluster sizes to try; the end is exclusive unless asked otherwise."""
        return list(range(2, self.min_cluster_size_end + int(self.end_inclusive)))

    def as_dict(self) -> dict:
        return asdict(self)
