"""Parameters of one study run."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, replace
from datetime import date


@dataclass(frozen=True)
class StudyConfig:
    """Immutable run parameters; derive variants with :meth:`variant`."""

    # Defaults of the main analysis.
    date_name: str = "2022-01-24"
    date_start: date = date(2021, 11, 29)
    date_stop: date = date(2022, 1, 9)
    censor_date: date = date(2022, 1, 24)
    last_assay_date: date = date(2021, 12, 30)
    first_stay_date: date = date(2021, 1, 4)
    endpoints: tuple[str, ...] = ("hosp", "hosp4", "hospA", "dead")
    min_days_to_stay: int = 0
    max_days_to_stay: int = 14
    short_days_to_stay: int = 7
    max_days_to_death: int = 28
    prior_stay_days: int = 90
    new_episode_gap: int = 90
    match_window: int = 14
    assay_look_back: int = 28
    travel_days: int = 14
    dose_effect_days: int = 14
    min_days_dose2_to_dose3: int = 80
    follow_up_days: int = 14
    follow_up_days_death: int = 28
    bootstrap_iterations: int = 200
    seed: int = 10287918

    # Switches.
    link_variant: str = ""
    drop_prior_stays: bool = False
    pillar2_only: bool = False
    genotype_only: bool = False
    valid_id_only: bool = True
    unvaccinated_only: bool = False
    add_late_episodes: bool = True
    resample: bool = False
    impute_exposure: bool = False
    model_imputation: bool = False
    standard_errors: bool = True

    def variant(self, **changes) -> "StudyConfig":
        return replace(self, **changes)

    def link_tag(self) -> str:
        """Short digest of every parameter, used to name snapshots."""
        text = repr(sorted(asdict(self).items(), key=lambda kv: kv[0]))
        return hashlib.md5(text.encode()).hexdigest()[:10]

    def data_cut(self) -> str:
        """Label of the data cut, used in result names."""
        label = ("pillar2" if self.pillar2_only else "pillar1+2") + self.link_variant
        if not self.valid_id_only:
            label += "nv"
        if self.unvaccinated_only:
            label += "_unvacc"
        if self.impute_exposure:
            label += "_imp"
        return label
