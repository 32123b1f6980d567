"""Fixed values of the study (labels, codes, level maps, estimates), in one place."""

from __future__ import annotations

# Stay outcomes, in report order.
STAY_OUTCOMES = ["hosp", "hosp1", "hosp4", "hosp2", "hospE", "hospF", "hospG", "hospA"]
TABLE_ENDPOINTS = ["case", "hosp", "hosp1", "hosp4", "hosp2", "hospE", "hospF", "hospA", "dead"]
ADMITTED_DISCHARGES = ["Admitted", "Transfer", "Died"]
DIED_DESTINATION = 79
DOSE_NUMBERS = [1, 2, 3, 4, 5, 6]

# Genotype calls.
DELTA_VARIANTS = ["VOC-21APR-02", "VUI-21OCT-01"]
OMICRON_VARIANTS = ["VOC-21NOV-01"]
CONFIRMED = "Confirmed"
GENOTYPE_RESULTS = ["Confirmed", "Provisional genotyping"]
GENOTYPE_FIELDS = ["variant", "variant_alt_name", "seq_result", "vam_specimen_date", "vam_pillar"]

# Assay channels: target, then controls, and the cycle limit.
ASSAY_TARGET = "P2CH3CQ"
ASSAY_CONTROLS = ["P2CH1CQ", "P2CH2CQ"]
ASSAY_LIMIT = 30.0

PILLAR_2_SOURCE = "PILLAR 2 TESTING"
PRIMARY_PRODUCTS = ["AZ", "PF", "MD"]
BOOSTER_PRODUCTS = ["PF", "MD"]

AGE_BREAKS = [0, 1, 5, 10, 20, 30, 40, 50, 60, 70, 80]

ETHNICITY_GROUPS = {
    "white": ["Any other White background", "Irish (White)", "British (White)"],
    "black": [
        "African (Black or Black British)",
        "Any other Black background",
        "White and Black African (Mixed)",
        "White and Black Caribbean (Mixed)",
        "Caribbean (Black or Black British)",
    ],
    "all_other": [
        "White and Asian (Mixed)",
        "Any other Asian background",
        "Any other ethnic group",
        "Any other Mixed background",
        "Chinese (other ethnic group)",
    ],
    "pakastani_or_bangladeshi": [
        "Bangladeshi (Asian or Asian British)",
        "Pakistani (Asian or Asian British)",
    ],
    "indian": ["Indian (Asian or Asian British)"],
    "unknown": ["Unknown"],
}

REFERENCE_LEVELS = {
    "dose_type": "None",
    "dose_vacc": "None",
    "dose_lv": "Unvaccinated",
    "ethnicity_group2": "white",
    "om_vacc3": "Unvaccinated",
    "om_vacc4": "0.None",
    "om_age": "Delta",
    "om_age1": "Delta",
    "om_age2": "Delta",
    "om_age3": "Delta",
    "om_dose": "Unvaccinated",
    "om_dose2": "Unvaccinated",
    "vacc_reinf": "first",
    "reinf_var": "No past infection",
}

# Share of first infections that were reported, by age band, with its standard deviation.
REPORTED_SHARE = [0.155, 0.155, 0.185, 0.366, 0.418, 0.437, 0.411, 0.386, 0.366, 0.343, 0.343]
REPORTED_SHARE_SD = [0.0037, 0.0037, 0.0042, 0.0074, 0.0104, 0.0132, 0.0127, 0.0117, 0.0112, 0.0114, 0.0114]

# Parts of each stratification.
STRATIFICATIONS = {
    "id9": ["ageband1", "NHSER_name", "ethnicity_group2", "Tg"],
    "id10": ["ageband3", "NHSER_name", "ethnicity_group2", "Tg"],
    "id11": ["ageband1", "NHSER_name", "ethnicity_group2", "Tg", "dose_vacc"],
    "id12": ["ageband3", "NHSER_name", "ethnicity_group2", "Tg", "dose_vacc"],
    "id13": ["ageband1", "UTLA_name", "ethnicity_group2", "Tg", "dose_vacc"],
    "id14": ["Tg"],
    "id15": ["ageband1", "NHSER_name", "Tg"],
}
STRATIFICATION_NAMES = {
    "10y": "id9",
    "<1,1-4, 5-9, 10y": "id10",
    "10y+vacc": "id11",
    "<1,1-4, 5-9, 10y+vacc": "id12",
    "10y, UTLA": "id13",
    "day only": "id14",
    "10y no eth": "id15",
}

CI_WIDTH = 1.96
