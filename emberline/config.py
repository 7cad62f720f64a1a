"""Thresholds of the detection analytics, in one place."""

from __future__ import annotations

SOURCES = ("osm", "wri", "gem", "eog")
CORROBORATION_KM, ONSITE_KM, FAR_KM = 3.0, 1.0, 10.0
EARTH_KM = 6371.0088
# Channel wavelengths (um) and physical constants (SI).
WAVELENGTHS = {"VIIRS": (3.74, 11.45), "MODIS": (3.96, 11.03)}
PLANCK_H, LIGHT_C, BOLTZMANN_K = 6.62607015e-34, 2.99792458e8, 1.380649e-23
I4_SATURATION_K = 367.0
TEMPERATURE_BANDS = ((1400.0, "flare_like"), (1100.0, "furnace_like"), (800.0, "mixed"), (500.0, "biomass_like"), (0.0, "smouldering"))
SOLVER_LOW_K, SOLVER_HIGH_K, SOLVER_STEPS = 400.0, 2500.0, 60
SOLVER_EDGE_K = SOLVER_HIGH_K - 0.01 * (SOLVER_HIGH_K - SOLVER_LOW_K)
MIN_EXCESS = (3.0, 1.0)
BACKGROUND_OFFSET = {"D": 8.0, "N": 1.0}
DEFAULT_PIXEL_KM = 0.375
MAD_TO_SIGMA, MIN_SAMPLES, SIGMA_FLOOR = 1.4826, 4, 0.5
Z_RANGE, ABNORMAL_SIGMAS = (-10.0, 25.0), 3.0
PERSISTENCE_FULL_DAYS = 15
TAILS = {"new": (0.10, 2), "ceased": (0.20, 3), "reactivated": (0.15, 2)}
# Name, lat range, lon range and months of each crop-burning season, in order of precedence.
SEASONS = (
    ("punjab_haryana_rabi", (29.0, 32.6), (73.8, 76.9), (4, 5)),
    ("punjab_haryana_kharif", (29.0, 32.6), (73.8, 76.9), (10, 11)),
    ("indo_gangetic_up", (25.0, 29.5), (77.0, 84.0), (4, 5, 10, 11)),
    ("central_india_kharif", (18.0, 24.0), (74.0, 84.0), (10, 11)),
)
EVIDENCE_WEIGHTS = {"corroboration": 0.30, "physics": 0.25, "persistence": 0.20, "nocturnal": 0.10, "intensity": 0.15}
SEASON_FACTOR = 0.55
FUSION_WEIGHTS = {"evidence": 0.55, "ml": 0.30, "unsupervised": 0.15}
PRIORITY_WEIGHTS = {"probability": 0.45, "abnormality": 0.25, "persistence": 0.20, "intensity": 0.10, "new": 0.05}
PERSISTENT_AT, INDUSTRIAL_AT = 0.62, 0.42
CLUSTER_KM, CLUSTER_DAYS = 3.0, 5
MERGE_KM, NAME_MERGE_KM, NAME_SIMILARITY = 1.5, 5.0, 0.82
COUNTRY_BOX = (6.0, 38.0, 66.0, 98.0)
FACILITY_COLUMNS = "facility_uid string, source string, source_id string, name string, ftype string, lat double, lon double, capacity_value double, capacity_unit string, status string, subnational string, attrs string"
