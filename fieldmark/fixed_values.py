"""Values that must equal the published study's for equal results."""

from __future__ import annotations

# --- fixed values: file tokens that mean "missing" ---------------------------
CHECKLIST_MISSING = ("", "NA", "?")
COVARIATE_MISSING_TEXT = ("", "NA", "?")
COVARIATE_MISSING_NUMBER = -9999.0

# --- fixed values: season, protocols, thresholds -----------------------------
SEASON_MONTHS = (5, 6, 7)
PROTOCOLS = ("P21", "P22", "P23")
PRIMARY_FLAG = 1.0
MIN_REPLICATES = 3
MIN_YEARS = 3
MIN_RECORDS = 500
FORTNIGHT_DAYS = (14, 13, 13, 13, 13, 13, 13)
RHAT_LIMIT = 1.1
IMPORTANT_MEAN = 0.5

# --- fixed values: column names of the two checklist releases ----------------
INFO_COLUMNS_19 = (
    ("SAMPLING_EVENT_ID", "string"), ("LOC_ID", "string"), ("LATITUDE", "double"), ("LONGITUDE", "double"),
    ("YEAR", "int"), ("MONTH", "int"), ("DAY", "int"), ("TIME", "double"), ("COUNTRY", "string"),
    ("STATE_PROVINCE", "string"), ("COUNTY", "string"), ("COUNT_TYPE", "string"), ("EFFORT_HRS", "double"),
    ("EFFORT_DISTANCE_KM", "double"), ("EFFORT_AREA_HA", "double"), ("OBSERVER_ID", "string"),
    ("NUMBER_OBSERVERS", "double"), ("GROUP_ID", "string"), ("PRIMARY_CHECKLIST_FLAG", "double"),
)
INFO_COLUMNS_17 = (
    ("SAMPLING_EVENT_ID", "string"), ("LATITUDE", "double"), ("LONGITUDE", "double"),
    ("YEAR", "int"), ("MONTH", "int"), ("DAY", "int"), ("TIME", "double"), ("COUNTRY", "string"),
    ("STATE_PROVINCE", "string"), ("COUNT_TYPE", "string"), ("EFFORT_HRS", "double"),
    ("EFFORT_DISTANCE_KM", "double"), ("EFFORT_AREA_HA", "double"), ("OBSERVER_ID", "string"),
    ("NUMBER_OBSERVERS", "int"), ("GROUP_ID", "string"), ("PRIMARY_CHECKLIST_FLAG", "int"),
)

# --- fixed values: covariate files -------------------------------------------
NLCD_YEARS = (2001, 2006, 2011)
NLCD_CLASSES = (11, 12, 21, 22, 23, 24, 31, 41, 42, 43, 52, 71, 81, 82, 90, 95)
CORE_COVARIATES = (
    "POP00_SQMI", "HOUSING_DENSITY", "HOUSING_PERCENT_VACANT", "ELEV_GT", "ELEV_NED", "BCR",
    "BAILEY_ECOREGION", "OMERNIK_L3_ECOREGION", "CAUS_TEMP_AVG", "CAUS_TEMP_MIN", "CAUS_TEMP_MAX",
    "CAUS_PREC", "CAUS_SNOW",
) + tuple(f"NLCD{y}_FS_C{c}_7500_PLAND" for y in NLCD_YEARS for c in NLCD_CLASSES)
CORE_TEXT_COVARIATES = ("BAILEY_ECOREGION",)
UMD_CLASSES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 16)
EXTENDED_COVARIATES = (
    "ASTER2011_DEM", "UMD2011_LANDCOVER", "UMD2011_FS_L_1500_LPI", "UMD2011_FS_L_1500_PD", "UMD2011_FS_L_1500_ED",
) + tuple(f"UMD2011_FS_C{c}_1500_{m}" for c in UMD_CLASSES for m in ("PLAND", "LPI", "PD", "ED"))

# --- fixed values: parameter lookup ------------------------------------------
PARAMETER_LOOKUP = (
    ("mu.gammabeta1", "Colonisation", "Forest (% cover)"),
    ("mu.gammabeta2", "Colonisation", "Agriculture (% cover)"),
    ("mu.gammabeta3", "Colonisation", "Urban (% cover)"),
    ("mu.gammabeta4", "Colonisation", "Precipitation"),
    ("mu.gammabeta5", "Colonisation", "Temperature"),
    ("mu.phibeta1", "Persistence", "Forest (% cover)"),
    ("mu.phibeta2", "Persistence", "Agriculture (% cover)"),
    ("mu.phibeta3", "Persistence", "Urban (% cover)"),
    ("mu.phibeta4", "Persistence", "Precipitation"),
    ("mu.phibeta5", "Persistence", "Temperature"),
)
COVARIATE_ORDER = ("Forest (% cover)", "Agriculture (% cover)", "Urban (% cover)", "Temperature", "Precipitation")
DETECTION_COVARIATES = (
    "effort_hrs", "day", "time", "year", "pop00_sqmi", "housing_density", "number_observers",
)
TRAIT_CODES = (("Neotropical", 1), ("Temperate", 2), ("Resident", 3))
