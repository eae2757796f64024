"""Fixed code lists and labels of the workforce data model.

Everything in this file is a fixed value: the codes, band edges and labels are
part of the data model and must stay exactly as they are for results to match.
"""

from datetime import datetime

# --- fixed values: end-date sentinel of an active person ---------------------
ACTIVE_UNTIL = datetime(2049, 12, 31, 23, 59, 0)

# --- fixed values: pay code -> bucket ----------------------------------------
PAY_BUCKETS = {
    "FINES": ["FINES"],
    "MILES": ["MILES"],
    "PDIEM": ["PDIEM"],
    "personaladv": ["LDMNY", "ADV.PA"],
    "Detention": ["DETPAY", "STOPS"],
    "DRVSLY": ["DRVSLY"],
    "ENDSE": ["ENDRSE", "ENDRS-"],
    "chargeback": [
        "TRAVEL", "HOTEL", "CHAIN", "SCALE", "OIL", "FAX", "PALLET",
        "PARKING", "REPAIR", "ADV.MO", "ADV.LU", "ADV.HZ", "ORTRAV", "HOLDAY",
    ],
    "safetybonus": ["BNSSAF"],
    "calcrev": ["HAZRET", "HAZMTM", "LOCAL"],
    "correction": ["GRNT"],
}
OTHER_BUCKET = "other"
BUCKET_NAMES = [*PAY_BUCKETS, OTHER_BUCKET]
BUCKETED_CODES = [code for codes in PAY_BUCKETS.values() for code in codes]
UNCOUNTED_CODES = ["PDIEM", "MILES"]
LATE_HOME_CODE = "HMETME"
LAYOVER_CODE = "LAY"

# --- fixed values: bucket -> weekly flag, in output order --------------------
# (flag, bucket, sign that raises the flag)
WEEK_FLAGS = [
    ("finesbinary", "FINES", -1),
    ("detentionbinary", "Detention", 1),
    ("DRVSLYbinary", "DRVSLY", 1),
    ("ENDSEbinary", "ENDSE", 1),
    ("chargebackbinary", "chargeback", 1),
    ("safetybinary", "safetybonus", 1),
    ("correctionbinary", "correction", 1),
]

# --- fixed values: weekly column -> per-driver total -------------------------
DRIVER_TOTALS = [
    ("finescount", "finesbinary"),
    ("detentioncount", "detentionbinary"),
    ("DRVSLYcount", "DRVSLYbinary"),
    ("endorsecount", "ENDSEbinary"),
    ("chargebackcount", "chargebackbinary"),
    ("safetycount", "safetybinary"),
    ("correctioncount", "correctionbinary"),
    ("latehomecount", "latehomebinary"),
    ("layoverbinary", "layoverbinary"),
    ("paydetails", "count"),
]
MIN_WEEK_PAY = 200

# --- fixed values: person class codes ----------------------------------------
DRIVER_CLASSES = {
    "Team Driver_Student": [
        "DRV180", "DRV90", "TD1", "TD2", "VET22", "FPST", "ST1", "VET11",
        "STUD", "ST2-3", "FPEX",
    ],
    "Owner Operator": ["OO", "OOTETR"],
    "DRVENG": ["DRVENG", "LOCAL", "LOCCAN"],
    "Trainer": [
        "TR410", "TR2", "TR3", "TR2FL", "TR4", "TRAIN", "TR404", "TR3FL",
        "TR40FL", "TR4FL",
    ],
    "OTR": [
        "OTR", "VET33", "SLHMTK", "SRTLOY", "SR2008", "S8HMTK", "UNK",
        "SRO8HM", "SRTREG",
    ],
}
DEFAULT_DRIVER_CLASS = "OTR"
NOT_TEAMED_CLASSES = ["Trainer", "DRVENG", "Owner Operator"]
COMPANY = "company"

# --- fixed values: tenure bands, (inclusive upper edge in months, label) ------
PROFILE_TENURE = [(6, "6 months"), (12, "6m- 1 year"), (24, "1-2 years"), (60, "2-5")]
PROFILE_TENURE_ABOVE = "5+"
PROFILE_TENURE_NULL = "UNKNOWN"
SURVEY_TENURE = [(6, "<6"), (12, "1 year"), (24, "2 year"), (60, "2-5 years")]
SURVEY_TENURE_ABOVE = "5+"

# --- fixed values: demographic recodes ---------------------------------------
STAYED_LABELS = {0: "Left", 1: "Stayed"}
GENDER_LABELS = {0: "UNKNOWN", 1: "MALE", 2: "FEMALE", 3: "UNKNOWN"}
MARITAL_LABELS = {0: "UNKNOWN", 1: "MARRIED", 2: "SINGLE", 3: "UNKNOWN"}
ETHNICITY_LABELS = {
    0: "UNKNOWN",
    1: "WHITE",
    2: "AM. INDIAN",
    3: "BLACK",
    4: "ASIAN",
    5: "HISPANIC",
    6: "2+ Races",
    7: "UNKNOWN",
    8: "Pacific Islander",
}
DEPENDENT_LABELS = {
    0: "UNKNOWN", 1: "none", 2: "1", 3: "2+", 4: "2+", 5: "2+", 6: "2+",
    7: "2+", 8: "2+", 10: "2+",
}

# --- fixed values: columns of the retention extract that are not analysed ----
RETENTION_DROPPED = [
    "phone", "groupavgpay", "CSA_month", "Vio_month", "sumlayover",
    "avglayover", "student_to_team_driver_days",
]

# --- fixed values: survey words ----------------------------------------------
DOMAIN_WORDS = ["driver", "pro", "drivers", "driving", "drive", "3", "company"]
THEMES = {
    "familyneeds": [
        "home", "time", "family", "emergency", "week", "weeks", "road",
        "days", "day",
    ],
    "teamissues": ["team", "solo", "truck", "hazmat"],
    "expectations": [
        "pay", "paid", "money", "issue", "payroll", "miles", "issues", "lot",
    ],
    "communication": ["manager", "fleet", "dispatch", "dispatcher"],
    "training": ["trainer", "training"],
}
SENTIMENTS = ["negative", "positive"]
