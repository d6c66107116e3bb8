"""Item lists and clinical limits used as defaults; every operator takes its own."""

from tidewatch.functions.expressions import StepRule

# Laboratory items.
LAB_ITEMS = (
    51221, 51222, 51248, 51249, 51250, 51265, 51279, 51301,
    50862, 50863, 50878, 50885, 50912, 50931, 50960, 50970, 50971, 50983, 51006,
    50800, 50801, 50802, 50803, 50804, 50805, 50806, 50821,
    51237, 51274, 51275,
    51002, 50911, 50908,
    50889, 51144, 50809,
)

# Vital-sign items.
VITAL_ITEMS = (
    220045, 220046, 220047, 220050, 220051, 220052, 220179, 220180, 220181,
    220210, 224684, 224685, 220277, 223835,
    223761, 223762,
    220739, 223900, 223901, 198,
    224642, 224289,
)

# Organ-failure score, from mild to severe.
ORGAN_RULES = (
    StepRule("50821", "below", (400, 300, 200, 100)),
    StepRule("220052", "below", (70,)),
    StepRule("50885", "above", (1.2, 2.0, 6.0, 12.0)),
    StepRule("51265", "below", (150, 100, 50, 20)),
    StepRule("50912", "above", (1.2, 2.0, 3.5, 5.0)),
)
ONSET_SCORE = 2
HORIZON_HOURS = 6

# Items of the full severity map.
MAP_ITEMS = (220052, 220181)
VASOPRESSOR_ITEMS = {"dopamine": 221662, "dobutamine": 221653,
                     "epinephrine": 221289, "norepinephrine": 221906}
GCS_ITEMS = (220739, 223900, 223901)
GCS_TOTAL_ITEM = 198
URINE_ITEM = 224289

# Published cuts for coma scale (points) and urine (mL per day).
GCS_CUTS = (15, 13, 10, 6)
URINE_CUTS = (500, 200)

# Screening limits (breaths/min, mmHg, coma points).
SCREEN_RESP_RATE, SCREEN_SYSTOLIC, SCREEN_GCS = 22, 100, 13

# Infection signs (thousand cells per microlitre, degrees Celsius).
WBC_LOW, WBC_HIGH, TEMP_LOW, TEMP_HIGH = 4.0, 12.0, 36.0, 38.0

# Sequences, windows and quality limits.
SEQUENCE_STEPS, BUCKET_MINUTES = 72, 30
MIN_POINTS, MAX_MISSING = 5, 0.3
MIN_REQUEST_STEPS, MAX_REQUEST_STEPS = 24, 72

# Accepted ranges per request field.
VITAL_RANGES = {
    "heart_rate": (0, 300), "systolic_bp": (50, 300), "diastolic_bp": (30, 200),
    "mean_bp": (40, 250), "respiratory_rate": (5, 60), "temperature": (90, 110),
    "spo2": (0, 100), "gcs_total": (3, 15),
}
LAB_RANGES = {
    "wbc": (0, 50), "hemoglobin": (0, 25), "hematocrit": (0, 70), "platelets": (0, 1000),
    "sodium": (100, 180), "potassium": (1, 10), "chloride": (80, 130), "bun": (0, 200),
    "creatinine": (0, 20), "glucose": (0, 1000), "lactate": (0, 30), "ph": (6.5, 8.0),
    "pco2": (10, 100), "po2": (30, 600), "bicarbonate": (5, 50),
}
GENDER_PATTERN = "^(M|F)$"

# Defaults for missing request fields.
PERSON_DEFAULTS = {"weight": 70.0, "height": 170.0}

# Widths of the two assembled vectors and the series cut.
VECTOR_WIDTH, POOLED_WIDTH, SERIES_CUT = 256, 64, 252

# Monitoring limits.
HISTORY_POINTS, KEPT_ALERTS = 100, 50
LATENCY_LIMIT_MS, ERROR_RATE_LIMIT = 2000, 0.05
DECISION_ALERT, FALLBACK_SCORE = 0.7, 0.1
RETENTION_DAYS, RETENTION_YEARS = 90, 7
DRIFT_LIMIT = 0.05
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
