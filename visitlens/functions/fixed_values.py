"""Fixed values that results depend on: bin limits, labels, the calendar, thresholds and default priors."""

AGE_UPPER_LIMITS = [(17, "0-17"), (65, "18-65")]
AGE_ABOVE = "65+"
AGE_MISSING = "NA"

GCS_RANGES = [(13, 15, "GCS 13-15"), (9, 12, "GCS 9-12"), (3, 8, "GCS 3-8")]

SEX_CODES = {"male": ["1", "3"], "female": ["4", "2"]}

CALENDAR_FIRST = "2010-01-01"
CALENDAR_LAST = "2023-12-01"
CALENDAR_START_YEAR = 2010
CALENDAR_MONTHS = 168

RARE_LEVEL_MINIMUM = 50
RARE_LEVEL_LABEL = ">50"
RESPONSE_DAYS = 90
UNKNOWN = "Unknown"

REGION_CLASSES = [("1", "Capital"), ("1.5", "Surrounding Area")]
REGION_CLASS_OTHER = "Other"
REGION_CLASS_OTHER_SEVERITY = "Countryside"
REGION_TOTAL_ROW = 9
REGION_ABROAD = 0
REGION_ABROAD_POPULATION = 100000.0

DEPARTMENT_CATEGORIES = [
    "ICU", "ER", "HOSPITAL ADMISSION", "Hospice", "Rehabilitation", "Death", "Other", "Missing",
]
UNCATEGORIZED = "Uncategorized"
REHABILITATION = "Rehabilitation"

ARRIVAL_KEPT = {"Ambulance Service": "Ambulance", "Family": "Family"}
ARRIVAL_OTHER = "Other"
NO_DIAGNOSIS = "-"
LOG_SHIFT = 0.1
SIGNIFICANCE = 0.05
