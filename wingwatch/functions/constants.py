"""Fixed values.

Every value in this module must equal the reference's for results to match
(code lists, weights, ladders, thresholds, dimension rows).  They are written
out plainly, in the reference's natural order.
"""

# ---- FIXED VALUES (must equal the reference) -------------------------------

VALID_SOURCES = ["NTSB", "ASRS", "FAA", "SYNTHETIC", "INTERNAL"]
VALID_SEVERITIES = ["NONE", "MINOR", "SERIOUS", "FATAL"]
VALID_PHASES = [
    "PREFLIGHT", "TAXI", "TAKEOFF", "CLIMB", "CRUISE",
    "DESCENT", "APPROACH", "LANDING", "POST_FLIGHT", "UNKNOWN",
]
INCIDENT_REQUIRED = ["source", "incident_date", "severity"]
INCIDENT_IMPORTANT = ["source", "incident_date", "severity", "location",
                      "aircraft_make", "phase_of_flight"]
OPS_REQUIRED = ["date", "aircraft_id"]
OPS_RANGES = [
    ("crew_duty_hours", 0, 24),
    ("crew_rest_hours", 0, 48),
    ("crew_fatigue_index", 0, 100),
    ("aircraft_age_years", 0, 100),
    ("operational_risk_score", 0, 100),
]
OPS_IMPORTANT = ["date", "aircraft_id", "crew_duty_hours", "aircraft_age_years",
                 "operational_risk_score"]
EARLIEST_VALID_DATE = "1950-01-01"

# severity weight used by the transformer (0/1/3/5) and class code (0..3)
SEVERITY_WEIGHTS = {"NONE": 0, "MINOR": 1, "SERIOUS": 3, "FATAL": 5}
SEVERITY_CLASSES = {"NONE": 0, "MINOR": 1, "SERIOUS": 2, "FATAL": 3}

PHASE_RISK = {
    "TAKEOFF": 1.5, "LANDING": 1.4, "APPROACH": 1.3, "CLIMB": 1.1,
    "DESCENT": 1.1, "CRUISE": 0.8, "TAXI": 0.7, "PREFLIGHT": 0.5,
    "POST_FLIGHT": 0.5, "UNKNOWN": 1.0,
}
PHASE_RISK_DEFAULT = 1.0
WEATHER_CONDITION_RISK = {"VMC": 0.3, "IMC": 0.8}
WEATHER_CONDITION_RISK_DEFAULT = 0.5
HOLIDAY_MONTHS = [11, 12, 7]

# accident-database code maps
INJURY_CODE_SEVERITY = {"FATL": "FATAL", "SERS": "SERIOUS", "MINR": "MINOR", "NONE": "NONE"}
PHASE_CODE_MAP = {
    "TAXI": "TAXI", "TKOF": "TAKEOFF", "CLIMB": "CLIMB", "CRUISE": "CRUISE",
    "DESCEND": "DESCENT", "DESCENT": "DESCENT", "APPR": "APPROACH",
    "APPROACH": "APPROACH", "LDG": "LANDING", "LANDING": "LANDING",
    "MANEUVERING": "CRUISE", "STANDING": "PREFLIGHT", "OTHER": "UNKNOWN",
}

# voluntary-report keyword maps (ordered: first contained key wins)
REPORT_PHASE_KEYWORDS = [
    ("takeoff", "TAKEOFF"), ("climb", "CLIMB"), ("cruise", "CRUISE"),
    ("descent", "DESCENT"), ("approach", "APPROACH"), ("landing", "LANDING"),
    ("taxi", "TAXI"), ("parked", "PREFLIGHT"), ("initial", "CLIMB"),
    ("final", "APPROACH"),
]
REPORT_DATE_FORMATS = ["yyyyMM", "yyyy-M", "M/yyyy", "yyyy", "yyyyMMdd", "M/d/yyyy"]

# weather ladder 1 (wind in m/s)
SI_VISIBILITY_STEPS = [(500, 30), (1000, 25), (3000, 15), (5000, 10), (8000, 5)]
SI_WIND_STEPS = [(20, 30), (15, 25), (10, 15), (7, 10), (5, 5)]
SI_CONDITION_RISK = {
    "Thunderstorm": 25, "Tornado": 25, "Squall": 25, "Snow": 20, "Rain": 10,
    "Drizzle": 5, "Fog": 20, "Mist": 10, "Haze": 5, "Clouds": 3, "Clear": 0,
}
SI_CONDITION_DEFAULT = 5
SI_SEVERE_CONDITIONS = ["Thunderstorm", "Tornado", "Squall", "Hurricane"]
SI_SEVERE_WIND_MS = 12.9
SI_SEVERE_VISIBILITY_M = 1000

# weather ladder 2 (wind in knots)
KT_VISIBILITY_STEPS = [(500, 30), (1000, 25), (3000, 18), (5000, 12), (8000, 6)]
KT_WIND_STEPS = [(30, 30), (25, 25), (20, 18), (15, 12), (10, 6)]
KT_CONDITION_RISK = {"Thunderstorm": 25, "Fog": 22, "Snow": 18, "Rain": 12,
                     "Clouds": 5, "Clear": 0}
KT_CONDITION_DEFAULT = 10
KT_SEVERE_CONDITIONS = ["Thunderstorm", "Tornado"]
KT_SEVERE_WIND_KT = 25

MPS_TO_KNOTS = 1.94384
IMC_VISIBILITY_M = 5000
IMC_CLOUD_COVER = 80

# risk level bands
RISK_LEVELS = [(75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM")]
RISK_LEVEL_DEFAULT = "LOW"

# airport complexity by type
AIRPORT_TYPES_KEPT = ["large_airport", "medium_airport", "small_airport"]
AIRPORT_COMPLEXITY = {"large_airport": 80, "medium_airport": 50, "small_airport": 30}

# aircraft reference dimension (24 rows):
# make, model, category, engine_type, engines, seats, mtow_lbs, risk_factor
AIRCRAFT_TYPES = [
    ("CESSNA", "172", "Airplane", "Piston", 1, 4, 2550, 0.6),
    ("CESSNA", "182", "Airplane", "Piston", 1, 4, 3100, 0.55),
    ("CESSNA", "152", "Airplane", "Piston", 1, 2, 1670, 0.65),
    ("PIPER", "PA-28", "Airplane", "Piston", 1, 4, 2550, 0.6),
    ("PIPER", "PA-32", "Airplane", "Piston", 1, 6, 3600, 0.5),
    ("BEECHCRAFT", "BONANZA", "Airplane", "Piston", 1, 6, 3650, 0.45),
    ("MOONEY", "M20", "Airplane", "Piston", 1, 4, 2900, 0.55),
    ("CESSNA", "310", "Airplane", "Piston", 2, 6, 5500, 0.4),
    ("PIPER", "PA-34", "Airplane", "Piston", 2, 6, 4750, 0.45),
    ("BEECHCRAFT", "BARON", "Airplane", "Piston", 2, 6, 5500, 0.4),
    ("CESSNA", "CARAVAN", "Airplane", "Turboprop", 1, 14, 8750, 0.3),
    ("BEECHCRAFT", "KING AIR", "Airplane", "Turboprop", 2, 12, 12500, 0.25),
    ("PILATUS", "PC-12", "Airplane", "Turboprop", 1, 10, 10450, 0.25),
    ("CESSNA", "CITATION", "Airplane", "Jet", 2, 10, 15100, 0.2),
    ("LEARJET", "45", "Airplane", "Jet", 2, 9, 21500, 0.2),
    ("GULFSTREAM", "G550", "Airplane", "Jet", 2, 18, 91000, 0.15),
    ("BOEING", "737", "Airplane", "Jet", 2, 180, 174200, 0.1),
    ("BOEING", "777", "Airplane", "Jet", 2, 350, 775000, 0.08),
    ("AIRBUS", "A320", "Airplane", "Jet", 2, 180, 172000, 0.1),
    ("AIRBUS", "A380", "Airplane", "Jet", 4, 525, 1268000, 0.05),
    ("ROBINSON", "R44", "Helicopter", "Piston", 1, 4, 2500, 0.7),
    ("ROBINSON", "R22", "Helicopter", "Piston", 1, 2, 1370, 0.75),
    ("BELL", "206", "Helicopter", "Turboshaft", 1, 5, 3350, 0.5),
    ("SIKORSKY", "S-76", "Helicopter", "Turboshaft", 2, 12, 13000, 0.35),
]

# anomaly contributing factors (threshold, label), in order
ANOMALY_FACTORS = [
    ("operational_risk_score", 70, "High operational risk score"),
    ("fatigue_risk", 60, "Elevated crew fatigue"),
    ("maintenance_risk", 50, "Maintenance concerns"),
    ("crew_duty_hours", 12, "Extended duty hours"),
]
NO_FACTORS = "No significant factors"

# KPI targets
KPI_TARGETS = {"fatal_rate_target": 15.0, "weather_risk_target": 30.0,
               "operational_risk_target": 25.0}

PRIORITY_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
MAX_TOTAL_REDUCTION = 95.0

# feature lists declared by the models (in declared order)
RISK_FEATURES = [
    "incident_year", "incident_month", "incident_day_of_week", "is_weekend",
    "severity_code", "phase_risk_factor", "total_injuries", "injury_rate",
    "has_coordinates", "is_us", "weather_risk_score",
]
ANOMALY_FEATURES = ["operational_risk_score", "fatigue_risk", "maintenance_risk",
                    "schedule_risk", "crew_duty_hours", "crew_rest_hours",
                    "schedule_deviation_mins", "turnaround_time_mins",
                    "total_injuries", "injury_score", "weather_risk_score",
                    "phase_risk_factor"]
ANOMALY_MIN_FEATURES = 3
RISK_MIN_FEATURES = 5
ANOMALY_NUMERIC_EXCLUDE = ["id", "year", "month", "day"]
SEVERITY_NUMERIC_EXCLUDE = ["severity_code", "severity_encoded", "injury_score"]
RISK_TARGET = "injury_score"
