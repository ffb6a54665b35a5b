"""Source normalisation into the incident schema.

Every per-row loop of the reference is one ``select`` here.  Header matching
(B8) and table discovery (A7) are driver-side decisions over *schema*
metadata only, never over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wingwatch.functions import text as T
from wingwatch.sources.delimited import read_delimited  # noqa: F401

ACCIDENT_WEATHER_FIELDS = [
    ("wx_temp", "temperature_f"), ("wx_dew_pt", "dew_point_f"),
    ("wind_vel_kts", "wind_speed_kt"), ("wind_dir_deg", "wind_direction_deg"),
    ("vis_sm", "visibility_sm"), ("gust_kts", "gust_kts"), ("altimeter", "altimeter"),
    ("sky_cond_ceil", "ceiling_condition"), ("sky_ceil_ht", "ceiling_height"),
    ("light_cond", "light_condition"),
]


def _col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def accident_weather_json(df: DataFrame) -> Column:
    """C14: JSON of the present weather fields, NULLs omitted; NULL when empty."""
    present = [(src, dst) for src, dst in ACCIDENT_WEATHER_FIELDS if src in df.columns]
    if not present:
        return F.lit(None).cast("string")
    js = F.to_json(F.struct(*[F.col(src).alias(dst) for src, dst in present]))
    return F.when(js == "{}", F.lit(None).cast("string")).otherwise(js)


#: fixed values: source fields kept as they came
RAW_DATA_FIELDS = ("ntsb_no", "ev_year", "ev_month", "ev_time", "ev_dow", "apt_name")


def normalize_accidents(events: DataFrame) -> DataFrame:
    """C11-C14: accident events -> incident rows."""
    e = events
    inj = {k: (T.safe_int(F.col(c)) if c in e.columns else F.lit(0))
           for k, c in [("injuries_fatal", "inj_tot_f"), ("injuries_serious", "inj_tot_s"),
                        ("injuries_minor", "inj_tot_m"), ("injuries_uninjured", "inj_tot_n")]}
    return e.select(
        F.lit("NTSB").alias("source"),
        F.col("ev_id").alias("external_id"),
        F.try_to_timestamp(F.col("ev_date")).cast("timestamp_ntz").alias("incident_date"),
        T.join_location(_col_or_null(e, "ev_city"), _col_or_null(e, "ev_state")).alias("location"),
        T.safe_str(_col_or_null(e, "ev_nr_apt_id")).alias("airport_code"),
        F.coalesce(T.safe_str(_col_or_null(e, "ev_country")), F.lit("USA")).alias("country"),
        T.safe_float(_col_or_null(e, "dec_latitude")).alias("latitude"),
        T.safe_float(_col_or_null(e, "dec_longitude")).alias("longitude"),
        T.phase_code(_col_or_null(e, "phase_flt_spec")).alias("phase_of_flight"),
        T.injury_code_severity(_col_or_null(e, "ev_highest_injury")).alias("severity"),
        *[v.cast("int").alias(k) for k, v in inj.items()],
        T.safe_str(_col_or_null(e, "wx_cond_basic")).alias("weather_conditions"),
        accident_weather_json(e).alias("weather_data"),
        T.safe_str(_col_or_null(e, "ev_type")).alias("event_type"),
        F.to_json(F.struct(*[_col_or_null(e, c).alias(c) for c in RAW_DATA_FIELDS]), {"ignoreNullFields": "false"}).alias("raw_data"),
    )


def scan_aircraft(aircraft: DataFrame, limit: int | None = None) -> DataFrame:
    """The raw aircraft table; with ``limit`` the first rows in file order (event, line, part, supplier)."""
    return aircraft if limit is None else aircraft.orderBy("ev_id", "line_no", "part_no", "supp_no").limit(limit)


def first_per_key(rows: DataFrame, key: str, order: list[str], value_cols: list[str]) -> DataFrame:
    """the first row per key by ``order`` (file order stand-in).

    ``min_by`` over a struct is a partial aggregate: every task keeps one row
    per key before the shuffle, so a key holding a third of the data still
    ships one row per task, and no partition is sorted.
    """
    picked = rows.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in value_cols]),
                 F.struct(*[F.col(c) for c in order])).alias("_first"))
    return picked.select(key, *[F.col(f"_first.{c}").alias(c) for c in value_cols])


def enrich_first_aircraft(incidents: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Left lookup of the first aircraft per event (columns NULL when no match, or when the
    aircraft table does not have them)."""
    order = ["line_no", "part_no", "supp_no"]
    values = ["acft_make", "acft_model", "acft_category", "regis_no", "oper_name"]
    present = aircraft.select("ev_id", *order, *[_col_or_null(aircraft, c).alias(c) for c in values])
    first = first_per_key(present, "ev_id", order, values)
    return (incidents.join(first, incidents.external_id == first.ev_id, "left")
            .drop("ev_id")
            .withColumnsRenamed({"acft_make": "aircraft_make", "acft_model": "aircraft_model",
                                 "acft_category": "aircraft_type", "regis_no": "aircraft_registration",
                                 "oper_name": "operator"}))


def normalize_reports(reports: DataFrame, loaded_at: str = "2024-01-01 00:00:00") -> DataFrame:
    """Voluntary reports -> whole incident rows.

    ``id`` is a digest of source and external id, so loading a report twice gives the same row;
    ``loaded_at`` is the load's time (created_at, updated_at).  Fields that a report cannot have are NULL.
    """
    r = reports
    parsed = T.parse_multi_date(_col_or_null(r, "date_raw"))
    synopsis = T.safe_str(_col_or_null(r, "synopsis"), 2000)
    narrative = T.safe_str(_col_or_null(r, "narrative"), 5000)
    anomaly = _col_or_null(r, "anomaly")
    acn = _col_or_null(r, "acn")
    state = T.safe_str(_col_or_null(r, "state_reference"))
    external_id = F.when(acn.isNotNull(), T.safe_str(acn)).otherwise(
        F.concat(F.lit("ASRS-"), F.abs(F.xxhash64(*[F.col(c) for c in r.columns])).cast("string")))
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    loaded = F.lit(loaded_at).cast("timestamp_ntz")
    return r.withColumn("_external_id", external_id).select(
        F.md5(F.concat(F.lit("ASRS|"), F.col("_external_id"))).alias("id"),
        F.lit("ASRS").alias("source"),
        F.col("_external_id").alias("external_id"),
        F.coalesce(parsed, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("incident_date"),
        none("report_date", "timestamp_ntz"),
        F.coalesce(state, F.lit("USA")).alias("location"),
        none("airport_code"),
        F.lit("USA").alias("country"),
        none("latitude", "double"), none("longitude", "double"), none("aircraft_type"),
        T.safe_str(_col_or_null(r, "make_model")).alias("aircraft_make"),
        none("aircraft_model"), none("aircraft_registration"),
        T.safe_str(_col_or_null(r, "operator")).alias("operator"),
        (T.keyword_phase(F.col("flight_phase")) if "flight_phase" in r.columns
         else F.lit("UNKNOWN")).alias("phase_of_flight"),
        none("flight_type"),
        T.keyword_severity(_col_or_null(r, "result"), anomaly).alias("severity"),
        *[F.lit(0).alias(c) for c in ("injuries_fatal", "injuries_serious", "injuries_minor",
                                      "injuries_uninjured")],
        F.lit("None").alias("aircraft_damage"),
        F.coalesce(synopsis, narrative).alias("probable_cause"),
        none("contributing_factors"),
        F.coalesce(F.substring(T.safe_str(anomaly), 1, 100), F.lit("Near Miss")).alias("event_type"),
        T.safe_str(_col_or_null(r, "flight_conditions")).alias("weather_conditions"),
        none("weather_data"), none("raw_data"),
        loaded.alias("created_at"), loaded.alias("updated_at"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """H1: bag union of normalised sources; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


REQUIRED = ["source", "incident_date", "severity"]


def reject_split(rows: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Tag each row accepted/rejected with the first missing required field."""
    reason = None
    for c in required:
        cond = F.col(c).isNull()
        reason = F.when(cond, F.lit(f"missing_{c}")) if reason is None else reason.when(cond, F.lit(f"missing_{c}"))
    return rows.withColumn("reject_reason", reason).withColumn(
        "status", F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected"))


# ---- A9 / B8 delimited file scan with header resolution ----------------------

def find_column(columns: list[str], patterns: list[str], exact: bool = False) -> str | None:
    """First column (file order) matching any pattern; partial and
    case-insensitive unless ``exact``."""
    for col in columns:
        for p in patterns:
            if (col.strip() == p) if exact else (p.lower() in col.lower()):
                return col
    return None


REPORT_HEADERS = {
    "date_raw": ["Date"], "state_reference": ["State Reference", "State"],
    "flight_conditions": ["Flight Conditions"], "operator": ["Aircraft Operator"],
    "make_model": ["Make Model Name"], "flight_phase": ["Flight Phase"],
    "anomaly": ["Anomaly"], "result": ["Result"], "narrative": ["Narrative"],
    "synopsis": ["Synopsis"], "acn": ["ACN", "Accession Number", "Report Number"],
}


def resolve_report_columns(raw: DataFrame) -> DataFrame:
    """B8 applied: rename matched headers to canonical names, drop the rest."""
    picks = []
    for canon, patterns in REPORT_HEADERS.items():
        found = find_column(raw.columns, patterns)
        if found is not None:
            picks.append(F.col(f"`{found}`").alias(canon))
    return raw.select(*picks)


def find_table(spark: SparkSession, fragment: str) -> str | None:
    """First catalog table whose name contains ``fragment`` (case-insensitive)."""
    for t in spark.catalog.listTables():
        if fragment.lower() in t.name.lower():
            return t.name
    return None


NARRATIVE_SCHEMA = StructType([StructField("ev_id", StringType()),
                               StructField("narr_text", StringType())])


def scan_narratives(spark: SparkSession, fragment: str = "narr") -> DataFrame:
    """Narrative rows from the discovered table, or an empty typed frame."""
    name = find_table(spark, fragment)
    if name is None:
        return spark.createDataFrame([], NARRATIVE_SCHEMA)
    return spark.table(name)
