"""Layer 2: hand-made micro-fixtures for the semantic traps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField, StructType,
                               TimestampNTZType)

from wingwatch.functions import text as T
from wingwatch.functions import weather as W
from wingwatch.functions.incident import incident_features
from wingwatch.operators import analytics as AN
from wingwatch.operators import dims
from wingwatch.operators import enrich as EN
from wingwatch.operators import ingest as IN
from wingwatch.operators import quality as Q
from wingwatch.operators import rules as RU

INC_SCHEMA = StructType([
    StructField("id", IntegerType()), StructField("source", StringType()),
    StructField("incident_date", TimestampNTZType()), StructField("severity", StringType()),
    StructField("injuries_fatal", IntegerType()), StructField("injuries_serious", IntegerType()),
    StructField("injuries_minor", IntegerType()), StructField("injuries_uninjured", IntegerType()),
    StructField("latitude", DoubleType()), StructField("longitude", DoubleType()),
    StructField("country", StringType()), StructField("location", StringType()),
    StructField("phase_of_flight", StringType()), StructField("weather_conditions", StringType()),
    StructField("aircraft_make", StringType()),
])


def inc_rows(spark, rows):
    base = dict(id=0, source="NTSB", incident_date=dt.datetime(2024, 1, 1), severity="NONE",
                injuries_fatal=0, injuries_serious=0, injuries_minor=0, injuries_uninjured=0,
                latitude=None, longitude=None, country="USA", location=None, phase_of_flight=None,
                weather_conditions=None, aircraft_make=None)
    data = []
    for i, r in enumerate(rows):
        d = {**base, "id": i, **r}
        data.append(tuple(d[f.name] for f in INC_SCHEMA.fields))
    return spark.createDataFrame(data, INC_SCHEMA)


def checks(df, as_of="2025-01-01"):
    out = Q.validate_incidents(df, as_of)
    return {r["check_name"]: r for r in out.select(F.inline("checks")).collect()}, out.first()


def test_t1_null_is_not_a_valid_enum(spark):
    c, _ = checks(inc_rows(spark, [{"source": None}, {"source": "NTSB"}, {"source": "BAD"}]))
    assert c["valid_source"]["records_failed"] == 2
    assert c["required_field_source"]["records_failed"] == 1


def test_t2_no_fatal_rows_gives_zero_pass_rate(spark):
    c, _ = checks(inc_rows(spark, [{"severity": "NONE"}]))
    r = c["injury_severity_consistency"]
    assert r["records_checked"] == 0 and r["pass_rate"] == 0.0


def test_t3_coordinates(spark):
    c, _ = checks(inc_rows(spark, [{}]))
    assert "valid_coordinates" not in c           # no row has both coordinates
    c, _ = checks(inc_rows(spark, [{"latitude": 10.0, "longitude": 20.0},
                                   {"latitude": 95.0, "longitude": None}]))
    r = c["valid_coordinates"]
    assert (r["records_checked"], r["records_failed"], r["records_passed"]) == (1, 1, 0)


def test_t5_missing_column(spark):
    df = inc_rows(spark, [{}, {}]).drop("source")
    c, _ = checks(df)
    assert c["required_field_source"]["records_failed"] == 2
    assert "valid_source" not in c


def test_t10_t11_dates(spark):
    df = incident_features(inc_rows(spark, [{"incident_date": None},
                                            {"incident_date": dt.datetime(2024, 1, 6)},
                                            {"incident_date": dt.datetime(2024, 1, 1)}]))
    rows = {r["id"]: r for r in df.collect()}
    assert rows[0]["is_weekend"] == 0 and rows[0]["is_holiday_season"] == 0
    assert rows[1]["day_of_week"] == 5 and rows[1]["is_weekend"] == 1     # Saturday
    assert rows[2]["day_of_week"] == 0                                     # Monday
    prof = AN.monthly_incident_profile(df).collect()
    assert all(r["year"] is not None for r in prof)


def test_t14_zero_visibility(spark):
    df = spark.createDataFrame([(0.0,)], "v double")
    si = df.select(W.weather_risk_si(F.col("v"), F.lit(0.0), F.lit(0.0), F.lit("Clear"), F.lit(20.0))).first()[0]
    kt = df.select(W.weather_risk_kt(F.col("v"), F.lit(0.0), F.lit("Clear"), F.lit(20.0))).first()[0]
    assert si == 0.0 and kt == 30.0


def test_t15_empty_model_needle(spark):
    inc = inc_rows(spark, [{"aircraft_make": "ZZZZZZ"}]).withColumn("aircraft_model", F.lit(None).cast("string"))
    fixed = EN.aircraft_matches(inc).first()
    legacy = EN.aircraft_matches(inc, legacy_empty_match=True).first()
    assert fixed["match_count"] == 0 and legacy["match_count"] == 24


@pytest.mark.parametrize("n,expected", [(1, "insufficient_data"), (2, None), (4, None), (6, None)])
def test_t16_trend_periods(spark, n, expected):
    counts = [10 * (i + 1) for i in range(n)]
    series = spark.createDataFrame([(f"20{i:02d}", c) for i, c in enumerate(counts)], "period string, count long")
    r = AN.trend_direction(series, "yearly").first()
    if expected:
        assert r["trend_direction"] == expected
    else:
        recent = sum(sorted(counts, reverse=True)[:3])
        older = sum(counts[:3])
        want = "increasing" if recent > older * 1.1 else "decreasing" if recent < older * 0.9 else "stable"
        assert (r["recent"], r["older"], r["trend_direction"]) == (recent, older, want)


def test_t16_zero_older_window(spark):
    series = spark.createDataFrame([("2001", 0), ("2002", 0), ("2003", 0), ("2004", 5), ("2005", 5),
                                    ("2006", 5)], "period string, count long")
    r = AN.trend_direction(series, "yearly").first()
    assert r["trend_direction"] == "increasing" and r["change_percent"] is None


def test_c18_date_formats(spark):
    vals = ["202301", "2023-01", "01/2023", "2023", "20230115", "1/5/2023", "junk", None]
    df = spark.createDataFrame([(v,) for v in vals], "d string")
    got = [r[0] for r in df.select(T.parse_multi_date(F.col("d"))).collect()]
    want = [dt.datetime(2023, 1, 1)] * 4 + [dt.datetime(2023, 1, 15), dt.datetime(2023, 1, 5), None, None]
    assert got == want


def test_d1_first_aircraft_wins(spark):
    inc = spark.createDataFrame([("E1",), ("E2",)], "external_id string")
    ac = spark.createDataFrame([("E1", 2, 1, 1, "B", "b", "N2"), ("E1", 1, 9, 9, "A", "a", "N1")],
                               "ev_id string, line_no int, part_no long, supp_no long, acft_make string, "
                               "acft_model string, regis_no string")
    rows = {r["external_id"]: r for r in IN.enrich_first_aircraft(inc, ac).collect()}
    assert rows["E1"]["aircraft_make"] == "A" and rows["E2"]["aircraft_make"] is None


def test_d2_code_variants(spark):
    inc = inc_rows(spark, [{}, {}, {}]).withColumn(
        "airport_code", F.element_at(F.array(F.lit("LAX"), F.lit("JFK"), F.lit("sfo")), F.col("id") + 1))
    ap = spark.createDataFrame([("KLAX", 1.0, 2.0), ("JFK", 3.0, 4.0), ("SFO", 5.0, 6.0)],
                               "icao_code string, latitude double, longitude double")
    rows = {r["airport_code"]: r for r in EN.airport_coords(inc, ap).collect()}
    assert rows["LAX"]["matched_code"] == "KLAX" and rows["LAX"]["latitude"] == 1.0
    assert rows["JFK"]["matched_code"] == "JFK"
    assert rows["sfo"]["matched_code"] == "SFO" and rows["sfo"]["longitude"] == 6.0


def test_e16_zero_and_one_recommendation(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 90.0)], "id string, crew_fatigue_index double")
    none = RU.recommendation_summary(RU.recommendations(df.filter("id = 'a'"))).first()
    one = RU.recommendation_summary(RU.recommendations(df.filter("id = 'b'"))).first()
    assert none["total_recommendations"] == 0 and none["total_risk_reduction"] == 0.0
    assert one["total_recommendations"] == 1 and one["critical"] == 1 and one["total_risk_reduction"] == 45.0


def test_t8_alias_and_null_never_fires(spark):
    df = spark.createDataFrame([("a", 20), ("b", None)], "id string, turnaround_time_minutes int")
    recs = RU.recommendations(df).collect()
    assert [(r["record_id"], r["rule_id"]) for r in recs] == [("a", "RUSHED_TURNAROUND")]
    assert RU.recommendations(df, use_aliases=False).count() == 0


def test_api_rules_zero_does_not_fire(spark):
    df = spark.createDataFrame([("a", 0.0, 80.0), ("b", 100.0, 60.0)],
                               "id string, visibility_m double, weather_risk_score double")
    rows = {r["record_id"]: r for r in RU.api_recommendations(df).collect()}
    assert rows["a"]["recommendation_ids"] == ["WEATHER_SEVERE_001"]
    assert rows["b"]["recommendation_ids"] == ["LOW_VIS_001", "WEATHER_MODERATE_001"]
    assert rows["b"]["total_risk_reduction"] == 55.0


def test_safe_int_rules(spark):
    df = spark.createDataFrame([("2",), (" 3 ",), ("2.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(T.safe_int(F.col("v"))).collect()] == [2, 3, 0, 0, 0]


def test_c25_unit_conversions(spark):
    df = spark.createDataFrame([(10.0, 20.0, 60.0), (0.0, 20.0, None)], "ms double, t double, lat double")
    rows = df.select(W.mps_to_knots(F.col("ms")).alias("kt"),
                     W.feels_like(F.col("t"), F.lit(10.0)).alias("fl"),
                     W.latitude_temperature(F.col("t"), F.col("lat")).alias("lt")).collect()
    assert rows[0]["kt"] == pytest.approx(19.4384) and rows[1]["kt"] == 0.0
    assert rows[0]["fl"] == 17.0
    assert rows[0]["lt"] == pytest.approx(20.0 - (60 - 40) / 50 * 5) and rows[1]["lt"] == 20.0
