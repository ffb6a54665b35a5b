"""Brute-force checks: Spark operators vs a direct Python statement of the same rules
on small random inputs (NULLs, boundaries and out-of-range values included)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wingwatch.functions import constants as K
from wingwatch.functions.rule_table import RULES
from wingwatch.operators import quality as Q
from wingwatch.operators import rules as RU

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
FEATURES = sorted({r["feature"] for r in RULES})
edge = st.sampled_from([None, 0.0, 1.0, 3.0, 12.0, 25.0, 30.0, 50.0, 60.0, 70.0, 80.0, 2999.0, 3000.0])
val = st.one_of(edge, st.floats(-10, 4000, allow_nan=False))


def _fires(rule, v):
    if v is None:
        return False
    lo, hi = rule["lo"], rule["hi"]
    if lo is not None and not (v >= lo if rule["lo_incl"] else v > lo):
        return False
    if hi is not None and not (v <= hi if rule["hi_incl"] else v < hi):
        return False
    return True


@SETTINGS
@given(st.lists(st.tuples(*[val] * len(FEATURES)), min_size=1, max_size=15))
def test_rules_match_python(spark, rows):
    data = [(str(i), *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id string, " + ", ".join(f"{f} double" for f in FEATURES))
    got = sorted((r["record_id"], r["rule_id"], r["trigger_value"]) for r in RU.recommendations(df).collect())
    want = []
    for i, r in enumerate(rows):
        values = dict(zip(FEATURES, r))
        for rule in RULES:
            v = values[rule["feature"]]
            if _fires(rule, v):
                want.append((str(i), rule["rule_id"], float(v)))
    assert got == sorted(want)


sources = st.sampled_from(["NTSB", "ASRS", "FAA", "BOGUS", None])
sevs = st.sampled_from(["NONE", "MINOR", "SERIOUS", "FATAL", "bad", None])
phases = st.sampled_from(K.VALID_PHASES + ["GO_AROUND", None])
dates = st.sampled_from([None, dt.datetime(1940, 1, 1), dt.datetime(2000, 5, 1), dt.datetime(2030, 1, 1)])
ints = st.sampled_from([None, -1, 0, 2])
coords = st.sampled_from([None, 0.0, 95.0, -200.0, 45.0])
row = st.tuples(sources, sevs, phases, dates, ints, ints, ints, coords, coords)

SCHEMA = ("source string, severity string, phase_of_flight string, incident_date timestamp_ntz, "
          "injuries_fatal int, injuries_serious int, injuries_minor int, latitude double, longitude double")
AS_OF = dt.datetime(2025, 1, 1)


def _pandas_checks(pdf: pd.DataFrame) -> dict[str, tuple[int, int]]:
    """The validator rules restated on pandas (checked, failed)."""
    n = len(pdf)
    out = {f"required_field_{f}": (n, int(pdf[f].isna().sum())) for f in K.INCIDENT_REQUIRED}
    out["valid_source"] = (n, int((~pdf["source"].isin(K.VALID_SOURCES)).sum()))
    out["valid_severity"] = (n, int((~pdf["severity"].isin(K.VALID_SEVERITIES)).sum()))
    d = pd.to_datetime(pdf["incident_date"])
    out["valid_dates"] = (n, int(d.isna().sum() + (d > AS_OF).sum() + (d < dt.datetime(1950, 1, 1)).sum()))
    fatal = pdf["severity"] == "FATAL"
    out["injury_severity_consistency"] = (int(fatal.sum()),
                                          int((fatal & (pdf["injuries_fatal"].fillna(0) == 0)).sum()))
    for c in ["injuries_fatal", "injuries_serious", "injuries_minor"]:
        out[f"non_negative_{c}"] = (n, int((pdf[c].fillna(0) < 0).sum()))
    lat, lon = pdf["latitude"], pdf["longitude"]
    both = lat.notna() & lon.notna()
    if both.sum():
        bad = (((lat < -90) | (lat > 90)) & lat.notna()) | (((lon < -180) | (lon > 180)) & lon.notna())
        out["valid_coordinates"] = (int(both.sum()), int(bad.sum()))
    ph = pdf["phase_of_flight"]
    out["valid_flight_phase"] = (int(ph.notna().sum()), int((ph.notna() & ~ph.isin(K.VALID_PHASES)).sum()))
    return out


@SETTINGS
@given(st.lists(row, min_size=1, max_size=25))
def test_quality_report_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    res = Q.validate_incidents(df, AS_OF.strftime("%Y-%m-%d")).first()
    got = {c["check_name"]: (c["records_checked"], c["records_failed"]) for c in res["checks"]}
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(
        {"injuries_fatal": "Int64", "injuries_serious": "Int64", "injuries_minor": "Int64"})
    want = _pandas_checks(pdf)
    assert got == want
    rates = [0.0 if c == 0 else (c - f) / c * 100 for c, f in want.values()]
    valid = [0.0 if c == 0 else (c - f) / c * 100 for k, (c, f) in want.items() if k.startswith("valid_")]
    present = ["source", "incident_date", "severity", "phase_of_flight"]
    completeness = float(np.mean([(1 - pdf[f].isna().mean()) * 100 for f in present]))
    overall = completeness * 0.3 + float(np.mean(rates)) * 0.4 + (float(np.mean(valid)) if valid else 100) * 0.3
    assert res["overall_score"] == pytest.approx(overall, abs=1e-9)
