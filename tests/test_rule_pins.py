"""Rule engine and API items pinned to literal values, so that a slip in the rule table shows.

The oracles of these queries are generated from the same table as the operators; here every expected value is
written out, with a value on, just below and just above each bound.
"""

import pytest

from wingwatch.operators import rules as R

#: (column, value, rules that fire)
EDGES = [
    ("weather_risk_score", 50.0, []),
    ("weather_risk_score", 50.1, ["WEATHER_MODERATE"]),
    ("weather_risk_score", 70.0, ["WEATHER_MODERATE"]),
    ("weather_risk_score", 70.1, ["WEATHER_SEVERE"]),
    ("visibility_m", 2999.9, ["LOW_VISIBILITY"]),
    ("visibility_m", 0.0, ["LOW_VISIBILITY"]),
    ("visibility_m", 3000.0, []),
    ("wind_speed_kt", 25.0, []),
    ("wind_speed_kt", 25.1, ["HIGH_WIND"]),
    ("crew_fatigue_index", 60.0, []),
    ("crew_fatigue_index", 60.1, ["CREW_FATIGUE_MODERATE"]),
    ("crew_fatigue_index", 80.0, ["CREW_FATIGUE_MODERATE"]),
    ("crew_fatigue_index", 80.1, ["CREW_FATIGUE_HIGH"]),
    ("crew_duty_hours", 12.0, []),
    ("crew_duty_hours", 12.1, ["EXCESSIVE_DUTY"]),
    ("maintenance_overdue_flag", 0.0, []),
    ("maintenance_overdue_flag", 1.0, ["MAINTENANCE_OVERDUE"]),
    ("maintenance_overdue_flag", 2.0, []),
    ("maintenance_risk", 70.0, []),
    ("maintenance_risk", 70.1, ["MAINTENANCE_RISK_HIGH"]),
    ("aircraft_age_years", 25.0, []),
    ("aircraft_age_years", 25.1, ["OLD_AIRCRAFT"]),
    ("turnaround_time_minutes", 29.9, ["RUSHED_TURNAROUND"]),
    ("turnaround_time_minutes", 30.0, []),
    ("injury_score", 50.0, []),
    ("injury_score", 50.1, ["HIGH_INJURY_PATTERN"]),
    ("severity_code", 2.0, []),
    ("severity_code", 3.0, ["FATAL_RISK_ELEVATED"]),
    ("severity_code", 5.0, ["FATAL_RISK_ELEVATED"]),
]
COLUMNS = list(dict.fromkeys(c for c, _, _ in EDGES))
SCHEMA = "id long, " + ", ".join(f"{c} double" for c in COLUMNS)


def rows(spark, given):
    return spark.createDataFrame([(i, *[g.get(c) for c in COLUMNS]) for i, g in enumerate(given)], SCHEMA)


def test_every_bound(spark):
    out = R.recommendations(rows(spark, [{c: v} for c, v, _ in EDGES])).collect()
    fired = {i: [] for i in range(len(EDGES))}
    for r in out:
        fired[r.record_id].append(r.rule_id)
        assert r.rec_id == f"{r.rule_id}_{r.record_id}" and r.trigger_value == EDGES[r.record_id][1]
    assert [(c, v, fired[i]) for i, (c, v, _) in enumerate(EDGES)] == EDGES


def test_attributes_of_fired_rules(spark):
    everything = {"weather_risk_score": 90.0, "visibility_m": 100.0, "wind_speed_kt": 40.0, "crew_fatigue_index": 70.0,
                  "crew_duty_hours": 13.0, "maintenance_overdue_flag": 1.0, "maintenance_risk": 90.0, "aircraft_age_years": 30.0,
                  "turnaround_time_minutes": 20.0, "injury_score": 60.0, "severity_code": 4.0}
    recs = R.recommendations(rows(spark, [everything]))
    got = [(r.rule_id, r.priority, r.risk_reduction_percent, r.cost_level, r.trigger_threshold)
           for r in R.sorted_recommendations(recs).collect()]
    assert got == [
        ("WEATHER_SEVERE", "CRITICAL", 35.0, "$$", 70.0),
        ("LOW_VISIBILITY", "CRITICAL", 40.0, "$$$", 3000.0),
        ("MAINTENANCE_OVERDUE", "CRITICAL", 50.0, "$$$$", 1.0),
        ("FATAL_RISK_ELEVATED", "CRITICAL", 50.0, "$$", 3.0),
        ("HIGH_WIND", "HIGH", 25.0, "$", 25.0),
        ("CREW_FATIGUE_MODERATE", "HIGH", 20.0, "$", 60.0),
        ("EXCESSIVE_DUTY", "HIGH", 30.0, "$$", 12.0),
        ("MAINTENANCE_RISK_HIGH", "HIGH", 25.0, "$$", 70.0),
        ("RUSHED_TURNAROUND", "HIGH", 20.0, "$", 30.0),
        ("HIGH_INJURY_PATTERN", "HIGH", 30.0, "$$$", 50.0),
        ("OLD_AIRCRAFT", "MEDIUM", 15.0, "$$$", 25.0),
    ]
    total = R.recommendation_summary(recs).first()
    assert (total.total_recommendations, total.critical, total.high, total.medium, total.low) == (11, 4, 6, 1, 0)
    assert total.total_risk_reduction == 95.0


@pytest.mark.parametrize("given, ids, reduction", [
    ({}, [], 0.0),
    ({"weather_risk_score": 70.0}, ["WEATHER_MODERATE_001"], 15.0),
    ({"weather_risk_score": 70.1}, ["WEATHER_SEVERE_001"], 35.0),
    ({"weather_risk_score": 50.0}, [], 0.0),
    ({"crew_fatigue_index": 80.0}, [], 0.0),
    ({"crew_fatigue_index": 80.1}, ["FATIGUE_HIGH_001"], 45.0),
    ({"maintenance_overdue_flag": 1.0}, ["MAINTENANCE_OVERDUE_001"], 50.0),
    ({"maintenance_overdue_flag": 2.0}, [], 0.0),
    ({"visibility_m": 0.0}, [], 0.0),  # zero counts as not given
    ({"visibility_m": 2999.0}, ["LOW_VIS_001"], 40.0),
    ({"turnaround_time_minutes": 0.0}, [], 0.0),
    ({"turnaround_time_minutes": 29.0}, ["TURNAROUND_001"], 20.0),
    ({"weather_risk_score": 60.0, "turnaround_time_minutes": 10.0, "visibility_m": 10.0},
     ["LOW_VIS_001", "WEATHER_MODERATE_001", "TURNAROUND_001"], 75.0),
    ({"weather_risk_score": 90.0, "crew_fatigue_index": 90.0, "maintenance_overdue_flag": 1.0},
     ["WEATHER_SEVERE_001", "FATIGUE_HIGH_001", "MAINTENANCE_OVERDUE_001"], 95.0),
])
def test_api_items(spark, given, ids, reduction):
    row = R.api_recommendations(rows(spark, [given])).first()
    assert (row.recommendation_ids, row.total_recommendations, row.total_risk_reduction) == (ids, len(ids), reduction)
