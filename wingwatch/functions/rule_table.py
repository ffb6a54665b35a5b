"""Recommendation rule table.

FIXED VALUES: the rules below must equal the reference's (feature, bounds,
titles, priorities, reductions, costs, pillars, regulations, actions, KPIs),
listed in the reference's order.  A rule fires when its feature is not NULL
and lies inside the interval: ``lo`` (exclusive unless ``lo_incl``) and
``hi`` (exclusive unless ``hi_incl``); a missing bound is open.
"""

RULES = [
    dict(rule_id="WEATHER_SEVERE", feature="weather_risk_score", lo=70, lo_incl=False, hi=None, hi_incl=False,
         title="Delay Flight - Severe Weather Conditions",
         description="Weather conditions exceed safe operating limits. Consider delaying operations until conditions improve.",
         priority="CRITICAL", risk_reduction=35.0, cost="$$", time="Immediate",
         sms_pillar="Safety Risk Management", regulations=["14 CFR 91.103", "ICAO Annex 3"],
         actions=["Monitor weather updates every 30 minutes", "Brief crew on alternate airports",
                  "Calculate additional fuel for diversions", "Notify passengers of potential delay"],
         kpis=["On-time departure rate", "Weather-related incidents"]),
    dict(rule_id="WEATHER_MODERATE", feature="weather_risk_score", lo=50, lo_incl=False, hi=70, hi_incl=True,
         title="Enhanced Weather Monitoring Required",
         description="Elevated weather risk detected. Implement enhanced monitoring procedures.",
         priority="HIGH", risk_reduction=15.0, cost="$", time="1-2 hours",
         sms_pillar="Safety Assurance", regulations=["14 CFR 91.103"],
         actions=["Review latest METAR/TAF", "Confirm alternate airport fuel loaded",
                  "Brief crew on weather conditions", "Check PIREPs for route"],
         kpis=["Weather briefing completion rate"]),
    dict(rule_id="LOW_VISIBILITY", feature="visibility_m", lo=None, lo_incl=False, hi=3000, hi_incl=False,
         title="Low Visibility Operations Protocol",
         description="Visibility below standard minimums. Implement LVO procedures if equipped.",
         priority="CRITICAL", risk_reduction=40.0, cost="$$$", time="Immediate",
         sms_pillar="Safety Risk Management", regulations=["14 CFR 91.175", "ICAO Annex 6"],
         actions=["Verify crew is LVO certified", "Confirm aircraft CAT II/III equipped",
                  "Check RVR requirements", "Coordinate with ATC for low vis ops"],
         kpis=["Low visibility go-around rate", "LVO training currency"]),
    dict(rule_id="HIGH_WIND", feature="wind_speed_kt", lo=25, lo_incl=False, hi=None, hi_incl=False,
         title="High Wind Crosswind Landing Assessment",
         description="Wind speeds exceed normal limits. Evaluate crosswind component and aircraft limitations.",
         priority="HIGH", risk_reduction=25.0, cost="$", time="30 minutes",
         sms_pillar="Safety Risk Management", regulations=["Aircraft POH/AFM"],
         actions=["Calculate crosswind component", "Review aircraft crosswind limits",
                  "Consider alternate runway", "Plan for go-around"],
         kpis=["Hard landing rate", "Go-around rate"]),
    dict(rule_id="CREW_FATIGUE_HIGH", feature="crew_fatigue_index", lo=80, lo_incl=False, hi=None, hi_incl=False,
         title="CRITICAL: Crew Fatigue Limit Exceeded",
         description="Crew fatigue levels are dangerously high. Immediate crew rest or replacement required.",
         priority="CRITICAL", risk_reduction=45.0, cost="$$$", time="Immediate",
         sms_pillar="Safety Policy & Objectives", regulations=["14 CFR 117", "EASA ORO.FTL"],
         actions=["Verify actual rest hours", "Consider crew replacement",
                  "Delay departure for minimum rest", "Document fatigue report"],
         kpis=["Fatigue-related incidents", "FDP utilization rate"]),
    dict(rule_id="CREW_FATIGUE_MODERATE", feature="crew_fatigue_index", lo=60, lo_incl=False, hi=80, hi_incl=True,
         title="Crew Fatigue Management Actions",
         description="Elevated crew fatigue detected. Implement fatigue countermeasures.",
         priority="HIGH", risk_reduction=20.0, cost="$", time="Before flight",
         sms_pillar="Safety Risk Management", regulations=["14 CFR 117"],
         actions=["Brief crew on fatigue countermeasures", "Schedule controlled rest if applicable",
                  "Reduce workload where possible", "Monitor crew performance"],
         kpis=["Fatigue report submission rate"]),
    dict(rule_id="EXCESSIVE_DUTY", feature="crew_duty_hours", lo=12, lo_incl=False, hi=None, hi_incl=False,
         title="Flight Duty Period Limit Approaching",
         description="Crew approaching or exceeding FDP limits. Plan for extension or relief.",
         priority="HIGH", risk_reduction=30.0, cost="$$", time="1-2 hours",
         sms_pillar="Safety Policy & Objectives", regulations=["14 CFR 117.17", "14 CFR 117.19"],
         actions=["Calculate remaining FDP", "Assess need for extension",
                  "Pre-position relief crew if needed", "Document FDP extension justification"],
         kpis=["FDP extension rate", "Max FDP utilization"]),
    dict(rule_id="MAINTENANCE_OVERDUE", feature="maintenance_overdue_flag", lo=1, lo_incl=True, hi=1, hi_incl=True,
         title="CRITICAL: Maintenance Action Overdue",
         description="Aircraft has overdue maintenance items. Ground aircraft until resolved.",
         priority="CRITICAL", risk_reduction=50.0, cost="$$$$", time="Immediate",
         sms_pillar="Safety Assurance", regulations=["14 CFR 43.3", "14 CFR 91.409"],
         actions=["Ground aircraft immediately", "Review overdue items with maintenance",
                  "Complete required maintenance", "Document MEL/CDL items"],
         kpis=["Maintenance completion rate", "AOG hours"]),
    dict(rule_id="MAINTENANCE_RISK_HIGH", feature="maintenance_risk", lo=70, lo_incl=False, hi=None, hi_incl=False,
         title="High Maintenance Risk - Enhanced Inspection",
         description="Elevated maintenance risk factors. Conduct enhanced pre-flight inspection.",
         priority="HIGH", risk_reduction=25.0, cost="$$", time="1-2 hours",
         sms_pillar="Safety Assurance", regulations=["14 CFR 91.403"],
         actions=["Complete extended walk-around", "Review recent maintenance history",
                  "Verify open MEL items", "Check fluid levels and tire pressure"],
         kpis=["Pre-flight finding rate", "Maintenance write-up rate"]),
    dict(rule_id="OLD_AIRCRAFT", feature="aircraft_age_years", lo=25, lo_incl=False, hi=None, hi_incl=False,
         title="Aging Aircraft Enhanced Monitoring",
         description="Aircraft age exceeds 25 years. Implement aging aircraft monitoring procedures.",
         priority="MEDIUM", risk_reduction=15.0, cost="$$$", time="Ongoing",
         sms_pillar="Safety Assurance", regulations=["14 CFR 121.1107", "AC 120-104"],
         actions=["Review CPCP compliance", "Check structural modifications history",
                  "Verify fatigue-critical inspections current", "Document corrosion prevention status"],
         kpis=["Structural finding rate", "Corrosion finding rate"]),
    dict(rule_id="RUSHED_TURNAROUND", feature="turnaround_time_mins", lo=None, lo_incl=False, hi=30, hi_incl=False,
         title="Rushed Turnaround - Risk Mitigation",
         description="Turnaround time below minimum. Risk of incomplete checks.",
         priority="HIGH", risk_reduction=20.0, cost="$", time="Immediate",
         sms_pillar="Safety Risk Management", regulations=["Company SOP"],
         actions=["Prioritize critical safety checks", "Use quick-turn checklist",
                  "Verify fuel, weight, balance complete", "Accept minor delay if needed for safety"],
         kpis=["Turnaround incident rate", "Ground damage rate"]),
    dict(rule_id="HIGH_INJURY_PATTERN", feature="injury_score", lo=50, lo_incl=False, hi=None, hi_incl=False,
         title="High-Risk Pattern - Enhanced Safety Measures",
         description="Historical injury patterns indicate elevated risk. Implement enhanced safety measures.",
         priority="HIGH", risk_reduction=30.0, cost="$$$", time="Before flight",
         sms_pillar="Safety Promotion", regulations=["ICAO Annex 13"],
         actions=["Review similar incidents", "Brief crew on specific risks",
                  "Implement threat and error management", "Consider additional safety briefing"],
         kpis=["Incident recurrence rate", "Near-miss reports"]),
    dict(rule_id="FATAL_RISK_ELEVATED", feature="severity_code", lo=3, lo_incl=True, hi=None, hi_incl=False,
         title="FATAL Risk Level - Comprehensive Review",
         description="Conditions match historical fatal accident patterns. Full risk review required.",
         priority="CRITICAL", risk_reduction=50.0, cost="$$", time="Immediate",
         sms_pillar="Safety Risk Management", regulations=["ICAO SMS Manual"],
         actions=["Conduct pre-flight risk assessment", "Brief all crew on heightened awareness",
                  "Establish hard risk mitigation criteria", "Document and share safety concern"],
         kpis=["Pre-flight risk assessment completion", "Safety stand-down rate"]),
]

# API subset: (id, feature, test, threshold, title, priority, reduction, cost, pillar);
# "gt"/"lt"/"eq1" with the API's truthiness test (0 and NULL never fire).
# The two weather rules are exclusive (elif).
API_RULES = [
    ("WEATHER_SEVERE_001", "weather_risk_score", "gt", 70, "Delay Flight - Severe Weather Conditions",
     "CRITICAL", 35.0, "$$", "Safety Risk Management"),
    ("WEATHER_MODERATE_001", "weather_risk_score", "gt", 50, "Enhanced Weather Monitoring Required",
     "HIGH", 15.0, "$", "Safety Assurance"),
    ("FATIGUE_HIGH_001", "crew_fatigue_index", "gt", 80, "CRITICAL: Crew Fatigue Limit Exceeded",
     "CRITICAL", 45.0, "$$$", "Safety Policy"),
    ("MAINTENANCE_OVERDUE_001", "maintenance_overdue_flag", "eq1", 1, "CRITICAL: Maintenance Action Overdue",
     "CRITICAL", 50.0, "$$$$", "Safety Assurance"),
    ("LOW_VIS_001", "visibility_m", "lt", 3000, "Low Visibility Operations Protocol",
     "CRITICAL", 40.0, "$$$", "Safety Risk Management"),
    ("TURNAROUND_001", "turnaround_time_mins", "lt", 30, "Rushed Turnaround - Risk Mitigation",
     "HIGH", 20.0, "$", "Safety Risk Management"),
]

# FIXED VALUES: the rest of each API item, in the order of API_RULES:
# id -> (description, implementation time, regulatory references, action steps, KPIs)
API_DETAILS = {
    "WEATHER_SEVERE_001": (
        "Weather conditions exceed safe operating limits. Consider delaying operations.", "Immediate",
        ["14 CFR 91.103", "ICAO Annex 3"],
        ["Monitor weather updates every 30 minutes", "Brief crew on alternate airports",
         "Calculate additional fuel for diversions", "Notify passengers of potential delay"],
        ["On-time departure rate", "Weather-related incidents"]),
    "WEATHER_MODERATE_001": (
        "Elevated weather risk detected. Implement enhanced monitoring.", "1-2 hours", ["14 CFR 91.103"],
        ["Review latest METAR/TAF", "Confirm alternate airport fuel loaded", "Brief crew on weather conditions"],
        ["Weather briefing completion rate"]),
    "FATIGUE_HIGH_001": (
        "Crew fatigue levels are dangerously high. Immediate action required.", "Immediate",
        ["14 CFR 117", "EASA ORO.FTL"],
        ["Verify actual rest hours", "Consider crew replacement", "Delay departure for minimum rest", "Document fatigue report"],
        ["Fatigue-related incidents", "FDP utilization rate"]),
    "MAINTENANCE_OVERDUE_001": (
        "Aircraft has overdue maintenance items. Ground aircraft until resolved.", "Immediate",
        ["14 CFR 43.3", "14 CFR 91.409"],
        ["Ground aircraft immediately", "Review overdue items with maintenance", "Complete required maintenance", "Document MEL/CDL items"],
        ["Maintenance completion rate", "AOG hours"]),
    "LOW_VIS_001": (
        "Visibility below standard minimums. Implement LVO procedures.", "Immediate",
        ["14 CFR 91.175", "ICAO Annex 6"],
        ["Verify crew is LVO certified", "Confirm aircraft CAT II/III equipped", "Check RVR requirements", "Coordinate with ATC"],
        ["Low visibility go-around rate", "LVO training currency"]),
    "TURNAROUND_001": (
        "Turnaround time below minimum. Risk of incomplete checks.", "Immediate", ["Company SOP"],
        ["Prioritize critical safety checks", "Use quick-turn checklist", "Verify fuel, weight, balance complete"],
        ["Turnaround incident rate", "Ground damage rate"]),
}

# Feature-name aliases applied before rule matching (trap T8, deliberate fix):
# the rules name ``*_mins`` while operational tables carry ``*_minutes``.
FEATURE_ALIASES = {"turnaround_time_mins": "turnaround_time_minutes",
                   "schedule_deviation_mins": "schedule_deviation_minutes"}
