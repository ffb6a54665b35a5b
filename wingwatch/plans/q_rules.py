"""Recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wingwatch.functions import constants as K
from wingwatch.functions.incident import incident_features
from wingwatch.functions.ops import ops_features
from wingwatch.functions.rule_table import API_DETAILS, API_RULES, FEATURE_ALIASES, RULES
from wingwatch.operators import analytics as AN
from wingwatch.operators import rules as RU
from wingwatch.plans.catalog import query
from wingwatch.sources import adapters as A
from wingwatch.sources.tables import Tables

OPS_RULE_COLS = ["crew_fatigue_index", "crew_duty_hours", "maintenance_overdue_flag", "maintenance_risk",
                 "aircraft_age_years", "turnaround_time_minutes"]


def rule_records(spark, sf_dir):
    """Operational and incident feature rows in one frame for rule matching."""
    t = Tables(spark, sf_dir)
    ops = ops_features(A.operational_data(t)).select(F.col("id").alias("record_id"), *OPS_RULE_COLS)
    inc = AN.with_weather_payload(incident_features(A.incidents(t))).select(
        F.col("id").cast("string").alias("record_id"),
        F.col("wx_risk").alias("weather_risk_score"), F.col("wx_visibility").alias("visibility_m"),
        F.col("wx_wind").alias("wind_speed_kt"), "injury_score", "severity_code")
    return ops.unionByName(inc, allowMissingColumns=True)


# ---- oracle helpers --------------------------------------------------------------

_RECORDS_SQL = """records AS (
  SELECT id AS record_id, crew_fatigue_index, crew_duty_hours, maintenance_overdue_flag, maintenance_risk,
    aircraft_age_years, turnaround_time_minutes, CAST(NULL AS DOUBLE) AS weather_risk_score,
    CAST(NULL AS DOUBLE) AS visibility_m, CAST(NULL AS DOUBLE) AS wind_speed_kt,
    CAST(NULL AS INTEGER) AS injury_score, CAST(NULL AS INTEGER) AS severity_code
  FROM ops_features
  UNION ALL
  SELECT CAST(id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, wx_risk, wx_visibility, wx_wind,
    injury_score, severity_code FROM incident_wx)"""


def _cond_sql(v: str, r: dict) -> str:
    parts = [f"{v} IS NOT NULL"]
    if r["lo"] is not None:
        parts.append(f"{v} {'>=' if r['lo_incl'] else '>'} {r['lo']}")
    if r["hi"] is not None:
        parts.append(f"{v} {'<=' if r['hi_incl'] else '<'} {r['hi']}")
    return " AND ".join(parts)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "CAST(to_json([" + ", ".join(map(_text, values)) + "]) AS VARCHAR)"


def _recs_sql(source: str) -> str:
    branches = []
    for i, r in enumerate(RULES):
        col = FEATURE_ALIASES.get(r["feature"], r["feature"]) if r["feature"] in FEATURE_ALIASES else r["feature"]
        v = f"CAST({col} AS DOUBLE)"
        thr = float(r["lo"] if r["lo"] is not None else r["hi"])
        title = r["title"].replace("'", "''")
        branches.append(
            f"SELECT '{r['rule_id']}_' || record_id AS rec_id, record_id, '{r['rule_id']}' AS rule_id, "
            f"{i} AS rule_order, '{title}' AS title, '{r['priority']}' AS priority, "
            f"{K.PRIORITY_ORDER[r['priority']]} AS priority_rank, "
            f"CAST({r['risk_reduction']} AS DOUBLE) AS risk_reduction_percent, '{r['cost']}' AS cost_level, "
            f"'{r['sms_pillar']}' AS sms_pillar, CAST(0.0 AS DOUBLE) AS shap_contribution, "
            f"{v} AS trigger_value, CAST({thr} AS DOUBLE) AS trigger_threshold, "
            f"{_text(r['description'])} AS description, {_text(r['time'])} AS implementation_time, "
            f"{_list(r['regulations'])} AS regulatory_refs, {_list(r['actions'])} AS action_steps, {_list(r['kpis'])} AS kpis "
            f"FROM {source} WHERE {_cond_sql(v, r)}")
    return "\nUNION ALL ".join(branches)


_REC_COLS = ["rec_id", "record_id", "rule_id", "rule_order", "title", "priority", "priority_rank",
             "risk_reduction_percent", "cost_level", "sms_pillar", "shap_contribution", "trigger_value",
             "trigger_threshold"]


@query("recommendations", ("ops_features", "incident_wx"),
       f"WITH {_RECORDS_SQL}\nSELECT {', '.join(_REC_COLS)} FROM ({_recs_sql('records')}) r")
def recommendations(spark, sf_dir):
    recs = RU.recommendations(rule_records(spark, sf_dir), key="record_id")
    return recs.select(*_REC_COLS)


_TOP10_SQL = f"""top10 AS (SELECT * FROM records WHERE record_id IN (
  SELECT id FROM ops_features ORDER BY operational_risk_score DESC, id LIMIT 10)),
recs AS ({_recs_sql('top10')})"""


def _top10_recs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ops = ops_features(A.operational_data(t))
    top = AN.top_k(ops, "operational_risk_score", 10).select(F.col("id").alias("record_id"), *OPS_RULE_COLS)
    return RU.recommendations(top, key="record_id")


@query("recommendation_summary", ("ops_features", "incident_wx"), f"""WITH {_RECORDS_SQL}, {_TOP10_SQL}
SELECT count(*) AS total_recommendations, count_if(priority = 'CRITICAL') AS critical,
  count_if(priority = 'HIGH') AS high, count_if(priority = 'MEDIUM') AS medium, count_if(priority = 'LOW') AS low,
  least(COALESCE(sum(risk_reduction_percent), 0.0), 95.0) AS total_risk_reduction FROM recs""")
def recommendation_summary(spark, sf_dir):
    """Top-10 riskiest operations -> rules -> priority counts."""
    return RU.recommendation_summary(_top10_recs(spark, sf_dir))


_RECORD_JSON = """'{' || concat_ws(',', '"rec_id":' || to_json(rec_id)::VARCHAR, '"title":' || to_json(title)::VARCHAR,
  '"description":' || to_json(description)::VARCHAR, '"priority":' || to_json(priority)::VARCHAR,
  '"risk_reduction_percent":' || CAST(risk_reduction_percent AS VARCHAR), '"cost_level":' || to_json(cost_level)::VARCHAR,
  '"implementation_time":' || to_json(implementation_time)::VARCHAR, '"sms_pillar":' || to_json(sms_pillar)::VARCHAR,
  '"regulatory_refs":' || regulatory_refs, '"shap_contribution":' || CAST(shap_contribution AS VARCHAR),
  '"trigger_value":' || CAST(trigger_value AS VARCHAR), '"trigger_threshold":' || CAST(trigger_threshold AS VARCHAR),
  '"action_steps":' || action_steps, '"kpis":' || kpis) || '}'"""


@query("recs_json", ("ops_features", "incident_wx"), f"""WITH {_RECORDS_SQL}, {_TOP10_SQL}
SELECT rec_id, priority, title, regulatory_refs, action_steps, kpis, {_RECORD_JSON} AS json FROM recs""")
def recs_json(spark, sf_dir):
    """Whole export rows of the top-10 run (list fields as JSON text, and the JSON record)."""
    return RU.to_export(_top10_recs(spark, sf_dir))


@query("recommendations_ordered", ("ops_features", "incident_wx"), f"""WITH {_RECORDS_SQL}, {_TOP10_SQL}
SELECT CAST(row_number() OVER (ORDER BY priority_rank, rule_order, record_id) AS INTEGER) AS position, rec_id, priority FROM recs""")
def recommendations_ordered(spark, sf_dir):
    """The top-10 run's recommendations in served order, numbered by the order they come in."""
    ordered = RU.sorted_recommendations(_top10_recs(spark, sf_dir))
    # at most 13 rules x 10 records: one list in that order
    listed = ordered.agg(F.array_sort(F.collect_list(F.struct("priority_rank", "rule_order", "record_id", "rec_id", "priority"))).alias("r"))
    return listed.select(F.posexplode("r").alias("pos", "x")).select((F.col("pos") + 1).alias("position"), "x.rec_id", "x.priority")


#: rule feature -> (column of the linear contributions, its SQL)
_TERMS = {"crew_fatigue_index": ("fatigue_term", "crew_fatigue_index * 0.25"),
          "maintenance_risk": ("maintenance_term", "maintenance_risk * 0.2"),
          "aircraft_age_years": ("age_term", "aircraft_age_years / 2.0")}


def _contribution_sql() -> str:
    rows = []
    for r in RULES:
        col = FEATURE_ALIASES.get(r["feature"], r["feature"])
        if col in OPS_RULE_COLS:
            term = _TERMS.get(r["feature"], ("", "0.0"))[1]
            rows.append(f"SELECT '{r['rule_id']}_' || id AS rec_id, round(COALESCE(CAST({term} AS DOUBLE), 0.0), 6) AS shap_contribution "
                        f"FROM ops_features WHERE {_cond_sql(f'CAST({col} AS DOUBLE)', r)}")
    return " UNION ALL ".join(rows)


@query("recommendation_contributions", ("ops_features",), _contribution_sql())
def recommendation_contributions(spark, sf_dir):
    """D5 with contributions: rules fired by operations carry the linear term of their feature."""
    from wingwatch.plans.q_stats import linear_contributions

    ops = ops_features(A.operational_data(Tables(spark, sf_dir)))
    terms = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("contribution")) for f, (c, _) in _TERMS.items()])
    long = linear_contributions(ops).select(F.col("id").alias("record_id"), F.inline(terms))
    recs = RU.recommendations(ops.select(F.col("id").alias("record_id"), *OPS_RULE_COLS), key="record_id", shap=long)
    return recs.select("rec_id", F.round("shap_contribution", 6).alias("shap_contribution"))


def _api_sql() -> str:
    items = []
    for pos, (rid, feature, test, thr, *_rest) in enumerate(API_RULES):
        col = FEATURE_ALIASES.get(feature, feature)
        v = f"CAST({col} AS DOUBLE)"
        op = {"gt": ">", "lt": "<", "eq1": "="}[test]
        cond = f"COALESCE({v} <> 0, FALSE) AND {v} {op} {thr}"
        items.append((K.PRIORITY_ORDER[_rest[1]], pos, rid, cond, _rest[2]))
    sev = items[0][3]
    items[1] = (items[1][0], items[1][1], items[1][2], f"NOT COALESCE({sev}, FALSE) AND {items[1][3]}", items[1][4])
    ordered = sorted(items, key=lambda x: (x[0], x[1]))
    ids = ", ".join(f"CASE WHEN COALESCE({c}, FALSE) THEN '{rid}' END" for _, _, rid, c, _ in ordered)
    n = " + ".join(f"CAST(COALESCE({c}, FALSE) AS INTEGER)" for _, _, _, c, _ in ordered)
    red = " + ".join(f"CASE WHEN COALESCE({c}, FALSE) THEN {r} ELSE 0.0 END" for _, _, _, c, r in ordered)
    return (f"SELECT record_id, {n} AS total_recommendations, concat_ws('|', {ids}) AS recommendation_ids, "
            f"CAST(least({red}, 95.0) AS DOUBLE) AS total_risk_reduction FROM records")


@query("recommendations_api", ("ops_features", "incident_wx"), f"WITH {_RECORDS_SQL}\n{_api_sql()}")
def recommendations_api(spark, sf_dir):
    r = RU.api_recommendations(rule_records(spark, sf_dir), key="record_id")
    return r.select("record_id", F.col("total_recommendations").cast("int").alias("total_recommendations"),
                    F.array_join("recommendation_ids", "|").alias("recommendation_ids"), "total_risk_reduction")


def _api_items_sql() -> str:
    fired, out = [], []
    severe = None
    for pos, (rid, feature, test, thr, title, prio, red, cost, pillar) in enumerate(API_RULES):
        v = f"CAST({FEATURE_ALIASES.get(feature, feature)} AS DOUBLE)"
        cond = f"COALESCE({v} <> 0 AND {v} {dict(gt='>', lt='<', eq1='=')[test]} {thr}, FALSE)"
        if rid == "WEATHER_SEVERE_001":
            severe = cond
        elif rid == "WEATHER_MODERATE_001":
            cond = f"(NOT {severe} AND {cond})"
        text, time, refs, steps, kpis = API_DETAILS[rid]
        fired.append((K.PRIORITY_ORDER[prio], pos, cond, f"'{rid}' AS recommendation_id, {_text(title)} AS title, {_text(text)} AS description, "
                      f"'{prio}' AS priority, CAST({red} AS DOUBLE) AS risk_reduction_percent, '{cost}' AS cost_level, '{time}' AS implementation_time, "
                      f"'{pillar}' AS sms_pillar, {_list(refs)} AS regulatory_refs, {_list(steps)} AS action_steps, {_list(kpis)} AS kpis"))
    before = []
    for _, _, cond, fields in sorted(fired, key=lambda x: x[:2]):
        place = " + ".join([f"CAST({c} AS INTEGER)" for c in before] + ["1"])
        out.append(f"SELECT record_id, {place} AS position, {fields} FROM records WHERE {cond}")
        before.append(cond)
    return "\nUNION ALL ".join(out)


@query("recommendations_api_items", ("ops_features", "incident_wx"), f"WITH {_RECORDS_SQL}\n{_api_items_sql()}")
def recommendations_api_items(spark, sf_dir):
    """Whole items, in the order served."""
    items = RU.api_recommendation_items(rule_records(spark, sf_dir), key="record_id")
    return items.withColumns({c: F.to_json(c) for c in ("regulatory_refs", "action_steps", "kpis")})
