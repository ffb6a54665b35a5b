"""Statistics queries used around the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from wingwatch.functions import risk as R
from wingwatch.functions.incident import severity_class
from wingwatch.functions.ops import ops_features
from wingwatch.operators import quantiles as Q
from wingwatch.operators import stats as ST
from wingwatch.plans.catalog import query
from wingwatch.sources import adapters as A
from wingwatch.sources.tables import Tables

PROBS = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
ANOMALY_COLS = ["operational_risk_score", "fatigue_risk", "maintenance_risk", "schedule_risk",
                "crew_duty_hours", "crew_rest_hours", "schedule_deviation_minutes", "turnaround_time_minutes"]
CONTRIB_COLS = ["weather_term", "fatigue_term", "maintenance_term", "night_term", "age_term"]
SCENARIOS = [{"crew_fatigue_index": 40}, {"maintenance_risk": 20},
             {"weather_risk_score": 30, "crew_fatigue_index": 50}]


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _ops(spark, sf_dir):
    return ops_features(A.operational_data(_t(spark, sf_dir)))


def linear_contributions(ops):
    """Per-row terms of the dashboard's linear risk (C34), weather at the API default 50."""
    h = F.hour("scheduled_departure")
    return ops.select(
        "id", F.lit(50.0 * 0.35).alias("weather_term"), (F.col("crew_fatigue_index") * 0.25).alias("fatigue_term"),
        (F.col("maintenance_risk") * 0.2).alias("maintenance_term"),
        F.when((h < 6) | (h >= 21), F.lit(10.0)).otherwise(F.lit(0.0)).alias("night_term"),
        (F.col("aircraft_age_years") / 2.0).alias("age_term"))


_CONTRIB_SQL = """contrib AS (
  SELECT id, 50.0 * 0.35 AS weather_term, crew_fatigue_index * 0.25 AS fatigue_term,
    maintenance_risk * 0.2 AS maintenance_term,
    CASE WHEN hour(scheduled_departure) < 6 OR hour(scheduled_departure) >= 21 THEN 10.0 ELSE 0.0 END AS night_term,
    aircraft_age_years / 2.0 AS age_term FROM ops_features),
lng AS (
  SELECT id, 'weather_term' AS feature, weather_term AS contribution FROM contrib
  UNION ALL SELECT id, 'fatigue_term', fatigue_term FROM contrib
  UNION ALL SELECT id, 'maintenance_term', maintenance_term FROM contrib
  UNION ALL SELECT id, 'night_term', night_term FROM contrib
  UNION ALL SELECT id, 'age_term', age_term FROM contrib)"""
_HEUR_SQL = """heur AS (SELECT id, greatest(least(50.0 * 0.35 + crew_fatigue_index * 0.25 + maintenance_risk * 0.2
  + CASE WHEN hour(scheduled_departure) < 6 OR hour(scheduled_departure) >= 21 THEN 10.0 ELSE 0.0 END
  + COALESCE(aircraft_age_years, 0.0) / 2.0, 100.0), 0.0) AS heuristic_risk FROM ops_features)"""


def _heuristic(ops):
    h = F.hour("scheduled_departure")
    return ops.withColumn("heuristic_risk", R.heuristic_risk(
        F.lit(50.0), F.col("crew_fatigue_index"), F.col("maintenance_risk"), (h < 6) | (h >= 21),
        F.coalesce(F.col("aircraft_age_years"), F.lit(0.0))))


@query("split_counts", ("incidents",), """
SELECT CASE WHEN CAST(floor(((id % 2147483648) * 1103515245 + 12345 + 42) % 2147483648 / 65536) % 100 AS INTEGER) < 80
         THEN 'train' ELSE 'test' END AS split,
  CAST(CASE severity WHEN 'NONE' THEN 0 WHEN 'MINOR' THEN 1 WHEN 'SERIOUS' THEN 2 WHEN 'FATAL' THEN 3 ELSE 0 END AS INTEGER)
    AS severity_class, count(*) AS records
FROM incidents GROUP BY 1, 2""")
def split_counts(spark, sf_dir):
    inc = A.incidents(_t(spark, sf_dir)).withColumn("severity_class", severity_class(F.col("severity")))
    return ST.hash_split(inc, "id").groupBy("split", "severity_class").agg(F.count(F.lit(1)).alias("records"))


@query("stratified_split", ("incidents",), """
SELECT id, severity_class, CASE WHEN rn <= (n * 80 + 50) // 100 THEN 'train' ELSE 'test' END AS split FROM (
  SELECT id, severity_class, row_number() OVER (PARTITION BY severity_class ORDER BY h, id) AS rn,
         count(*) OVER (PARTITION BY severity_class) AS n FROM (
    SELECT id, ((id % 2147483648) * 1103515245 + 12345 + 42) % 2147483648 AS h,
      CAST(CASE severity WHEN 'NONE' THEN 0 WHEN 'MINOR' THEN 1 WHEN 'SERIOUS' THEN 2 WHEN 'FATAL' THEN 3 ELSE 0 END AS INTEGER)
        AS severity_class FROM incidents) a) b""")
def stratified_split(spark, sf_dir):
    inc = A.incidents(_t(spark, sf_dir)).select("id", severity_class(F.col("severity")).alias("severity_class"))
    return ST.stratified_split(inc, "id", "severity_class")


@query("regression_metrics", ("scored",), """
SELECT n, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2,
  CASE WHEN r2 > 0.8 THEN 'excellent' WHEN r2 > 0.6 THEN 'good' WHEN r2 > 0.4 THEN 'moderate' ELSE 'poor' END AS quality
FROM (SELECT count(*) AS n, avg((y_hat - y) * (y_hat - y)) AS mse, avg(abs(y_hat - y)) AS mae,
        CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum((y_hat - y) * (y_hat - y)) / (var_pop(y) * count(*)) END AS r2
      FROM scored WHERE y IS NOT NULL AND y_hat IS NOT NULL) a""")
def regression_metrics(spark, sf_dir):
    return ST.regression_metrics(A.scored(_t(spark, sf_dir)), "y", "y_hat")


@query("class_weights", ("incidents",), """
SELECT severity_class, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight FROM (
  SELECT CAST(CASE severity WHEN 'NONE' THEN 0 WHEN 'MINOR' THEN 1 WHEN 'SERIOUS' THEN 2 WHEN 'FATAL' THEN 3 ELSE 0 END AS INTEGER)
    AS severity_class, count(*) AS n_c FROM incidents GROUP BY 1) g""")
def class_weights(spark, sf_dir):
    inc = A.incidents(_t(spark, sf_dir)).withColumn("severity_class", severity_class(F.col("severity")))
    return ST.class_weights(inc, "severity_class")


@query("confusion_matrix", ("scored",),
       "SELECT class_actual AS actual, class_pred AS predicted, count(*) AS count FROM scored GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return ST.confusion_matrix(A.scored(_t(spark, sf_dir)), "class_actual", "class_pred")


@query("class_report", ("scored",), """
WITH cm AS (SELECT class_actual AS a, class_pred AS p, count(*) AS c FROM scored GROUP BY 1, 2),
lab AS (SELECT a AS label FROM cm UNION SELECT p FROM cm),
per AS (
  SELECT l.label, COALESCE(tp.c, 0) AS tp, COALESCE(s.c, 0) AS support, COALESCE(pr.c, 0) AS pn
  FROM lab l LEFT JOIN (SELECT a, c FROM cm WHERE a = p) tp ON tp.a = l.label
    LEFT JOIN (SELECT a, sum(c) AS c FROM cm GROUP BY a) s ON s.a = l.label
    LEFT JOIN (SELECT p, sum(c) AS c FROM cm GROUP BY p) pr ON pr.p = l.label),
m AS (SELECT CAST(label AS VARCHAR) AS label, tp, support,
        CASE WHEN pn > 0 THEN tp / pn ELSE 0.0 END AS prec, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec
      FROM per),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m)
SELECT label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def class_report(spark, sf_dir):
    return ST.class_report(A.scored(_t(spark, sf_dir)), "class_actual", "class_pred")


@query("zscores", ("ops_features",), "WITH st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ANOMALY_COLS) + " FROM ops_features)\nSELECT id, " + ", ".join(
    f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END, 6) AS {c}" for c in ANOMALY_COLS)
    + " FROM ops_features, st")
def zscores(spark, sf_dir):
    z = ST.standardize(_ops(spark, sf_dir), ANOMALY_COLS, ["id"])
    return z.select("id", *[F.round(c, 6).alias(c) for c in ANOMALY_COLS])


@query("median_impute", ("ops_features",), "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, median({c}) AS median, count_if({c} IS NULL) AS filled FROM ops_features"
    for c in ANOMALY_COLS))
def median_impute(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    _, med = ST.median_impute(ops, ANOMALY_COLS)
    nulls = ops.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ANOMALY_COLS]).first()
    return spark.createDataFrame([(c, med[c], int(nulls[c])) for c in ANOMALY_COLS],
                                 "feature string, median double, filled bigint")


@query("anomaly_vs_normal", ("ops_features",), "WITH f AS (SELECT *, COALESCE(operational_risk_score > 70 OR "
       "crew_fatigue_index > 80 OR maintenance_risk > 60, FALSE) AS flag FROM ops_features)\n" + "\nUNION ALL ".join(
           f"""SELECT '{c}' AS feature, round(a, 6) AS anomaly_mean, round(n, 6) AS normal_mean,
  round(CASE WHEN n <> 0 THEN (a - n) / n * 100 ELSE 0.0 END, 6) AS diff_pct,
  CASE WHEN abs(CASE WHEN n <> 0 THEN (a - n) / n * 100 ELSE 0.0 END) > 50 THEN 'high'
       WHEN abs(CASE WHEN n <> 0 THEN (a - n) / n * 100 ELSE 0.0 END) > 20 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT round(avg(CASE WHEN flag THEN {c} END), 6) AS a, round(avg(CASE WHEN NOT flag THEN {c} END), 6) AS n
      FROM f) x"""
           for c in ANOMALY_COLS))
def anomaly_vs_normal(spark, sf_dir):
    ops = _ops(spark, sf_dir).withColumn("flag", R.heuristic_anomaly(
        F.col("operational_risk_score"), F.col("crew_fatigue_index"), F.col("maintenance_risk")))
    return ST.anomaly_vs_normal(ops, "flag", ANOMALY_COLS)


@query("score_percentiles", ("scored",), "SELECT CAST(unnest([" + ", ".join(str(p * 100) for p in PROBS)
       + "]) AS DOUBLE) AS percentile, round(unnest(quantile_cont(anomaly_score, [" + ", ".join(map(str, PROBS))
       + "])), 6) AS value FROM scored")
def score_percentiles(spark, sf_dir):
    q = Q.quantile_frame(A.scored(_t(spark, sf_dir)), "anomaly_score", PROBS)
    return q.select(F.round("percentile", 6).alias("percentile"), F.round("value", 6).alias("value"))


@query("top_anomalies", ("scored",), """
SELECT id, anomaly_score, CAST(position AS INTEGER) AS position,
  CASE WHEN position < 3 THEN 3 WHEN position < 6 THEN 2 ELSE 1 END AS severity_level
FROM (SELECT id, anomaly_score, row_number() OVER (ORDER BY anomaly_score, id) - 1 AS position FROM scored) x
WHERE position < 10""")
def top_anomalies(spark, sf_dir):
    return ST.most_anomalous(A.scored(_t(spark, sf_dir)), "anomaly_score", "id")


@query("top_contributions", ("ops_features",), f"""WITH {_CONTRIB_SQL}
SELECT id, CAST(rk AS INTEGER) AS rank, feature, contribution FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature) AS rk
  FROM lng WHERE contribution IS NOT NULL) x WHERE rk <= 3""")
def top_contributions(spark, sf_dir):
    c = linear_contributions(_ops(spark, sf_dir))
    return ST.top_abs_contributions(c, "id", CONTRIB_COLS, 3).withColumn("rank", F.col("rank").cast("int"))


@query("extreme_rows", ("ops_features",), f"""WITH {_HEUR_SQL}
SELECT * FROM (SELECT 'highest' AS which, id, heuristic_risk FROM heur ORDER BY heuristic_risk DESC, id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'lowest', id, heuristic_risk FROM heur ORDER BY heuristic_risk, id LIMIT 1)""")
def extreme_rows(spark, sf_dir):
    return ST.extreme_rows(_heuristic(_ops(spark, sf_dir)), "heuristic_risk", "id")


@query("percent_rank", ("scored",), "WITH g AS (SELECT quantile_cont(anomaly_score, ["
       + ", ".join(str(i / 100) for i in range(1, 100)) + """]) AS grid FROM scored)
SELECT id, anomaly_score, CAST(len(list_filter(grid, lambda q: q <= anomaly_score)) AS INTEGER) AS percentile_bucket
FROM scored, g""")
def percent_rank(spark, sf_dir):
    return ST.percentile_bucket(A.scored(_t(spark, sf_dir)), "anomaly_score", "id")


@query("percent_rank_exact", ("scored",), "SELECT id, anomaly_score, percent_rank() OVER (ORDER BY anomaly_score) AS percent_rank FROM scored")
def percent_rank_exact(spark, sf_dir):
    """Exact percent rank of every row, ties equal."""
    return ST.exact_percent_rank(A.scored(_t(spark, sf_dir)), "anomaly_score", "id")


@query("seeded_sample", ("ops_features",),
       "SELECT id, date, operational_risk_score FROM ops_features ORDER BY md5('42|' || id), id LIMIT 1000")
def seeded_sample(spark, sf_dir):
    return ST.seeded_sample(_ops(spark, sf_dir).select("id", "date", "operational_risk_score"), "id", 1000, seed=42)


@query("shap_importance", ("ops_features",), f"""WITH {_CONTRIB_SQL}
SELECT feature, round(mean_abs, 6) AS mean_abs_shap, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs FROM lng GROUP BY feature) x""")
def shap_importance(spark, sf_dir):
    r = ST.mean_abs_importance(linear_contributions(_ops(spark, sf_dir)), CONTRIB_COLS)
    return r.withColumn("rank", F.col("rank").cast("int"))


@query("explain_extremes", ("ops_features",), f"""WITH {_CONTRIB_SQL}, {_HEUR_SQL},
ex AS (SELECT * FROM (SELECT 'highest' AS which, id FROM heur ORDER BY heuristic_risk DESC, id LIMIT 1)
       UNION ALL SELECT * FROM (SELECT 'lowest', id FROM heur ORDER BY heuristic_risk, id LIMIT 1))
SELECT which, id, CAST(rk AS INTEGER) AS rank, feature, contribution,
  CASE WHEN contribution > 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction FROM (
  SELECT ex.which, lng.*, row_number() OVER (PARTITION BY ex.which ORDER BY abs(contribution) DESC, feature) AS rk
  FROM ex JOIN lng ON ex.id = lng.id WHERE contribution IS NOT NULL) x WHERE rk <= 5""")
def explain_extremes(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    ext = ST.extreme_rows(_heuristic(ops), "heuristic_risk", "id").select("which", "id")
    contrib = linear_contributions(ops).join(F.broadcast(ext), "id")   # 2 rows: bounded
    top = ST.top_abs_contributions(contrib, "id", CONTRIB_COLS, 5)
    return top.join(F.broadcast(ext), "id").select("which", "id", F.col("rank").cast("int").alias("rank"),
                                                   "feature", "contribution",
                                                   R.direction(F.col("contribution")).alias("direction"))


def _linear_score(v):
    return v["weather_risk_score"] * 0.35 + v["crew_fatigue_index"] * 0.25 + v["maintenance_risk"] * 0.2


@query("what_if_linear", ("ops_features",), """
WITH s AS (SELECT id, 50.0 * 0.35 + crew_fatigue_index * 0.25 + maintenance_risk * 0.2 AS b,
  50.0 * 0.35 + 40.0 * 0.25 + maintenance_risk * 0.2 AS s1,
  50.0 * 0.35 + crew_fatigue_index * 0.25 + 20.0 * 0.2 AS s2,
  30.0 * 0.35 + 50.0 * 0.25 + maintenance_risk * 0.2 AS s3 FROM ops_features),
o AS (SELECT id, b, CASE WHEN s1 <= s2 AND s1 <= s3 THEN 1 WHEN s2 <= s3 THEN 2 ELSE 3 END AS k,
        least(s1, s2, s3) AS best FROM s)
SELECT id, round(b, 6) AS base_risk, 'Scenario ' || CAST(k AS VARCHAR) AS optimal_scenario, round(best, 6) AS optimal_risk,
  round(CASE WHEN b > 0 THEN (best - b) / b * 100 ELSE 0.0 END, 6) AS risk_change_percent,
  round(b - best, 6) AS max_risk_reduction FROM o""")
def what_if_linear(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    base = {"weather_risk_score": F.lit(50.0), "crew_fatigue_index": F.col("crew_fatigue_index"),
            "maintenance_risk": F.col("maintenance_risk")}
    return ST.what_if(ops, "id", base, SCENARIOS, _linear_score)
