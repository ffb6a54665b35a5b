"""Rule-based recommendations.

Rules are data rows compiled to Column predicates.  Per record, the fired
rules form one ``array(when(cond_i, struct(i, value)))`` expression that is
filtered and exploded: a single narrow projection, no join per rule and no
cross join.  Rule attributes (titles, actions, ...) come from a broadcast
join to the rule dimension, whose size is fixed (13 rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType,
                               StringType, StructField, StructType)

from wingwatch.functions import constants as K
from wingwatch.functions.rule_table import API_DETAILS, API_RULES, FEATURE_ALIASES, RULES

RULE_SCHEMA = StructType([
    StructField("rule_order", IntegerType()), StructField("rule_id", StringType()),
    StructField("feature", StringType()), StructField("title", StringType()),
    StructField("description", StringType()), StructField("priority", StringType()),
    StructField("priority_rank", IntegerType()), StructField("risk_reduction_percent", DoubleType()),
    StructField("cost_level", StringType()), StructField("implementation_time", StringType()),
    StructField("sms_pillar", StringType()), StructField("regulatory_refs", ArrayType(StringType())),
    StructField("action_steps", ArrayType(StringType())), StructField("kpis", ArrayType(StringType())),
    StructField("trigger_threshold", DoubleType()), StructField("lo_inclusive", BooleanType()),
])


def rule_dim(spark: SparkSession, rules: list[dict] = RULES) -> DataFrame:
    rows = [(i, r["rule_id"], r["feature"], r["title"], r["description"], r["priority"],
             K.PRIORITY_ORDER.get(r["priority"], 4), float(r["risk_reduction"]), r["cost"], r["time"],
             r["sms_pillar"], list(r["regulations"]), list(r["actions"]), list(r["kpis"]),
             float(r["lo"] if r["lo"] is not None else r["hi"]), bool(r["lo_incl"]))
            for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _resolve(df: DataFrame, feature: str, use_aliases: bool) -> str | None:
    if feature in df.columns:
        return feature
    if use_aliases and FEATURE_ALIASES.get(feature) in df.columns:
        return FEATURE_ALIASES[feature]
    return None


def rule_condition(value: Column, rule: dict) -> Column:
    cond = value.isNotNull()
    if rule["lo"] is not None:
        cond = cond & ((value >= rule["lo"]) if rule["lo_incl"] else (value > rule["lo"]))
    if rule["hi"] is not None:
        cond = cond & ((value <= rule["hi"]) if rule["hi_incl"] else (value < rule["hi"]))
    return cond


def fired_rules(df: DataFrame, rules: list[dict] = RULES, use_aliases: bool = True) -> Column:
    """Array of (rule_order, trigger_value) for the rules a row triggers.

    Rules whose feature is absent are skipped at plan time; NULL never fires.
    """
    items = []
    for i, r in enumerate(rules):
        col = _resolve(df, r["feature"], use_aliases)
        if col is None:
            continue
        v = F.col(col).cast("double")
        items.append(F.when(rule_condition(v, r),
                            F.struct(F.lit(i).alias("rule_order"), v.alias("trigger_value"))))
    if not items:
        return F.array().cast("array<struct<rule_order:int,trigger_value:double>>")
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def recommendations(df: DataFrame, key: str = "id", rules: list[dict] = RULES,
                    use_aliases: bool = True, shap: DataFrame | None = None) -> DataFrame:
    """One row per (record, fired rule) with rule attributes and a sort key
    (priority rank, rule order, record key) reproducing the stable sort."""
    spark = df.sparkSession
    fired = df.select(F.col(key).alias("record_id"), F.explode(fired_rules(df, rules, use_aliases)).alias("f"))
    fired = fired.select("record_id", "f.rule_order", "f.trigger_value")
    recs = fired.join(F.broadcast(rule_dim(spark, rules)), "rule_order")
    contrib = F.lit(0.0)
    if shap is not None:
        recs = recs.join(shap, (recs.record_id == shap.record_id) & (recs.feature == shap.feature), "left") \
                   .drop(shap.record_id).drop(shap.feature)
        contrib = F.coalesce(F.col("contribution"), F.lit(0.0))
    return recs.select(
        F.concat_ws("_", "rule_id", F.col("record_id").cast("string")).alias("rec_id"),
        "record_id", "rule_id", "rule_order", "title", "description", "priority", "priority_rank",
        "risk_reduction_percent", "cost_level", "implementation_time", "sms_pillar",
        "regulatory_refs", "action_steps", "kpis", contrib.alias("shap_contribution"),
        "trigger_value", "trigger_threshold")


def sorted_recommendations(recs: DataFrame) -> DataFrame:
    """CRITICAL < HIGH < MEDIUM < LOW, then rule order, then record key."""
    return recs.orderBy("priority_rank", "rule_order", "record_id")


def recommendation_summary(recs: DataFrame) -> DataFrame:
    """Counts by priority and total reduction capped at 95, one row."""
    return recs.agg(
        F.count(F.lit(1)).alias("total_recommendations"),
        *[F.count_if(F.col("priority") == p).alias(p.lower()) for p in K.PRIORITY_ORDER],
        F.least(F.coalesce(F.sum("risk_reduction_percent"), F.lit(0.0)),
                F.lit(K.MAX_TOTAL_REDUCTION)).alias("total_risk_reduction"))


def to_export(recs: DataFrame) -> DataFrame:
    """Export rows; list fields as JSON text (CSV-safe) plus a JSON record."""
    return recs.select(
        "rec_id", "priority", "title",
        F.to_json("regulatory_refs").alias("regulatory_refs"),
        F.to_json("action_steps").alias("action_steps"), F.to_json("kpis").alias("kpis"),
        F.to_json(F.struct("rec_id", "title", "description", "priority", "risk_reduction_percent",
                           "cost_level", "implementation_time", "sms_pillar", "regulatory_refs",
                           "shap_contribution", "trigger_value", "trigger_threshold", "action_steps",
                           "kpis")).alias("json"))


def api_recommendations(df: DataFrame, key: str = "id", use_aliases: bool = True) -> DataFrame:
    """The API's six-rule subset per record.  Values use the API's
    truthiness (``if x and x > t``: 0 and NULL never fire); the weather pair is
    exclusive; items sorted by priority (stable); reduction capped at 95."""
    fired = []
    weather_severe = None
    for rid, feature, test, thr, title, prio, red, cost, pillar in API_RULES:
        col = _resolve(df, feature, use_aliases)
        if col is None:
            continue
        v = F.col(col).cast("double")
        truthy = F.coalesce(v != 0, F.lit(False))
        if test == "gt":
            cond = truthy & (v > thr)
        elif test == "lt":
            cond = truthy & (v < thr)
        else:
            cond = truthy & (v == thr)
        if rid == "WEATHER_SEVERE_001":
            weather_severe = cond
        elif rid == "WEATHER_MODERATE_001" and weather_severe is not None:
            cond = ~weather_severe & cond
        item = F.struct(F.lit(K.PRIORITY_ORDER[prio]).alias("rank"), F.lit(len(fired)).alias("pos"),
                        F.lit(rid).alias("id"), F.lit(red).alias("reduction"))
        fired.append(F.when(cond, item))
    arr = (F.array_sort(F.filter(F.array(*fired), lambda x: x.isNotNull())) if fired
           else F.array().cast("array<struct<rank:int,pos:int,id:string,reduction:double>>"))
    return df.select(F.col(key).alias("record_id"), arr.alias("items")).select(
        "record_id", F.size("items").alias("total_recommendations"),
        F.transform("items", lambda x: x["id"]).alias("recommendation_ids"),
        F.least(F.aggregate("items", F.lit(0.0), lambda acc, x: acc + x["reduction"]),
                F.lit(K.MAX_TOTAL_REDUCTION)).alias("total_risk_reduction"))


API_ITEM_SCHEMA = ("recommendation_id string, title string, description string, priority string, risk_reduction_percent double, cost_level string, "
                   "implementation_time string, sms_pillar string, regulatory_refs array<string>, action_steps array<string>, kpis array<string>")


def api_recommendation_items(df: DataFrame, key: str = "id", use_aliases: bool = True) -> DataFrame:
    """D6 in full: one row per (record, item) in the order served, with all fields of the item."""
    details = [(rid, title, API_DETAILS[rid][0], prio, red, cost, API_DETAILS[rid][1], pillar, *API_DETAILS[rid][2:])
               for rid, _, _, _, title, prio, red, cost, pillar in API_RULES]
    dim = df.sparkSession.createDataFrame(details, API_ITEM_SCHEMA)  # six fixed items
    fired = api_recommendations(df, key, use_aliases).select("record_id", F.posexplode("recommendation_ids").alias("pos", "recommendation_id"))
    return (fired.join(F.broadcast(dim), "recommendation_id")
            .select("record_id", (F.col("pos") + 1).alias("position"), *dim.columns))
