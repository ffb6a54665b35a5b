"""Aggregations, trends and KPI queries.

All aggregations are single ``groupBy().agg()`` passes: Spark runs them as a
partial (map-side) hash aggregate followed by a final aggregate on the
shuffled partial rows, so a hot key costs one partial row per task, not one
row per record.  Windows run only over already-aggregated series (at most a
few thousand rows), never over raw records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wingwatch.functions import constants as K


def r6(col: Column) -> Column:
    return F.round(col, 6)


def mean6(col: Column | str) -> Column:
    """Reported mean: exact decimal sum, HALF_UP to 6 places, as double.

    A double ``avg`` depends on the order partial sums meet in the shuffle,
    so a mean that sits on a rounding tie could flip between runs; the
    decimal sum makes the reported value independent of partitioning.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.avg(c.cast("decimal(38,12)")), 6).cast("double")


def pct(part: Column, whole: Column) -> Column:
    """part / whole * 100 exactly (decimal), HALF_UP to 6 places; 0 when whole is 0."""
    exact = part.cast("decimal(38,0)") * 100 / whole.cast("decimal(38,0)")
    return F.when(whole > 0, F.round(exact, 6).cast("double")).otherwise(F.lit(0.0))


def monthly_incident_profile(features: DataFrame) -> DataFrame:
    """Incident profile per (year, month); NULL keys dropped like pandas."""
    return (features.filter(F.col("year").isNotNull() & F.col("month").isNotNull())
            .groupBy("year", "month")
            .agg(mean6("severity_code").alias("avg_severity"),
                 F.max("severity_code").cast("bigint").alias("max_severity"),
                 F.count("severity_code").alias("incident_count"),
                 F.sum("is_serious").cast("bigint").alias("serious_count"),
                 F.sum("injury_score").cast("bigint").alias("total_injury_score"),
                 mean6("phase_risk").alias("avg_phase_risk"),
                 mean6("weather_risk").alias("avg_weather_risk")))


# ---- payload parsing (C31) --------------------------------------------------

WEATHER_PAYLOAD_SCHEMA = ("weather_risk_score DOUBLE, visibility_m DOUBLE, wind_speed_kt DOUBLE, "
                          "weather_condition STRING")


def with_weather_payload(df: DataFrame, col: str = "weather_data") -> DataFrame:
    """Parse the JSON payload once per row into typed columns ``wx_*``."""
    p = F.from_json(F.col(col), WEATHER_PAYLOAD_SCHEMA)
    return df.withColumn("_wx", p).withColumns({
        "wx_risk": F.col("_wx.weather_risk_score"),
        "wx_visibility": F.col("_wx.visibility_m"),
        "wx_wind": F.col("_wx.wind_speed_kt"),
        "wx_type": F.col("_wx.weather_condition"),
    }).drop("_wx")


# ---- dashboard / API aggregates --------------------------------------------

def dashboard_summary(features: DataFrame) -> DataFrame:
    """Totals by severity and source in one pass, fatal rate, avg injury score."""
    sev, src = F.col("severity"), F.col("source")
    total = F.count(F.lit(1))
    return features.agg(
        total.alias("total"),
        F.count_if(sev == "FATAL").alias("fatal"),
        F.count_if(sev == "SERIOUS").alias("serious"),
        F.count_if(sev == "MINOR").alias("minor"),
        F.count_if(sev == "NONE").alias("none_count"),
        F.count_if(src == "NTSB").alias("ntsb"),
        F.count_if(src == "ASRS").alias("asrs"),
        pct(F.count_if(sev == "FATAL"), total).alias("fatal_rate"),
        mean6("injury_score").alias("avg_injury_score"),
    )


def yearly_counts(features: DataFrame, last_n: int = 10) -> DataFrame:
    """Incidents per year, newest ``last_n`` years (top-k on <= #years rows)."""
    return (features.filter(F.col("incident_date").isNotNull())
            .groupBy("year").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("year")).limit(last_n))


def period_series(features: DataFrame, period: str, as_of: str, months_back: int = 24,
                  last_n: int | None = None) -> DataFrame:
    """E4/E5 series: count and fatal count per period, newest first.

    ``yearly`` uses all dated rows (last 10 years); ``monthly`` uses rows since
    ``as_of - months_back`` (last 24 months).  ``daily``/``weekly`` are the
    extensions the API accepted but ignored; they have no limit of their own.
    """
    d = F.col("incident_date")
    if period == "yearly":
        key = F.year(d).cast("string")
        rows = features.filter(d.isNotNull())
        last_n = last_n or 10
    else:
        fmt = {"monthly": "yyyy-MM", "weekly": "yyyy-MM-dd", "daily": "yyyy-MM-dd"}[period]
        base = F.date_trunc("week", d) if period == "weekly" else d
        key = F.date_format(base, fmt)
        since = F.add_months(F.lit(as_of).cast("date"), -months_back).cast("timestamp_ntz")
        rows = features.filter(d >= since)
        last_n = last_n or (24 if period == "monthly" else None)
    series = (rows.groupBy(key.alias("period"))
              .agg(F.count(F.lit(1)).alias("count"),
                   F.count_if(F.col("severity") == "FATAL").alias("fatal_count"))
              .orderBy(F.desc("period")))
    return series if last_n is None else series.limit(last_n)


def trend_direction(series: DataFrame, period_type: str) -> DataFrame:
    """Compare the newest 3 periods with the oldest 3 (they overlap when
    fewer than 6 periods exist, as in the API).  Runs on the aggregated series."""
    w_new = Window.orderBy(F.desc("period"))
    w_old = Window.orderBy(F.asc("period"))
    s = series.select("period", "count",
                      F.row_number().over(w_new).alias("rn_new"),
                      F.row_number().over(w_old).alias("rn_old"))
    agg = s.agg(F.count(F.lit(1)).alias("periods"),
                F.coalesce(F.sum(F.when(F.col("rn_new") <= 3, F.col("count"))), F.lit(0))
                .cast("bigint").alias("recent"),
                F.coalesce(F.sum(F.when(F.col("rn_old") <= 3, F.col("count"))), F.lit(0))
                .cast("bigint").alias("older"))
    recent, older = F.col("recent").cast("double"), F.col("older").cast("double")
    direction = (F.when(F.col("periods") < 2, "insufficient_data")
                 .when(recent > older * 1.1, "increasing")
                 .when(recent < older * 0.9, "decreasing").otherwise("stable"))
    change = (F.when(F.col("periods") < 2, F.lit(0.0))
              .when(recent > older * 1.1, F.try_divide(recent - older, older) * 100.0)
              .when(recent < older * 0.9, F.try_divide(older - recent, older) * -100.0)
              .otherwise(F.lit(0.0)))
    return agg.select(F.lit(period_type).alias("period_type"), "periods", "recent", "older",
                      direction.alias("trend_direction"), r6(change).alias("change_percent"))


def severity_by_weather(features: DataFrame) -> DataFrame:
    """Weather payload averages per severity, ordered by avg risk."""
    return (with_weather_payload(features.filter(F.col("weather_data").isNotNull()))
            .groupBy("severity")
            .agg(mean6("wx_risk").alias("avg_weather_risk"),
                 mean6("wx_visibility").alias("avg_visibility"),
                 mean6("wx_wind").alias("avg_wind"),
                 F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc_nulls_last("avg_weather_risk"), "severity"))


def safety_kpis(incidents: DataFrame, ops: DataFrame) -> DataFrame:
    """Incident and operational KPI block with targets (two 1-row aggs)."""
    wx = with_weather_payload(incidents)
    total = F.count(F.lit(1))
    inc = wx.agg(total.alias("total_incidents"),
                 F.count_if(F.col("severity") == "FATAL").alias("fatal_incidents"),
                 pct(F.count_if(F.col("severity") == "FATAL"), total).alias("fatal_rate_percent"),
                 pct(F.count_if(F.col("severity") == "NONE"), total).alias("no_injury_rate_percent"),
                 mean6("wx_risk").alias("avg_weather_risk"))
    op = ops.agg(F.count(F.lit(1)).alias("total_operations"),
                 mean6("operational_risk_score").alias("avg_operational_risk"))
    targets = [F.lit(v).alias(k) for k, v in K.KPI_TARGETS.items()]
    return inc.crossJoin(op).select("*", *targets)


def coverage_counts(incidents: DataFrame) -> DataFrame:
    """Null-aware counts and distinct sources."""
    return incidents.agg(F.count(F.lit(1)).alias("total_incidents"),
                         F.count("weather_data").alias("with_weather"),
                         F.count("latitude").alias("with_coords"),
                         F.countDistinct("source").alias("sources"))


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """Row count per value (NULL is its own group, as in SQL)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), key)


def weather_distribution(incidents: DataFrame) -> DataFrame:
    """Count and avg risk by (conditions, payload weather type)."""
    return (with_weather_payload(incidents.filter(F.col("weather_data").isNotNull()))
            .groupBy("weather_conditions", "wx_type")
            .agg(F.count(F.lit(1)).alias("count"), mean6("wx_risk").alias("avg_risk")))


def ops_summary(ops: DataFrame) -> DataFrame:
    """Operational record count and average risk."""
    return ops.agg(F.count(F.lit(1)).alias("records"),
                   mean6("operational_risk_score").alias("avg_risk"))


def value_distribution(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """Value counts with share of total.  The total is a one-row aggregate of the grouped
    result, joined back to it."""
    g = df.groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("count").alias("_total")))).withColumn("share_pct", pct(F.col("count"), F.col("_total")))
    if top_n:
        g = g.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(top_n)
    return g.select(F.lit(column).alias("dimension"), "value", "count", "share_pct")


def ops_profile(ops: DataFrame, high_risk: float = 70.0) -> DataFrame:
    """Profile of the operational risk column."""
    r = F.col("operational_risk_score")
    return ops.agg(r6(F.min(r)).alias("min_risk"), r6(F.max(r)).alias("max_risk"),
                   mean6(r).alias("mean_risk"),
                   F.countDistinct("aircraft_id").alias("unique_aircraft"),
                   F.countDistinct("flight_id").alias("unique_flights"),
                   F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                   F.count_if(r > high_risk).alias("high_risk_count"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per-column null count and share, one agg then stack to long."""
    total = F.count(F.lit(1)).alias("n")
    row = df.agg(total, *[F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(columns)])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"z{i}").alias("null_count"))
               for i, c in enumerate(columns)]
    return (row.select("n", F.inline(F.array(*entries)))
            .select("column_name", "null_count",
                    pct(F.col("null_count"), F.col("n")).alias("null_pct")))


def feature_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample feature means, long form."""
    row = df.agg(*[mean6(c).alias(f"m{i}") for i, c in enumerate(columns)])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"))
               for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*entries)))


def severity_distribution(features: DataFrame) -> DataFrame:
    """Severity counts, real percentages and average payload risk."""
    g = with_weather_payload(features).groupBy("severity").agg(
        F.count(F.lit(1)).alias("count"), mean6("wx_risk").alias("avg_risk_score"))
    return g.withColumn("percentage", pct(F.col("count"), F.sum("count").over(Window.partitionBy())))


def seasonality(features: DataFrame) -> DataFrame:
    """Incidents per month of year."""
    return (features.filter(F.col("month").isNotNull()).groupBy("month")
            .agg(F.count(F.lit(1)).alias("incidents"),
                 F.count_if(F.col("severity") == "FATAL").alias("fatal")))


def hour_profile(df: DataFrame, ts: str, risk: str) -> DataFrame:
    """Rows and mean risk per hour of day."""
    return (df.filter(F.col(ts).isNotNull()).groupBy(F.hour(ts).cast("int").alias("hour"))
            .agg(F.count(F.lit(1)).alias("observations"), mean6(risk).alias("avg_risk")))


def weekly_series(features: DataFrame) -> DataFrame:
    """Weekly count, fatal rate and mean payload risk (weeks start Monday)."""
    wx = with_weather_payload(features.filter(F.col("incident_date").isNotNull()))
    total = F.count(F.lit(1))
    return (wx.groupBy(F.date_trunc("week", "incident_date").cast("date").alias("week_start"))
            .agg(total.alias("incidents"),
                 pct(F.count_if(F.col("severity") == "FATAL"), total).alias("fatal_rate"),
                 mean6("wx_risk").alias("avg_risk")))


def region_distribution(incidents: DataFrame) -> DataFrame:
    """Incidents per region (suffix of the location text)."""
    region = F.coalesce(F.regexp_extract(F.col("location"), r", (.*)$", 1), F.lit("Unknown"))
    g = incidents.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("incidents"))
    total = g.agg(F.sum("incidents").alias("_total"))  # one row
    return g.crossJoin(F.broadcast(total)).select(
        "region", "incidents", pct(F.col("incidents"), F.col("_total")).alias("share_pct"))


def factor_correlation(df: DataFrame, factors: list[str]) -> DataFrame:
    """Pairwise Pearson correlation of the factors, all pairs in ONE agg."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"),
                        r6(F.col(f"r{i}")).alias("correlation")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*entries)))


def kpi_status(features: DataFrame, warning_factor: float = 1.2,
               critical_factor: float = 1.5) -> DataFrame:
    """Yearly SPI values against targets, status and trend vs prior year.

    Warning/critical thresholds are ``target * factor`` (parameters).  Lower is
    better for every KPI here.  ``lag`` runs on the per-year rows only.
    """
    wx = with_weather_payload(features.filter(F.col("year").isNotNull()))
    total = F.count(F.lit(1))
    yearly = wx.groupBy("year").agg(
        pct(F.count_if(F.col("severity") == "FATAL"), total).alias("fatal_rate"),
        mean6("wx_risk").alias("avg_weather_risk"))
    kpis = [("SPI-001", "fatal_rate", K.KPI_TARGETS["fatal_rate_target"]),
            ("SPI-002", "avg_weather_risk", K.KPI_TARGETS["weather_risk_target"])]
    entries = [F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"),
                        F.col(name).alias("value"), F.lit(target).alias("target_value"))
               for code, name, target in kpis]
    long = yearly.select("year", F.inline(F.array(*entries)))
    prev = F.lag("value").over(Window.partitionBy("code").orderBy("year"))
    v, t = F.col("value"), F.col("target_value")
    return long.select(
        "code", "name", "year", r6(v).alias("value"), "target_value",
        (t * warning_factor).alias("threshold_warning"),
        (t * critical_factor).alias("threshold_critical"),
        (v <= t).alias("target_met"),
        F.when(v.isNull(), "NO_DATA").when(v <= t, "ON_TARGET")
         .when(v <= t * warning_factor, "WARNING").otherwise("CRITICAL").alias("status"),
        F.when(prev.isNull() | v.isNull(), "stable").when(v < prev, "improving")
         .when(v > prev, "declining").otherwise("stable").alias("trend_direction"))


def period_delta(features: DataFrame) -> DataFrame:
    """year-over-year change of incident count and fatal rate."""
    total = F.count(F.lit(1))
    yearly = features.filter(F.col("year").isNotNull()).groupBy("year").agg(
        total.alias("incidents"),
        pct(F.count_if(F.col("severity") == "FATAL"), total).alias("fatal_rate"))
    w = Window.orderBy("year")
    prev_n, prev_r = F.lag("incidents").over(w), F.lag("fatal_rate").over(w)
    return yearly.select(
        "year", "incidents", r6(F.col("fatal_rate")).alias("fatal_rate"),
        r6(F.try_divide((F.col("incidents") - prev_n).cast("double"), prev_n.cast("double")) * 100.0)
        .alias("incidents_change_pct"),
        r6(F.col("fatal_rate") - prev_r).alias("fatal_rate_change"))


# ---- lists, paging, top-k ---------------------------------------------------

def incident_page(incidents: DataFrame, severity: str | None = None, source: str | None = None,
                  limit: int = 50, offset: int = 0, after: tuple | None = None, cause_chars: int = 200) -> DataFrame:
    """Filtered page, newest first (NULL dates first, as PostgreSQL
    DESC), ties broken by id; display projection; total matching count.

    ``after`` = (date or None, id) of the last row seen pages by key: only rows behind it are
    ordered, whatever the depth, where ``offset`` orders all rows before the page as well.  A page
    past the end is one row with NULL columns and the total."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset >= 0")
    cond = F.lit(True)
    if severity is not None:
        cond = cond & (F.col("severity") == F.lit(severity))
    if source is not None:
        cond = cond & (F.col("source") == F.lit(source))
    rows = incidents.filter(cond)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    if after is not None:
        date, last = F.lit(after[0]).cast("timestamp_ntz"), F.col("id") > F.lit(after[1])
        d = F.col("incident_date")
        rows = rows.filter((d.isNull() & last) | d.isNotNull() if after[0] is None else
                           (d < date) | ((d == date) & last))
    page = (rows.orderBy(F.desc_nulls_first("incident_date"), F.asc("id"))
            .offset(offset).limit(limit)
            .select("id", "source", F.col("incident_date").cast("date").alias("date"), "severity",
                    "location",
                    F.when(F.col("aircraft_make").isNotNull(),
                           F.concat(F.col("aircraft_make"), F.lit(" "),
                                    F.coalesce(F.col("aircraft_model"), F.lit("None"))))
                     .otherwise(F.lit("Unknown")).alias("aircraft"),
                    F.substring("probable_cause", 1, cause_chars).alias("cause")))
    return F.broadcast(total).join(page, F.lit(True), "left").select(*page.columns, "total")


def enrichment_backlog(incidents: DataFrame) -> DataFrame:
    """Sizes of the four enrichment work lists, one pass."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return incidents.agg(
        F.count_if(lat.isNotNull() & lon.isNotNull() & F.col("weather_data").isNull())
        .alias("weather_fetch_backlog"),
        F.count_if(F.col("weather_data").isNull()).alias("weather_generate_backlog"),
        F.count_if(F.col("airport_code").isNotNull() & (lat.isNull() | lon.isNull()))
        .alias("airport_coord_backlog"),
        F.count_if(F.col("aircraft_make").isNotNull()).alias("aircraft_match_candidates"))


def analytics_query(features: DataFrame, start: str, end: str, metric: str) -> DataFrame:
    """Date-range filter, monthly value of the chosen metric."""
    d = F.col("incident_date")
    rows = features.filter((d >= F.lit(start).cast("timestamp_ntz"))
                           & (d < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))
    total = F.count(F.lit(1))
    metrics = {
        "incidents": total.cast("double"),
        "fatal_rate": pct(F.count_if(F.col("severity") == "FATAL"), total),
        "injury_score": F.avg("injury_score"),
    }
    return (rows.groupBy(F.date_format(d, "yyyy-MM").alias("period"))
            .agg(r6(metrics[metric]).alias("value"))
            .select(F.lit(metric).alias("metric"), "period", "value"))


def top_k(df: DataFrame, score: str, k: int, key: str = "id", ascending: bool = False) -> DataFrame:
    """Top-k by score with a total tie-break (TakeOrderedAndProject:
    each task keeps k rows, the driver merges k x tasks)."""
    order = F.asc(score) if ascending else F.desc(score)
    return df.orderBy(order, F.asc(key)).limit(k)


def riskiest(df: DataFrame, k: int, key: str = "id", seed: int = 42) -> DataFrame:
    """The k rows to analyse: by operational risk score, else by injury score, else a seeded sample."""
    from wingwatch.operators.stats import seeded_sample

    for score in ("operational_risk_score", "injury_score"):
        if score in df.columns:
            return top_k(df.filter(F.col(score).isNotNull()), score, k, key)
    return seeded_sample(df, key, k, seed)


def trailing_window(df: DataFrame, date_col: str, as_of: str, days: int) -> DataFrame:
    """A2/A3: rows of the last ``days`` days before ``as_of`` (pushed to the scan)."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    return df.filter(F.col(date_col) >= since.cast(df.schema[date_col].dataType))


ALERT_RULES = [  # (condition column, threshold, alert type), first match wins
    ("crew_fatigue_index", 80, "Fatigue Warning"),
    ("maintenance_risk", 60, "Maintenance Due"),
    ("operational_risk_score", 70, "High Operational Risk"),
]


def alert_feed(ops: DataFrame, limit: int | None = None) -> DataFrame:
    """Operations over an alert threshold, typed and levelled (C30 on
    the operational risk), newest first; ``limit`` shortens the feed."""
    from wingwatch.functions.risk import risk_level

    cond = F.lit(False)
    typ = None
    for col, thr, label in ALERT_RULES:
        c = F.coalesce(F.col(col) > thr, F.lit(False))
        cond = cond | c
        typ = F.when(c, label) if typ is None else typ.when(c, label)
    alerts = ops.filter(cond).select(
        "id", "date", "aircraft_id", typ.alias("alert_type"),
        risk_level(F.col("operational_risk_score")).alias("risk_level"),
        F.round("operational_risk_score", 6).alias("operational_risk_score"))
    alerts = alerts.orderBy(F.desc("date"), F.asc("id"))
    return alerts if limit is None else alerts.limit(limit)
