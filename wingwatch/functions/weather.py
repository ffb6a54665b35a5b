"""Weather expressions (C20-C25) and payload flattening.

Two separate risk ladders exist in the reference, one with wind in m/s and a
truthiness test on visibility/temperature (0 counts as missing, trap T14),
one with wind in knots.  Both are kept as separate functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingwatch.functions import constants as K
from wingwatch.functions.incident import lookup


def _ladder(value: Column, steps: list[tuple[float, int]], below: bool) -> Column:
    """First step whose bound is crossed wins; NULL or no step -> 0."""
    expr = None
    for bound, points in steps:
        cond = value < bound if below else value > bound
        expr = F.when(cond, F.lit(float(points))) if expr is None else expr.when(cond, F.lit(float(points)))
    return F.coalesce(expr.otherwise(F.lit(0.0)), F.lit(0.0))


def _truthy(v: Column) -> Column:
    """Python ``if v:`` for a number: NULL and 0 are false."""
    return F.coalesce(v != 0, F.lit(False))


def weather_risk_si(visibility: Column, wind_speed: Column, wind_gust: Column,
                    condition: Column, temperature: Column) -> Column:
    """C20: ladder 1 (wind m/s).  Visibility/temperature of 0 add nothing."""
    vis = F.when(_truthy(visibility), _ladder(visibility, K.SI_VISIBILITY_STEPS, True)).otherwise(0.0)
    max_wind = F.greatest(F.coalesce(wind_speed, F.lit(0.0)), F.coalesce(wind_gust, F.lit(0.0)))
    wind = _ladder(max_wind, K.SI_WIND_STEPS, False)
    cond = lookup(F.coalesce(condition, F.lit("Clear")), K.SI_CONDITION_RISK,
                  K.SI_CONDITION_DEFAULT).cast("double")
    t = F.coalesce(temperature, F.lit(20.0))
    temp = (F.when(~_truthy(t), F.lit(0.0))
            .when((t < -10) | (t > 40), F.lit(15.0))
            .when((t < 0) | (t > 35), F.lit(10.0))
            .when((t < 5) | (t > 30), F.lit(5.0)).otherwise(F.lit(0.0)))
    return F.least(vis + wind + cond + temp, F.lit(100.0))


def weather_risk_kt(visibility: Column, wind_kt: Column, condition: Column,
                    temperature: Column) -> Column:
    """Ladder 2 (wind in knots); unknown condition adds 10; no hot-side 5."""
    vis = _ladder(visibility, K.KT_VISIBILITY_STEPS, True)
    wind = _ladder(wind_kt, K.KT_WIND_STEPS, False)
    cond = lookup(condition, K.KT_CONDITION_RISK, K.KT_CONDITION_DEFAULT).cast("double")
    t = temperature
    temp = F.coalesce(F.when((t < -10) | (t > 40), F.lit(15.0))
                      .when((t < 0) | (t > 35), F.lit(10.0))
                      .when(t < 5, F.lit(5.0)), F.lit(0.0))
    return F.least(vis + wind + cond + temp, F.lit(100.0))


def severe_weather_si(condition: Column, wind_speed_ms: Column, visibility: Column) -> Column:
    """C22 (1): severe condition, wind > 12.9 m/s, or 0 < visibility < 1000."""
    return (F.coalesce(condition.isin(*K.SI_SEVERE_CONDITIONS), F.lit(False))
            | (F.coalesce(wind_speed_ms, F.lit(0.0)) > K.SI_SEVERE_WIND_MS)
            | (_truthy(visibility) & F.coalesce(visibility < K.SI_SEVERE_VISIBILITY_M, F.lit(False))))


def severe_weather_kt(condition: Column, wind_kt: Column) -> Column:
    """C22 (2): Thunderstorm/Tornado or wind > 25 kt."""
    return (F.coalesce(condition.isin(*K.KT_SEVERE_CONDITIONS), F.lit(False))
            | F.coalesce(wind_kt > K.KT_SEVERE_WIND_KT, F.lit(False)))


def flight_category_si(visibility: Column) -> Column:
    """IMC when visibility (missing -> 10000) < 5000."""
    return F.when(F.coalesce(visibility, F.lit(10000.0)) < K.IMC_VISIBILITY_M, "IMC").otherwise("VMC")


def flight_category_kt(visibility: Column, cloud_cover: Column) -> Column:
    """IMC when visibility < 5000 or cloud cover > 80."""
    imc = F.coalesce(visibility < K.IMC_VISIBILITY_M, F.lit(False)) | F.coalesce(
        cloud_cover > K.IMC_CLOUD_COVER, F.lit(False))
    return F.when(imc, "IMC").otherwise("VMC")


def mps_to_knots(mps: Column) -> Column:
    """m/s -> kt; 0 or missing gives 0."""
    return F.when(_truthy(mps), mps * K.MPS_TO_KNOTS).otherwise(F.lit(0.0))


def feels_like(temperature: Column, wind: Column) -> Column:
    """Temperature - 0.3 * wind, one decimal."""
    return F.round(temperature - wind * 0.3, 1)


def latitude_temperature(temperature: Column, latitude: Column) -> Column:
    """Colder away from the temperate band: t - (|lat| - 40) / 50 * 5."""
    return F.when(_truthy(latitude), temperature - (F.abs(latitude) - 40) / 50.0 * 5.0).otherwise(temperature)


# ---- A11 payload flattening ---------------------------------------------------

_HOUR = ("temp DOUBLE, feels_like DOUBLE, humidity DOUBLE, pressure DOUBLE, visibility DOUBLE, "
         "clouds DOUBLE, speed DOUBLE, gust DOUBLE, deg DOUBLE, `all` DOUBLE, "
         "weather ARRAY<STRUCT<main: STRING, description: STRING>>")
_MAIN = "temp DOUBLE, feels_like DOUBLE, humidity DOUBLE, pressure DOUBLE, visibility DOUBLE, clouds DOUBLE"
PAYLOAD_SCHEMA = (
    f"main STRUCT<{_MAIN}>, current STRUCT<{_MAIN}>, "
    "wind STRUCT<speed: DOUBLE, gust: DOUBLE, deg: DOUBLE>, clouds STRUCT<`all`: DOUBLE>, "
    "weather ARRAY<STRUCT<main: STRING, description: STRING>>, visibility DOUBLE, "
    f"data ARRAY<STRUCT<{_HOUR}>>"
)


def flatten_weather_payload(df: DataFrame, col: str = "payload") -> DataFrame:
    """One row per landed payload -> typed weather fields.

    Current shape: ``main``/``current``, ``wind``, ``clouds``, ``weather[0]``,
    top-level ``visibility``.  History shape: everything from ``data[0]``.
    An empty payload gives ``parsed = false`` and NULL fields.  The JSON is
    parsed once per row.
    """
    p = F.from_json(F.col(col), PAYLOAD_SCHEMA)
    d = df.withColumn("_p", p)
    hist = F.col("_p.data").isNotNull()
    h0 = F.get(F.col("_p.data"), 0)
    main = F.coalesce(F.col("_p.main"), F.col("_p.current"))
    empty = (F.col("_p.main").isNull() & F.col("_p.current").isNull() & F.col("_p.wind").isNull()
             & F.col("_p.clouds").isNull() & F.col("_p.weather").isNull()
             & F.col("_p.visibility").isNull() & F.col("_p.data").isNull())

    def pick(hist_v: Column, cur_v: Column) -> Column:
        return F.when(empty, F.lit(None)).when(hist, hist_v).otherwise(cur_v)

    temp = pick(h0["temp"], main["temp"])
    humidity = pick(h0["humidity"], main["humidity"])
    visibility = pick(F.coalesce(F.col("_p.visibility"), h0["visibility"], F.lit(10000.0)),
                      F.coalesce(F.col("_p.visibility"), main["visibility"], F.lit(10000.0)))
    speed = pick(h0["speed"], F.col("_p.wind.speed"))
    gust = pick(h0["gust"], F.col("_p.wind.gust"))
    wx = pick(F.get(h0["weather"], 0), F.get(F.col("_p.weather"), 0))
    cond_main = wx["main"]
    clouds = pick(F.coalesce(h0["all"], h0["clouds"]),
                  F.coalesce(F.col("_p.clouds.all"), main["clouds"]))
    out = d.select(
        *[c for c in df.columns if c != col],
        (~empty).alias("parsed"),
        temp.alias("temperature_c"), pick(h0["feels_like"], main["feels_like"]).alias("feels_like_c"),
        humidity.alias("humidity_percent"), pick(h0["pressure"], main["pressure"]).alias("pressure_hpa"),
        visibility.alias("visibility_m"), clouds.alias("cloud_cover_percent"),
        F.when(empty, F.lit(None)).otherwise(mps_to_knots(speed)).alias("wind_speed_kt"),
        F.when(_truthy(gust), gust * K.MPS_TO_KNOTS).alias("wind_gust_kt"),
        pick(h0["deg"], F.col("_p.wind.deg")).alias("wind_direction_deg"),
        F.when(empty, F.lit(None)).otherwise(F.coalesce(cond_main, F.lit("Unknown")))
        .alias("weather_condition"),
        F.when(empty, F.lit(None)).otherwise(F.coalesce(wx["description"], F.lit(""))).alias("weather_description"),
        F.when(~empty, F.col(col)).alias("raw_data"),
        F.when(empty, F.lit(None)).otherwise(severe_weather_si(cond_main, speed, visibility))
        .alias("severe_weather_flag"),
        F.when(empty, F.lit(None)).otherwise(weather_risk_si(visibility, speed, gust, cond_main, temp))
        .alias("weather_risk_score"),
        F.when(empty, F.lit(None)).otherwise(flight_category_si(visibility)).alias("flight_conditions"),
    )
    return out
