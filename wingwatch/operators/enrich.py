"""Dimension enrichment and keyed updates.

The aircraft types (24 fixed values) are matched by two hashed look-ups a row (D3).  Airports (D2) and
the keyed update (D7) are joins that AQE plans: broadcast while a side is small, sort-merge with
skew splitting beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingwatch.functions import constants as K
from wingwatch.operators.analytics import mean6


def airport_index(airports: DataFrame) -> DataFrame:
    """(key, found): for every upper-cased code, and every K code without its K, the airports it may mean
    (code -> coordinates).  One row a key."""
    coords = airports.filter(F.col("icao_code").isNotNull()).groupBy("icao_code").agg(F.min(F.struct("latitude", "longitude")).alias("c"))
    code = F.col("icao_code")
    keys = F.array_distinct(F.array(F.upper(code), F.when(code.startswith("K"), F.upper(F.substring(code, 2, 1 << 30))).otherwise(F.upper(code))))
    return (coords.select(F.explode(keys).alias("key"), F.struct(code, "c").alias("entry"))
            .groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("found")))


def airport_coords(incidents: DataFrame, airports: DataFrame) -> DataFrame:
    """Fill coordinates of backlog incidents (code present, a coordinate
    missing) from the airport table, trying ``code``, ``'K' + code`` and
    ``upper(code)`` in that order; a match overwrites both coordinates.

    All three codes have one upper-cased key apart from the K, so the backlog is joined once, with an index
    of the airports by that key; AQE broadcasts the index while it is small and splits hot codes
    where it is not.
    """
    code = F.col("airport_code")
    backlog = incidents.filter(code.isNotNull() & (F.col("latitude").isNull() | F.col("longitude").isNull()))
    joined = (backlog.select("id", "airport_code", "latitude", "longitude")
              .join(airport_index(airports), F.upper(code) == F.col("key"), "left"))
    cands = [code, F.concat(F.lit("K"), code), F.upper(code)]
    hits = [F.try_element_at("found", c) for c in cands]
    matched = F.coalesce(*[F.when(h.isNotNull(), c) for h, c in zip(hits, cands)])
    taken = F.coalesce(*hits)
    return joined.select(
        "id", "airport_code", matched.alias("matched_code"),
        *[F.when(matched.isNotNull(), taken[c]).otherwise(F.col(c)).alias(c) for c in ("latitude", "longitude")])


def _needles(values: list[str], longest: int) -> dict[str, int]:
    """Every substring of up to ``longest`` characters -> bit mask of the values that contain it."""
    index: dict[str, int] = {}
    for i, value in enumerate(values):
        for size in range(1, longest + 1):
            for at in range(len(value) - size + 1):
                needle = value[at:at + size]
                index[needle] = index.get(needle, 0) | 1 << i
    return index


def _with_mask(df: DataFrame, needle: str, index: dict[str, int], n: int, legacy_empty_match: bool, name: str) -> DataFrame:
    """``df`` with the mask of the column ``needle``, looked up by a hash join with the index."""
    rows = df.sparkSession.createDataFrame(list(index.items()), f"_{needle} string, _mask long")
    found = F.coalesce(F.col("_mask"), F.lit(0).cast("long"))
    mask = F.when(F.col(needle) == "", F.lit((1 << n) - 1).cast("long")).otherwise(found) if legacy_empty_match else found
    return (df.join(F.broadcast(rows), F.col(needle) == F.col(f"_{needle}"), "left")
            .withColumn(name, mask).drop(f"_{needle}", "_mask"))


def aircraft_matches(incidents: DataFrame, types: list[tuple] = K.AIRCRAFT_TYPES, make_chars: int = 4,
                     model_chars: int = 3, legacy_empty_match: bool = False) -> DataFrame:
    """D3: substring match of incident make/model against the aircraft types.

    A type matches when its make contains the first ``make_chars`` characters of the incident make,
    or its model contains the first ``model_chars`` of the incident model (upper-cased, literal).
    An empty needle (missing model) matches nothing unless ``legacy_empty_match`` (the reference's
    ``contains('')`` matches every row).

    The fixed types (at most 62) are indexed by all their substrings of that length: a row looks up the bit
    masks of the types that hold its two needles, by a join with each index (a few hundred rows, broadcast and
    hashed).  No shuffle, no loop over the types or over the index.
    """
    inc = incidents.filter(F.col("aircraft_make").isNotNull()).select(
        "id", F.substring(F.upper("aircraft_make"), 1, make_chars).alias("by_make"),
        F.substring(F.upper(F.coalesce("aircraft_model", F.lit(""))), 1, model_chars).alias("by_model"))
    for i, (needle, chars) in enumerate((("by_make", make_chars), ("by_model", model_chars))):
        index = _needles([t[i].upper() for t in types], chars)
        inc = _with_mask(inc, needle, index, len(types), legacy_empty_match, f"_{i}")
    inc = inc.select("id", F.col("_0").bitwiseOR(F.col("_1")).alias("m"))
    m = F.col("m")
    worst = None  # the largest risk factor among the matched types
    for risk in sorted({float(t[7]) for t in types}, reverse=True):
        held = m.bitwiseAND(F.lit(sum(1 << i for i, t in enumerate(types) if float(t[7]) == risk)).cast("long")) != 0
        worst = F.when(held, F.lit(risk)) if worst is None else worst.when(held, F.lit(risk))
    first = F.bit_count(m.bitwiseAND(-m) - 1)  # place of the lowest bit
    pick = lambda values: F.when(m != 0, F.get(F.array(*[F.lit(v) for v in values]), first))
    return inc.select(
        "id", (m != 0).alias("matched"), F.bit_count(m).cast("bigint").alias("match_count"),
        (worst * 100.0).alias("max_base_risk"),
        pick([t[2] for t in types]).alias("first_category"), pick([float(t[7]) for t in types]).alias("first_risk_factor"))


def aircraft_category(matches: DataFrame) -> DataFrame:
    """E12 (re-aimed onto incidents): matched incidents and mean risk factor
    per aircraft category (category of the first matching type)."""
    return (matches.filter("matched").groupBy(F.col("first_category").alias("category"))
            .agg(F.count(F.lit(1)).alias("incidents"),
                 mean6("first_risk_factor").alias("mean_risk_factor")))


def apply_weather_update(incidents: DataFrame, parsed: DataFrame) -> DataFrame:
    """Incidents with coordinates and no weather take the landed,
    parsed payload with the same id: ``weather_data`` becomes the payload JSON
    and ``weather_conditions`` IMC/VMC by visibility (missing -> 10000)."""
    # one payload per incident: a parsed one before others, then the greatest text
    new = parsed.select(
        F.col("id").alias("_pid"),
        F.struct(F.coalesce("parsed", F.lit(False)).alias("ok"),
                 F.to_json(F.struct("temperature_c", "visibility_m", "wind_speed_kt", "weather_condition",
                                    "severe_weather_flag", "weather_risk_score")).alias("wd"),
                 F.when(F.coalesce(F.col("visibility_m"), F.lit(10000.0)) < 5000, "IMC").otherwise("VMC").alias("wc"))
        .alias("_new")).groupBy("_pid").agg(F.max("_new").alias("_new"))
    backlog = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("weather_data").isNull()
    # only the backlog is joined; the other incidents stay where they are
    rest = incidents.filter(~backlog).withColumn("updated", F.lit(False))
    open_ = incidents.filter(backlog)
    j = open_.join(new, open_.id == new._pid, "left")
    upd = F.coalesce(F.col("_new.ok"), F.lit(False))
    taken = {"weather_data": "_new.wd", "weather_conditions": "_new.wc"}
    cols = [F.when(upd, F.col(taken[c])).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in incidents.columns]
    return rest.unionByName(j.select(*cols, upd.alias("updated")))


def prediction_lineage(incidents: DataFrame, predictions: DataFrame, recs: DataFrame) -> DataFrame:
    """Incident -> predictions -> recommendations, counted per severity."""
    p = predictions.select(F.col("incident_id"), F.col("prediction_id"), F.col("risk_score"))
    r = recs.groupBy("prediction_id").agg(F.count(F.lit(1)).alias("n_recs"))
    j = (incidents.select("id", "severity").join(p, incidents.id == p.incident_id)
         .join(r, "prediction_id", "left"))
    return j.groupBy("severity").agg(
        F.countDistinct("id").alias("incidents"), F.count("prediction_id").alias("predictions"),
        F.coalesce(F.sum("n_recs"), F.lit(0)).cast("bigint").alias("recommendations"),
        mean6("risk_score").alias("avg_risk_score"))
