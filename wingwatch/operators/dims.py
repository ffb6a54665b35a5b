"""Dimension tables.

The 24 aircraft types are fixed values and become literals where they are matched.  Airports come
from a file of any size; the planner chooses their join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField,
                               StructType)

from wingwatch.functions import constants as K
from wingwatch.functions.incident import lookup

AIRCRAFT_SCHEMA = StructType([
    StructField("_ord", IntegerType()), StructField("make", StringType()), StructField("model", StringType()),
    StructField("category", StringType()), StructField("engine_type", StringType()),
    StructField("engines", IntegerType()), StructField("seats", IntegerType()),
    StructField("mtow_lbs", IntegerType()), StructField("risk_factor", DoubleType()),
])

AIRPORT_CSV_SCHEMA = StructType([
    StructField("ident", StringType()), StructField("type", StringType()),
    StructField("name", StringType()), StructField("latitude_deg", DoubleType()),
    StructField("longitude_deg", DoubleType()), StructField("elevation_ft", IntegerType()),
    StructField("iso_country", StringType()), StructField("iso_region", StringType()),
    StructField("municipality", StringType()),
])


def aircraft_types(spark: SparkSession) -> DataFrame:
    """The 24-row aircraft reference dimension with C29 base risk score."""
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(K.AIRCRAFT_TYPES)], AIRCRAFT_SCHEMA)
    return df.withColumn("base_risk_score", F.col("risk_factor") * 100.0)


def read_dimension_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A10: typed CSV scan (explicit schema, no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def airport_projection(raw: DataFrame) -> DataFrame:
    """B1 + B2 + C29: keep large/medium/small airports, rename, complexity score."""
    return (raw.filter(F.col("type").isin(*K.AIRPORT_TYPES_KEPT))
            .select(F.col("ident").alias("icao_code"), "type", "name",
                    F.col("latitude_deg").alias("latitude"),
                    F.col("longitude_deg").alias("longitude"), "elevation_ft",
                    F.col("iso_country").alias("country"), F.col("iso_region").alias("region"),
                    F.col("municipality").alias("city"),
                    lookup(F.col("type"), K.AIRPORT_COMPLEXITY).cast("int")
                    .alias("complexity_score")))
