"""Preparation of a table for geocoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_coordinates(df: DataFrame) -> DataFrame:
    """Latitude and longitude as empty decimals where the table lacks them."""
    for name in ("residential_lat", "residential_lng"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("decimal(38,18)"))
    return df


def flag_needs_geocoding(df: DataFrame) -> DataFrame:
    """``needs_geocoding``: an address (not trimmed) without a latitude, or with latitude 0."""
    has = F.coalesce(F.col("residential_address1"), F.lit("")) != ""
    lat = F.col("residential_lat")
    return df.withColumn("needs_geocoding", has & (lat.isNull() | (lat == 0)))


def add_location(df: DataFrame) -> DataFrame:
    """``location_geometry``: WKT point of longitude and latitude, NULL if either is missing."""
    lng, lat = F.col("residential_lng").cast("string"), F.col("residential_lat").cast("string")
    return df.withColumn("location_geometry", F.concat(F.lit("POINT("), lng, F.lit(" "), lat, F.lit(")")))


def prepare_for_geocoding(df: DataFrame) -> DataFrame:
    """Coordinates, flag and location in one projection.  Empty tables keep the new columns."""
    return add_location(flag_needs_geocoding(add_coordinates(df)))
