"""Declared schemas (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()

# The 34-column accident record, in the order the dataset builder writes it.
ACCIDENT_FIELDS = [
    ("source_url", _S), ("publisher", _S), ("headline", _S), ("keyword", _S), ("date", _S),
    ("hour", _I), ("day_of_week", _S), ("is_weekend", _I), ("is_peak_hour", _I), ("month", _I),
    ("is_monsoon", _I), ("time_period", _S), ("location_name", _S), ("zone", _S), ("latitude", _D),
    ("longitude", _D), ("road_type", _S), ("severity", _S), ("vehicle_type", _S), ("num_vehicles", _I),
    ("num_injured", _I), ("num_fatalities", _I), ("is_junction", _I), ("is_school_zone", _I),
    ("flood_risk", _I), ("congestion_pct", _I), ("speed_kmh", _I), ("weather_condition", _S),
    ("temperature_c", _D), ("humidity_pct", _D), ("wind_speed_kmh", _D), ("visibility_km", _D),
    ("rainfall_mm", _D), ("accident", _I),
]
ACCIDENT_COLUMNS = [n for n, _ in ACCIDENT_FIELDS]
ACCIDENT = T.StructType([T.StructField(n, t, True) for n, t in ACCIDENT_FIELDS])

# Stored weather payload (numbers as DOUBLE; every key optional).
WEATHER_PAYLOAD = T.StructType([
    T.StructField("main", T.StructType([
        T.StructField("temp", _D), T.StructField("feels_like", _D),
        T.StructField("humidity", _D), T.StructField("pressure", _D)])),
    T.StructField("weather", T.ArrayType(T.StructType([
        T.StructField("main", _S), T.StructField("description", _S)]))),
    T.StructField("rain", T.StructType([T.StructField("1h", _D)])),
    T.StructField("wind", T.StructType([T.StructField("speed", _D), T.StructField("gust", _D)])),
    T.StructField("visibility", _D),
])

# Stored routing payload.
ROUTE_PAYLOAD = T.StructType([
    T.StructField("routes", T.ArrayType(T.StructType([
        T.StructField("summary", T.StructType([
            T.StructField("lengthInMeters", T.LongType()),
            T.StructField("travelTimeInSeconds", T.LongType()),
            T.StructField("trafficDelayInSeconds", T.LongType()),
            T.StructField("noTrafficTravelTimeInSeconds", T.LongType())])),
        T.StructField("legs", T.ArrayType(T.StructType([
            T.StructField("points", T.ArrayType(T.StructType([
                T.StructField("latitude", _D), T.StructField("longitude", _D)])))]))),
    ]))),
])

# Feed item.
RSS_ITEM = T.StructType([T.StructField("title", _S), T.StructField("link", _S),
                         T.StructField("description", _S), T.StructField("pubDate", _S)])
