"""Encoders, request completion, risk levels and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from . import calendar as cal


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode_training(df: DataFrame) -> DataFrame:
    """weather/road/time codes with the training defaults 0/2/2."""
    d = dims.TRAIN_DEFAULTS
    return (df.withColumn("weather_enc", dims.map_lookup(dims.TRAIN_WEATHER_CODES, F.col("weather_condition"), d["weather"]))
              .withColumn("road_enc", dims.map_lookup(dims.TRAIN_ROAD_CODES, F.col("road_type"), d["road"]))
              .withColumn("time_enc", dims.map_lookup(dims.TRAIN_TIME_CODES, F.col("time_period"), d["time"])))


def encode_serving(df: DataFrame, time_default: int = dims.SERVE_DEFAULTS["time"]) -> DataFrame:
    """Serving codes with defaults 0/2/``time_default`` (0 as served)."""
    d = dims.SERVE_DEFAULTS
    return (df.withColumn("weather_enc", dims.map_lookup(dims.SERVE_WEATHER_CODES, F.col("weather_condition"), d["weather"]))
              .withColumn("road_enc", dims.map_lookup(dims.SERVE_ROAD_CODES, F.col("road_type"), d["road"]))
              .withColumn("time_enc", dims.map_lookup(dims.SERVE_TIME_CODES, F.col("time_period"), time_default)))


_REQUEST_DOUBLES = ["latitude", "longitude", "temperature_c", "humidity_pct", "wind_speed_kmh", "visibility_km",
                    "rainfall_mm", "congestion_pct", "speed_kmh"]
_REQUEST_INTS = ["is_junction", "is_school_zone", "flood_risk"]
_REQUEST_STRINGS = ["weather_condition", "road_type", "time_period"]


def complete_requests(df: DataFrame, as_of_ts) -> DataFrame:
    """Fill the 17 request fields with defaults; hour and weekend default
    to ``as_of_ts`` (the request time); "Afternoon" counts as unset and is
    recomputed from the hour."""
    ts = _c(as_of_ts) if not isinstance(as_of_ts, str) else F.col(as_of_ts)
    out = df
    for c in _REQUEST_DOUBLES:
        src = F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        out = out.withColumn(c, F.coalesce(src, F.lit(float(dims.REQUEST_DEFAULTS[c]))))
    for c in _REQUEST_INTS:
        src = F.col(c).cast("int") if c in df.columns else F.lit(None).cast("int")
        out = out.withColumn(c, F.coalesce(src, F.lit(int(dims.REQUEST_DEFAULTS[c]))))
    for c in _REQUEST_STRINGS:
        src = F.col(c) if c in df.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.coalesce(src, F.lit(dims.REQUEST_DEFAULTS[c])))
    hour = F.col("hour").cast("int") if "hour" in df.columns else F.lit(None).cast("int")
    wk = F.col("is_weekend").cast("int") if "is_weekend" in df.columns else F.lit(None).cast("int")
    out = (out.withColumn("hour", F.coalesce(hour, F.hour(ts)))
              .withColumn("is_weekend", F.coalesce(wk, cal.is_weekend(F.to_date(ts))))
              .withColumn("time_period", F.when(F.col("time_period") == "Afternoon", cal.hour_to_period("hour"))
                                         .otherwise(F.col("time_period"))))
    return out


def risk_level(p) -> Column:
    """Strict thresholds 0.75 / 0.55 / 0.35."""
    x = _c(p)
    return (F.when(x > 0.75, "CRITICAL").when(x > 0.55, "HIGH").when(x > 0.35, "MODERATE").otherwise("LOW"))


def risk_outputs(df: DataFrame, p: str = "probability") -> DataFrame:
    """Rounded probability and score; prediction and level use the unrounded value."""
    x = F.col(p)
    return (df.withColumn("accident_probability", F.round(x, 4))
              .withColumn("accident_predicted", (x >= dims.THRESHOLD_SERVE).cast("int"))
              .withColumn("risk_score", F.round(x * 100, 1))
              .withColumn("risk_level", risk_level(x)))


def driver_alerts(rainfall, visibility, flood, congestion, junction, hour) -> Column:
    """Six independent rules in fixed order."""
    return F.array_compact(F.array(
        F.when(_c(rainfall) > 15, F.lit(dims.ALERT_HEAVY_RAIN)),
        F.when(_c(visibility) < 2, F.lit(dims.ALERT_LOW_VIS)),
        F.when(_c(flood) != 0, F.lit(dims.ALERT_FLOOD)),
        F.when(_c(congestion) > 80, F.lit(dims.ALERT_CONGESTION)),
        F.when(_c(junction) != 0, F.lit(dims.ALERT_JUNCTION)),
        F.when(_c(hour).between(17, 20), F.lit(dims.ALERT_PEAK)),
    ))


def merge_alerts(first, second, prefix: int = 30) -> Column:
    """Concatenation keeping the first alert of each ``prefix``-character head, in order."""
    both = F.concat(_c(first), _c(second))
    return F.aggregate(
        both, F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.left(y, F.lit(prefix)) == F.left(x, F.lit(prefix))), acc)
                        .otherwise(F.concat(acc, F.array(x))))


def combined_severity(advisory_severity, level) -> Column:
    """CRITICAL/HIGH risk raises the advisory to WARN unless it is DANGER."""
    s, lv = F.coalesce(_c(advisory_severity), F.lit("OK")), _c(level)
    return F.when(lv.isin("CRITICAL", "HIGH") & (s != "DANGER"), F.lit("WARN")).otherwise(s)
