"""Route payloads, metrics, polylines and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..schemas import ROUTE_PAYLOAD
from . import weather as wx


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_routes(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Routing JSON -> first route's summary fields and first leg's points;
    payloads with no routes are skipped."""
    df = wx.parse_once(raw, payload, ROUTE_PAYLOAD, "_p").where(F.coalesce(F.size("_p.routes"), F.lit(-1)) > 0)
    r0 = F.get(F.col("_p.routes"), 0)
    s = r0["summary"]
    return df.select(
        *[c for c in raw.columns if c != payload],
        s["lengthInMeters"].cast("int").alias("length_m"),
        s["travelTimeInSeconds"].cast("int").alias("travel_s"),
        s["trafficDelayInSeconds"].cast("int").alias("delay_s"),
        s["noTrafficTravelTimeInSeconds"].cast("int").alias("no_traffic_s"),
        route_coordinates(F.get(r0["legs"], 0)["points"]).alias("coordinates"))


def route_coordinates(points) -> Column:
    """Points -> [[lng, lat], ...]; empty when absent."""
    return F.coalesce(F.transform(_c(points), lambda p: F.array(p["longitude"], p["latitude"])),
                      F.array().cast("array<array<double>>"))


def route_metrics(df: DataFrame) -> DataFrame:
    """Distance km (0.1), minutes (half-even), congestion and status.

    Minutes follow round-half-even as the original; the free-flow time
    defaults to the travel time; congestion is truncated and capped at 100.
    """
    dur = F.bround(F.col("travel_s") / 60.0, 0).cast("int")
    delay = F.bround(F.coalesce(F.col("delay_s"), F.lit(0)) / 60.0, 0).cast("int")
    free = F.bround(F.coalesce(F.col("no_traffic_s"), F.col("travel_s")) / 60.0, 0).cast("int")
    cong = F.when(free > 0, F.least(F.lit(100), (delay / F.greatest(free, F.lit(1)) * 200).cast("int"))) \
            .otherwise(F.lit(0))
    return (df.withColumn("distance_km", F.bround(F.col("length_m") / 100.0, 0) / 10.0)
              .withColumn("duration_traffic_min", dur)
              .withColumn("delay_min", delay)
              .withColumn("duration_min", free)
              .withColumn("congestion_pct", cong)
              .withColumn("traffic_status", traffic_status("congestion_pct")))


def traffic_status(cong) -> Column:
    c = _c(cong)
    return F.when(c > 60, "HEAVY").when(c > 30, "MODERATE").otherwise("CLEAR")


def route_summary(destination, route_type) -> Column:
    suffix = dims.map_lookup({t: s for t, s in dims.ROUTE_CONFIGS}, _c(route_type), "Route")
    return F.concat(_c(destination), F.lit(" — "), suffix)


def parse_origin(origin) -> Column:
    """T27: "lat,lng" -> struct(lat, lng); anything else -> nulls (a place name)."""
    parts = F.split(F.trim(_c(origin)), ",")
    lat = F.try_element_at(parts, F.lit(1)).try_cast("double")
    lng = F.try_element_at(parts, F.lit(2)).try_cast("double")
    ok = lat.isNotNull() & lng.isNotNull()
    return F.struct(F.when(ok, lat).alias("lat"), F.when(ok, lng).alias("lng"))


def route_key(origin, destination) -> Column:
    """Cache key of a trip; a separator keeps ("ab","c") and ("a","bc") apart."""
    return F.md5(F.concat_ws("\u0001", _c(origin), _c(destination)))
