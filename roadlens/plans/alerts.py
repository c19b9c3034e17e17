"""Composite jobs for locations: weather enrichment, full alerts, route lookup."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import calendar as cal
from ..functions import risk as rk
from ..functions import routes as rt
from ..functions import weather as wx
from ..operators import asof
from ..operators import geo
from ..operators import model as ml
from ..operators import ranking as rank

WEATHER_VALUES = ["obs_id", "temperature_c", "humidity_pct", "wind_speed_kmh", "visibility_km", "rainfall_mm",
                  "weather_condition"]


def weather_table(obs: DataFrame) -> DataFrame:
    """S8 + T23 + T28: valid observations, normalised, with their grid cell."""
    norm = wx.normalize_weather(wx.parse_weather(obs))
    cell = wx.grid_cell("lat", "lng")
    return norm.withColumn("cell_lat", cell["cell_lat"]).withColumn("cell_lng", cell["cell_lng"])


def weather_asof(probes: DataFrame, obs: DataFrame, ttl_s: int = dims.WEATHER_TTL_S) -> DataFrame:
    """Latest fresh observation of the probe's 0.01-degree cell, else the
    per-field defaults.  Adds obs_id (null when none) and the weather fields."""
    cell = wx.grid_cell("lat", "lng")
    p = probes.withColumn("cell_lat", cell["cell_lat"]).withColumn("cell_lng", cell["cell_lng"])
    w = weather_table(obs).select("cell_lat", "cell_lng", "obs_ts", *WEATHER_VALUES)
    m = asof.asof_latest(p, w, ["cell_lat", "cell_lng"], "ts", "obs_ts", ttl_s, WEATHER_VALUES, "obs_id")
    out = m.withColumn("obs_id", F.col("m_obs_id"))
    for k, d in dims.WEATHER_FALLBACK.items():
        out = out.withColumn(k, F.coalesce(F.col("m_" + k), F.lit(d)))
    return out.drop(*["m_" + c for c in WEATHER_VALUES], "cell_lat", "cell_lng")


def full_alerts_rules(probes: DataFrame, obs: DataFrame, ttl_s: int = dims.WEATHER_TTL_S) -> DataFrame:
    """J10 without the model: zone, weather, advisory, driver alerts, merged
    alerts and the advisory severity for every probe (probe time = request time)."""
    z = geo.nearest_zone(probes)
    w = weather_asof(z, obs, ttl_s)
    adv = wx.weather_advisory("rainfall_mm", "visibility_km", "wind_speed_kmh", "weather_condition")
    hour = F.hour("ts")
    flood = (F.col("rainfall_mm") > 10).cast("int")
    drv = rk.driver_alerts("rainfall_mm", "visibility_km", flood, F.col("base_risk").cast("double"),
                           F.lit(0), hour)
    return (w.withColumn("advisory", adv)
             .withColumn("hour", hour)
             .withColumn("flood_risk", flood)
             .withColumn("driver_alerts", drv)
             .withColumn("alerts", rk.merge_alerts(F.col("advisory.alerts"), F.col("driver_alerts")))
             .withColumn("advisory_severity", F.col("advisory.severity")))


def full_alerts(probes: DataFrame, obs: DataFrame, model: PipelineModel, ttl_s: int = dims.WEATHER_TTL_S) -> DataFrame:
    """The rules above plus the model score of the probe (zone base risk as
    congestion, serving defaults elsewhere) and the combined severity."""
    base = full_alerts_rules(probes, obs, ttl_s)
    req = (base.withColumn("latitude", F.col("lat")).withColumn("longitude", F.col("lng"))
               .withColumn("congestion_pct", F.col("base_risk").cast("double"))
               .withColumn("time_period", F.lit(None).cast("string")))
    req = rk.complete_requests(req, F.col("ts")).withColumn("time_period", cal.hour_to_period("hour"))
    scored = ml.score_requests(model, req)
    return (scored.withColumn("alerts", rk.merge_alerts(F.col("advisory.alerts"), F.col("alerts")))
                  .withColumn("severity", rk.combined_severity("advisory_severity", "risk_level")))


def routes_asof(requests: DataFrame, route_options: DataFrame, ttl_s: int = dims.ROUTE_TTL_S) -> DataFrame:
    """The stored route set of the same (origin, destination) younger than
    ``ttl_s``; requests without a destination never match."""
    key = lambda: F.when(F.col("destination").isNotNull(), rt.route_key("origin", "destination"))
    req = requests.withColumn("route_key", key())
    sets = (route_options.select("trip_id", "origin", "destination", "obs_ts").distinct()
            .withColumn("route_key", key()).where(F.col("route_key").isNotNull()))
    m = asof.asof_latest(req, sets, ["route_key"], "ts", "obs_ts", ttl_s, ["trip_id"], "trip_id")
    return m.withColumnRenamed("m_trip_id", "matched_trip_id")


def alerts_with_routes(probes: DataFrame, requests: DataFrame, obs: DataFrame, route_options: DataFrame,
                       ttl_s: int = dims.WEATHER_TTL_S, route_ttl_s: int = dims.ROUTE_TTL_S) -> DataFrame:
    """J10 with the optional destination: the rule-based alerts of every probe,
    the weather behind them and, where a fresh route set of its trip is stored,
    the recommended route.  ``requests`` has the request of a probe under its
    id.  Probes without a route set skip the join with the routes."""
    return _with_routes(full_alerts_rules(probes, obs, ttl_s), requests, route_options, route_ttl_s)


def full_alerts_with_routes(probes: DataFrame, requests: DataFrame, obs: DataFrame, route_options: DataFrame,
                            model: PipelineModel, ttl_s: int = dims.WEATHER_TTL_S,
                            route_ttl_s: int = dims.ROUTE_TTL_S) -> DataFrame:
    """J10 whole: zone, weather, model score, merged alerts, combined severity and
    the recommended route of every probe in one row."""
    return _with_routes(full_alerts(probes, obs, model, ttl_s), requests, route_options, route_ttl_s)


def _with_routes(alerts: DataFrame, requests: DataFrame, route_options: DataFrame, route_ttl_s: int) -> DataFrame:
    hits = (routes_asof(requests, route_options, route_ttl_s).where(F.col("matched_trip_id").isNotNull())
            .select(F.col("request_id").alias("probe_id"), F.col("matched_trip_id").alias("trip_id")))
    best = rank.recommended_route(rank.routes_table(route_options)).select(
        "trip_id", "route_type", F.col("summary").alias("route_summary"),
        F.col("duration_traffic_min").alias("route_min"), F.col("congestion_pct").alias("route_congestion_pct"))
    return alerts.join(hits.join(best, "trip_id"), "probe_id", "left")
