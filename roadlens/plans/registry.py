"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or views Spark derives from them)
and runs over them whole.  Oracle SQL for the same names is in
``oracle_sql.ORACLES``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import calendar as cal
from ..functions import risk as rk
from ..functions import routes as rt
from ..functions import text as tx
from ..functions import weather as wx
from ..operators import gazetteer as gaz
from ..operators import geo
from ..operators import ranking as rank
from ..operators import training as tr
from ..schemas import ACCIDENT_COLUMNS
from ..session import materialize, scratch_path
from ..sources import accidents as src
from ..sources import feeds
from ..operators import model as ml
from ..sources import fixtures as fx
from ..streaming import jobs as sj
from . import alerts as al
from . import build
from . import train as trn
from ..operators import aggregates as agg
from ..operators import records as rec
from .inputs import Inputs

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---- articles -> records ---------------------------------------------------

@register("relevant_articles")
def q_relevant_articles(i: Inputs) -> DataFrame:
    """F1 on every article (the standard rule), as a flag column."""
    a = i.articles
    return a.select("article_id", "source_rank", tx.dedupe_key("title").alias("dedupe_key"),
                    tx.is_relevant(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))).alias("is_relevant"))


@register("relevant_tamil")
def q_relevant_tamil(i: Inputs) -> DataFrame:
    """F1/F2 per source (relaxed Tamil rule for its site), as a flag column."""
    return rec.with_candidate_columns(i.articles).select("article_id", "source_rank", "dedupe_key", "is_relevant")


@register("article_dedupe")
def q_article_dedupe(i: Inputs) -> DataFrame:
    return rec.dedupe_articles(i.articles).select("article_id", "source_rank", "dedupe_key")


@register("article_location")
def q_article_location(i: Inputs) -> DataFrame:
    df = rec.match_location(i.articles, F.col("title"), i.zones_train)
    return df.select("article_id", "zone_ord", F.initcap("zone_key").alias("location_name"), "zone")


@register("article_location_any")
def q_article_location_any(i: Inputs) -> DataFrame:
    """J1 by a join with the place table, which may have any size."""
    df = gaz.first_key(i.articles, "article_id", F.col("title"), i.zones_train)
    return df.select("article_id", "zone_ord", F.initcap("zone_key").alias("location_name"), "zone")


@register("build_dataset")
def q_build_dataset(i: Inputs) -> DataFrame:
    """The builder's whole run: listing pages and feed to the written dataset."""
    return build.build_dataset(fx.feed_items(i.events), fx.listing_pages(i.events), dims.source_profiles(i.spark),
                               i.zones_train, F.lit(i.as_of)).select("record_id", *ACCIDENT_COLUMNS)


@register("article_records")
def q_article_records(i: Inputs) -> DataFrame:
    return i.records.drop("source_rank")


# ---- dashboard ---------------------------------------------------------------

@register("region_summary")
def q_region_summary(i: Inputs) -> DataFrame:
    return agg.region_summary(i.records, dims.region_risk(i.spark))


# ---- scalar rules over the driver's events -------------------------------------

@register("hour_features")
def q_hour_features(i: Inputs) -> DataFrame:
    h = F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("int")).otherwise(F.hour("ts"))
    return i.events.select("event_id", h.alias("hour")).select(
        "event_id", "hour", cal.is_peak_hour("hour").alias("is_peak_hour"),
        cal.hour_to_period("hour").alias("time_period"))


def _region_of(eid):
    regions = [r for r, _ in dims.REGION_RISK] + ["Elsewhere"]
    return cal.pick(regions, (eid % len(regions)).cast("int"))


@register("congestion_estimate")
def q_congestion_estimate(i: Inputs) -> DataFrame:
    e = i.events
    h = F.when(e.event_id % 7 == 0, F.lit(None).cast("int")).otherwise(F.hour("ts"))
    df = e.select("event_id", h.alias("hour"), _region_of(e.event_id).alias("zone"))
    c = cal.estimate_congestion("hour", "zone")
    return df.select("event_id", "hour", "zone", c.alias("congestion_pct"), cal.estimate_speed(c).alias("speed_kmh"))


@register("calendar_features")
def q_calendar_features(i: Inputs) -> DataFrame:
    d = F.date_sub(F.to_date("ts"), (F.col("event_id") % 400).cast("int"))
    df = i.events.select("event_id", d.alias("d"))
    return df.select("event_id", F.date_format("d", "yyyy-MM-dd").alias("date"), F.month("d").alias("month"),
                     cal.is_weekend("d").alias("is_weekend"), cal.weekday_name("d").alias("day_of_week"),
                     cal.is_monsoon(F.month("d")).alias("is_monsoon"))


@register("flood_flags")
def q_flood_flags(i: Inputs) -> DataFrame:
    e = i.events
    month = (e.event_id % 12 + 1).cast("int")
    df = e.select("event_id", month.alias("month"), _region_of(e.event_id).alias("zone"),
                  (e.value / 2).alias("rainfall_mm"))
    return df.select("event_id", "month", "zone", "rainfall_mm",
                     cal.flood_risk_season(cal.is_monsoon("month"), F.col("zone")).alias("flood_risk_season"),
                     cal.flood_risk_rain("rainfall_mm").alias("flood_risk_rain"))


PUBLISHED_TEXT_FORMATS = ["EEE, dd MMM yyyy HH:mm:ss '+0530'", "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
                          "yyyy-MM-dd'T'HH:mm:ss'Z'", "MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd"]


@register("parse_dates")
def q_parse_dates(i: Inputs) -> DataFrame:
    e = i.events
    k = (e.event_id % 7).cast("int")
    ts = F.col("ts")
    text = F.when(k == 6, F.lit("not a date"))
    for j, fmt in enumerate(PUBLISHED_TEXT_FORMATS):
        text = text.when(k == j, F.date_format(ts, fmt))
    parsed = cal.parse_published(text)
    return e.select("event_id", parsed["date"].alias("date"), parsed["hour"].alias("hour"),
                    parsed["day_of_week"].alias("day_of_week"))


@register("impute_dates")
def q_impute_dates(i: Inputs) -> DataFrame:
    a = i.articles
    return a.select("article_id", F.date_format(cal.impute_date("source_url", F.lit(i.as_of)), "yyyy-MM-dd").alias("date"),
                    cal.impute_hour("source_url", dated=False).alias("hour_undated"),
                    cal.impute_hour("source_url", dated=True).alias("hour_dated"))


@register("url_dates")
def q_url_dates(i: Inputs) -> DataFrame:
    return i.articles.select("article_id", F.date_format(cal.date_from_url("source_url"), "yyyy-MM-dd").alias("url_date"))


@register("publisher_split")
def q_publisher_split(i: Inputs) -> DataFrame:
    sp = tx.split_publisher("title")
    return i.articles.select("article_id", sp["title"].alias("clean_title"), sp["publisher"].alias("publisher"))


def _texts(i: Inputs) -> DataFrame:
    docs = i.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"),
                                       F.col("text"))
    arts = i.articles.select(F.concat(F.lit("a"), F.col("article_id").cast("string")).alias("text_id"),
                             F.col("title").alias("text"))
    return arts.unionByName(docs)


@register("severity")
def q_severity(i: Inputs) -> DataFrame:
    return _texts(i).select("text_id", tx.extract_severity("text").alias("severity"))


@register("vehicle")
def q_vehicle(i: Inputs) -> DataFrame:
    return _texts(i).select("text_id", tx.extract_vehicle("text").alias("vehicle_type"))


@register("casualty_numbers")
def q_casualty_numbers(i: Inputs) -> DataFrame:
    n = tx.extract_numbers("text")
    return _texts(i).select("text_id", n["num_injured"].alias("num_injured"),
                            n["num_fatalities"].alias("num_fatalities"), n["num_vehicles"].alias("num_vehicles"))


@register("place_flags")
def q_place_flags(i: Inputs) -> DataFrame:
    f = tx.place_flags("text")
    return _texts(i).select("text_id", f["is_junction"].alias("is_junction"), f["is_school_zone"].alias("is_school_zone"))


# ---- weather -------------------------------------------------------------------

@register("weather_parsed")
def q_weather_parsed(i: Inputs) -> DataFrame:
    p = wx.parse_weather(i.weather_obs)
    w = F.col("w")
    return p.select("obs_id", "is_valid", w["main"]["temp"].alias("temp"), w["main"]["humidity"].alias("humidity"),
                    F.get(w["weather"], 0)["main"].alias("main"), w["rain"]["1h"].alias("rain_1h"),
                    w["wind"]["speed"].alias("wind_speed"), w["visibility"].alias("visibility"))


_WEATHER_OUT = ["obs_id", "temperature_c", "feels_like_c", "humidity_pct", "wind_speed_kmh", "wind_gust_kmh",
                "visibility_km", "rainfall_mm", "weather_condition", "weather_desc", "pressure_hpa"]


@register("weather_normalized")
def q_weather_normalized(i: Inputs) -> DataFrame:
    return wx.normalize_weather(wx.parse_weather(i.weather_obs)).select(*_WEATHER_OUT)


@register("weather_advisory")
def q_weather_advisory(i: Inputs) -> DataFrame:
    n = wx.normalize_weather(wx.parse_weather(i.weather_obs))
    adv = wx.weather_advisory("rainfall_mm", "visibility_km", "wind_speed_kmh", "weather_condition")
    return n.select("obs_id", F.array_join(adv["alerts"], " | ").alias("alerts"), adv["severity"].alias("severity"))


def _weather_asof(i: Inputs, ttl: int) -> DataFrame:
    out = al.weather_asof(i.probes, i.weather_obs, ttl)
    return out.select("probe_id", "obs_id", *dims.WEATHER_FALLBACK.keys())


@register("weather_asof")
def q_weather_asof(i: Inputs) -> DataFrame:
    return _weather_asof(i, dims.WEATHER_TTL_S)


@register("weather_asof_day")
def q_weather_asof_day(i: Inputs) -> DataFrame:
    return _weather_asof(i, 86400)


# ---- routes ----------------------------------------------------------------------

_ROUTE_OUT = ["trip_id", "config_ord", "summary", "distance_km", "duration_min", "duration_traffic_min", "delay_min",
              "congestion_pct", "traffic_status"]


@register("route_metrics")
def q_route_metrics(i: Inputs) -> DataFrame:
    return rank.routes_table(i.route_options).select(*_ROUTE_OUT)


@register("rank_routes")
def q_rank_routes(i: Inputs) -> DataFrame:
    return rank.rank_routes(rank.routes_table(i.route_options)).select("trip_id", "config_ord", "rank", "is_recommended")


@register("recommended_route")
def q_recommended_route(i: Inputs) -> DataFrame:
    return rank.recommended_route(rank.routes_table(i.route_options))


def _route_payloads(i: Inputs) -> DataFrame:
    """Stored routing payloads built from the route options (one route each,
    a two-point leg; every 25th trip stored with an empty route list)."""
    o = i.route_options
    pts = F.array(F.struct(F.lit(13.0).alias("latitude"), (F.col("trip_id") % 100 / 1000.0 + 80.0).alias("longitude")),
                  F.struct((F.col("config_ord") / 100.0 + 13.0).alias("latitude"), F.lit(80.2).alias("longitude")))
    route = F.struct(F.struct(F.col("length_m").alias("lengthInMeters"), F.col("travel_s").alias("travelTimeInSeconds"),
                              F.col("delay_s").alias("trafficDelayInSeconds"),
                              F.col("no_traffic_s").alias("noTrafficTravelTimeInSeconds")).alias("summary"),
                     F.array(F.struct(pts.alias("points"))).alias("legs"))
    routes = F.filter(F.array(route), lambda _r: F.col("trip_id") % 25 != 0)
    return o.select("trip_id", "config_ord", F.to_json(F.struct(routes.alias("routes"))).alias("payload"))


@register("routes_parsed")
def q_routes_parsed(i: Inputs) -> DataFrame:
    p = rt.parse_routes(_route_payloads(i))
    return p.select("trip_id", "config_ord", "length_m", "travel_s", "delay_s", "no_traffic_s",
                    F.size("coordinates").alias("n_points"),
                    F.get(F.get("coordinates", 0), 0).alias("first_lng"))


@register("route_coordinates")
def q_route_coordinates(i: Inputs) -> DataFrame:
    """One row per point, in the order of the leg."""
    p = rt.parse_routes(_route_payloads(i))
    return p.select("trip_id", "config_ord", F.posexplode("coordinates").alias("point_ord", "point")).select(
        "trip_id", "config_ord", "point_ord", F.get("point", 0).alias("lng"), F.get("point", 1).alias("lat"))


@register("parse_origin")
def q_parse_origin(i: Inputs) -> DataFrame:
    p = i.probes
    text = F.when(p.probe_id % 3 == 0, F.lit("T Nagar")).otherwise(
        F.concat(p.lat.cast("string"), F.lit(","), p.lng.cast("string")))
    o = rt.parse_origin(text)
    return p.select("probe_id", o["lat"].alias("origin_lat"), o["lng"].alias("origin_lng"))


@register("route_keys")
def q_route_keys(i: Inputs) -> DataFrame:
    r = i.route_requests
    return r.select("request_id", F.when(F.col("destination").isNotNull(),
                                         rt.route_key("origin", "destination")).alias("route_key"))


def _routes_asof(i: Inputs, ttl: int) -> DataFrame:
    return al.routes_asof(i.route_requests, i.route_options, ttl).select("request_id", "matched_trip_id")


@register("routes_asof")
def q_routes_asof(i: Inputs) -> DataFrame:
    return _routes_asof(i, dims.ROUTE_TTL_S)


@register("routes_asof_day")
def q_routes_asof_day(i: Inputs) -> DataFrame:
    return _routes_asof(i, 86400)


# ---- geo -----------------------------------------------------------------------

@register("nearest_zone")
def q_nearest_zone(i: Inputs) -> DataFrame:
    return geo.nearest_zone(i.probes).select("probe_id", "zone_name", "base_risk")


@register("nearest_zone_any")
def q_nearest_zone_any(i: Inputs) -> DataFrame:
    """J2 by a grid search of the zone table, which may have any size."""
    return geo.nearest_zone(i.probes, zones=i.zones_serving).select("probe_id", "zone_name", "base_risk")


@register("history_base")
def q_history_base(i: Inputs) -> DataFrame:
    return geo.history_base(i.records).select("article_id", "headline", "date", "location_name")


@register("history_near")
def q_history_near(i: Inputs) -> DataFrame:
    return geo.accidents_near(i.probes, i.history, radius=0.05, limit=10)


@register("geocode")
def q_geocode(i: Inputs) -> DataFrame:
    return geo.geocode(i.records, "location_name").select("article_id", "location_name", "geo_lat", "geo_lng")


@register("top_zone_incidents")
def q_top_zone_incidents(i: Inputs) -> DataFrame:
    return geo.zone_name_incidents(dims.top_zones(i.spark), i.records)


# ---- alerts and scoring rules ---------------------------------------------------

@register("full_alerts_rules")
def q_full_alerts_rules(i: Inputs) -> DataFrame:
    r = al.full_alerts_rules(i.probes, i.weather_obs, 86400)
    return r.select("probe_id", "zone_name", "obs_id", "rainfall_mm", "visibility_km", "weather_condition",
                    F.array_join("alerts", " | ").alias("alerts"), F.col("advisory_severity").alias("severity"))


@register("full_alerts_routes")
def q_full_alerts_routes(i: Inputs) -> DataFrame:
    """J10 with J7: probes with an optional destination, at the real lifetimes."""
    r = al.alerts_with_routes(i.probes, i.route_requests, i.weather_obs, i.route_options)
    return r.select("probe_id", "zone_name", "obs_id", "temperature_c", "humidity_pct", "wind_speed_kmh",
                    "visibility_km", "rainfall_mm", "weather_condition", F.array_join("alerts", " | ").alias("alerts"),
                    F.col("advisory_severity").alias("severity"), "trip_id", "route_type", "route_summary",
                    "route_min", "route_congestion_pct")


def _requests(i: Inputs) -> DataFrame:
    """Scoring requests derived from probes, with some fields left unset."""
    p = i.probes
    pid = p.probe_id
    return p.select(
        "probe_id", "ts", p.lat.alias("latitude"), p.lng.alias("longitude"),
        F.when(pid % 5 == 0, F.lit(None).cast("int")).otherwise((pid % 24).cast("int")).alias("hour"),
        F.when(pid % 3 == 0, F.lit(None).cast("string"))
         .otherwise(cal.pick(["Clear", "Fog", "Thunderstorm", "Heavy Rain", "Haze"], (pid % 5).cast("int")))
         .alias("weather_condition"),
        F.when(pid % 4 == 0, F.lit("Afternoon")).when(pid % 4 == 1, F.lit(None).cast("string"))
         .otherwise(F.lit("Night")).alias("time_period"),
        F.when(pid % 6 == 0, F.lit(None).cast("string"))
         .otherwise(cal.pick(["Urban", "Expressway", "Highway", "Commercial", "Flyover"], (pid % 5).cast("int")))
         .alias("road_type"),
        (pid % 30).cast("double").alias("rainfall_mm"),
        ((pid % 7) / 2.0).alias("visibility_km"),
        (pid % 101).cast("double").alias("congestion_pct"),
        (pid % 2).cast("int").alias("is_junction"),
        F.when(pid % 9 == 0, F.lit(None).cast("int")).otherwise((pid % 3 == 0).cast("int")).alias("flood_risk"))


_REQ_OUT = ["probe_id", "hour", "is_weekend", "temperature_c", "humidity_pct", "wind_speed_kmh", "visibility_km",
            "rainfall_mm", "congestion_pct", "speed_kmh", "is_junction", "is_school_zone", "flood_risk",
            "weather_condition", "road_type", "time_period"]


@register("complete_requests")
def q_complete_requests(i: Inputs) -> DataFrame:
    return rk.complete_requests(_requests(i), F.col("ts")).select(*_REQ_OUT)


@register("encode_serving")
def q_encode_serving(i: Inputs) -> DataFrame:
    return rk.encode_serving(rk.complete_requests(_requests(i), F.col("ts"))).select(
        "probe_id", "weather_enc", "road_enc", "time_enc")


@register("driver_alerts")
def q_driver_alerts(i: Inputs) -> DataFrame:
    r = rk.complete_requests(_requests(i), F.col("ts"))
    a = rk.driver_alerts("rainfall_mm", "visibility_km", "flood_risk", "congestion_pct", "is_junction", "hour")
    return r.select("probe_id", F.array_join(a, " | ").alias("alerts"))


def _probabilities(i: Inputs) -> DataFrame:
    return i.probes.select("probe_id", ((F.col("probe_id") * 7919 % 10007) / 10007.0).alias("probability"))


@register("risk_levels")
def q_risk_levels(i: Inputs) -> DataFrame:
    return rk.risk_outputs(_probabilities(i)).select("probe_id", "accident_probability", "accident_predicted",
                                                     "risk_score", "risk_level")


@register("alert_severity")
def q_alert_severity(i: Inputs) -> DataFrame:
    n = wx.normalize_weather(wx.parse_weather(i.weather_obs))
    adv = wx.weather_advisory("rainfall_mm", "visibility_km", "wind_speed_kmh", "weather_condition")
    lvl = rk.risk_level((F.col("obs_id") * 7919 % 10007) / 10007.0)
    return n.select("obs_id", adv["severity"].alias("advisory_severity"), lvl.alias("risk_level")) \
            .withColumn("severity", rk.combined_severity("advisory_severity", "risk_level"))


@register("merge_alerts")
def q_merge_alerts(i: Inputs) -> DataFrame:
    n = wx.normalize_weather(wx.parse_weather(i.weather_obs))
    adv = wx.weather_advisory("rainfall_mm", "visibility_km", "wind_speed_kmh", "weather_condition")
    drv = rk.driver_alerts("rainfall_mm", "visibility_km", (F.col("rainfall_mm") > 10).cast("int"),
                           (F.col("obs_id") % 100).cast("double"), (F.col("obs_id") % 2).cast("int"), F.hour("obs_ts"))
    return n.select("obs_id", F.array_join(rk.merge_alerts(adv["alerts"], drv), " | ").alias("alerts"))


@register("weather_quarantine")
def q_weather_quarantine(i: Inputs) -> DataFrame:
    """The payloads that can't be used, with the reason."""
    return wx.account_weather(i.weather_obs)[1].select("obs_id", "payload", "fault")


@register("weather_accounts")
def q_weather_accounts(i: Inputs) -> DataFrame:
    """Rows in against rows kept and rows of each fault."""
    return wx.account_weather(i.weather_obs)[2]


# ---- dashboard and dataset reports ------------------------------------------------

@register("dashboard")
def q_dashboard(i: Inputs) -> DataFrame:
    return agg.dashboard(i.records, dims.region_risk(i.spark), dims.top_zones(i.spark), F.lit(i.as_of))


@register("dashboard_totals")
def q_dashboard_totals(i: Inputs) -> DataFrame:
    return agg.dashboard_totals(i.records)


@register("year_breakdown")
def q_year_breakdown(i: Inputs) -> DataFrame:
    return agg.year_breakdown(i.records)


@register("top_publishers")
def q_top_publishers(i: Inputs) -> DataFrame:
    return agg.top_publishers(i.records, 10)


@register("dataset_totals")
def q_dataset_totals(i: Inputs) -> DataFrame:
    return agg.dataset_totals(i.dataset)


@register("source_month_counts")
def q_source_month_counts(i: Inputs) -> DataFrame:
    return agg.source_month_counts(i.records)


@register("recent_accidents")
def q_recent_accidents(i: Inputs) -> DataFrame:
    return rank.recent_accidents(i.records, F.lit(i.as_of), 10)


@register("union_sources")
def q_union_sources(i: Inputs) -> DataFrame:
    """U1 where all sources share one table: tagged in a single scan."""
    kind = dims.map_lookup({r: k for r, k, _ in dims.SOURCES}, F.col("source_rank"), None)
    return i.articles.select("article_id", "source_rank", kind.alias("source_kind")).where("source_kind IS NOT NULL")


@register("training_union")
def q_training_union(i: Inputs) -> DataFrame:
    return i.dataset.select("record_id", "accident", "location_name", "date", "hour", "congestion_pct")


@register("negatives_zones")
def q_negatives_zones(i: Inputs) -> DataFrame:
    return i.negatives


@register("negatives_1x")
def q_negatives_1x(i: Inputs) -> DataFrame:
    return tr.negatives_mutate(i.records, 1).select("record_id", *ACCIDENT_COLUMNS)


@register("negatives_3x")
def q_negatives_3x(i: Inputs) -> DataFrame:
    return tr.negatives_mutate(i.records, 3).select("record_id", *ACCIDENT_COLUMNS)


@register("seeded_shuffle")
def q_seeded_shuffle(i: Inputs) -> DataFrame:
    return tr.seeded_shuffle(i.dataset, 42).select("record_id", "shuffle_key")


@register("encode_training")
def q_encode_training(i: Inputs) -> DataFrame:
    return rk.encode_training(i.dataset).select("record_id", "weather_enc", "road_enc", "time_enc")


@register("feature_matrix")
def q_feature_matrix(i: Inputs) -> DataFrame:
    return rk.encode_training(i.dataset).select("record_id", *dims.FEATURES, "accident")


@register("stratified_split")
def q_stratified_split(i: Inputs) -> DataFrame:
    return tr.stratified_split(i.dataset, "accident", 0.2, 42).select("record_id", "accident", "split")


@register("class_weights")
def q_class_weights(i: Inputs) -> DataFrame:
    return (tr.balanced_weights(i.dataset).groupBy("accident", "class_weight")
            .agg(F.count(F.lit(1)).alias("n")))


@register("feature_stats")
def q_feature_stats(i: Inputs) -> DataFrame:
    s = tr.feature_stats(rk.encode_training(i.dataset))
    return s.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _scored_dataset(i: Inputs) -> DataFrame:
    """A deterministic score column for the metric operators (congestion share)."""
    return i.dataset.withColumn("score", F.col("congestion_pct") / 100.0)


@register("roc_auc")
def q_roc_auc(i: Inputs) -> DataFrame:
    return tr.roc_auc(_scored_dataset(i), "score").select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


@register("accuracy")
def q_accuracy(i: Inputs) -> DataFrame:
    return tr.accuracy(_scored_dataset(i), "score").select(F.round("accuracy", 9).alias("accuracy"), "n")


@register("class_report")
def q_class_report(i: Inputs) -> DataFrame:
    r = tr.classification_report(_scored_dataset(i), "score")
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("leakage_report")
def q_leakage_report(i: Inputs) -> DataFrame:
    return tr.leakage_report(rk.encode_training(i.dataset))


@register("batch_requests")
def q_batch_requests(i: Inputs) -> DataFrame:
    """Every serving zone for every hour seen in the events (hourly boards)."""
    return trn.batch_requests(i.events, i.zones_serving).drop("board_ts")


# ---- sources and sinks ---------------------------------------------------------

@register("scan_accidents")
def q_scan_accidents(i: Inputs) -> DataFrame:
    """Files of two column orders in one folder."""
    path = scratch_path(i.spark, "accidents-csv")
    early = F.coalesce(F.col("hour") < 12, F.lit(False))
    src.write_dataset_csv(i.dataset.where(early), path)
    src.write_dataset_csv(i.dataset.where(~early), path, ACCIDENT_COLUMNS[::-1], mode="append")
    return src.read_accidents(i.spark, path)


@register("history_files")
def q_history_files(i: Inputs) -> DataFrame:
    """S2 + S3 + U3 + D2: the dataset in files with different column orders, one
    file without labels, one missing, and a last one, the first of two paths
    that exists, which repeats the rows of the first."""
    base = scratch_path(i.spark, "history-files")
    even = F.coalesce(F.col("hour") % 2 == 0, F.lit(False))
    src.write_dataset_csv(i.dataset.where(even), f"{base}/even")
    src.write_dataset_csv(i.dataset.where(~even), f"{base}/odd", ACCIDENT_COLUMNS[::-1])
    src.write_dataset_csv(i.dataset, f"{base}/unlabelled", ["headline", "zone"])
    src.write_dataset_csv(i.dataset.where(even), f"{base}/parent")
    last = src.first_existing(i.spark, [f"{base}/elsewhere", f"{base}/parent"])
    files = [f"{base}/{x}" for x in ("even", "unlabelled", "missing", "odd")]
    history = geo.history_base(src.read_accident_history(i.spark, [*files, last]), F.struct("file_rank", "source_url"))
    return history.select("headline", "date", "location_name", "source_url", "file_rank")


@register("sink_roundtrip")
def q_sink_roundtrip(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "dataset-parquet")
    src.write_dataset(i.dataset, path)
    return src.read_dataset(i.spark, path).select("record_id", *ACCIDENT_COLUMNS)


@register("month_spine")
def q_month_spine(i: Inputs) -> DataFrame:
    return src.month_keyword_spine(i.articles)


@register("page_links")
def q_page_links(i: Inputs) -> DataFrame:
    return feeds.extract_links(i.table("pages"))


@register("rss_items")
def q_rss_items(i: Inputs) -> DataFrame:
    a = i.articles.where(F.col("source_rank") == 0)
    items = a.select(F.col("title"), F.col("source_url").alias("link"),
                     F.col("summary").alias("description"),
                     F.date_format(F.col("published_ts"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"))
    path = scratch_path(i.spark, "rss")
    feeds.write_rss(items, path)
    r = feeds.read_rss(i.spark, path)
    p = cal.parse_published("published")
    return r.select("title", "link", "summary", "published", p["date"].alias("date"), p["hour"].alias("hour"))


# ---- model-backed (rows-only checks: tree models have no SQL oracle) -------------

_MODELS: dict = {}


def _trained(i: Inputs):
    key = (i.spark.sparkContext.applicationId, i.sf_dir, str(i.as_of))  # written splits and models of one application
    if key not in _MODELS:
        _MODELS[key] = trn.train(i.dataset, "retrain", 42)
    return _MODELS[key]


@register("evaluate")
def q_evaluate(i: Inputs) -> DataFrame:
    _, _, metrics = _trained(i)
    return metrics.select(*[F.round(c, 6).alias(c) for c in ("gbt_auc", "rf_auc", "ensemble_auc", "accuracy")],
                          "n_pos", "n_neg")


@register("score_ensemble")
def q_score_ensemble(i: Inputs) -> DataFrame:
    _, scored, _ = _trained(i)
    return scored.select("record_id", "accident", "gbt_probability", "rf_probability", "probability")


@register("score_requests")
def q_score_requests(i: Inputs) -> DataFrame:
    model, _, _ = _trained(i)
    req = rk.complete_requests(_requests(i), F.col("ts"))
    out = ml.score_requests(model, req)
    return out.select("probe_id", "accident_probability", "accident_predicted", "risk_score", "risk_level",
                      "gbt_probability", "rf_probability", F.array_join("alerts", " | ").alias("alerts"))


@register("zone_board")
def q_zone_board(i: Inputs) -> DataFrame:
    model, _, _ = _trained(i)
    req = rk.complete_requests(trn.batch_requests(i.events, i.zones_serving), F.col("board_ts"))
    return trn.zone_board(model, req).select("board_hour", "board_rank", "zone_name", "latitude", "longitude",
                                             "accident_probability", "risk_level")


@register("importances")
def q_importances(i: Inputs) -> DataFrame:
    model, _, _ = _trained(i)
    return i.spark.createDataFrame(ml.importances(model), "feature string, gbt_importance double, rf_importance double")


@register("model_meta")
def q_model_meta(i: Inputs) -> DataFrame:
    model, _, metrics = _trained(i)
    path = scratch_path(i.spark, "model")
    ml.save_model(model, path)
    meta = ml.model_metadata(i.dataset, metrics).withColumn("model_path", F.lit(path))
    meta_path = scratch_path(i.spark, "model-meta")
    meta.write.mode("overwrite").json(meta_path)
    return ml.read_metadata(i.spark, meta_path)


@register("full_alerts")
def q_full_alerts(i: Inputs) -> DataFrame:
    model, _, _ = _trained(i)
    out = al.full_alerts(i.probes, i.weather_obs, model, 86400)
    return out.select("probe_id", "zone_name", "obs_id", "accident_probability", "risk_level",
                      F.array_join("alerts", " | ").alias("alerts"), "severity")


@register("full_alerts_whole")
def q_full_alerts_whole(i: Inputs) -> DataFrame:
    """J10 with the model and the route in one row, both at the TTLs of the original."""
    model, _, _ = _trained(i)
    out = al.full_alerts_with_routes(i.probes, i.route_requests, i.weather_obs, i.route_options, model)
    return out.select("probe_id", "zone_name", "obs_id", "accident_probability", "risk_level",
                      F.array_join("alerts", " | ").alias("alerts"), "advisory_severity", "severity", "trip_id",
                      "route_type", "route_summary", "route_min", "route_congestion_pct")


def _paired(i: Inputs) -> DataFrame:
    key = (i.spark.sparkContext.applicationId, i.sf_dir, str(i.as_of), "paired")
    if key not in _MODELS:
        _MODELS[key] = materialize(trn.train_paired(i.record_table, i.dataset), "paired-metrics")
    return _MODELS[key]


@register("evaluate_paired")
def q_evaluate_paired(i: Inputs) -> DataFrame:
    """L6, L7, L12 as the original pairs them: the builder's configuration on L1
    negatives, the retrainings on L2 and L3."""
    return _paired(i).select("training", "config", *[F.round(c, 6).alias(c) for c in (
        "gbt_auc", "rf_auc", "ensemble_auc", "accuracy")], "n_pos", "n_neg")


# ---- what can be said exactly about the model-backed results ------------------------

def _near(a, b, within: float):
    return F.abs(a - b) <= within


@register("zone_board_base")
def q_zone_board_base(i: Inputs) -> DataFrame:
    """W3 by the base risk of the zones."""
    req = trn.batch_requests(i.events, i.zones_serving)
    ranked = rank.rank_zones(req.withColumn("accident_probability", F.round(F.col("congestion_pct") / 100, 4)))
    return ranked.select("board_hour", "board_rank", "zone_name", "accident_probability")


@register("evaluate_checked")
def q_evaluate_checked(i: Inputs) -> DataFrame:
    """Holdout counts, and the AUCs against Spark's evaluator."""
    _, scored, metrics = _trained(i)
    evaluator = BinaryClassificationEvaluator(labelCol="accident", metricName="areaUnderROC", numBins=0)
    agrees = [_near(F.col(name), F.lit(evaluator.setRawPredictionCol(c).evaluate(scored)), 1e-6).alias(name + "_agrees")
              for name, c in [("gbt_auc", "gbt_probability"), ("rf_auc", "rf_probability"),
                              ("ensemble_auc", "probability")]]
    return metrics.select("n_pos", "n_neg", *agrees, F.col("accuracy").between(0, 1).alias("accuracy_in_range"))


@register("evaluate_paired_checked")
def q_evaluate_paired_checked(i: Inputs) -> DataFrame:
    """L6, L7, L12 paired: holdout counts, metrics in range and better than chance."""
    aucs = [F.col(c).between(0.5, 1) for c in ("gbt_auc", "rf_auc", "ensemble_auc")]
    return _paired(i).select("training", "config", "n_pos", "n_neg", (aucs[0] & aucs[1] & aucs[2]).alias("beats_chance"),
                             F.col("accuracy").between(0, 1).alias("accuracy_in_range"))


@register("score_ensemble_checked")
def q_score_ensemble_checked(i: Inputs) -> DataFrame:
    """Every holdout row, scored also by the model after saving and loading it."""
    model, scored, _ = _trained(i)
    path = scratch_path(i.spark, "model")
    ml.save_model(model, path)
    names = ["gbt_probability", "rf_probability", "probability"]
    again = ml.score(ml.load_model(path), scored.withColumnsRenamed({c: "first_" + c for c in names}))
    wg, wf = dims.ENSEMBLE_WEIGHTS
    same = [_near(F.col(c), F.col("first_" + c), 1e-12) for c in names]
    blend = _near(F.col("probability"), wg * F.col("gbt_probability") + wf * F.col("rf_probability"), 1e-12)
    return again.select("record_id", F.col("accident").cast("int").alias("accident"),
                        F.col("probability").between(0, 1).alias("in_range"), blend.alias("is_blend"),
                        (same[0] & same[1] & same[2]).alias("same_after_load"))


@register("score_requests_checked")
def q_score_requests_checked(i: Inputs) -> DataFrame:
    """Alerts, and whether outputs agree with the rounded probability."""
    p, half = F.col("accident_probability"), 0.5e-4 + 1e-9
    wg, wf = dims.ENSEMBLE_WEIGHTS
    blend = _near(p, wg * F.col("gbt_probability") + wf * F.col("rf_probability"), 2 * half)
    level = F.col("risk_level").isin(rk.risk_level(p - half), rk.risk_level(p + half))
    predicted = F.col("accident_predicted").between((p - half >= dims.THRESHOLD_SERVE).cast("int"),
                                                    (p + half >= dims.THRESHOLD_SERVE).cast("int"))
    return q_score_requests(i).select("probe_id", "alerts", p.between(0, 1).alias("in_range"),
                                      blend.alias("is_blend"), level.alias("level_agrees"),
                                      predicted.alias("prediction_agrees"),
                                      _near(F.col("risk_score"), p * 100, 0.06).alias("score_agrees"))


@register("zone_board_checked")
def q_zone_board_checked(i: Inputs) -> DataFrame:
    """Ranks of every hour, and whether the probability falls with the rank."""
    before = F.lag("accident_probability").over(Window.partitionBy("board_hour").orderBy("board_rank"))
    return q_zone_board(i).select("board_hour", "board_rank", F.coalesce(
        before >= F.col("accident_probability"), F.lit(True)).alias("in_order"))


@register("importances_checked")
def q_importances_checked(i: Inputs) -> DataFrame:
    """The features, shares between 0 and 1 that add up to 1."""
    every = Window.partitionBy(F.lit(1))  # 15 rows
    share = lambda c: F.col(c).between(0, 1) & _near(F.sum(c).over(every), F.lit(1.0), 1e-6)
    return q_importances(i).select("feature", share("gbt_importance").alias("gbt_share"),
                                   share("rf_importance").alias("rf_share"))


@register("model_meta_checked")
def q_model_meta_checked(i: Inputs) -> DataFrame:
    """The columns that don't depend on the fitted trees."""
    return q_model_meta(i).select("total_records", "accident_rows", "n_pos", "n_neg",
                                  F.array_join("features", ",").alias("features"))


@register("full_alerts_checked")
def q_full_alerts_checked(i: Inputs) -> DataFrame:
    """J10 with the model: alerts, and whether the severity follows from advisory and level."""
    model, _, _ = _trained(i)
    out = al.full_alerts(i.probes, i.weather_obs, model)
    agrees = F.col("severity") == rk.combined_severity("advisory_severity", "risk_level")
    return out.select("probe_id", "zone_name", "obs_id", F.array_join("alerts", " | ").alias("alerts"),
                      "advisory_severity", agrees.alias("severity_agrees"))


@register("full_alerts_whole_checked")
def q_full_alerts_whole_checked(i: Inputs) -> DataFrame:
    """J10 whole: all but the model's numbers, and whether the severity follows from advisory and level."""
    agrees = F.col("severity") == rk.combined_severity("advisory_severity", "risk_level")
    return q_full_alerts_whole(i).withColumn("severity_agrees", agrees).drop(
        "accident_probability", "risk_level", "severity")


# ---- streaming (run to completion with availableNow, final table compared) --------

@register("stream_dedupe")
def q_stream_dedupe(i: Inputs) -> DataFrame:
    arts = fx.articles(sj.events_stream(i.spark, i.sf_dir))
    out = sj.run_to_table(sj.stream_dedupe(arts).select("dedupe_key"), "dedupe")
    return out.select("dedupe_key")


@register("stream_latest")
def q_stream_latest(i: Inputs) -> DataFrame:
    obs = fx.weather_obs(sj.events_stream(i.spark, i.sf_dir))
    out = sj.run_to_table(sj.stream_latest_weather(obs), "latest", mode="update", upsert_keys=["cell_lat", "cell_lng"])
    out = sj.expire_latest(out, dims.WEATHER_TTL_S)
    return out.select("cell_lat", "cell_lng", F.col("latest.obs_id").alias("obs_id"),
                      F.col("latest.rainfall_mm").alias("rainfall_mm"),
                      F.col("latest.weather_condition").alias("weather_condition"), "n_obs", "expired")


@register("stream_live")
def q_stream_live(i: Inputs) -> DataFrame:
    """X2 with expiry: the observations a cache of a day would still give out at the end."""
    obs = fx.weather_obs(sj.events_stream(i.spark, i.sf_dir))
    out = sj.run_to_table(sj.stream_live_weather(obs, 86400), "live", mode="update",
                          upsert_keys=["cell_lat", "cell_lng"], newest_by="latest")
    return sj.live_latest(out, 86400).select(
        "cell_lat", "cell_lng", *[F.col("latest")[c].alias(c) for c in ("obs_id", "rainfall_mm", "weather_condition")])


@register("stream_zone_board_all")
def q_stream_zone_board_all(i: Inputs) -> DataFrame:
    """X3 to its end: the emitted windows, and the open ones read from the state store."""
    base = scratch_path(i.spark, "stream-zone-board")
    obs = fx.weather_obs(sj.events_stream(i.spark, i.sf_dir))
    closed = sj.run_to_table(sj.stream_zone_board(obs), "zone-board", base=base)
    out = closed.withColumn("is_open", F.lit(False)).unionByName(
        sj.open_windows(i.spark, base).withColumn("is_open", F.lit(True)))
    return out.withColumn("avg_rainfall", F.round("avg_rainfall", 9))


@register("stream_zone_board")
def q_stream_zone_board(i: Inputs) -> DataFrame:
    obs = fx.weather_obs(sj.events_stream(i.spark, i.sf_dir))
    out = sj.run_to_table(sj.stream_zone_board(obs), "zone-board")
    return out.select("window_start", "zone_name", "n_obs", F.round("avg_rainfall", 9).alias("avg_rainfall"),
                      "max_rainfall", "min_visibility")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, _fn=fn: _fn(Inputs(spark, sf_dir))) for name, fn in QUERIES.items()}
