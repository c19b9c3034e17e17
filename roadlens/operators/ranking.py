"""Per-group ranking and top-k.

Every per-group rank is a ``row_number`` over the group key with an explicit
tie-break column (stable sorts of the original become deterministic order
columns).  Global top-k uses ``orderBy().limit()`` which plans as
TakeOrderedAndProject: each task keeps only its own k best rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routes as rt


def rank_routes(routes: DataFrame, trip: str = "trip_id") -> DataFrame:
    """Rank options of a trip by traffic minutes (stable on config order);
    rank 1 is recommended."""
    w = Window.partitionBy(trip).orderBy("duration_traffic_min", "config_ord")
    return (routes.withColumn("rank", F.row_number().over(w))
                  .withColumn("is_recommended", F.col("rank") == 1))


def recommended_route(routes: DataFrame, trip: str = "trip_id") -> DataFrame:
    """The recommended option per trip as an aggregate (``min_by`` on the
    (minutes, config order) key; partial aggregation keeps hot trips small)."""
    key = F.struct("duration_traffic_min", "config_ord")
    return routes.groupBy(trip).agg(
        F.min_by("route_type", key).alias("route_type"),
        F.min_by("summary", key).alias("summary"),
        F.min("duration_traffic_min").alias("duration_traffic_min"),
        F.min_by("distance_km", key).alias("distance_km"),
        F.min_by("congestion_pct", key).alias("congestion_pct"),
        F.count(F.lit(1)).alias("n_options"))


def routes_table(route_options: DataFrame) -> DataFrame:
    """T25 + summary text for stored route options."""
    return rt.route_metrics(route_options).withColumn("summary", rt.route_summary("destination", "route_type"))


def age_label(date_text, as_of) -> Column:
    """T32: "Nd ago", "Today" (0 or future), or "Recent" for an unreadable date."""
    d = F.try_to_date(F.substring(date_text if isinstance(date_text, Column) else F.col(date_text), 1, 10),
                      "yyyy-MM-dd")
    days = F.datediff(as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date"), d)
    return (F.when(d.isNull(), F.lit("Recent"))
             .when(days > 0, F.concat(days.cast("string"), F.lit("d ago")))
             .otherwise(F.lit("Today")))


def severity_color(sev) -> Column:
    """Display class of a severity."""
    s = sev if isinstance(sev, Column) else F.col(sev)
    return F.when(s == "Fatal", "#ff2d55").when(s == "Major", "#ff6b35").otherwise("#ffcc00")


def recent_accidents(records: DataFrame, as_of, n: int = 10, order_col: str = "article_id") -> DataFrame:
    """The n newest positives (date text descending, file order) with age
    label, display class and cut headline."""
    top = (records.where(F.col("accident") == 1)
           .orderBy(F.desc("date"), F.asc(order_col)).limit(n))
    return top.select(
        order_col,
        age_label("date", as_of).alias("time"),
        F.col("location_name").alias("location"), "zone",
        F.substring("headline", 1, 60).alias("detail"),
        severity_color("severity").alias("severity"),
        F.col("source_url").alias("source"))


def rank_zones(scored: DataFrame) -> DataFrame:
    """Zones by rounded probability, descending, stable on zone order."""
    w = Window.partitionBy("board_hour").orderBy(F.desc("accident_probability"), F.asc("zone_ord"))
    return scored.withColumn("board_rank", F.row_number().over(w))
