"""Reporting aggregates (A1-A6, A11, W4 helpers).

All of these are partial (map-side) + final hash aggregates over the
record table; lookup tables they join to are fixed-size and broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import ranking
from .geo import zone_name_incidents


def positives(records: DataFrame) -> DataFrame:
    """accident rows only (pushed into the Parquet scan when reading files)."""
    return records.where(F.col("accident") == 1)


def region_summary(records: DataFrame, regions: DataFrame) -> DataFrame:
    """A1: incidents per region over the fixed region list, zero when absent."""
    counts = positives(records).groupBy("zone").agg(F.count(F.lit(1)).alias("incidents"))
    # the per-zone counts hold one row per region value of the gazetteer
    # (a fixed table), so that side is the broadcast build side
    return (regions.join(F.broadcast(counts), "zone", "left")
            .select("zone", "risk", F.coalesce("incidents", F.lit(0)).cast("bigint").alias("incidents")))


def dataset_totals(df: DataFrame) -> DataFrame:
    """A4: total rows, positives, negatives in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.coalesce(F.sum("accident"), F.lit(0)).cast("bigint").alias("accident_rows"),
                  F.coalesce(F.sum(1 - F.col("accident")), F.lit(0)).cast("bigint").alias("negative_rows"))


def dashboard_totals(records: DataFrame) -> DataFrame:
    """Positives behind the dashboard and the data-present flag."""
    return (positives(records).agg(F.count(F.lit(1)).alias("total_records"))
            .withColumn("real_data", F.col("total_records") > 0))


def year_breakdown(records: DataFrame) -> DataFrame:
    """A2: positive records per year (unparseable dates dropped), by year."""
    y = F.year(F.try_to_date(F.col("date"), "yyyy-MM-dd"))
    return (positives(records).select(y.alias("year")).where("year IS NOT NULL")
            .groupBy("year").agg(F.count(F.lit(1)).alias("records")).orderBy("year"))


def top_publishers(records: DataFrame, n: int = 10) -> DataFrame:
    """A3: the n most frequent publishers among positives (ties by name)."""
    return (positives(records).groupBy("publisher").agg(F.count(F.lit(1)).alias("records"))
            .orderBy(F.desc("records"), F.asc("publisher")).limit(n))


def source_month_counts(records: DataFrame) -> DataFrame:
    """A5: records per source and month, with per-source and grand totals (rollup)."""
    month = F.substring("date", 1, 7)
    return (records.select("source_rank", month.alias("month"))
            .rollup("source_rank", "month").agg(F.count(F.lit(1)).alias("records")))


def dashboard(records: DataFrame, regions: DataFrame, top_zones: DataFrame, as_of, n: int = 10) -> DataFrame:
    """A1 + A6 + J9 + W4 as one table of panels, one pass over the records.

    The positives' few columns are written once; the panels read that table.
    ``panel``: ``total`` (accidents and whether there is data), ``zone``
    (incidents and risk a region), ``prediction`` (incidents and risk a
    highlight zone), ``recent`` (the ``n`` newest accidents); ``pos`` is the
    order inside a panel."""
    cols = ["article_id", "accident", "zone", "date", "location_name", "headline", "severity", "source_url"]
    pos = materialize(positives(records).select(*cols), "dashboard")
    nothing = F.lit(None).cast("string")

    def panel(df: DataFrame, name: str, order, label, value, risk, age=nothing, detail=nothing, color=nothing):
        return df.select(F.lit(name).alias("panel"), order.cast("int").alias("pos"), label.alias("name"),
                         value.cast("long").alias("value"), risk.cast("int").alias("risk"), age.alias("age"),
                         detail.alias("detail"), color.alias("color"))

    no_risk = F.lit(None)
    places = zone_name_incidents(top_zones, pos)
    recent = ranking.recent_accidents(pos, as_of, n)
    newest = Window.orderBy(F.desc("date"), F.asc("article_id"))  # over the n rows kept
    recent = (recent.join(F.broadcast(pos.orderBy(F.desc("date"), F.asc("article_id")).limit(n)
                                      .select("article_id", F.row_number().over(newest).alias("pos"))), "article_id"))
    region = region_summary(pos, regions).join(F.broadcast(regions.select("zone", "region_ord")), "zone")
    return reduce(DataFrame.unionByName, [
        panel(dashboard_totals(pos), "total", F.lit(1), F.lit("accidents"), F.col("total_records"), no_risk,
              detail=F.when(F.col("real_data"), "data").otherwise("no data")),
        panel(region, "zone", F.col("region_ord") + 1, F.col("zone"), F.col("incidents"), F.col("risk")),
        panel(places, "prediction", F.col("top_ord") + 1, F.col("name"), F.col("real_incidents"), F.col("risk")),
        panel(recent, "recent", F.col("pos"), F.col("location"), F.col("article_id"), no_risk, F.col("time"),
              F.col("detail"), F.col("severity"))])
