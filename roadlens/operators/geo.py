"""Spatial operators (J2, J3, J6, J9, S2/D2 history base).

Design notes for scale:
* J2 scores a probe against the fixed 60-zone gazetteer with a literal
  array of distance structs and ``array_min``: per-row work, no join, no
  shuffle.
* J3 never forms all (probe, accident) pairs.  Probes are reduced to distinct
  locations (the answer depends only on the coordinates).  Accidents are first reduced
  to distinct locations (count + the newest ``limit`` rows per location,
  both partial-aggregated / window-group-limited before the shuffle, so a
  location holding a third of all rows is cut down map-side).  Probes are
  bucketed into cells of the box's half-width and exploded to their 3x3
  neighbourhood, giving an equi-join on the cell instead of a nested-loop
  range join.  Which of the two boxes a location needs is settled before, from
  counts per cell and the points of the narrow grid, so only locations with
  too few accidents nearby meet the points of the wide grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from . import gazetteer


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- J2 ---------------------------------------------------------------------

def nearest_zone_struct(lat, lng, zones: list | None = None) -> Column:
    """struct(dist, zone_ord) of the closest serving zone (ties -> lowest order).

    One literal struct per zone and ``array_min``, which compares (dist, ord):
    the first-strictly-smaller rule of the original loop.  Plain generated
    code (a higher-order ``transform`` would be evaluated interpretively)."""
    zones = zones if zones is not None else dims.ZONES_SERVING
    la, ln = _c(lat), _c(lng)
    nan = F.lit(float("nan"))
    cands = []
    for i, z in enumerate(zones):
        dla, dln = la - F.lit(z[1]), ln - F.lit(z[2])
        cands.append(F.struct(F.coalesce(F.sqrt(dla * dla + dln * dln), nan).alias("dist"),
                              F.lit(i).alias("zone_ord")))
    return F.array_min(F.array(*cands))


def nearest_zone(df: DataFrame, lat: str = "lat", lng: str = "lng", zones: DataFrame | None = None) -> DataFrame:
    """Adds zone_ord, zone_name, base_risk, zone_road_type, zone_dist.

    Without ``zones`` the fixed gazetteer (broadcast, 60 rows); a caller's table,
    of any size, is searched by grid cells (``gazetteer.nearest_place``)."""
    z = zones if zones is not None else dims.zones_serving(df.sparkSession)
    if zones is not None:
        df = gazetteer.nearest_place(df, zones, lat, lng)
    z = z.select("zone_ord", "zone_name", "base_risk", F.col("road_type").alias("zone_road_type"),
                 F.col("lat").alias("zone_lat"), F.col("lng").alias("zone_lng"))
    if zones is not None:
        return df.join(z, "zone_ord", "left")
    best = nearest_zone_struct(lat, lng)
    return (df.withColumn("_nz", best)
              .withColumn("zone_ord", F.col("_nz.zone_ord"))
              .withColumn("zone_dist", F.col("_nz.dist"))
              .drop("_nz")
              .join(F.broadcast(z), "zone_ord", "left"))


# ---- S2 / D2 history base -----------------------------------------------------

def history_base(records: DataFrame, order_col: str | Column = "article_id") -> DataFrame:
    """Positives, first row per headline in file order, headline longer than 10."""
    w = Window.partitionBy("headline").orderBy(order_col)
    return (records.where(F.col("accident") == 1)
            .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
            .where(F.length("headline") > 10))


# ---- J3 -----------------------------------------------------------------------

def _cells(lat: str, lng: str, width: Column, around: int = 0) -> list[Column]:
    """Grid cell of a place, or the cells up to ``around`` beside it.  Cells are a hair wider than
    ``width``, so that places closer than ``width`` are never two cells apart by rounding."""
    wide = width * F.lit(1 + 1e-9)
    cells = [F.floor(F.col(x) / wide) for x in (lat, lng)]
    return [F.explode(F.sequence(c - around, c + around)) for c in cells] if around else cells


def _inside(half: Column) -> Column:
    return (F.abs(F.col("a_lat") - F.col("p_lat")) < half) & (F.abs(F.col("a_lng") - F.col("p_lng")) < half)


def choose_radius(locs: DataFrame, points: DataFrame, radius: float, widen: float, min_hits: int) -> DataFrame:
    """``locs`` (p_lat, p_lng) with ``half``: ``radius``, or ``widen`` times it where the box of ``radius``
    holds fewer than ``min_hits`` accidents (points: a_lat, a_lng, n_point).

    Reads the points of the cells beside a location only, and its pairs are added up before they are
    shuffled.  A location beside cells with too few accidents in all meets no point."""
    width = F.lit(radius)
    clat, clng = _cells("a_lat", "a_lng", width)
    points = points.select("a_lat", "a_lng", "n_point", clat.alias("c_lat"), clng.alias("c_lng"))
    counts = points.groupBy("c_lat", "c_lng").agg(F.sum("n_point").alias("n_cell"))
    # per cell, the accidents of the 3x3 cells around it
    blocks = (counts.withColumn("c_lat", F.explode(F.sequence(F.col("c_lat") - 1, F.col("c_lat") + 1)))
              .withColumn("c_lng", F.explode(F.sequence(F.col("c_lng") - 1, F.col("c_lng") + 1)))
              .groupBy("c_lat", "c_lng").agg(F.sum("n_cell").alias("n_block")).where(F.col("n_block") >= min_hits)
              .select(F.col("c_lat").alias("b_lat"), F.col("c_lng").alias("b_lng")))
    blat, blng = _cells("p_lat", "p_lng", width)
    likely = locs.withColumn("b_lat", blat).withColumn("b_lng", blng).join(blocks, ["b_lat", "b_lng"], "left_semi")
    nlat, nlng = _cells("p_lat", "p_lng", width, 1)
    hits = (likely.select("p_lat", "p_lng").withColumn("c_lat", nlat).withColumn("c_lng", nlng)
            .join(points, ["c_lat", "c_lng"]).where(_inside(width))
            .groupBy("p_lat", "p_lng").agg(F.sum("n_point").alias("hits")).where(F.col("hits") >= min_hits))
    return (locs.join(hits, ["p_lat", "p_lng"], "left")
            .select("p_lat", "p_lng", F.when(F.col("hits").isNotNull(), width)
                    .otherwise(F.lit(radius * widen)).alias("half")))


def accidents_near(probes: DataFrame, accidents: DataFrame, radius: float = 0.05, limit: int = 10,
                   widen: float = 3.0, min_hits: int = 3, order_col: str = "article_id") -> DataFrame:
    """Per probe, accidents inside the box of half-width ``radius``
    (strict); if fewer than ``min_hits`` the box of ``widen*radius`` replaces
    it; newest first (date text descending, then file order); at most
    ``limit`` rows.  A probe without hits keeps one row with ``total`` 0 and no
    accident.  Output: probe_id, rank, record fields, total, matched.

    The box is chosen first (``choose_radius``); then every location meets the
    points of its own box, on a grid as wide as the box.
    """
    r = float(radius)
    acc = accidents.select(F.col("latitude").alias("a_lat"), F.col("longitude").alias("a_lng"),
                           "date", "location_name", "zone", "headline", "severity", "publisher",
                           "source_url", "vehicle_type", F.col(order_col).alias("_ord"))
    # newest `limit` rows per location (WindowGroupLimit runs before the shuffle too)
    wp = Window.partitionBy("a_lat", "a_lng").orderBy(F.desc("date"), F.asc("_ord"))
    newest = acc.withColumn("_prn", F.row_number().over(wp)).where(F.col("_prn") <= limit)
    ranked = newest.select("a_lat", "a_lng", "_prn", "date", "_ord")
    # distinct locations with their counts (partial + final hash aggregate) and newest row
    counts = acc.groupBy("a_lat", "a_lng").agg(F.count(F.lit(1)).alias("n_point"))
    points = counts.join(ranked.where("_prn = 1").drop("_prn"), ["a_lat", "a_lng"])
    # every point on both grids
    alat, alng = _cells("a_lat", "a_lng", F.col("half"))
    points = (points.withColumn("half", F.explode(F.array(F.lit(r), F.lit(r * widen))))
              .withColumn("c_lat", alat).withColumn("c_lng", alng))

    # the answer depends only on the probe's coordinates: search once per
    # distinct location (a hot location collapses in the partial aggregate)
    locs = probes.select(F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).distinct()
    plat, plng = _cells("p_lat", "p_lng", F.col("half"), 1)
    chosen = choose_radius(locs, counts, r, widen, min_hits).withColumn("c_lat", plat).withColumn("c_lng", plng)
    pairs = chosen.join(points, ["half", "c_lat", "c_lng"]).where(_inside(F.col("half")))
    wloc = Window.partitionBy("p_lat", "p_lng")
    wr = wloc.orderBy(F.desc("date"), F.asc("_ord"))
    chosen = (pairs
              .withColumn("matched", F.sum("n_point").over(wloc))
              # Each of the k - 1 locations with a newer newest row has a row before
              # any row of the k-th, so that one can give limit - k + 1 rows at most.
              .withColumn("_quota", F.lit(limit + 1) - F.row_number().over(wr))
              .where(F.col("_quota") > 0)
              .select("p_lat", "p_lng", "a_lat", "a_lng", "matched",
                      F.explode(F.sequence(F.lit(1), F.col("_quota"))).alias("_prn")))
    # ranked on the sort key alone; the record fields join the rows that stay
    per_loc = (chosen.join(ranked, ["a_lat", "a_lng", "_prn"])
               .withColumn("rank", F.row_number().over(wr))
               .where(F.col("rank") <= limit)
               .select("p_lat", "p_lng", "rank", "matched", "a_lat", "a_lng", "_prn")
               .join(newest, ["a_lat", "a_lng", "_prn"])
               .select("p_lat", "p_lng", "rank",
                       F.col("date").cast("string").alias("date"),
                       F.col("location_name").alias("location"),
                       "zone",
                       F.substring("headline", 1, 100).alias("headline"),
                       "severity", "publisher", "source_url",
                       F.col("vehicle_type").alias("vehicle"),
                       F.least(F.col("matched"), F.lit(limit)).alias("total"),
                       "matched"))
    # back to the probes: at most `limit` rows per location; a hot location is
    # a skewed join key on the probe side, which AQE's skew join splits
    out = probes.select("probe_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")) \
                .join(per_loc, ["p_lat", "p_lng"], "left") \
                .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "matched")})
    return out.select("probe_id", "rank", "date", "location", "zone", "headline", "severity", "publisher",
                      "source_url", "vehicle", "total", "matched")


# ---- J6 -----------------------------------------------------------------------

def geocode(df: DataFrame, name: str, zones: DataFrame | None = None) -> DataFrame:
    """Place name -> gazetteer coordinates (lower-case exact match, left join)."""
    z = zones if zones is not None else F.broadcast(dims.zones_serving(df.sparkSession))
    z = z.select(F.lower("zone_name").alias("_gkey"), F.col("lat").alias("geo_lat"), F.col("lng").alias("geo_lng"))
    return (df.withColumn("_gkey", F.lower(F.trim(F.col(name))))
              .join(z, "_gkey", "left").drop("_gkey"))


# ---- J9 -----------------------------------------------------------------------

def zone_name_incidents(top_zones: DataFrame, accidents: DataFrame) -> DataFrame:
    """Per highlight zone, positives whose place name contains the zone
    name's first lower-cased token.  Accidents are first reduced to counts per
    distinct place name (partial aggregation); the tokens of ``top_zones``, a
    table of any size, are looked up in these names."""
    names = (accidents.where(F.col("accident") == 1)
             .groupBy(F.lower("location_name").alias("lname")).agg(F.count(F.lit(1)).alias("n")))
    zones = top_zones.withColumn("_token", F.lower(F.split_part("name", F.lit(" "), F.lit(1))))
    hits = (gazetteer.key_hits(names, "lname", "lname", zones, "_token").join(names, "lname")
            .groupBy("_token").agg(F.sum("n").alias("n")))
    return (zones.join(hits, "_token", "left")
            .select("top_ord", "name", "lat", "lng", "risk",
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("real_incidents")))
