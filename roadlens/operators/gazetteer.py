"""Lookups in a place table of any size (J1, J2, J9 with a caller's table).

The fixed gazetteers are matched by generated code (``text.match_location_ord``,
``geo.nearest_zone_struct``).  A table given by the caller is joined instead,
on equality only: on the parts of a text that are as long as a key, or on the
cells of a grid.  Nothing is broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: code points of a text that are looked at from one cut of it
PIECE = 256


def _hits(texts: DataFrame, id_col: str, text: str, keys: DataFrame, key: str) -> DataFrame:
    """(id, key) of every place where a key stands in a text; see ``key_hits``.

    No step needs the positions in any order or once only, so they are not
    exchanged unless the keys are too many to be sent to every task."""
    k = keys.select(F.col(key).alias("_key")).where(F.length("_key") > 0).distinct()
    shortest, longest = (k.select(f(F.length("_key"))).scalar() for f in (F.min, F.max))
    starts = (k.select(F.substring(F.col("_key"), F.lit(1), shortest).alias("_start"), F.length("_key").alias("_n"))
              .groupBy("_start").agg(F.collect_set("_n").alias("_lengths")))
    n = F.length("_text")
    piece = F.substring(F.col("_text"), F.col("_cut") * PIECE + 1, F.lit(PIECE) + longest)
    parts = (texts.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(n > 0)
             .select("_id", "_text", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int"))).alias("_cut"))
             .select("_id", piece.alias("_text"))
             .select("_id", "_text", F.explode(F.sequence(F.lit(1), F.least(n, F.lit(PIECE)))).alias("_pos"))
             .select("_id", F.substring(F.col("_text"), F.col("_pos"), longest).alias("_part")))
    cand = (parts.withColumn("_start", F.substring(F.col("_part"), F.lit(1), shortest)).join(starts, "_start")
            .select("_id", "_part", F.explode("_lengths").alias("_n")).where(F.length("_part") >= F.col("_n"))
            .select("_id", F.substring(F.col("_part"), F.lit(1), F.col("_n")).alias("_key")))
    return cand.join(k, "_key").select(F.col("_id").alias(id_col), F.col("_key").alias(key))


def key_hits(texts: DataFrame, id_col: str, text: str, keys: DataFrame, key: str) -> DataFrame:
    """(id, key) of every distinct key that is a substring of a text.

    Each position of a text gives one row: the part that starts there, as long
    as the longest key.  The first code points, as many as the shortest key
    has, are joined to the beginnings of the keys, which say how long a key may
    be here; the parts of these lengths are joined to the keys.  So most
    positions end at the first join, and a position meets a key length once,
    however many keys begin alike.  Texts are cut into overlapping pieces
    first, so a long text costs in proportion to its length but for the cuts.
    Only what is found is made distinct, not the positions.

    Null and empty keys match nothing, so do null texts; an empty table gives
    no hits.  Rows with the same id count as one."""
    return _hits(texts, id_col, text, keys, key).distinct()


def first_key(df: DataFrame, id_col: str, text: Column, zones: DataFrame, key: str = "zone_key",
              order: str = "zone_ord") -> DataFrame:
    """J1 with any table: adds the row of ``zones`` with the lowest ``order``
    whose key is in the lower-cased text (keys are taken as written); rows
    without one are left out, as in the fixed match."""
    low = df.select(id_col, F.lower(text).alias("_ltext"))
    best = (_hits(low, id_col, "_ltext", zones, key).join(zones.select(key, order), key)
            .groupBy(id_col).agg(F.min(order).alias(order)))
    return df.join(best, id_col).join(zones, order)


def nearest_place(df: DataFrame, places: DataFrame, lat: str = "lat", lng: str = "lng", order: str = "zone_ord",
                  place_lat: str = "lat", place_lng: str = "lng", cell: float = 0.02) -> DataFrame:
    """J2 with any table: adds ``order`` and ``zone_dist`` of the nearest place by
    plain distance in degrees, ties to the lowest order; null without
    coordinates or without places.

    Each distinct location looks at the 3 x 3 cells around it.  A place
    outside of them is at least one cell width away, so a location whose best
    place is nearer than that is done; the others go on in cells twice as
    wide.  The last width holds every coordinate in the cells around the
    origin, so no location is left.  A location far from all places meets all
    places of the cells in which it first finds one."""
    p = materialize(places.select(F.col(order).alias("_ord"), F.col(place_lat).cast("double").alias("_plat"),
                                  F.col(place_lng).cast("double").alias("_plng"))
                    .where("NOT isnan(_plat + _plng)"), "places")
    spot = [F.col(lat).cast("double").alias("_lat"), F.col(lng).cast("double").alias("_lng")]
    left = materialize(df.select(*spot).where("NOT isnan(_lat + _lng)").distinct(), "places-left")
    reach = left.select(F.abs("_lat").alias("x"), F.abs("_lng").alias("y")).unionByName(
        p.select(F.abs("_plat").alias("x"), F.abs("_plng").alias("y"))).agg(F.max(F.greatest("x", "y"))).first()[0]
    offs = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    found, width = [], float(cell)
    while reach is not None:
        last = width > reach
        at = lambda c: F.floor(F.col(c) / width)
        cells = (left.withColumn("_cx", F.explode(F.transform(offs, lambda o: at("_lat") + o)))
                     .withColumn("_cy", F.explode(F.transform(offs, lambda o: at("_lng") + o))))
        dla, dln = F.col("_lat") - F.col("_plat"), F.col("_lng") - F.col("_plng")
        best = (cells.join(p.withColumn("_cx", at("_plat")).withColumn("_cy", at("_plng")), ["_cx", "_cy"])
                .groupBy("_lat", "_lng").agg(F.min(F.struct(F.sqrt(dla * dla + dln * dln).alias("d"), "_ord")).alias("_b")))
        done = materialize(best.where(F.lit(last) | (F.col("_b.d") < width)), "places-found")
        found.append(done)
        if last:
            break
        left = materialize(left.join(done, ["_lat", "_lng"], "left_anti"), "places-left")
        if left.isEmpty():
            break
        width *= 2
    types = {f.name: f.dataType for f in places.schema.fields}
    if not found:
        return df.withColumn(order, F.lit(None).cast(types[order])).withColumn("zone_dist", F.lit(None).cast("double"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    out = df.withColumn("_lat", spot[0]).withColumn("_lng", spot[1]).join(every, ["_lat", "_lng"], "left")
    return (out.withColumn(order, F.col("_b._ord")).withColumn("zone_dist", F.col("_b.d"))
               .drop("_lat", "_lng", "_b"))
