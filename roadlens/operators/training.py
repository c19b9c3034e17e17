"""Training-set construction and evaluation.

Randomness is replaced by md5 draws keyed on row identity, so results do
not depend on partitioning, retries or executor loss.  No window in this
module is ever partitioned by the label alone: ranks and prefix sums over a
whole class are built from small per-bucket aggregates plus windows inside
hash buckets, so no task has to hold a whole class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import calendar as cal
from ..schemas import ACCIDENT_COLUMNS


def _key(*parts) -> Column:
    return F.concat_ws("-", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def _uniform(key: Column, salt: str, lo: int, hi: int) -> Column:
    """Integer in [lo, hi] (both inclusive), like randint."""
    return F.lit(lo) + cal.md5_draw(key, salt, hi - lo + 1)


# ---- L1 -----------------------------------------------------------------------

def negatives_from_zones(positives: DataFrame, zones: DataFrame, as_of, ratio: int = 1,
                         id_col: str = "article_id") -> DataFrame:
    """L1: ``ratio`` negatives per positive from the gazetteer: random zone,
    off-peak hour, day in the last 10 years, lowered congestion, random
    junction/school flags and weather in the stated ranges."""
    as_of = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    base = (positives.select(F.col(id_col).alias("src_id"))
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(int(ratio))))))
    key = _key("src_id", "k")
    nz = zones.select(F.count(F.lit(1))).scalar()  # ``zone_ord`` numbers the zones from 0
    z = zones.select("zone_ord", F.initcap("zone_key").alias("location_name"), "zone",
                     F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), "road_type")
    df = (base.withColumn("zone_ord", cal.md5_draw(key, "zone", nz))
              .join(z, "zone_ord")
              .withColumn("hour", cal.pick(dims.NEG_ZONE_HOURS, cal.md5_draw(key, "hour", len(dims.NEG_ZONE_HOURS))))
              .withColumn("_d", F.date_sub(as_of, _uniform(key, "days", 1, dims.NEG_ZONE_MAX_DAYS)))
              .withColumn("congestion_pct", F.greatest(F.lit(5), cal.estimate_congestion("hour", "zone")
                                                       - _uniform(key, "cong", 10, 30)).cast("int")))
    month = F.month("_d")
    return df.select(
        F.concat(F.lit("neg-"), key).alias("record_id"),
        F.lit("generated-negative").alias("source_url"), F.lit("generated").alias("publisher"),
        F.lit("").alias("headline"), F.lit("").alias("keyword"),
        F.date_format("_d", "yyyy-MM-dd").alias("date"), F.col("hour").cast("int").alias("hour"),
        cal.weekday_name("_d").alias("day_of_week"), cal.is_weekend("_d").alias("is_weekend"),
        F.lit(0).alias("is_peak_hour"), month.alias("month"), cal.is_monsoon(month).alias("is_monsoon"),
        cal.hour_to_period("hour").alias("time_period"),
        "location_name", "zone", "latitude", "longitude", "road_type",
        F.lit("None").alias("severity"), F.lit("None").alias("vehicle_type"),
        F.lit(0).alias("num_vehicles"), F.lit(0).alias("num_injured"), F.lit(0).alias("num_fatalities"),
        _uniform(key, "junction", 0, 1).alias("is_junction"), _uniform(key, "school", 0, 1).alias("is_school_zone"),
        F.lit(0).alias("flood_risk"), "congestion_pct",
        F.least(F.lit(80), F.lit(60) - F.floor(F.col("congestion_pct") / 3).cast("int")
                + _uniform(key, "speed", 0, 20)).cast("int").alias("speed_kmh"),
        cal.pick(dims.NEG_ZONE_WEATHER, cal.md5_draw(key, "weather", len(dims.NEG_ZONE_WEATHER))).alias("weather_condition"),
        ((F.lit(280) + cal.md5_draw(key, "temp", 81)) / 10.0).alias("temperature_c"),
        ((F.lit(550) + cal.md5_draw(key, "hum", 251)) / 10.0).alias("humidity_pct"),
        ((F.lit(50) + cal.md5_draw(key, "wind", 151)) / 10.0).alias("wind_speed_kmh"),
        ((F.lit(60) + cal.md5_draw(key, "vis", 91)) / 10.0).alias("visibility_km"),
        F.lit(0.0).alias("rainfall_mm"), F.lit(0).alias("accident"))


# ---- L2 / L3 --------------------------------------------------------------------

def negatives_mutate(positives: DataFrame, copies: int = 1, id_col: str = "article_id") -> DataFrame:
    """L2 (copies=1) / L3 (copies=3): negatives made by changing each positive.

    copies=1: off-peak hour, congestion 10..50, speed +20 capped at 80.
    copies=3: also speed 30..80, visibility 6..15, no rain, random junction.
    Other columns (time_period included) are copied from the positive.
    """
    base = positives.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(int(copies)))))
    key = _key(id_col, "k")
    hours = dims.NEG_MUTATE_HOURS
    df = (base.withColumn("hour", cal.pick(hours, cal.md5_draw(key, "hour", len(hours))).cast("int"))
              .withColumn("is_peak_hour", F.lit(0))
              .withColumn("source_url", F.lit("generated-negative"))
              .withColumn("headline", F.lit(""))
              .withColumn("accident", F.lit(0)))
    if copies == 1:
        df = (df.withColumn("congestion_pct", _uniform(key, "cong", 10, 50).cast("int"))
                .withColumn("speed_kmh", F.least(F.lit(80), F.col("speed_kmh") + 20).cast("int")))
    else:
        df = (df.withColumn("congestion_pct", _uniform(key, "cong", 10, 55).cast("int"))
                .withColumn("speed_kmh", _uniform(key, "speed", 30, 80).cast("int"))
                .withColumn("visibility_km", F.lit(6.0) + cal.md5_draw(key, "vis", 900001) / 100000.0)
                .withColumn("rainfall_mm", F.lit(0.0))
                .withColumn("is_junction", _uniform(key, "junction", 0, 1)))
    return df.withColumn("record_id", F.concat(F.lit("neg-"), key)).drop("k")


def training_set(positives: DataFrame, negatives: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Positives + negatives with a common ``record_id``."""
    pos = positives.withColumn("record_id", F.concat(F.lit("pos-"), F.col(id_col).cast("string")))
    cols = ["record_id"] + ACCIDENT_COLUMNS
    return pos.select(*cols).unionByName(negatives.select(*cols))


# ---- W6 -----------------------------------------------------------------------

def seeded_shuffle(df: DataFrame, seed: int = 42, id_col: str = "record_id") -> DataFrame:
    """Reproducible shuffle at any partitioning (a sort on md5(id|seed)).

    Only needed where the consumer is order-sensitive; Spark ML is not."""
    return df.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.col(id_col), F.lit(str(seed))))) \
             .orderBy("shuffle_key")


# ---- L5 -----------------------------------------------------------------------

def _draw32(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, label: str = "accident", test_frac: float = 0.2, seed: int = 42,
                     id_col: str = "record_id", buckets_bits: int = 16) -> DataFrame:
    """Exact per-class holdout of round(test_frac * n_class) rows, chosen by
    the smallest md5(id|seed) draws.

    Rank inside a class = rows of earlier draw buckets (from a small
    (label, bucket) count table) + row number inside the bucket, so windows
    only ever span one hash bucket of one class.
    """
    shift = 32 - buckets_bits
    d = (df.withColumn("_u", _draw32(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))))
           .withColumn("_bk", F.shiftright("_u", shift)))
    counts = d.groupBy(label, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    wl = Window.partitionBy(label).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(label)
    offsets = (counts.withColumn("_off", F.coalesce(F.sum("_n").over(wl), F.lit(0)))
                     .withColumn("_target", F.round(F.sum("_n").over(wt) * test_frac).cast("bigint"))
                     .drop("_n"))
    wb = Window.partitionBy(label, "_bk").orderBy("_u", id_col)
    return (d.join(F.broadcast(offsets), [label, "_bk"])
             .withColumn("_rank", F.col("_off") + F.row_number().over(wb))
             .withColumn("split", F.when(F.col("_rank") <= F.col("_target"), "test").otherwise("train"))
             .drop("_u", "_bk", "_off", "_target", "_rank"))


# ---- A7 -----------------------------------------------------------------------

def balanced_weights(df: DataFrame, label: str = "accident") -> DataFrame:
    """Weight n / (k * n_c) per row (scikit-learn's 'balanced')."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    everything = Window.partitionBy()  # over the per-class count table only (one row per class)
    w = counts.select(label, (F.sum("_nc").over(everything)
                              / (F.count(F.lit(1)).over(everything) * F.col("_nc"))).alias("class_weight"))
    return df.join(F.broadcast(w), label)


# ---- A9 / A10 / A11 -------------------------------------------------------------

def exclusive_prefix(df: DataFrame, order_col: str, value_cols: list[str], steps: int = 1 << 16) -> DataFrame:
    """For each row, the sums of ``value_cols`` over all rows with a smaller
    ``order_col`` (``order_col`` unique per row).  Rows are cut into ``steps``
    equal steps of the unit interval; step totals (at most ``steps`` rows) give
    each step its offset, and a window inside the step adds the rest.  Values
    outside 0..1 fall into the end steps: still exact, less evenly spread.
    Rows with a null value are left out."""
    step = F.floor(F.col(order_col) * steps)
    d = df.withColumn("_bk", F.least(F.greatest(step, F.lit(0)), F.lit(steps - 1)))
    tot = d.groupBy("_bk").agg(*[F.sum(c).alias("_t_" + c) for c in value_cols])
    wo = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_bk", *[F.coalesce(F.sum("_t_" + c).over(wo), F.lit(0)).alias("_o_" + c) for c in value_cols])
    wi = Window.partitionBy("_bk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(F.broadcast(off), "_bk")
    for c in value_cols:
        out = out.withColumn("below_" + c, F.col("_o_" + c) + F.coalesce(F.sum(c).over(wi), F.lit(0)))
    return out.drop("_bk", *["_o_" + c for c in value_cols])


def roc_auc(df: DataFrame, score: str, label: str = "accident") -> DataFrame:
    """ROC-AUC with tie-averaged ranks (one row: auc, n_pos, n_neg); auc is
    null when a class is missing.

    Equal to the rank-sum form: sum over distinct scores of
    pos(s) * (neg below s + neg(s) / 2) / (n_pos * n_neg).  Rows are first
    reduced to one row per distinct score (partial aggregation), then the
    "negatives below" prefix sum is computed without a global window."""
    per = df.groupBy(F.col(score).alias("_s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("double").alias("neg"))
    pref = exclusive_prefix(per, "_s", ["neg"])
    return pref.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)),
                     F.sum("pos") * F.sum("neg")).alias("auc"),
        F.sum("pos").cast("bigint").alias("n_pos"), F.sum("neg").cast("bigint").alias("n_neg"))


def accuracy(df: DataFrame, score: str, label: str = "accident", threshold: float = dims.THRESHOLD_ACCURACY) -> DataFrame:
    """A10: share of rows where (score > threshold) equals the label."""
    pred = (F.col(score) > threshold).cast("int")
    return df.agg(F.avg((pred == F.col(label)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, score: str, label: str = "accident",
                          threshold: float = dims.THRESHOLD_ACCURACY) -> DataFrame:
    """Precision, recall, F1 and support per class from one confusion aggregate."""
    pred = (F.col(score) > threshold).cast("int")
    conf = df.select(F.col(label).cast("int").alias("y"), pred.alias("p")).groupBy("y", "p").count()
    rows = []
    for cls in (0, 1):
        tp = F.sum(F.when((F.col("y") == cls) & (F.col("p") == cls), F.col("count")).otherwise(0))
        fp = F.sum(F.when((F.col("y") != cls) & (F.col("p") == cls), F.col("count")).otherwise(0))
        fn = F.sum(F.when((F.col("y") == cls) & (F.col("p") != cls), F.col("count")).otherwise(0))
        rows.append(conf.agg(F.lit(cls).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")))
    r = reduce(lambda a, b: a.unionByName(b), rows)
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return (r.withColumn("precision", prec).withColumn("recall", rec)
             .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(0.0))
             .withColumn("support", (F.col("tp") + F.col("fn")).cast("bigint"))
             .select("class", "precision", "recall", "f1", "support"))


# ---- A8 / L14 -------------------------------------------------------------------

def feature_stats(df: DataFrame, features: list[str] = dims.FEATURES) -> DataFrame:
    """Mean and population standard deviation per feature (one pass, stacked)."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.col(f).cast("double")).alias(f"m_{f}"), F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{f}', m_{f}, s_{f}" for f in features)
    return wide.selectExpr(f"stack({len(features)}, {stack}) AS (feature, mean, std)")


def leakage_report(df: DataFrame, label: str = "accident", features: list[str] = dims.FEATURES) -> DataFrame:
    """Per feature and class: min, max, distinct count; ``constant_in_class``
    flags a feature with a single value inside a class (a label leak when the
    other class varies)."""
    # long form (label, feature, value), distinct values first (partial
    # aggregation), then min / max / count per (label, feature): two plain
    # hash aggregates instead of one Expand per distinct column
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    distinct_vals = df.select(label, F.inline(pairs)).distinct()
    return (distinct_vals.groupBy(label, "feature")
            .agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"),
                 F.count("value").alias("n_distinct"))
            .withColumn("constant_in_class", (F.col("n_distinct") <= 1).cast("int")))
