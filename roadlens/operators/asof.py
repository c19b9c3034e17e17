"""As-of lookup with a freshness limit (J5, J7; the TTL caches re-aimed).

For every left row, the latest right row with the same key, at or before the
left row's time and younger than ``ttl_s`` seconds (strict, as the cache's
``age < ttl`` test).

Plan: no pairwise join and no window as wide as the limit.  Time is cut into
``slices`` buckets a limit.  Each right row stays in its own bucket; what a
bucket needs from before is one row, the last one of an earlier bucket:

1. the last right row of every (key, bucket), by a partial aggregate;
2. a running last value over these rows and the buckets that hold left rows.
   It is taken in blocks of buckets one limit wide, each row copied into its
   own block and the next, since older rows are expired.  A block holds at
   most ``3 * slices`` or so rows of a key, however many rows its buckets have;
3. the two sides and the carried rows are unioned, and ``last(value,
   ignorenulls)`` runs over windows of one (key, bucket).

A key holding a third of all rows is therefore split into buckets of
``ttl_s / slices``, also where the limit is a day.  Rows without a key or a
time match nothing: they skip the shuffles.  Both sides are read twice;
callers whose sides are costly to compute write them first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: buckets a freshness limit is cut into
SLICES = 64


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds of a time; of one without zone as written, whatever the session's zone."""
    c = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        seconds = F.unix_date(F.to_date(c)).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
                ttl_s: int, value_cols: list[str], tiebreak: str, prefix: str = "m_",
                slices: int = SLICES) -> DataFrame:
    """Adds ``prefix + c`` for every right value column (null when none is fresh)."""
    ttl_us = int(ttl_s) * 1_000_000
    width = max(1, ttl_us // slices)
    block = -(-ttl_us // width) + 1  # buckets that cover a limit, wherever it starts in a bucket
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    can_match = has_key & F.col(left_ts).isNotNull()
    bucket = F.floor(F.col("_t") / width)
    lt = left.where(can_match).withColumn("_t", _micros(left, left_ts)).withColumn("_b", bucket)
    vals = F.struct(*[F.col(c).alias(c) for c in value_cols], F.col("_t").alias("_rt"))
    r = (right.where(has_key & F.col(right_ts).isNotNull()).withColumn("_t", _micros(right, right_ts))
              .select(*keys, "_t", bucket.alias("_b"), F.lit(0).alias("_kind"), F.col(tiebreak).alias("_tb"),
                      vals.alias("_r")))
    none = {c: F.lit(None).cast(r.schema[c].dataType) for c in ("_tb", "_r")}

    newest = r.groupBy(*keys, "_b").agg(F.max_by("_r", F.struct("_t", "_tb")).alias("_r"))
    own = F.floor(F.col("_b") / block)
    # a bucket's own rows come after its question: only earlier buckets are carried into it
    steps = (newest.select(*keys, "_b", "_r", F.lit(1).alias("_kind"), F.explode(F.array(own, own + 1)).alias("_blk"))
             .unionByName(lt.select(*keys, "_b").distinct()
                          .select(*keys, "_b", none["_r"].alias("_r"), F.lit(0).alias("_kind"), own.alias("_blk"))))
    before = (Window.partitionBy(*keys, "_blk").orderBy("_b", "_kind")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = (steps.withColumn("_r", F.last("_r", ignorenulls=True).over(before))
               .where((F.col("_kind") == 0) & F.col("_r").isNotNull())
               .select(*keys, F.col("_r._rt").alias("_t"), "_b", "_kind", none["_tb"].alias("_tb"), "_r"))

    both = (lt.withColumn("_kind", F.lit(1)).withColumns(none)
            .unionByName(r.unionByName(carried), allowMissingColumns=True))
    w = (Window.partitionBy(*keys, "_b").orderBy("_t", "_kind", "_tb")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where(F.col("_kind") == 1)
               .withColumn("_m", F.when(F.col("_t") - F.col("_m._rt") < ttl_us, F.col("_m"))))
    out = out.select(*left.columns, *[F.col("_m")[c].alias(prefix + c) for c in value_cols])
    types = {f.name: f.dataType for f in right.schema.fields}
    return out.unionByName(left.where(~can_match).select(
        "*", *[F.lit(None).cast(types[c]).alias(prefix + c) for c in value_cols]))
