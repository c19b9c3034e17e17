"""Structured Streaming forms of the stateful behaviours.

They reuse the batch Column rules; state lives in Spark's state store under a
checkpoint location in the shared checkpoint folder, so a restarted query (or
a lost executor) resumes from the last committed micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import weather as wx
from ..operators import geo
from ..operators import records as rec
from ..session import materialize, scratch_path
from ..sources import fixtures as fx
from ..sources.accidents import path_exists

#: partitions of an upserted table; each batch replaces those of its keys
UPSERT_BUCKETS = 32


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The driver's ``events`` table as a file stream (new files are new data)."""
    schema = fx.table(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def stream_dedupe(articles: DataFrame, delay: str = "3650 days") -> DataFrame:
    """Relevant articles, first per 60-character key while duplicates arrive
    within ``delay`` of the newest event time (state is then dropped)."""
    cand = rec.with_candidate_columns(articles).withColumn("event_time", F.col("published_ts").cast("timestamp"))
    # irrelevant items are dropped first: they neither take a key nor reach the state
    return (cand.where("is_relevant").withWatermark("event_time", delay)
                .dropDuplicatesWithinWatermark(["dedupe_key"]))


def stream_latest_weather(obs: DataFrame) -> DataFrame:
    """Latest valid observation per 0.01-degree cell (streaming aggregate,
    one state row per cell; partial aggregation before the state shuffle)."""
    w = wx.normalize_weather(wx.parse_weather(obs))
    cell = wx.grid_cell("lat", "lng")
    w = w.withColumn("cell_lat", cell["cell_lat"]).withColumn("cell_lng", cell["cell_lng"])
    order = F.struct(F.col("obs_ts"), F.col("obs_id"))
    val = F.struct("obs_id", "obs_ts", "temperature_c", "rainfall_mm", "visibility_km", "weather_condition")
    return w.groupBy("cell_lat", "cell_lng").agg(F.max_by(val, order).alias("latest"),
                                                 F.count(F.lit(1)).alias("n_obs"))


def expire_latest(latest: DataFrame, ttl_s: int) -> DataFrame:
    """X2 expiry: a cell's latest observation is expired once it is ``ttl_s``
    seconds or more older than the newest observation the stream has seen
    (a one-value aggregate of the state table)."""
    newest = latest.select(F.max("latest.obs_ts")).scalar()
    return latest.withColumn("expired", F.col("latest.obs_ts") <= newest - F.make_dt_interval(secs=F.lit(int(ttl_s))))


def stream_live_weather(obs: DataFrame, ttl_s: int) -> DataFrame:
    """X2 with expiry: latest valid observation per cell and window of ``ttl_s``
    seconds.  Windows that ended ``ttl_s`` before the newest observation leave
    the state, so it holds the cells of the last three windows at most, not
    every cell ever seen.  Put into a table of one row per cell
    (``upsert_table`` by ``latest``), whose rows ``live_latest`` reads."""
    w = wx.normalize_weather(wx.parse_weather(obs)).withColumn("event_time", F.col("obs_ts").cast("timestamp"))
    cell = wx.grid_cell("lat", "lng")
    # time first: the order of the struct is the order of the observations
    latest = F.struct("obs_ts", "obs_id", "temperature_c", "rainfall_mm", "visibility_km", "weather_condition")
    return (w.withColumn("cell_lat", cell["cell_lat"]).withColumn("cell_lng", cell["cell_lng"])
             .withWatermark("event_time", f"{int(ttl_s)} seconds")
             .groupBy(F.window("event_time", f"{int(ttl_s)} seconds").alias("win"), "cell_lat", "cell_lng")
             .agg(F.max(latest).alias("latest"))
             .select("cell_lat", "cell_lng", "latest"))


def live_latest(table: DataFrame, ttl_s: int) -> DataFrame:
    """The cells whose latest observation is younger than ``ttl_s`` seconds."""
    return expire_latest(table, ttl_s).where(~F.col("expired")).drop("expired")


def state_rows(spark: SparkSession, base: str) -> DataFrame:
    """The state that a query run with ``run_to_table(base=...)`` keeps, as rows of ``key`` and ``value``."""
    return spark.read.format("statestore").load(base + "/checkpoint")


def stream_zone_board(obs: DataFrame, window: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """Observations -> nearest serving zone -> tumbling windows per zone
    (count, mean and max rainfall, min visibility); rows are emitted once the
    watermark passes the window end."""
    w = wx.normalize_weather(wx.parse_weather(obs)).withColumn("event_time", F.col("obs_ts").cast("timestamp"))
    z = geo.nearest_zone(w)
    return (z.withWatermark("event_time", delay)
             .groupBy(F.window("event_time", window).alias("win"), "zone_name")
             .agg(F.count(F.lit(1)).alias("n_obs"), F.sum("rainfall_mm").alias("rainfall"),
                  F.max("rainfall_mm").alias("max_rainfall"), F.min("visibility_km").alias("min_visibility"))
             .select(F.date_format(F.col("win.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "zone_name",
                     # a normalised observation always has a rainfall
                     "n_obs", (F.col("rainfall") / F.col("n_obs")).alias("avg_rainfall"), "max_rainfall",
                     "min_visibility"))


def open_windows(spark: SparkSession, base: str) -> DataFrame:
    """The windows the zone board hasn't emitted yet, as they stand in its state."""
    v = F.col("value")
    return state_rows(spark, base).select(
        F.date_format(F.col("key.window.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "key.zone_name",
        v["count"].alias("n_obs"), (v["sum"] / v["count"]).alias("avg_rainfall"), v["max"].alias("max_rainfall"),
        v["min"].alias("min_visibility"))


def start_continuous(df: DataFrame, name: str, every: str = "30 seconds", mode: str = "append"):
    """Run a streaming job continuously (e.g. the zone board refreshed every
    30 seconds) into a Parquet table under the shared checkpoint folder.
    Returns the StreamingQuery; restarting with the same name's paths resumes
    from the checkpoint."""
    base = scratch_path(df.sparkSession, "stream-" + name)
    return (df.writeStream.option("checkpointLocation", base + "/checkpoint")
              .trigger(processingTime=every).outputMode(mode).format("parquet")
              .option("path", base + "/table").start())


def upsert_table(batch: DataFrame, batch_id: int, out: str, keys: list[str], buckets: int = UPSERT_BUCKETS,
                 newest_by: str = "_batch") -> None:
    """Put a micro-batch's rows into the Parquet table ``out``: one row per key, the one of the latest batch
    or the one of the greatest ``newest_by``.

    The table is partitioned by a hash of the keys.  Only the partitions of
    the batch's keys are read, merged and replaced (dynamic partition
    overwrite), so the work follows the batch and not the table.  A batch that
    is replayed after a failure brings the same rows under the same id and
    changes nothing."""
    spark = batch.sparkSession
    new = batch.withColumn("_batch", F.lit(batch_id).cast("long"))
    new = materialize(new.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "upsert-batch")
    touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    merged = new
    if path_exists(spark, out):
        merged = spark.read.schema(new.schema).parquet(out).where(F.col("_bucket").isin(touched)).unionByName(new)
    rest = [c for c in new.columns if c not in keys]
    newest = merged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(newest_by)).alias("_row")).select(*keys, "_row.*")
    # written aside first: a table can't be replaced while it is read
    (materialize(newest, "upsert-merged").repartition("_bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(out))


def run_to_table(df: DataFrame, name: str, mode: str = "append", upsert_keys: list[str] | None = None,
                 base: str | None = None, newest_by: str = "_batch") -> DataFrame:
    """Run a streaming DataFrame until its input is drained (availableNow) into a
    Parquet table under the shared checkpoint folder and return that table.

    ``mode='update'`` puts each micro-batch's changed state rows into a table of
    one row per ``upsert_keys`` (``upsert_table``).  Passing the same ``base``
    again resumes the query from its checkpoint (only new input is processed).
    """
    spark = df.sparkSession
    base = base or scratch_path(spark, "stream-" + name)
    out, ckpt = base + "/table", base + "/checkpoint"
    w = df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        q = w.outputMode("update").foreachBatch(lambda batch, n: upsert_table(batch, n, out, upsert_keys, newest_by=newest_by)).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.parquet(out)
    if not path_exists(spark, out):  # no batch had a row
        return spark.createDataFrame([], df.schema)
    return spark.read.parquet(out).drop("_batch", "_bucket")
