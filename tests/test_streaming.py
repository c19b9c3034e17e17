"""Streaming jobs resume from their checkpoint and end in the batch result."""

import datetime
import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from roadlens.operators import records as rec
from roadlens.sources import fixtures as fx
from roadlens.streaming import jobs as sj


def test_dedupe_resumes_from_checkpoint(spark):
    src = tempfile.mkdtemp(prefix="roadlens-stream-src-")
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    ev.where("event_id < 500").coalesce(1).write.parquet(f"{src}/part1")
    base = tempfile.mkdtemp(prefix="roadlens-stream-run-")

    def run():
        stream = spark.readStream.schema(ev.schema).parquet(f"{src}/*")
        return sj.run_to_table(sj.stream_dedupe(fx.articles(stream)).select("dedupe_key"), "t", base=base)

    first = run().count()
    ev.where("event_id >= 500").coalesce(1).write.parquet(f"{src}/part2")
    resumed = run()
    batch = rec.dedupe_articles(fx.articles(ev)).select("dedupe_key")
    assert first <= resumed.count()
    assert sorted(r[0] for r in resumed.collect()) == sorted(r[0] for r in batch.collect())


def test_zone_board_windows_are_thirty_seconds(spark):
    obs = fx.weather_obs(spark.readStream.schema(spark.read.parquet(f"{SMALL}/events.parquet").schema)
                         .option("pathGlobFilter", "events*.parquet").parquet(SMALL))
    out = sj.run_to_table(sj.stream_zone_board(obs), "zb")
    secs = out.select(F.second(F.to_timestamp("window_start")).alias("s")).distinct().collect()
    assert {r.s for r in secs} <= {0, 30}


def test_continuous_board_runs_and_stops(spark):
    obs = fx.weather_obs(spark.readStream.schema(spark.read.parquet(f"{SMALL}/events.parquet").schema)
                         .option("pathGlobFilter", "events*.parquet").parquet(SMALL))
    q = sj.start_continuous(sj.stream_zone_board(obs), "zb-continuous", every="1 second")
    try:
        q.processAllAvailable()
        assert q.exception() is None and q.lastProgress is not None
    finally:
        q.stop()


def test_upsert_keeps_one_row_per_key_on_disk(spark, tmp_path):
    out = str(tmp_path / "table")
    schema = "k1 long, k2 string, v int"

    def put(rows, batch_id):
        sj.upsert_table(spark.createDataFrame(rows, schema), batch_id, out, ["k1", "k2"], buckets=4)

    put([(i, "a", 0) for i in range(40)] + [(None, None, 5)], 0)
    put([(3, "a", 1), (100, "b", 1)], 1)
    expected = sorted([(i, "a", int(i == 3)) for i in range(40)] + [(100, "b", 1)])
    assert sorted(r for r in stored_rows(spark, out) if r[0] is not None) == expected
    before = {r.file: r.n for r in files(spark, out)}
    put([(3, "a", 1), (100, "b", 1)], 1)  # replayed
    put([], 2)
    assert sorted(r for r in stored_rows(spark, out) if r[0] is not None) == expected
    put([(3, "a", 7)], 3)
    after = {r.file: r.n for r in files(spark, out)}
    assert sum(before.values()) == sum(after.values()) == 42
    assert len(set(before) & set(after)) > 0  # partitions without a key of the batch are untouched
    assert (3, "a", 7) in stored_rows(spark, out) and (None, None, 5) in stored_rows(spark, out)


def stored_rows(spark, out):
    return sorted(((r.k1, r.k2, r.v) for r in spark.read.parquet(out).collect()), key=str)


def files(spark, out):
    return spark.read.parquet(out).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(
        F.count("*").alias("n")).collect()


def test_latest_over_three_batches(spark, tmp_path):
    """Three runs of one query: the table has one row per cell, equal to the batch aggregate."""
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    base = str(tmp_path / "run")
    for n in range(3):
        ev.where(f"event_id % 3 = {n}").coalesce(1).write.parquet(f"{tmp_path}/src/part{n}")
        stream = fx.weather_obs(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/src/*"))
        out = sj.run_to_table(sj.stream_latest_weather(stream), "latest", "update", ["cell_lat", "cell_lng"], base=base)
    batch = sj.stream_latest_weather(fx.weather_obs(ev))
    rows = lambda df: sorted((r.cell_lat, r.cell_lng, r.latest.obs_id, r.n_obs) for r in df.collect())
    assert rows(out) == rows(batch)


def test_expired_cells_leave_the_state(spark, tmp_path):
    """Three batches, an hour apart: the state holds windows near the newest observation, the table tells
    live cells from expired ones, and a late batch doesn't replace a newer observation."""
    payload = '{"main":{"temp":30,"feels_like":31,"humidity":60},"weather":[{"main":"Clear","description":"x"}]}'
    schema = "obs_id long, obs_ts timestamp_ntz, lat double, lng double, payload string"
    base = str(tmp_path / "run")

    def run(n, rows):
        full = [(i, datetime.datetime(2024, 1, 1, h, m), lat, 80.0, payload) for i, h, m, lat in rows]
        spark.createDataFrame(full, schema).coalesce(1).write.parquet(f"{tmp_path}/src/part{n}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/src/*")
        out = sj.run_to_table(sj.stream_live_weather(stream, 600), "live", "update", ["cell_lat", "cell_lng"],
                              base=base, newest_by="latest")
        live = sorted(r.latest.obs_id for r in sj.live_latest(out, 600).collect())
        kept = sorted(r.latest.obs_id for r in out.collect())
        state = {r.h for r in sj.state_rows(spark, base).select(F.hour("key.window.start").alias("h")).collect()}
        return live, kept, state

    assert run(0, [(1, 0, 0, 10.0), (2, 0, 1, 10.0), (3, 0, 2, 11.0)]) == ([2, 3], [2, 3], {0})
    assert run(1, [(4, 1, 0, 10.0), (5, 1, 1, 12.0)]) == ([4, 5], [3, 4, 5], {1})
    assert run(2, [(6, 0, 5, 10.0), (7, 2, 0, 13.0)]) == ([7], [3, 4, 5, 7], {2})


def test_open_windows_complete_the_board(spark, tmp_path):
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    obs = lambda df: fx.weather_obs(df)
    base = str(tmp_path / "run")
    stream = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events*.parquet").parquet(SMALL)
    closed = sj.run_to_table(sj.stream_zone_board(obs(stream)), "zb", base=base)
    opened = sj.open_windows(spark, base)
    board = lambda df: sorted((r.window_start, r.zone_name, r.n_obs, round(r.avg_rainfall, 9))
                              for r in df.collect())
    assert opened.count() > 0
    assert board(closed.unionByName(opened)) == board(sj.stream_zone_board(obs(ev)))
