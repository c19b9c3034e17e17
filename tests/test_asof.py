"""As-of lookup: against brute force, whatever the slices, and spread of one hot key."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from roadlens.operators import asof

EPOCH = datetime.datetime(2024, 1, 1)


def at(us):
    return None if us is None else EPOCH + datetime.timedelta(microseconds=us)


def frames(spark, n, span_us, seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["a", "a", "a", "b", None])
    when = lambda: rnd.choice([None] + [rnd.randrange(-span_us, span_us) // 500_000 * 500_000 for _ in range(9)])
    left = [(i, key(), when()) for i in range(n)]
    right = [(i, key(), when(), rnd.choice([None, "x", "y"])) for i in range(n)]
    lf = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "id long, k string, ts timestamp_ntz")
    rf = spark.createDataFrame([(i, k, at(t), v) for i, k, t, v in right],
                               "rid long, k string, rts timestamp_ntz, v string")
    return left, right, lf, rf


def brute(left, right, ttl_us):
    out = {}
    for i, k, t in left:
        hits = [(rt, rid, v) for rid, rk, rt, v in right
                if None not in (k, t, rt) and rk == k and rt <= t and t - rt < ttl_us]
        out[i] = max(hits)[1:] if hits else (None, None)
    return out


@pytest.mark.parametrize("slices", [1, 3, 64])
@pytest.mark.parametrize("ttl_s", [1, 7, 60])
def test_equals_brute_force(spark, ttl_s, slices):
    left, right, lf, rf = frames(spark, 300, 120_000_000, ttl_s)
    got = asof.asof_latest(lf, rf, ["k"], "ts", "rts", ttl_s, ["rid", "v"], "rid", slices=slices)
    assert {r.id: (r.m_rid, r.m_v) for r in got.collect()} == brute(left, right, ttl_s * 1_000_000)


def test_empty_sides(spark):
    left, right, lf, rf = frames(spark, 20, 10_000_000, 1)
    none = asof.asof_latest(lf, rf.where("false"), ["k"], "ts", "rts", 60, ["rid"], "rid")
    assert none.count() == 20 and none.where("m_rid IS NOT NULL").count() == 0
    assert asof.asof_latest(lf.where("false"), rf, ["k"], "ts", "rts", 60, ["rid"], "rid").count() == 0


def test_times_without_zone_keep_their_distance(spark):
    """A limit over the night in which the session's zone skips an hour."""
    night = [datetime.datetime(2024, 3, 31, 1, 30), datetime.datetime(2024, 3, 31, 3, 15)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        lf = spark.createDataFrame([(1, "a", night[1])], "id long, k string, ts timestamp_ntz")
        rf = spark.createDataFrame([(2, "a", night[0])], "rid long, k string, rts timestamp_ntz")
        assert asof.asof_latest(lf, rf, ["k"], "ts", "rts", 3600, ["rid"], "rid").first().m_rid is None
        assert asof.asof_latest(lf, rf, ["k"], "ts", "rts", 6301, ["rid"], "rid").first().m_rid == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_hot_key_spreads_over_its_limit(spark):
    """One key, a day's limit: no window partition holds more than a slice of it."""
    ids = spark.range(0, 20_000)
    when = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 4)).alias("ts")
    lf = ids.select("id", F.lit("hot").alias("k"), when)
    rf = ids.select(F.col("id").alias("rid"), F.lit("hot").alias("k"), when.alias("rts"))
    got = asof.asof_latest(lf, rf, ["k"], "ts", "rts", 86_400, ["rid"], "rid")
    assert got.where("m_rid = id").count() == 20_000
    width = 86_400 // asof.SLICES
    assert ids.groupBy(F.floor(F.col("id") * 4 / width)).count().agg(F.max("count")).first()[0] <= width / 4 + 1
    keys = [line for line in got._jdf.queryExecution().toString().splitlines() if "hashpartitioning(k" in line]
    assert keys and all("_b" in line for line in keys)
