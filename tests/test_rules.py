"""Rule tables for the scalar rules, with boundary values, and the quirks
the original behaviour has (first match by order, substring traps, ...)."""

from pyspark.sql import functions as F

from roadlens import dims
from roadlens.functions import calendar as cal
from roadlens.functions import risk as rk
from roadlens.functions import routes as rt
from roadlens.functions import text as tx
from roadlens.functions import weather as wx


def one(spark, col, schema_rows, schema):
    return [r[0] for r in spark.createDataFrame(schema_rows, schema).select(col).collect()]


def test_peak_and_period(spark):
    hours = [4, 5, 7, 8, 10, 11, 14, 15, 16, 17, 20, 21, 22, 23, None]
    df = spark.createDataFrame([(h,) for h in hours], "h int")
    got = df.select(cal.is_peak_hour("h").alias("p"), cal.hour_to_period("h").alias("t")).collect()
    assert [r.p for r in got] == [0, 0, 0, 1, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0]
    assert [r.t for r in got] == ["Early Morning", "Night", "Night", "Morning Peak", "Morning Peak", "Afternoon",
                                  "Afternoon", "Night", "Night", "Evening Peak", "Evening Peak", "Night", "Night",
                                  "Early Morning", "Afternoon"]


def test_congestion_and_speed(spark):
    rows = [(9, "Central Chennai"), (12, "East Chennai"), (3, "East Chennai"), (None, "North Chennai"), (18, "Elsewhere")]
    df = spark.createDataFrame(rows, "h int, z string")
    got = df.select(cal.estimate_congestion("h", "z").alias("c")).collect()
    assert [r.c for r in got] == [95, 25, 10, 45, 75]
    sp = spark.createDataFrame([(95,), (10,), (11,)], "c int").select(cal.estimate_speed("c").alias("s")).collect()
    assert [r.s for r in sp] == [13, 55, 55]


def test_location_first_match_quirks(spark):
    texts = ["crash at besant nagar", "accident on omr today", "padi bridge", "Mount Road and Anna Salai", "nowhere"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.o for r in df.select(tx.match_location_ord("t").alias("o")).collect()]
    keys = [z[0] for z in dims.ZONES_TRAIN]
    # Q1: "t nagar" (earlier in order) is a substring of "besant nagar"
    assert keys[got[0]] == "t nagar"
    assert keys[got[1]] == "omr"
    assert keys[got[2]] == "padi"
    assert keys[got[3]] == "anna salai"  # order of the gazetteer, not of the text
    assert got[4] is None


def test_severity_vehicle_quirks(spark):
    texts = ["man struck by bus", "heavy vehicle overturns", "skill test crash", "white car hit", "auto-rickshaw"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tx.extract_severity("t").alias("s"), tx.extract_vehicle("t").alias("v")).collect()
    assert got[0].v == "Truck"           # Q3: "truck" inside "struck"
    assert got[1].v == "Car"             # Q4: \bvehicle\b (Car) precedes "heavy vehicle" (Truck)
    assert got[2].s == "Fatal"           # Q3: "kill" inside "skill"
    assert got[3].v == "Car"
    assert got[4].v == "Auto"
    assert got[0].s == "Minor"


def test_numbers(spark):
    texts = ["3 people injured, 2 killed, 9 vehicles", "no numbers", "12 dead as 4 cars pile up", "99999999999 hurt"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tx.extract_numbers("t").alias("n")).collect()
    assert tuple(got[0].n) == (3, 2, 5)
    assert tuple(got[1].n) == (0, 0, 2)
    assert tuple(got[2].n) == (0, 12, 4)


def test_relevance(spark):
    rows = [("Bus accident in Chennai", False), ("Bus accident in Salem", False), ("விபத்து news", True),
            ("hit at adyar", False)]
    df = spark.createDataFrame(rows, "t string, tamil boolean")
    got = df.select(tx.is_relevant("t").alias("a"), tx.is_relevant("t", F.col("t"), tamil=True).alias("b")).collect()
    assert [r.a for r in got] == [True, False, False, True]
    assert [r.b for r in got] == [True, False, True, True]


def test_publisher_split(spark):
    rows = [("Crash - Part 2 - The Post",), ("No publisher",)]
    got = spark.createDataFrame(rows, "t string").select(tx.split_publisher("t").alias("s")).collect()
    assert tuple(got[0].s) == ("Crash - Part 2", "The Post")
    assert tuple(got[1].s) == ("No publisher", "Google News")


def test_parse_published(spark):
    rows = [("Mon, 01 Jan 2024 10:00:00 +0530",), ("Tue, 02 Jan 2024 23:15:00 GMT",), ("2024-01-03T04:05:06Z",),
            ("January 4, 2024",), ("5 January 2024",), ("2024-01-06",), ("garbage",)]
    got = spark.createDataFrame(rows, "t string").select(cal.parse_published("t").alias("p")).collect()
    assert [tuple(r.p) for r in got] == [
        ("2024-01-01", 10, "Monday"), ("2024-01-02", 23, "Tuesday"), ("2024-01-03", 4, "Wednesday"),
        ("2024-01-04", 0, "Thursday"), ("2024-01-05", 0, "Friday"), ("2024-01-06", 0, "Saturday"), (None, None, None)]


def test_published_hours_do_not_move_with_the_session_zone(spark):
    texts = ["Sun, 10 Mar 2024 02:30:00 GMT", "2024-03-10T02:30:00Z", "March 10, 2024", "Sun, 32 Mar 2024 02:30:00 GMT",
             "Sun, 10 Mar 2024 25:30:00 GMT"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # has no half past two on that day
    try:
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(cal.parse_published("t").alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [tuple(r.p) for r in got] == [("2024-03-10", 2, "Sunday"), ("2024-03-10", 2, "Sunday"),
                                         ("2024-03-10", 0, "Sunday"), (None, None, None), (None, None, None)]


def test_risk_levels_and_outputs(spark):
    ps = [0.35, 0.3500001, 0.45, 0.4499999, 0.55, 0.5500001, 0.75, 0.7500001]
    df = spark.createDataFrame([(p,) for p in ps], "probability double")
    got = rk.risk_outputs(df).collect()
    assert [r.risk_level for r in got] == ["LOW", "MODERATE", "MODERATE", "MODERATE", "MODERATE", "HIGH", "HIGH",
                                           "CRITICAL"]
    assert [r.accident_predicted for r in got] == [0, 0, 1, 0, 1, 1, 1, 1]


def test_weather_advisory_levels(spark):
    rows = [(0.0, 10.0, 10.0, "Clear"), (21.0, 10.0, 10.0, "Clear"), (6.0, 2.0, 31.0, "Clear"),
            (0.0, 0.5, 0.0, "Clear"), (0.0, 10.0, 0.0, "Thunderstorm"), (5.0, 3.0, 30.0, "Clear")]
    df = spark.createDataFrame(rows, "r double, v double, w double, c string")
    got = df.select(wx.weather_advisory("r", "v", "w", "c").alias("a")).collect()
    assert [r.a.severity for r in got] == ["OK", "DANGER", "WARN", "DANGER", "DANGER", "OK"]
    assert got[0].a.alerts == [dims.ADV_NORMAL]
    assert got[2].a.alerts == [dims.ADV_MODERATE_RAIN, dims.ADV_REDUCED_VIS, dims.ADV_WIND]


def test_weather_condition_map(spark):
    rows = [("Rain", 6.0), ("Rain", 5.0), ("Mist", None), ("Clouds", None), ("Haze", None), ("Thunderstorm", None)]
    got = spark.createDataFrame(rows, "m string, r double").select(wx.condition("m", "r").alias("c")).collect()
    assert [r.c for r in got] == ["Heavy Rain", "Light Rain", "Fog", "Clear", "Clear", "Thunderstorm"]


def test_route_metrics_half_even(spark):
    rows = [(1, 0, 4050, 90, 30, None), (2, 0, 4150, 150, 0, 150), (3, 0, 1000, 600, 600, 0)]
    df = spark.createDataFrame(rows, "trip_id long, config_ord int, length_m int, travel_s int, delay_s int, no_traffic_s int")
    got = rt.route_metrics(df).orderBy("trip_id").collect()
    assert [r.duration_traffic_min for r in got] == [2, 2, 10]      # 1.5 -> 2, 2.5 -> 2 (half-even)
    assert [r.distance_km for r in got] == [4.0, 4.2, 1.0]
    assert got[2].congestion_pct == 0                                 # free-flow 0 -> congestion 0
    assert got[0].delay_min == 0                                      # 30 s = 0.5 min -> 0 (half-even)
    assert got[0].congestion_pct == 0


def test_merge_alerts_prefix(spark):
    a = ["x" * 30 + "A", "short"]
    b = ["x" * 30 + "B", "other", "short"]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    got = df.select(rk.merge_alerts("a", "b").alias("m")).collect()[0].m
    assert got == ["x" * 30 + "A", "short", "other"]


def test_combined_severity(spark):
    rows = [("OK", "HIGH"), ("DANGER", "CRITICAL"), ("WARN", "LOW"), (None, "CRITICAL")]
    got = spark.createDataFrame(rows, "s string, l string").select(rk.combined_severity("s", "l").alias("x")).collect()
    assert [r.x for r in got] == ["WARN", "DANGER", "WARN", "WARN"]


def test_request_defaults(spark):
    rows = [(None, None, "Afternoon"), (3, 1, "Night")]
    df = spark.createDataFrame(rows, "hour int, is_weekend int, time_period string").withColumn(
        "ts", F.lit("2024-01-06 18:30:00").cast("timestamp_ntz"))
    got = rk.complete_requests(df, F.col("ts")).orderBy(F.col("hour").desc()).collect()
    assert got[0].hour == 18 and got[0].is_weekend == 1 and got[0].time_period == "Evening Peak"
    assert got[1].time_period == "Night" and got[1].temperature_c == 30.0 and got[1].road_type == "Urban"


def test_encoders_differ_by_side(spark):
    rows = [("Thunderstorm", "Expressway", "Unknown")]
    df = spark.createDataFrame(rows, "weather_condition string, road_type string, time_period string")
    tr = rk.encode_training(df).collect()[0]
    sv = rk.encode_serving(df).collect()[0]
    assert (tr.weather_enc, tr.road_enc, tr.time_enc) == (0, 0, 2)   # Q6-Q8
    assert (sv.weather_enc, sv.road_enc, sv.time_enc) == (5, 2, 0)


def test_origin_and_key(spark):
    rows = [("13.05,80.25",), ("T Nagar",), ("13.0",)]
    got = spark.createDataFrame(rows, "o string").select(rt.parse_origin("o").alias("p")).collect()
    assert tuple(got[0].p) == (13.05, 80.25) and tuple(got[1].p) == (None, None) and tuple(got[2].p) == (None, None)
    k = spark.createDataFrame([("ab", "c"), ("a", "bc")], "o string, d string").select(rt.route_key("o", "d").alias("k"))
    assert len({r.k for r in k.collect()}) == 2                      # Q23: separator keeps keys apart


def test_feed_dates_with_offsets_keep_the_written_hour(spark):
    texts = ["Mon, 01 Jan 2024 10:30:00 +0530", "Mon, 01 Jan 2024 10:30:00 +05:30", "Mon, 01 Jan 2024 10:30:00 Z",
             "Mon, 01 Jan 2024 10:30:00 GMT", "Mon, 01 Jan 2024 10:30:00 IST"]
    p = cal.parse_published("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", p["hour"].alias("h")).collect()
    assert {r.t: r.h for r in rows} == dict(zip(texts, [10, 10, 10, 10, None]))


def test_weather_faults_are_named_and_add_up(spark):
    good = '{"main":{"temp":1,"feels_like":2,"humidity":3},"weather":[{"main":"Rain","description":"r"}]}'
    payloads = [good, good, None, "{bad", "", '{"main":{"temp":1},"weather":[{"main":"Rain"}]}', "{}", "[1]",
                good.replace('"temp":1', '"temp":"hot"')]
    obs = spark.createDataFrame(list(enumerate(payloads)), "obs_id long, payload string")
    kept, bad, accounts = wx.account_weather(obs)
    assert sorted(r.obs_id for r in kept.collect()) == [0, 1]
    faults = {r.obs_id: r.fault for r in bad.collect()}
    assert sorted(faults) == [2, 3, 4, 5, 6, 7, 8] and all(faults.values())
    assert faults[2] == "no payload" and faults[3] == "not JSON"
    assert faults[5] == "without main.feels_like, main.humidity, weather.description"
    rows = accounts.collect()
    assert sum(r.n_rows for r in rows) == 9 and {r.rows_in for r in rows} == {9} and all(r.adds_up for r in rows)
    assert wx.account_weather(obs.where("false"))[2].count() == 0
