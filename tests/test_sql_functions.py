"""The SQL functions agree with the Column rules on every row of the driver's events."""

from pyspark.sql import functions as F

from conftest import SMALL
from roadlens import dims
from roadlens.functions import calendar as cal
from roadlens.functions import risk as rk
from roadlens.functions import routes as rt
from roadlens.functions import text as tx
from roadlens.functions import weather as wx
from roadlens.functions.sql import register_sql_functions


def test_sql_functions_match_columns(spark):
    register_sql_functions(spark)
    regions = [r for r, _ in dims.REGION_RISK] + ["Elsewhere"]
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select(
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("int")).otherwise(F.hour("ts")).alias("hour"),
        cal.pick(regions, (F.col("event_id") % 6).cast("int")).alias("zone"),
        (F.col("value") / 100.0).alias("p"), F.col("value").alias("rain"),
        (F.col("event_id") % 101).cast("int").alias("cong"), (F.col("value") / 3 + 12).alias("lat"))
    ev.createOrReplaceTempView("ev_sqlfn")
    sql = spark.sql("""SELECT is_peak_hour(hour) a, hour_to_period(hour) b, estimate_congestion(hour, zone) c,
                              estimate_speed(cong) d, risk_level(p) e, flood_risk_rain(rain) f, traffic_status(cong) g,
                              grid_cell_lat(lat) h FROM ev_sqlfn""")
    col = ev.select(cal.is_peak_hour("hour").alias("a"), cal.hour_to_period("hour").alias("b"),
                    cal.estimate_congestion("hour", "zone").alias("c"), cal.estimate_speed("cong").alias("d"),
                    rk.risk_level("p").alias("e"), cal.flood_risk_rain("rain").alias("f"),
                    rt.traffic_status("cong").alias("g"), wx.grid_cell("lat", F.lit(0.0))["cell_lat"].alias("h"))
    assert sql.exceptAll(col).count() == 0 and col.exceptAll(sql).count() == 0
    plan = sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_text_and_weather_functions_match_columns(spark):
    register_sql_functions(spark)
    words = [p for _, ps in dims.SEVERITY_PATTERNS for p in ps]
    words += ["bike", "two-wheeler", "a car hit", "scar", "vehicle", "LORRY", "heavy vehicle", "bus", "busy", "auto", "", None,
              "Two killed, 3 injured as truck rams bike"]
    numbers = [None, 0.0, 0.5, 1.0, 2.9, 3.0, 5.0, 5.1, 20.0, 20.1, 30.0, 31.0]
    rows = [(w, numbers[i % 12], numbers[i * 5 % 12], numbers[i * 7 % 12], ["Clear", "Thunderstorm", None][i % 3])
            for i, w in enumerate(words * 12)]
    df = spark.createDataFrame(rows, "t string, r double, v double, w double, c string")
    df.createOrReplaceTempView("text_sqlfn")
    sql = spark.sql("SELECT t, extract_severity(t) a, extract_vehicle(t) b, weather_advisory(r, v, w, c) c FROM text_sqlfn")
    col = df.select("t", tx.extract_severity("t").alias("a"), tx.extract_vehicle("t").alias("b"),
                    wx.weather_advisory("r", "v", "w", "c").alias("c"))
    assert sql.exceptAll(col).count() == 0 and col.exceptAll(sql).count() == 0
