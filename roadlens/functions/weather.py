"""Weather payload parsing, normalisation and advisory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..schemas import WEATHER_PAYLOAD
from ..session import materialize


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_weather(obs: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON payload -> typed struct ``w``; ``is_valid`` is false for
    malformed payloads (they are kept for a quarantine view, never scored)."""
    w = F.col("w")
    required = [w["main"]["temp"], w["main"]["feels_like"], w["main"]["humidity"],
                F.get(w["weather"], 0)["main"], F.get(w["weather"], 0)["description"]]
    valid = required[0].isNotNull()
    for c in required[1:]:
        valid = valid & c.isNotNull()
    return (parse_once(obs, payload, WEATHER_PAYLOAD, "w")
            .withColumn("is_valid", F.coalesce(valid, F.lit(False))))


REQUIRED = ["main.temp", "main.feels_like", "main.humidity", "weather.main", "weather.description"]


def fault(payload, w) -> Column:
    """Why a parsed payload can't be used: null for a valid one."""
    p, w = _c(payload), _c(w)
    first = F.get(w["weather"], 0)
    found = [w["main"]["temp"], w["main"]["feels_like"], w["main"]["humidity"], first["main"], first["description"]]
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for c, n in zip(found, REQUIRED)]))
    return (F.when(p.isNull(), "no payload")
             .when(F.is_valid_utf8(p) & F.try_parse_json(p).isNull(), "not JSON")
             .when(F.size(missing) > 0, F.concat(F.lit("without "), F.array_join(missing, ", "))))


def account_weather(obs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S8 + T23 without silent losses: (normalised rows, quarantined rows with
    their ``fault``, accounts).

    Every row is parsed once and written with its fault.  The accounts hold the
    written rows of each fault (null: kept), the rows of the input, counted on
    their own, and whether the two agree."""
    parsed = parse_weather(obs)
    table = materialize(parsed.withColumn("fault", F.when(~F.col("is_valid"), F.coalesce(
        fault("payload", "w"), F.lit("unreadable")))), "weather-parsed")
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))  # one row a fault
    accounts = (table.groupBy("fault").agg(F.count(F.lit(1)).alias("n_rows"))
                .withColumn("rows_in", obs.select(F.count(F.lit(1))).scalar())
                .withColumn("adds_up", total == F.col("rows_in")))
    return (normalize_weather(table.drop("fault")), table.where(F.col("fault").isNotNull()).drop("w", "is_valid"),
            accounts)


def parse_once(df: DataFrame, payload: str, schema, out: str) -> DataFrame:
    """``from_json`` evaluated exactly once per row into struct column ``out``.

    The parse is the single element of an array expanded by ``inline_outer``
    (a Generate node): later field accesses read the generated columns
    instead of Catalyst inlining (and re-running) the parse into every use."""
    fields = [f.name for f in schema.fields]
    clash = set(fields) & set(df.columns)
    assert not clash, f"payload fields clash with input columns: {clash}"
    parsed = df.select("*", F.inline_outer(F.array(F.from_json(F.col(payload), schema))))
    return parsed.withColumn(out, F.when(F.col(payload).isNotNull(), F.struct(*[F.col(f) for f in fields]))) \
                 .drop(*fields)


def condition(main, rain_1h) -> Column:
    """Provider condition -> model condition (Rain splits at 5 mm/h)."""
    m = _c(main)
    return (F.when(m == "Thunderstorm", "Thunderstorm")
            .when(m == "Drizzle", "Drizzle")
            .when(m == "Rain", F.when(F.coalesce(_c(rain_1h), F.lit(0.0)) > 5, "Heavy Rain").otherwise("Light Rain"))
            .when(m.isin("Mist", "Fog"), "Fog")
            .otherwise("Clear"))


def normalize_weather(parsed: DataFrame) -> DataFrame:
    """Flat weather record from the parsed struct ``w`` (valid rows only)."""
    w = F.col("w")
    rain = F.coalesce(w["rain"]["1h"], F.lit(0.0))
    return parsed.where("is_valid").select(
        "*",
        F.round(w["main"]["temp"], 1).alias("temperature_c"),
        F.round(w["main"]["feels_like"], 1).alias("feels_like_c"),
        w["main"]["humidity"].alias("humidity_pct"),
        F.round(F.coalesce(w["wind"]["speed"], F.lit(0.0)) * 3.6, 1).alias("wind_speed_kmh"),
        F.round(F.coalesce(w["wind"]["gust"], F.lit(0.0)) * 3.6, 1).alias("wind_gust_kmh"),
        F.round(F.coalesce(w["visibility"], F.lit(10000.0)) / 1000, 1).alias("visibility_km"),
        F.round(rain, 1).alias("rainfall_mm"),
        condition(F.get(w["weather"], 0)["main"], rain).alias("weather_condition"),
        F.upper(F.get(w["weather"], 0)["description"]).alias("weather_desc"),
        F.coalesce(w["main"]["pressure"], F.lit(1013.0)).alias("pressure_hpa"),
    ).drop("w")


_LEVEL = {"OK": 0, "WARN": 1, "DANGER": 2}


def weather_advisory(rainfall, visibility, wind, cond) -> Column:
    """struct(alerts array<string>, severity string).

    Alerts in rule order; severity is the highest level reached (DANGER for
    heavy rain, very low visibility or thunderstorm; WARN for any other
    alert; OK otherwise), which equals the original in-order update rule.
    """
    r, v, wd, c = _c(rainfall), _c(visibility), _c(wind), _c(cond)
    alerts = F.array_compact(F.array(
        F.when(r > 20, F.lit(dims.ADV_HEAVY_RAIN)).when(r > 5, F.lit(dims.ADV_MODERATE_RAIN)),
        F.when(v < 1, F.lit(dims.ADV_VERY_LOW_VIS)).when(v < 3, F.lit(dims.ADV_REDUCED_VIS)),
        F.when(wd > 30, F.lit(dims.ADV_WIND)),
        F.when(c == "Thunderstorm", F.lit(dims.ADV_THUNDER)),
    ))
    danger = (r > 20) | (v < 1) | (c == "Thunderstorm")
    severity = F.when(danger, "DANGER").when(F.size(alerts) > 0, "WARN").otherwise("OK")
    alerts = F.when(F.size(alerts) == 0, F.array(F.lit(dims.ADV_NORMAL))).otherwise(alerts)
    return F.struct(alerts.alias("alerts"), severity.alias("severity"))


def grid_cell(lat, lng) -> Column:
    """0.01-degree cell as two integers (portable form of 2-decimal rounding)."""
    return F.struct(F.floor(_c(lat) * 100 + 0.5).cast("long").alias("cell_lat"),
                    F.floor(_c(lng) * 100 + 0.5).cast("long").alias("cell_lng"))
