"""The scalar rules as temporary SQL functions, for users of ``spark.sql``.

SQL-bodied functions are expanded by the analyzer into the calling query, so
they run inside generated code like the Column forms (no Python).  Each is
checked against its Column counterpart in ``tests/test_sql_functions.py``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import dims


def _region_base_case(zone: str) -> str:
    arms = " ".join(f"WHEN {zone} = {dims.sql_str(k)} THEN {v}" for k, v in dims.REGION_CONGESTION_BASE.items())
    return f"CASE {arms} ELSE {dims.REGION_CONGESTION_DEFAULT} END"


def _class_case(text: str, classes, default: str, condition: str) -> str:
    arms = " ".join(f"WHEN {condition.format(text=text, pattern='r' + dims.sql_str(p))} THEN {dims.sql_str(label)}"
                    for label, patterns in classes for p in patterns)
    return f"CASE {arms} ELSE {dims.sql_str(default)} END"


def _advisory() -> str:
    text = dims.sql_str
    alerts = (f"array_compact(array("
              f"CASE WHEN rainfall > 20 THEN {text(dims.ADV_HEAVY_RAIN)} "
              f"WHEN rainfall > 5 THEN {text(dims.ADV_MODERATE_RAIN)} END, "
              f"CASE WHEN visibility < 1 THEN {text(dims.ADV_VERY_LOW_VIS)} "
              f"WHEN visibility < 3 THEN {text(dims.ADV_REDUCED_VIS)} END, "
              f"CASE WHEN wind > 30 THEN {text(dims.ADV_WIND)} END, "
              f"CASE WHEN condition = 'Thunderstorm' THEN {text(dims.ADV_THUNDER)} END))")
    severity = ("CASE WHEN rainfall > 20 OR visibility < 1 OR condition = 'Thunderstorm' THEN 'DANGER' "
                "WHEN rainfall > 5 OR visibility < 3 OR wind > 30 THEN 'WARN' ELSE 'OK' END")
    return (f"named_struct('alerts', CASE WHEN size({alerts}) = 0 THEN array({text(dims.ADV_NORMAL)}) "
            f"ELSE {alerts} END, 'severity', {severity})")


def definitions() -> dict[str, str]:
    base = _region_base_case("zone")
    h = "COALESCE(hour, 12)"
    return {
        "is_peak_hour": "(hour INT) RETURNS INT RETURN "
                        "COALESCE(CAST((hour BETWEEN 8 AND 10 OR hour BETWEEN 17 AND 20) AS INT), 0)",
        "hour_to_period": "(hour INT) RETURNS STRING RETURN CASE WHEN hour IS NULL THEN 'Afternoon' "
                          "WHEN hour BETWEEN 8 AND 10 THEN 'Morning Peak' WHEN hour BETWEEN 17 AND 20 THEN 'Evening Peak' "
                          "WHEN hour >= 23 OR hour <= 4 THEN 'Early Morning' WHEN hour BETWEEN 11 AND 14 THEN 'Afternoon' "
                          "ELSE 'Night' END",
        "estimate_congestion": f"(hour INT, zone STRING) RETURNS INT RETURN CAST(CASE "
                               f"WHEN {h} BETWEEN 8 AND 10 OR {h} BETWEEN 17 AND 20 THEN least(95, {base} + 25) "
                               f"WHEN {h} BETWEEN 11 AND 16 THEN {base} ELSE greatest(10, {base} - 30) END AS INT)",
        "estimate_speed": "(congestion INT) RETURNS INT RETURN CAST(greatest(5, 60 - floor(congestion / 2)) AS INT)",
        "risk_level": "(p DOUBLE) RETURNS STRING RETURN CASE WHEN p > 0.75 THEN 'CRITICAL' WHEN p > 0.55 THEN 'HIGH' "
                      "WHEN p > 0.35 THEN 'MODERATE' ELSE 'LOW' END",
        "flood_risk_rain": "(rainfall DOUBLE) RETURNS INT RETURN CAST(rainfall > 10 AS INT)",
        "traffic_status": "(congestion INT) RETURNS STRING RETURN CASE WHEN congestion > 60 THEN 'HEAVY' "
                          "WHEN congestion > 30 THEN 'MODERATE' ELSE 'CLEAR' END",
        "extract_severity": "(text STRING) RETURNS STRING RETURN " + _class_case(
            "lower(text)", dims.SEVERITY_PATTERNS, dims.SEVERITY_DEFAULT, "contains({text}, {pattern})"),
        "extract_vehicle": "(text STRING) RETURNS STRING RETURN " + _class_case(
            "lower(text)", dims.VEHICLE_PATTERNS, dims.VEHICLE_DEFAULT, "{text} RLIKE {pattern}"),
        "weather_advisory": "(rainfall DOUBLE, visibility DOUBLE, wind DOUBLE, condition STRING) "
                            "RETURNS STRUCT<alerts: ARRAY<STRING>, severity: STRING> RETURN " + _advisory(),
        "grid_cell_lat": "(lat DOUBLE) RETURNS BIGINT RETURN CAST(floor(lat * 100 + 0.5) AS BIGINT)",
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """CREATE OR REPLACE TEMPORARY FUNCTION for every rule; returns their names."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
