"""Hour, day and date rules as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def md5_draw(key, salt: str, n: int) -> Column:
    """Deterministic draw in [0, n): first 32 bits of md5(key|salt) modulo n.

    Replaces ``random`` so results do not depend on partitioning or retries;
    DuckDB repeats it with ``('0x'||substr(md5(...),1,8))::BIGINT % n``.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", _c(key).cast("string"), F.lit(salt))), 1, 8), 16, 10)
    return (h.cast("bigint") % F.lit(n)).cast("int")


def pick(values: list, idx: Column) -> Column:
    """``values[idx]`` for a small literal list (0-based)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx + 1)


def is_peak_hour(hour) -> Column:
    h = _c(hour)
    return F.coalesce((h.between(8, 10) | h.between(17, 20)).cast("int"), F.lit(0))


def hour_to_period(hour, null_value: str | None = "Afternoon") -> Column:
    """Five day parts in rule order; hours 5-7, 15, 16, 21, 22 fall to Night."""
    h = _c(hour)
    out = (F.when(h.between(8, 10), "Morning Peak")
           .when(h.between(17, 20), "Evening Peak")
           .when((h >= 23) | (h <= 4), "Early Morning")
           .when(h.between(11, 14), "Afternoon")
           .otherwise("Night"))
    if null_value is None:
        return out
    return F.when(h.isNull(), F.lit(null_value)).otherwise(out)


def congestion_base(zone) -> Column:
    return dims.map_lookup(dims.REGION_CONGESTION_BASE, _c(zone), dims.REGION_CONGESTION_DEFAULT)


def estimate_congestion(hour, zone) -> Column:
    h = F.coalesce(_c(hour), F.lit(12))
    base = congestion_base(zone)
    return (F.when(h.between(8, 10) | h.between(17, 20), F.least(F.lit(95), base + 25))
            .when(h.between(11, 16), base)
            .otherwise(F.greatest(F.lit(10), base - 30))).cast("int")


def estimate_speed(congestion) -> Column:
    return F.greatest(F.lit(5), F.lit(60) - F.floor(_c(congestion) / 2).cast("int")).cast("int")


def weekday_mon0(date) -> Column:
    """Weekday with Monday = 0."""
    return F.weekday(_c(date))


def is_weekend(date) -> Column:
    return (weekday_mon0(date) >= 5).cast("int")


def weekday_name(date) -> Column:
    return F.date_format(_c(date), "EEEE")


def is_monsoon(month) -> Column:
    return _c(month).between(6, 11).cast("int")


def flood_risk_season(monsoon, zone) -> Column:
    return ((_c(monsoon) == 1) & _c(zone).isin("Central Chennai", "South Chennai")).cast("int")


def flood_risk_rain(rainfall) -> Column:
    return (_c(rainfall) > 10).cast("int")


# Feed date formats, tried in order (day-name prefix stripped first because
# Spark refuses to parse day names; the offset or GMT marker is dropped so
# the hour is the hour as written).

def parse_published(text) -> Column:
    """First matching feed date format -> struct(date, hour, day_of_week)."""
    t = F.trim(_c(text))
    rfc = F.regexp_extract(t, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:[+-]\d{2}:?\d{2}|Z|GMT)$", 1)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})Z$", 1)
    # without a zone throughout: the session's zone can't move an hour
    written = F.concat(F.try_to_date(F.regexp_extract(rfc, r"^\S+ \S+ \S+", 0), "d MMM yyyy").cast("string"), F.lit(" "),
                       F.regexp_extract(rfc, r"\S+$", 0))
    ts = F.coalesce(
        F.when(rfc != "", written.try_cast("timestamp_ntz")),
        F.when(iso != "", iso.try_cast("timestamp_ntz")),
        F.when(t.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), F.try_to_date(t, "MMMM d, yyyy").cast("timestamp_ntz")),
        F.when(t.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), F.try_to_date(t, "d MMMM yyyy").cast("timestamp_ntz")),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd").cast("timestamp_ntz")),
    )
    return F.struct(F.date_format(ts, "yyyy-MM-dd").alias("date"),
                    F.hour(ts).alias("hour"),
                    F.date_format(ts, "EEEE").alias("day_of_week"))


def date_from_url(url) -> Column:
    """``/yyyy/mm/dd/`` in a link -> DATE (invalid calendar dates -> null)."""
    m = F.regexp_extract(_c(url), r"/(\d{4})/(\d{2})/(\d{2})/", 0)
    return F.when(m != "", F.try_to_date(F.substring(m, 2, 10), "yyyy/MM/dd"))


def impute_date(key, as_of) -> Column:
    """Date for an undated article: as_of minus 1..3000 days by md5 draw."""
    days = md5_draw(key, "days", dims.IMPUTE_MAX_DAYS) + 1
    return F.date_sub(_c(as_of), days)


def impute_hour(key, dated: bool) -> Column:
    hours = dims.IMPUTE_HOURS_DATED if dated else dims.IMPUTE_HOURS_UNDATED
    return pick(hours, md5_draw(key, "hour", len(hours)))
