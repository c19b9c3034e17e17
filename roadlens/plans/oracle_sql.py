"""DuckDB oracle SQL for the registered queries.

The driver pre-registers only its own tables, so the derived input views
(FIXTURES.md §3) are inlined as CTEs.  The gazetteer VALUES lists and the
ordered text rules are generated from the same fixed values in ``dims``;
everything else is plain, hand-written SQL that states each rule
independently of the Spark code.
"""

from __future__ import annotations

from .. import dims

AS_OF = "2024-02-01"


def q(s: str) -> str:
    return dims.sql_str(s)


def zones_train_cte() -> str:
    rows = ",\n  ".join(
        f"({i},{q(k)},{dims.sql_double(la)},{dims.sql_double(ln)},{q(z)},{q(r)},{q(dims.title_case(k))})"
        for i, (k, la, ln, z, r) in enumerate(dims.ZONES_TRAIN))
    return (f"zones_train AS (SELECT * FROM (VALUES\n  {rows}\n) AS t(zone_ord, zone_key, lat, lng, zone, "
            f"road_type, location_name))")


def zones_serving_cte() -> str:
    return f"zones_serving AS ({dims.zones_serving_values_sql()})"


def _arms(values: list[str], idx: str) -> str:
    return f"CASE {idx} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


ARTICLES = f"""articles AS (
SELECT b.event_id AS article_id,
       CAST(b.event_id % 6 AS INT) AS source_rank,
       b.ts - to_days(CAST(b.event_id % 7 * 30 AS INT)) AS published_ts,
       CASE WHEN b.hot THEN '3 people injured as bus and car collide in accident at kathipara, Chennai'
       ELSE concat(
         CASE WHEN b.told THEN concat('Case ', CAST(b.story AS VARCHAR), ': ', CASE b.block % 8
           WHEN 0 THEN 'Two-wheeler rider killed after lorry hit him'
           WHEN 1 THEN '3 people injured as bus and car collide in accident at signal'
           WHEN 2 THEN 'College student escapes unhurt in auto crash'
           WHEN 3 THEN '12 killed, 7 vehicles damaged in fatal pile-up'
           WHEN 4 THEN 'Man struck by heavy vehicle on flyover, critical'
           WHEN 5 THEN 'Council reviews new budget'
           WHEN 6 THEN 'SUV accident: 1 dead'
           ELSE 'Minor collision near school' END)
         ELSE concat('Note ', CAST(b.story AS VARCHAR), ': ', CASE b.block % 4
           WHEN 0 THEN 'School opens new library' WHEN 1 THEN 'Council plans a park'
           WHEN 2 THEN 'Metro work moves on' ELSE 'Market prices ease' END) END,
         CASE WHEN z.zone_key IS NULL THEN ' in Salem' ELSE concat(' at ', z.zone_key, ', Chennai') END,
         CASE WHEN b.story % 5 = 0 THEN ' - Daily Post' ELSE '' END) END AS title,
       CASE WHEN b.hot OR NOT b.told THEN NULL
            WHEN b.block % 8 = 5 THEN 'Accident near a school, 2 injured; Chennai police at the junction'
            WHEN b.event_id % 2 = 0 THEN 'Police said 4 people were injured and 2 vehicles towed at the signal'
            ELSE '' END AS summary,
       CASE WHEN b.event_id % 6 = 0 THEN {_arms(dims.RSS_KEYWORDS, f"b.block % {len(dims.RSS_KEYWORDS)}")} END AS keyword,
       CASE WHEN b.block % 2 = 0 THEN concat('https://news.example.org/2023/0', CAST(b.block % 9 + 1 AS VARCHAR), '/',
              CASE WHEN b.event_id % 28 < 9 THEN '0' ELSE '' END,
              CAST(b.event_id % 28 + 1 AS VARCHAR), '/a', CAST(b.event_id AS VARCHAR))
            ELSE concat('https://news.example.org/a', CAST(b.event_id AS VARCHAR)) END AS source_url
FROM (SELECT event_id, ts, event_id // 6 AS block, (event_id // 6) % 3 = 0 AS hot, (event_id // 18) % 5 = 1 AS told,
             CASE WHEN (event_id // 2) % 4 = 0 THEN event_id - event_id % 2 ELSE event_id END AS story FROM events) b
LEFT JOIN zones_train z ON z.zone_ord = (b.story * 7) % 50)"""

PROBES = """probes AS (
SELECT event_id AS probe_id, ts,
       CAST(CASE WHEN event_id % 97 = 0 THEN 11850 ELSE 12850 END + (event_id * 13) % 340 AS DOUBLE) / 1000 AS lat,
       CAST(80000 + (user_id * 29 + event_id) % 310 AS DOUBLE) / 1000 AS lng
FROM events)"""

WEATHER_OBS = """weather_obs AS (
SELECT event_id AS obs_id, ts - to_seconds(event_id % 900) AS obs_ts,
       CAST(12850 + (event_id * CASE WHEN event_id % 3 = 0 THEN 17 ELSE 13 END) % 340 AS DOUBLE) / 1000 AS lat,
       CAST(80000 + (user_id * CASE WHEN event_id % 3 = 0 THEN 31 ELSE 29 END + event_id) % 310 AS DOUBLE) / 1000 AS lng,
       CASE WHEN event_id % 50 = 0 THEN '{bad json'
       ELSE concat('{"main":{"temp":', CAST(24 + event_id % 13 AS VARCHAR),
         ',"feels_like":', CAST(26 + event_id % 13 AS VARCHAR),
         ',"humidity":', CAST(55 + event_id % 35 AS VARCHAR), '}',
         ',"weather":[{"main":"', CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'Clear' WHEN 1 THEN 'Rain' WHEN 2 THEN 'Mist'
            WHEN 3 THEN 'Clouds' WHEN 4 THEN 'Thunderstorm' WHEN 5 THEN 'Drizzle' WHEN 6 THEN 'Fog' ELSE 'Haze' END,
         '","description":"obs"}]',
         CASE WHEN event_id % 8 IN (1, 4) THEN concat(',"rain":{"1h":', CAST(event_id % 31 AS VARCHAR), '}') ELSE '' END,
         ',"wind":{"speed":', CAST(event_id % 12 AS VARCHAR), '}',
         CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(',"visibility":', CAST(400 + (event_id % 90) * 100 AS VARCHAR)) END,
         '}') END AS payload
FROM events)"""

ROUTE_OPTIONS = """route_options AS (
SELECT e.event_id AS trip_id, concat('o', CAST(e.user_id AS VARCHAR)) AS origin,
       concat('d', CAST(e.event_id % 40 AS VARCHAR)) AS destination, k.route_type, k.config_ord,
       CAST(4000 + (e.event_id * 37 + k.config_ord * 911) % 11000 AS INT) AS length_m,
       CAST(900 + (e.event_id * 53 + k.config_ord * 401) % 2700 AS INT) AS travel_s,
       CAST((e.event_id * 11 + k.config_ord * 97) % 1200 AS INT) AS delay_s,
       CASE WHEN e.event_id % 10 = 0 THEN CAST(NULL AS INT)
            ELSE CAST(700 + (e.event_id * 53 + k.config_ord * 401) % 1500 AS INT) END AS no_traffic_s,
       e.ts - to_seconds(e.event_id % 450) AS obs_ts
FROM events e CROSS JOIN (SELECT * FROM (VALUES (0,'fastest'),(1,'shortest'),(2,'eco')) AS v(config_ord, route_type)) k)"""

ROUTE_REQUESTS = """route_requests AS (
SELECT event_id AS request_id, ts, concat('o', CAST(user_id AS VARCHAR)) AS origin,
       CASE WHEN event_id % 4 = 0 THEN CAST(NULL AS VARCHAR)
            ELSE concat('d', CAST((event_id * CASE WHEN event_id % 3 = 0 THEN 3 ELSE 1 END) % 40 AS VARCHAR)) END AS destination
FROM events)"""


# ---- generated rule expressions (same fixed values as dims) -------------

def any_contains(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def relevance(text: str) -> str:
    t = f"lower({text})"
    return (f"({any_contains(t, dims.ACCIDENT_WORDS)} AND "
            f"{any_contains(t, dims.CITY_WORDS + [z[0] for z in dims.ZONES_TRAIN])})")


def location_ord(text: str) -> str:
    t = f"lower({text})"
    arms = " ".join(f"WHEN contains({t}, {q(z[0])}) THEN {i}" for i, z in enumerate(dims.ZONES_TRAIN))
    return f"(CASE {arms} END)"


def severity(text: str) -> str:
    t = f"lower({text})"
    arms = " ".join(f"WHEN contains({t}, {q(p)}) THEN {q(lbl)}" for lbl, ps in dims.SEVERITY_PATTERNS for p in ps)
    return f"(CASE {arms} ELSE {q(dims.SEVERITY_DEFAULT)} END)"


def vehicle(text: str) -> str:
    t = f"lower({text})"
    arms = " ".join(f"WHEN regexp_matches({t}, {q(p)}) THEN {q(lbl)}" for lbl, ps in dims.VEHICLE_PATTERNS for p in ps)
    return f"(CASE {arms} ELSE {q(dims.VEHICLE_DEFAULT)} END)"


def first_number(text: str, pattern: str) -> str:
    return f"TRY_CAST(regexp_extract(lower({text}), {q(pattern)}, 1) AS INTEGER)"


def draw(key: str, salt: str, n: int) -> str:
    return f"CAST((('0x' || substr(md5(concat_ws('|', CAST({key} AS VARCHAR), {q(salt)})), 1, 8))::BIGINT % {n}) AS INTEGER)"


def pick(values: list, idx: str) -> str:
    arr = "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"
    return f"{arr}[{idx} + 1]"


def hour_period(h: str, null_value: str | None = "Afternoon") -> str:
    nul = f"WHEN {h} IS NULL THEN {q(null_value)} " if null_value else ""
    return (f"(CASE {nul}WHEN {h} BETWEEN 8 AND 10 THEN 'Morning Peak' WHEN {h} BETWEEN 17 AND 20 THEN 'Evening Peak' "
            f"WHEN {h} >= 23 OR {h} <= 4 THEN 'Early Morning' WHEN {h} BETWEEN 11 AND 14 THEN 'Afternoon' "
            f"ELSE 'Night' END)")


def peak(h: str) -> str:
    return f"COALESCE(CAST(({h} BETWEEN 8 AND 10 OR {h} BETWEEN 17 AND 20) AS INTEGER), 0)"


def congestion(h: str, zone: str) -> str:
    base = ("(CASE " + " ".join(f"WHEN {zone} = {q(k)} THEN {v}" for k, v in dims.REGION_CONGESTION_BASE.items())
            + f" ELSE {dims.REGION_CONGESTION_DEFAULT} END)")
    hh = f"COALESCE({h}, 12)"
    return (f"CAST(CASE WHEN {hh} BETWEEN 8 AND 10 OR {hh} BETWEEN 17 AND 20 THEN least(95, {base} + 25) "
            f"WHEN {hh} BETWEEN 11 AND 16 THEN {base} ELSE greatest(10, {base} - 30) END AS INTEGER)")


def records_ctes(as_of: str = AS_OF) -> str:
    """cand -> dedup -> located -> records (34 columns + article_id, source_rank)."""
    rel = relevance("concat(title, ' ', summary)")
    tamil = any_contains("title", dims.TAMIL_TITLE_WORDS)
    site_pub = "CASE source_rank " + " ".join(f"WHEN {r} THEN {q(p)}" for r, _, p in dims.SOURCES if p) + " END"
    return f"""cand AS (
  SELECT article_id, source_rank, published_ts, title, source_url, summary, keyword,
         lower(substr(title, 1, 60)) AS dedupe_key,
         CASE WHEN source_rank = 5 THEN ({rel} OR {tamil}) ELSE {rel} END AS is_relevant
  FROM (SELECT * REPLACE (COALESCE(summary, '') AS summary) FROM articles) a),
dedup AS (
  SELECT * FROM cand WHERE is_relevant
  QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY source_rank, article_id) = 1),
titled AS (
  SELECT *,
    CASE WHEN source_rank = 0 THEN
      CASE WHEN regexp_matches(title, '(?s) - ') THEN trim(regexp_extract(title, '(?s)^(.*) - (.*)$', 1)) ELSE trim(title) END
    ELSE title END AS clean_title,
    CASE WHEN source_rank = 0 THEN
      CASE WHEN regexp_matches(title, '(?s) - ') THEN trim(regexp_extract(title, '(?s)^(.*) - (.*)$', 2)) ELSE 'Google News' END
    ELSE {site_pub} END AS publisher
  FROM dedup),
located AS (
  SELECT t.*, concat(t.clean_title, ' ', t.summary) AS text, z.zone_key, z.location_name, z.zone,
         z.lat AS latitude, z.lng AS longitude, z.road_type
  FROM titled t JOIN zones_train z ON z.zone_ord = {location_ord("concat(t.clean_title, ' ', t.summary)")}),
dated AS (
  SELECT *,
    CASE WHEN source_rank = 0 THEN CAST(published_ts AS DATE)
         WHEN source_rank IN (1, 2) THEN
           CASE WHEN regexp_extract(source_url, '/(\\d{{4}})/(\\d{{2}})/(\\d{{2}})/', 0) <> ''
                THEN CAST(TRY_STRPTIME(substr(regexp_extract(source_url, '/(\\d{{4}})/(\\d{{2}})/(\\d{{2}})/', 0), 2, 10), '%Y/%m/%d') AS DATE) END
    END AS gdate
  FROM located),
imputed AS (
  SELECT *,
    COALESCE(gdate, CAST(DATE '{as_of}' - (1 + {draw("source_url", "days", dims.IMPUTE_MAX_DAYS)}) AS DATE)) AS d,
    CAST(CASE WHEN gdate IS NULL THEN {pick(dims.IMPUTE_HOURS_UNDATED, draw("source_url", "hour", len(dims.IMPUTE_HOURS_UNDATED)))}
         WHEN source_rank = 0 AND hour(published_ts) IS NOT NULL THEN hour(published_ts)
         ELSE {pick(dims.IMPUTE_HOURS_DATED, draw("source_url", "hour", len(dims.IMPUTE_HOURS_DATED)))} END AS INTEGER) AS hour
  FROM dated),
records AS (
  SELECT article_id, source_rank, source_url, publisher, substr(clean_title, 1, 120) AS headline,
    CASE WHEN source_rank = 0 THEN COALESCE(keyword, '') ELSE '' END AS keyword,
    strftime(d, '%Y-%m-%d') AS date, hour,
    CASE WHEN gdate IS NULL THEN dayname(d) WHEN source_rank = 0 THEN dayname(d) ELSE NULL END AS day_of_week,
    CAST(isodow(d) >= 6 AS INTEGER) AS is_weekend,
    {peak("hour")} AS is_peak_hour,
    CAST(month(d) AS INTEGER) AS month,
    CAST(month(d) BETWEEN 6 AND 11 AS INTEGER) AS is_monsoon,
    {hour_period("hour")} AS time_period,
    location_name, zone, latitude, longitude, road_type,
    {severity("text")} AS severity,
    {vehicle("text")} AS vehicle_type,
    least(COALESCE({first_number("text", dims.VEHICLES_PATTERN)}, 2), 5) AS num_vehicles,
    COALESCE({first_number("text", dims.INJURED_PATTERN)}, 0) AS num_injured,
    COALESCE({first_number("text", dims.KILLED_PATTERN)}, 0) AS num_fatalities,
    CAST({any_contains("lower(text)", dims.JUNCTION_WORDS)} AS INTEGER) AS is_junction,
    CAST({any_contains("lower(text)", dims.SCHOOL_WORDS)} AS INTEGER) AS is_school_zone,
    CAST(month(d) BETWEEN 6 AND 11 AND zone IN ('Central Chennai', 'South Chennai') AS INTEGER) AS flood_risk,
    {congestion("hour", "zone")} AS congestion_pct,
    CAST(greatest(5, 60 - {congestion("hour", "zone")} // 2) AS INTEGER) AS speed_kmh,
    'Unknown' AS weather_condition, CAST(31.0 AS DOUBLE) AS temperature_c, CAST(72.0 AS DOUBLE) AS humidity_pct,
    CAST(15.0 AS DOUBLE) AS wind_speed_kmh, CAST(8.0 AS DOUBLE) AS visibility_km, CAST(0.0 AS DOUBLE) AS rainfall_mm,
    1 AS accident
  FROM imputed)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def base_article_ctes() -> list[str]:
    return [zones_train_cte(), ARTICLES]


def records_prefix() -> str:
    return with_ctes(zones_train_cte(), ARTICLES, records_ctes())


# ---- oracle per registered query ------------------------------------------

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def _cand_only() -> str:
    return with_ctes(zones_train_cte(), ARTICLES, records_ctes())


oracle("relevant_articles", _cand_only() + f"SELECT article_id, source_rank, dedupe_key, "
       f"{relevance('concat(title, \' \', summary)')} AS is_relevant FROM cand")
oracle("relevant_tamil", _cand_only() + "SELECT article_id, source_rank, dedupe_key, is_relevant FROM cand")
oracle("article_dedupe", _cand_only() + "SELECT article_id, source_rank, dedupe_key FROM dedup")
oracle("article_location", with_ctes(zones_train_cte(), ARTICLES) + f"""
SELECT a.article_id, z.zone_ord, z.location_name, z.zone
FROM articles a JOIN zones_train z ON z.zone_ord = {location_ord("a.title")}""")
oracle("article_records", records_prefix() + "SELECT * EXCLUDE (source_rank) FROM records")

REGIONS = "regions AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(r)}, {k})" for i, (r, k) in enumerate(dims.REGION_RISK)) + ") AS t(region_ord, zone, risk))"

oracle("region_summary", with_ctes(zones_train_cte(), ARTICLES, records_ctes(), REGIONS) + """
SELECT r.zone, r.risk, CAST(COALESCE(c.n, 0) AS BIGINT) AS incidents
FROM regions r LEFT JOIN (SELECT zone, count(*) AS n FROM records WHERE accident = 1 GROUP BY zone) c
  ON c.zone = r.zone""")

# ---- scalar rules over events ------------------------------------------------

oracle("hour_features", f"""
WITH h AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(hour(ts) AS INTEGER) END AS hour FROM events)
SELECT event_id, hour, {peak("hour")} AS is_peak_hour, {hour_period("hour")} AS time_period FROM h""")

_REGIONS6 = [r for r, _ in dims.REGION_RISK] + ["Elsewhere"]

oracle("congestion_estimate", f"""
WITH b AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(hour(ts) AS INTEGER) END AS hour,
                  {pick(_REGIONS6, "(event_id % 6)")} AS zone FROM events)
SELECT event_id, hour, zone, {congestion("hour", "zone")} AS congestion_pct,
       CAST(greatest(5, 60 - {congestion("hour", "zone")} // 2) AS INTEGER) AS speed_kmh FROM b""")

oracle("calendar_features", """
WITH b AS (SELECT event_id, CAST(ts AS DATE) - CAST(event_id % 400 AS INTEGER) AS d FROM events)
SELECT event_id, strftime(d, '%Y-%m-%d') AS date, CAST(month(d) AS INTEGER) AS month,
       CAST(isodow(d) >= 6 AS INTEGER) AS is_weekend, dayname(d) AS day_of_week,
       CAST(month(d) BETWEEN 6 AND 11 AS INTEGER) AS is_monsoon FROM b""")

oracle("flood_flags", f"""
WITH b AS (SELECT event_id, CAST(event_id % 12 + 1 AS INTEGER) AS month, {pick(_REGIONS6, "(event_id % 6)")} AS zone,
                  value / 2 AS rainfall_mm FROM events)
SELECT event_id, month, zone, rainfall_mm,
       CAST(month BETWEEN 6 AND 11 AND zone IN ('Central Chennai', 'South Chennai') AS INTEGER) AS flood_risk_season,
       CAST(rainfall_mm > 10 AS INTEGER) AS flood_risk_rain FROM b""")

oracle("parse_dates", """
SELECT event_id,
  CASE WHEN event_id % 7 = 6 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS date,
  CAST(CASE WHEN event_id % 7 IN (0, 1, 2) THEN hour(ts) WHEN event_id % 7 IN (3, 4, 5) THEN 0 END AS INTEGER) AS hour,
  CASE WHEN event_id % 7 = 6 THEN NULL ELSE dayname(ts) END AS day_of_week
FROM events""")

oracle("impute_dates", with_ctes(zones_train_cte(), ARTICLES) + f"""
SELECT article_id,
  strftime(CAST(DATE '{AS_OF}' - (1 + {draw("source_url", "days", dims.IMPUTE_MAX_DAYS)}) AS DATE), '%Y-%m-%d') AS date,
  {pick(dims.IMPUTE_HOURS_UNDATED, draw("source_url", "hour", len(dims.IMPUTE_HOURS_UNDATED)))} AS hour_undated,
  {pick(dims.IMPUTE_HOURS_DATED, draw("source_url", "hour", len(dims.IMPUTE_HOURS_DATED)))} AS hour_dated
FROM articles""")

oracle("url_dates", with_ctes(zones_train_cte(), ARTICLES) + """
SELECT article_id, strftime(CAST(TRY_STRPTIME(NULLIF(substr(regexp_extract(source_url, '/(\\d{4})/(\\d{2})/(\\d{2})/', 0), 2, 10), ''), '%Y/%m/%d') AS DATE), '%Y-%m-%d') AS url_date
FROM articles""")

oracle("publisher_split", with_ctes(zones_train_cte(), ARTICLES) + """
SELECT article_id,
  CASE WHEN regexp_matches(title, '(?s) - ') THEN trim(regexp_extract(title, '(?s)^(.*) - (.*)$', 1)) ELSE trim(title) END AS clean_title,
  CASE WHEN regexp_matches(title, '(?s) - ') THEN trim(regexp_extract(title, '(?s)^(.*) - (.*)$', 2)) ELSE 'Google News' END AS publisher
FROM articles""")

_TEXTS = with_ctes(zones_train_cte(), ARTICLES, """texts AS (
  SELECT concat('a', CAST(article_id AS VARCHAR)) AS text_id, title AS text FROM articles
  UNION ALL SELECT concat('d', CAST(doc_id AS VARCHAR)) AS text_id, text FROM documents)""")

oracle("severity", _TEXTS + f"SELECT text_id, {severity('text')} AS severity FROM texts")
oracle("vehicle", _TEXTS + f"SELECT text_id, {vehicle('text')} AS vehicle_type FROM texts")
oracle("casualty_numbers", _TEXTS + f"""
SELECT text_id, COALESCE({first_number("text", dims.INJURED_PATTERN)}, 0) AS num_injured,
       COALESCE({first_number("text", dims.KILLED_PATTERN)}, 0) AS num_fatalities,
       least(COALESCE({first_number("text", dims.VEHICLES_PATTERN)}, 2), 5) AS num_vehicles FROM texts""")
oracle("place_flags", _TEXTS + f"""
SELECT text_id, CAST({any_contains("lower(text)", dims.JUNCTION_WORDS)} AS INTEGER) AS is_junction,
       CAST({any_contains("lower(text)", dims.SCHOOL_WORDS)} AS INTEGER) AS is_school_zone FROM texts""")

# ---- weather -------------------------------------------------------------------

WEATHER_PARSED = """wp AS (
  SELECT obs_id, obs_ts, lat, lng, payload, COALESCE(json_valid(payload), false) AS ok FROM weather_obs),
wf AS (
  SELECT obs_id, obs_ts, lat, lng,
    CASE WHEN ok THEN TRY_CAST(json_extract_string(payload, '$.main.temp') AS DOUBLE) END AS temp,
    CASE WHEN ok THEN TRY_CAST(json_extract_string(payload, '$.main.feels_like') AS DOUBLE) END AS feels_like,
    CASE WHEN ok THEN TRY_CAST(json_extract_string(payload, '$.main.humidity') AS DOUBLE) END AS humidity,
    CASE WHEN ok THEN TRY_CAST(json_extract_string(payload, '$.main.pressure') AS DOUBLE) END AS pressure,
    CASE WHEN ok THEN json_extract_string(payload, '$.weather[0].main') END AS main,
    CASE WHEN ok THEN json_extract_string(payload, '$.weather[0].description') END AS description,
    CASE WHEN ok THEN TRY_CAST(json_extract_string(payload, '$.rain."1h"') AS DOUBLE) END AS rain_1h,
    CASE WHEN ok THEN TRY_CAST(json_extract_string(payload, '$.wind.speed') AS DOUBLE) END AS wind_speed,
    CASE WHEN ok THEN TRY_CAST(json_extract_string(payload, '$.wind.gust') AS DOUBLE) END AS wind_gust,
    CASE WHEN ok THEN TRY_CAST(json_extract_string(payload, '$.visibility') AS DOUBLE) END AS visibility
  FROM wp),
wv AS (
  SELECT *, COALESCE(temp IS NOT NULL AND feels_like IS NOT NULL AND humidity IS NOT NULL
                     AND main IS NOT NULL AND description IS NOT NULL, false) AS is_valid FROM wf)"""

WEATHER_NORM = WEATHER_PARSED + """,
wn AS (
  SELECT obs_id, obs_ts, lat, lng,
    CAST(floor(lat * 100 + 0.5) AS BIGINT) AS cell_lat, CAST(floor(lng * 100 + 0.5) AS BIGINT) AS cell_lng,
    round(temp, 1) AS temperature_c, round(feels_like, 1) AS feels_like_c, humidity AS humidity_pct,
    round(COALESCE(wind_speed, 0) * 3.6, 1) AS wind_speed_kmh, round(COALESCE(wind_gust, 0) * 3.6, 1) AS wind_gust_kmh,
    round(COALESCE(visibility, 10000) / 1000, 1) AS visibility_km, round(COALESCE(rain_1h, 0), 1) AS rainfall_mm,
    CASE WHEN main = 'Thunderstorm' THEN 'Thunderstorm' WHEN main = 'Drizzle' THEN 'Drizzle'
         WHEN main = 'Rain' THEN CASE WHEN COALESCE(rain_1h, 0) > 5 THEN 'Heavy Rain' ELSE 'Light Rain' END
         WHEN main IN ('Mist', 'Fog') THEN 'Fog' ELSE 'Clear' END AS weather_condition,
    upper(description) AS weather_desc, COALESCE(pressure, 1013) AS pressure_hpa
  FROM wv WHERE is_valid)"""


def advisory_text(r: str, v: str, w: str, c: str) -> str:
    parts = (f"concat_ws(' | ', CASE WHEN {r} > 20 THEN {q(dims.ADV_HEAVY_RAIN)} WHEN {r} > 5 THEN {q(dims.ADV_MODERATE_RAIN)} END, "
             f"CASE WHEN {v} < 1 THEN {q(dims.ADV_VERY_LOW_VIS)} WHEN {v} < 3 THEN {q(dims.ADV_REDUCED_VIS)} END, "
             f"CASE WHEN {w} > 30 THEN {q(dims.ADV_WIND)} END, "
             f"CASE WHEN {c} = 'Thunderstorm' THEN {q(dims.ADV_THUNDER)} END)")
    return f"(CASE WHEN {parts} = '' THEN {q(dims.ADV_NORMAL)} ELSE {parts} END)"


def advisory_severity(r: str, v: str, w: str, c: str) -> str:
    return (f"(CASE WHEN {r} > 20 OR {v} < 1 OR {c} = 'Thunderstorm' THEN 'DANGER' "
            f"WHEN {r} > 5 OR {v} < 3 OR {w} > 30 THEN 'WARN' ELSE 'OK' END)")


def driver_alert_list(r: str, v: str, f: str, cg: str, j: str, h: str) -> list[str]:
    return [f"CASE WHEN {r} > 15 THEN {q(dims.ALERT_HEAVY_RAIN)} END",
            f"CASE WHEN {v} < 2 THEN {q(dims.ALERT_LOW_VIS)} END",
            f"CASE WHEN {f} <> 0 THEN {q(dims.ALERT_FLOOD)} END",
            f"CASE WHEN {cg} > 80 THEN {q(dims.ALERT_CONGESTION)} END",
            f"CASE WHEN {j} <> 0 THEN {q(dims.ALERT_JUNCTION)} END",
            f"CASE WHEN {h} BETWEEN 17 AND 20 THEN {q(dims.ALERT_PEAK)} END"]


oracle("weather_parsed", with_ctes(WEATHER_OBS, WEATHER_PARSED) + """
SELECT obs_id, is_valid, temp, humidity, main, rain_1h, wind_speed, visibility FROM wv""")

oracle("weather_normalized", with_ctes(WEATHER_OBS, WEATHER_NORM) + """
SELECT obs_id, temperature_c, feels_like_c, humidity_pct, wind_speed_kmh, wind_gust_kmh, visibility_km, rainfall_mm,
       weather_condition, weather_desc, pressure_hpa FROM wn""")

oracle("weather_advisory", with_ctes(WEATHER_OBS, WEATHER_NORM) + f"""
SELECT obs_id, {advisory_text("rainfall_mm", "visibility_km", "wind_speed_kmh", "weather_condition")} AS alerts,
       {advisory_severity("rainfall_mm", "visibility_km", "wind_speed_kmh", "weather_condition")} AS severity FROM wn""")


def weather_asof_sql(ttl: int) -> str:
    fb = dims.WEATHER_FALLBACK
    return with_ctes(PROBES, WEATHER_OBS, WEATHER_NORM, f"""pc AS (
  SELECT *, CAST(floor(lat * 100 + 0.5) AS BIGINT) AS cell_lat, CAST(floor(lng * 100 + 0.5) AS BIGINT) AS cell_lng FROM probes),
best AS (
  SELECT p.probe_id, o.* EXCLUDE (lat, lng, cell_lat, cell_lng)
  FROM pc p JOIN wn o ON o.cell_lat = p.cell_lat AND o.cell_lng = p.cell_lng AND o.obs_ts <= p.ts
       AND epoch_us(p.ts) - epoch_us(o.obs_ts) < {ttl * 1_000_000}
  QUALIFY row_number() OVER (PARTITION BY p.probe_id ORDER BY o.obs_ts DESC, o.obs_id DESC) = 1),
wa AS (
  SELECT p.*, b.obs_id,
    COALESCE(b.temperature_c, {fb['temperature_c']}) AS temperature_c, COALESCE(b.humidity_pct, {fb['humidity_pct']}) AS humidity_pct,
    COALESCE(b.wind_speed_kmh, {fb['wind_speed_kmh']}) AS wind_speed_kmh, COALESCE(b.visibility_km, {fb['visibility_km']}) AS visibility_km,
    COALESCE(b.rainfall_mm, {fb['rainfall_mm']}) AS rainfall_mm, COALESCE(b.weather_condition, {q(fb['weather_condition'])}) AS weather_condition
  FROM probes p LEFT JOIN best b USING (probe_id))""")


oracle("weather_asof", weather_asof_sql(dims.WEATHER_TTL_S) + """
SELECT probe_id, obs_id, temperature_c, humidity_pct, wind_speed_kmh, visibility_km, rainfall_mm, weather_condition FROM wa""")
oracle("weather_asof_day", weather_asof_sql(86400) + """
SELECT probe_id, obs_id, temperature_c, humidity_pct, wind_speed_kmh, visibility_km, rainfall_mm, weather_condition FROM wa""")

# ---- routes ---------------------------------------------------------------------

ROUTE_TABLE = """rtab AS (
  SELECT *, concat(destination, ' — ', CASE route_type WHEN 'fastest' THEN 'Fastest Route' WHEN 'shortest' THEN 'Shortest Route'
                                        WHEN 'eco' THEN 'Eco Route' ELSE 'Route' END) AS summary,
    round_even(CAST(length_m AS DOUBLE) / 100, 0) / 10 AS distance_km,
    CAST(round_even(CAST(COALESCE(no_traffic_s, travel_s) AS DOUBLE) / 60, 0) AS INTEGER) AS duration_min,
    CAST(round_even(CAST(travel_s AS DOUBLE) / 60, 0) AS INTEGER) AS duration_traffic_min,
    CAST(round_even(CAST(COALESCE(delay_s, 0) AS DOUBLE) / 60, 0) AS INTEGER) AS delay_min
  FROM route_options),
rm AS (
  SELECT *, CASE WHEN duration_min > 0 THEN least(100, CAST(trunc(delay_min / greatest(duration_min, 1) * 200) AS INTEGER))
                 ELSE 0 END AS congestion_pct FROM rtab),
rmt AS (
  SELECT *, CASE WHEN congestion_pct > 60 THEN 'HEAVY' WHEN congestion_pct > 30 THEN 'MODERATE' ELSE 'CLEAR' END AS traffic_status
  FROM rm)"""

oracle("route_metrics", with_ctes(ROUTE_OPTIONS, ROUTE_TABLE) + """
SELECT trip_id, config_ord, summary, distance_km, duration_min, duration_traffic_min, delay_min, congestion_pct, traffic_status
FROM rmt""")
oracle("rank_routes", with_ctes(ROUTE_OPTIONS, ROUTE_TABLE) + """
SELECT trip_id, config_ord, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY duration_traffic_min, config_ord) AS INTEGER) AS rank,
       row_number() OVER (PARTITION BY trip_id ORDER BY duration_traffic_min, config_ord) = 1 AS is_recommended FROM rmt""")
oracle("recommended_route", with_ctes(ROUTE_OPTIONS, ROUTE_TABLE) + """
SELECT trip_id, arg_min(route_type, duration_traffic_min * 10 + config_ord) AS route_type,
       arg_min(summary, duration_traffic_min * 10 + config_ord) AS summary,
       min(duration_traffic_min) AS duration_traffic_min,
       arg_min(distance_km, duration_traffic_min * 10 + config_ord) AS distance_km,
       arg_min(congestion_pct, duration_traffic_min * 10 + config_ord) AS congestion_pct,
       count(*) AS n_options
FROM rmt GROUP BY trip_id""")
oracle("routes_parsed", with_ctes(ROUTE_OPTIONS) + """
SELECT trip_id, config_ord, length_m, travel_s, delay_s, no_traffic_s, 2 AS n_points,
       CAST(trip_id % 100 AS DOUBLE) / 1000 + CAST(80.0 AS DOUBLE) AS first_lng
FROM route_options WHERE trip_id % 25 <> 0""")
oracle("route_coordinates", with_ctes(ROUTE_OPTIONS) + """
SELECT trip_id, config_ord, point_ord,
       CASE point_ord WHEN 0 THEN CAST(trip_id % 100 AS DOUBLE) / 1000 + CAST(80.0 AS DOUBLE) ELSE CAST(80.2 AS DOUBLE) END AS lng,
       CASE point_ord WHEN 0 THEN CAST(13.0 AS DOUBLE) ELSE CAST(config_ord AS DOUBLE) / 100 + CAST(13.0 AS DOUBLE) END AS lat
FROM route_options CROSS JOIN (VALUES (0), (1)) AS t(point_ord) WHERE trip_id % 25 <> 0""")
oracle("parse_origin", with_ctes(PROBES) + """
SELECT probe_id, CASE WHEN probe_id % 3 = 0 THEN NULL ELSE lat END AS origin_lat,
       CASE WHEN probe_id % 3 = 0 THEN NULL ELSE lng END AS origin_lng FROM probes""")
oracle("route_keys", with_ctes(ROUTE_REQUESTS) + """
SELECT request_id, CASE WHEN destination IS NOT NULL THEN md5(concat_ws(chr(1), origin, destination)) END AS route_key
FROM route_requests""")


def routes_asof_sql(ttl: int) -> str:
    return with_ctes(ROUTE_OPTIONS, ROUTE_REQUESTS) + f"""
, sets AS (SELECT DISTINCT trip_id, origin, destination, obs_ts FROM route_options),
best AS (
  SELECT r.request_id, s.trip_id FROM route_requests r JOIN sets s
    ON r.destination IS NOT NULL AND s.origin = r.origin AND s.destination = r.destination AND s.obs_ts <= r.ts
       AND epoch_us(r.ts) - epoch_us(s.obs_ts) < {ttl * 1_000_000}
  QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY s.obs_ts DESC, s.trip_id DESC) = 1)
SELECT r.request_id, b.trip_id AS matched_trip_id FROM route_requests r LEFT JOIN best b USING (request_id)"""


oracle("routes_asof", routes_asof_sql(dims.ROUTE_TTL_S))
oracle("routes_asof_day", routes_asof_sql(86400))

# ---- geo --------------------------------------------------------------------------

NEAREST = """nz AS (
  SELECT p.*, z.zone_ord, z.zone_name, z.base_risk
  FROM probes p CROSS JOIN zones_serving z
  QUALIFY row_number() OVER (PARTITION BY p.probe_id
          ORDER BY sqrt((p.lat - z.lat) * (p.lat - z.lat) + (p.lng - z.lng) * (p.lng - z.lng)), z.zone_ord) = 1)"""

oracle("nearest_zone", with_ctes(PROBES, zones_serving_cte(), NEAREST) + "SELECT probe_id, zone_name, base_risk FROM nz")

HISTORY_BASE = """hb AS (
  SELECT * FROM records WHERE accident = 1
  QUALIFY row_number() OVER (PARTITION BY headline ORDER BY article_id) = 1),
hbase AS (SELECT * FROM hb WHERE length(headline) > 10)"""

oracle("history_base", records_prefix() + ", " + HISTORY_BASE + """
SELECT article_id, headline, date, location_name FROM hbase""")

oracle("history_near", with_ctes(zones_train_cte(), ARTICLES, records_ctes(), HISTORY_BASE, PROBES) + """
, pairs AS (
  SELECT p.probe_id, h.*,
    abs(h.latitude - p.lat) < CAST(0.05 AS DOUBLE) AND abs(h.longitude - p.lng) < CAST(0.05 AS DOUBLE) AS in_r
  FROM probes p JOIN hbase h
    ON abs(h.latitude - p.lat) < CAST(0.05 AS DOUBLE) * 3 AND abs(h.longitude - p.lng) < CAST(0.05 AS DOUBLE) * 3),
cnt AS (SELECT probe_id, sum(CASE WHEN in_r THEN 1 ELSE 0 END) AS hits_r FROM pairs GROUP BY probe_id),
kept AS (SELECT pairs.* FROM pairs JOIN cnt USING (probe_id) WHERE in_r OR hits_r < 3),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY date DESC, article_id) AS INTEGER) AS rank,
         count(*) OVER (PARTITION BY probe_id) AS matched FROM kept)
SELECT probe_id, rank, date, location_name AS location, zone, substr(headline, 1, 100) AS headline, severity,
       publisher, source_url, vehicle_type AS vehicle, CAST(least(matched, 10) AS BIGINT) AS total, matched
FROM ranked WHERE rank <= 10
UNION ALL SELECT probe_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0
FROM probes WHERE probe_id NOT IN (SELECT probe_id FROM kept)""")

oracle("geocode", records_prefix() + ", " + zones_serving_cte() + """
SELECT r.article_id, r.location_name, z.lat AS geo_lat, z.lng AS geo_lng
FROM records r LEFT JOIN zones_serving z ON lower(trim(r.location_name)) = lower(z.zone_name)""")

TOP = "top AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(n)}, {dims.sql_double(la)}, {dims.sql_double(ln)}, {r})" for i, (n, la, ln, r) in enumerate(dims.TOP_ZONES)
) + ") AS t(top_ord, name, lat, lng, risk))"

oracle("top_zone_incidents", records_prefix() + ", " + TOP + """
SELECT t.top_ord, t.name, t.lat, t.lng, t.risk, CAST(count(r.article_id) AS BIGINT) AS real_incidents
FROM top t LEFT JOIN records r
  ON r.accident = 1 AND contains(lower(r.location_name), lower(split_part(t.name, ' ', 1)))
GROUP BY t.top_ord, t.name, t.lat, t.lng, t.risk""")

# ---- alert and request rules ------------------------------------------------------

def list_of(exprs: list[str]) -> str:
    return "list_filter([" + ", ".join(exprs) + "], lambda x: x IS NOT NULL)"


def advisory_list(r: str, v: str, w: str, c: str) -> str:
    base = list_of([f"CASE WHEN {r} > 20 THEN {q(dims.ADV_HEAVY_RAIN)} WHEN {r} > 5 THEN {q(dims.ADV_MODERATE_RAIN)} END",
                    f"CASE WHEN {v} < 1 THEN {q(dims.ADV_VERY_LOW_VIS)} WHEN {v} < 3 THEN {q(dims.ADV_REDUCED_VIS)} END",
                    f"CASE WHEN {w} > 30 THEN {q(dims.ADV_WIND)} END",
                    f"CASE WHEN {c} = 'Thunderstorm' THEN {q(dims.ADV_THUNDER)} END"])
    return f"(CASE WHEN len({base}) = 0 THEN [{q(dims.ADV_NORMAL)}] ELSE {base} END)"


def prefix_dedupe(lst: str, n: int = 30) -> str:
    return (f"list_filter({lst}, lambda x, i: NOT list_contains("
            f"list_transform(({lst})[1:i-1], lambda y: left(y, {n})), left(x, {n})))")


REQUESTS = """req0 AS (
  SELECT probe_id, ts, lat AS latitude, lng AS longitude,
    CASE WHEN probe_id % 5 = 0 THEN NULL ELSE CAST(probe_id % 24 AS INTEGER) END AS hour,
    CASE WHEN probe_id % 3 = 0 THEN NULL ELSE ['Clear', 'Fog', 'Thunderstorm', 'Heavy Rain', 'Haze'][probe_id % 5 + 1] END AS weather_condition,
    CASE WHEN probe_id % 4 = 0 THEN 'Afternoon' WHEN probe_id % 4 = 1 THEN NULL ELSE 'Night' END AS time_period,
    CASE WHEN probe_id % 6 = 0 THEN NULL ELSE ['Urban', 'Expressway', 'Highway', 'Commercial', 'Flyover'][probe_id % 5 + 1] END AS road_type,
    CAST(probe_id % 30 AS DOUBLE) AS rainfall_mm, (probe_id % 7) / 2.0 AS visibility_km,
    CAST(probe_id % 101 AS DOUBLE) AS congestion_pct, CAST(probe_id % 2 AS INTEGER) AS is_junction,
    CASE WHEN probe_id % 9 = 0 THEN NULL ELSE CAST(probe_id % 3 = 0 AS INTEGER) END AS flood_risk
  FROM probes),
req1 AS (
  SELECT probe_id, COALESCE(hour, CAST(hour(ts) AS INTEGER)) AS hour, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
    CAST(30.0 AS DOUBLE) AS temperature_c, CAST(70.0 AS DOUBLE) AS humidity_pct, CAST(15.0 AS DOUBLE) AS wind_speed_kmh,
    CAST(visibility_km AS DOUBLE) AS visibility_km, rainfall_mm, congestion_pct, CAST(30.0 AS DOUBLE) AS speed_kmh,
    is_junction, 0 AS is_school_zone, COALESCE(flood_risk, 0) AS flood_risk,
    COALESCE(weather_condition, 'Clear') AS weather_condition, COALESCE(road_type, 'Urban') AS road_type,
    COALESCE(time_period, 'Afternoon') AS tp0 FROM req0),
requests AS (
  SELECT * EXCLUDE (tp0), CASE WHEN tp0 = 'Afternoon' THEN """ + hour_period("hour") + """ ELSE tp0 END AS time_period FROM req1)"""


def serving_codes(col: str, mapping: dict, default: int) -> str:
    return "(CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END)"


oracle("complete_requests", with_ctes(PROBES, REQUESTS) + """
SELECT probe_id, hour, is_weekend, temperature_c, humidity_pct, wind_speed_kmh, visibility_km, rainfall_mm, congestion_pct,
       speed_kmh, is_junction, is_school_zone, flood_risk, weather_condition, road_type, time_period FROM requests""")
oracle("encode_serving", with_ctes(PROBES, REQUESTS) + f"""
SELECT probe_id, {serving_codes("weather_condition", dims.SERVE_WEATHER_CODES, 0)} AS weather_enc,
       {serving_codes("road_type", dims.SERVE_ROAD_CODES, 2)} AS road_enc,
       {serving_codes("time_period", dims.SERVE_TIME_CODES, 0)} AS time_enc FROM requests""")
oracle("driver_alerts", with_ctes(PROBES, REQUESTS) + f"""
SELECT probe_id, concat_ws(' | ', {", ".join(driver_alert_list("rainfall_mm", "visibility_km", "flood_risk", "congestion_pct", "is_junction", "hour"))}) AS alerts
FROM requests""")

PROB = "CAST(probe_id * 7919 % 10007 AS DOUBLE) / 10007"

oracle("risk_levels", with_ctes(PROBES) + f"""
SELECT probe_id, round({PROB}, 4) AS accident_probability, CAST({PROB} >= 0.45 AS INTEGER) AS accident_predicted,
       round({PROB} * 100, 1) AS risk_score,
       CASE WHEN {PROB} > 0.75 THEN 'CRITICAL' WHEN {PROB} > 0.55 THEN 'HIGH' WHEN {PROB} > 0.35 THEN 'MODERATE' ELSE 'LOW' END AS risk_level
FROM probes""")

_OBS_PROB = "CAST(obs_id * 7919 % 10007 AS DOUBLE) / 10007"
oracle("alert_severity", with_ctes(WEATHER_OBS, WEATHER_NORM) + f"""
, s AS (SELECT obs_id, {advisory_severity("rainfall_mm", "visibility_km", "wind_speed_kmh", "weather_condition")} AS advisory_severity,
       CASE WHEN {_OBS_PROB} > 0.75 THEN 'CRITICAL' WHEN {_OBS_PROB} > 0.55 THEN 'HIGH' WHEN {_OBS_PROB} > 0.35 THEN 'MODERATE' ELSE 'LOW' END AS risk_level
  FROM wn)
SELECT *, CASE WHEN risk_level IN ('CRITICAL', 'HIGH') AND advisory_severity <> 'DANGER' THEN 'WARN' ELSE advisory_severity END AS severity FROM s""")

_MERGED = ("list_concat(" + advisory_list("rainfall_mm", "visibility_km", "wind_speed_kmh", "weather_condition") + ", "
           + list_of(driver_alert_list("rainfall_mm", "visibility_km", "CAST(rainfall_mm > 10 AS INTEGER)",
                                       "CAST(obs_id % 100 AS DOUBLE)", "obs_id % 2", "hour(obs_ts)")) + ")")
oracle("merge_alerts", with_ctes(WEATHER_OBS, WEATHER_NORM) + f"""
SELECT obs_id, array_to_string({prefix_dedupe(_MERGED)}, ' | ') AS alerts FROM wn""")

_FULL_MERGED = ("list_concat(" + advisory_list("rainfall_mm", "visibility_km", "wind_speed_kmh", "weather_condition") + ", "
                + list_of(driver_alert_list("rainfall_mm", "visibility_km", "CAST(rainfall_mm > 10 AS INTEGER)",
                                            "CAST(base_risk AS DOUBLE)", "0", "hour(ts)")) + ")")
_FULL_ALERTS = f"array_to_string({prefix_dedupe(_FULL_MERGED)}, ' | ') AS alerts"
_FULL_SEVERITY = advisory_severity("rainfall_mm", "visibility_km", "wind_speed_kmh", "weather_condition")


def full_alerts_sql(ttl: int) -> str:
    return weather_asof_sql(ttl) + ", " + zones_serving_cte() + """,
nz AS (
  SELECT p.probe_id, z.zone_name, z.base_risk
  FROM probes p CROSS JOIN zones_serving z
  QUALIFY row_number() OVER (PARTITION BY p.probe_id
          ORDER BY sqrt((p.lat - z.lat) * (p.lat - z.lat) + (p.lng - z.lng) * (p.lng - z.lng)), z.zone_ord) = 1),
fa AS (SELECT wa.*, nz.zone_name, nz.base_risk FROM wa JOIN nz USING (probe_id))
"""


oracle("full_alerts_rules", full_alerts_sql(86400) + f"""
SELECT probe_id, zone_name, obs_id, rainfall_mm, visibility_km, weather_condition, {_FULL_ALERTS}, {_FULL_SEVERITY} AS severity
FROM fa""")
oracle("full_alerts_checked", full_alerts_sql(dims.WEATHER_TTL_S) + f"""
SELECT probe_id, zone_name, obs_id, {_FULL_ALERTS}, {_FULL_SEVERITY} AS advisory_severity, TRUE AS severity_agrees FROM fa""")
_ALERT_ROUTES = full_alerts_sql(dims.WEATHER_TTL_S) + f""", {ROUTE_OPTIONS}, {ROUTE_REQUESTS}, {ROUTE_TABLE},
trips AS (
  SELECT r.request_id, o.trip_id FROM route_requests r JOIN route_options o
    ON o.origin = r.origin AND o.destination = r.destination AND o.obs_ts <= r.ts
       AND epoch_us(r.ts) - epoch_us(o.obs_ts) < {dims.ROUTE_TTL_S * 1_000_000}
  QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY o.obs_ts DESC, o.trip_id DESC) = 1),
chosen AS (
  SELECT trip_id, route_type, summary, duration_traffic_min, congestion_pct FROM rmt
  QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY duration_traffic_min, config_ord) = 1)
"""
_ROUTE_JOINS = " FROM fa LEFT JOIN trips ON trips.request_id = fa.probe_id LEFT JOIN chosen ON chosen.trip_id = trips.trip_id"
oracle("full_alerts_routes", _ALERT_ROUTES + f"""
SELECT fa.probe_id, zone_name, obs_id, temperature_c, humidity_pct, wind_speed_kmh, visibility_km, rainfall_mm,
       weather_condition, {_FULL_ALERTS}, {_FULL_SEVERITY} AS severity, trips.trip_id, route_type,
       summary AS route_summary, duration_traffic_min AS route_min, chosen.congestion_pct AS route_congestion_pct
""" + _ROUTE_JOINS)
oracle("full_alerts_whole_checked", _ALERT_ROUTES + f"""
SELECT fa.probe_id, zone_name, obs_id, {_FULL_ALERTS}, {_FULL_SEVERITY} AS advisory_severity, trips.trip_id, route_type,
       summary AS route_summary, duration_traffic_min AS route_min, chosen.congestion_pct AS route_congestion_pct,
       TRUE AS severity_agrees
""" + _ROUTE_JOINS)

# ---- dataset (records + generated negatives) -------------------------------------

ACC_COLS = ("source_url, publisher, headline, keyword, date, hour, day_of_week, is_weekend, is_peak_hour, month, "
            "is_monsoon, time_period, location_name, zone, latitude, longitude, road_type, severity, vehicle_type, "
            "num_vehicles, num_injured, num_fatalities, is_junction, is_school_zone, flood_risk, congestion_pct, "
            "speed_kmh, weather_condition, temperature_c, humidity_pct, wind_speed_kmh, visibility_km, rainfall_mm, accident")


def dbl_div(expr: str, d: int) -> str:
    return f"CAST({expr} AS DOUBLE) / {d}"


def negatives_cte(as_of: str = AS_OF) -> str:
    k = "key"
    return f"""neg0 AS (SELECT concat_ws('-', CAST(article_id AS VARCHAR), '1') AS key FROM records),
neg1 AS (
  SELECT key, {draw(k, "zone", len(dims.ZONES_TRAIN))} AS zone_ord,
    CAST({pick(dims.NEG_ZONE_HOURS, draw(k, "hour", len(dims.NEG_ZONE_HOURS)))} AS INTEGER) AS hour,
    CAST(DATE '{as_of}' - (1 + {draw(k, "days", dims.NEG_ZONE_MAX_DAYS)}) AS DATE) AS d FROM neg0),
neg2 AS (
  SELECT n.*, z.location_name, z.zone, z.lat AS latitude, z.lng AS longitude, z.road_type,
    CAST(greatest(5, {congestion("n.hour", "z.zone")} - (10 + {draw(k, "cong", 21)})) AS INTEGER) AS congestion_pct
  FROM neg1 n JOIN zones_train z USING (zone_ord)),
negatives AS (
  SELECT concat('neg-', key) AS record_id, 'generated-negative' AS source_url, 'generated' AS publisher, '' AS headline,
    '' AS keyword, strftime(d, '%Y-%m-%d') AS date, hour, dayname(d) AS day_of_week,
    CAST(isodow(d) >= 6 AS INTEGER) AS is_weekend, 0 AS is_peak_hour, CAST(month(d) AS INTEGER) AS month,
    CAST(month(d) BETWEEN 6 AND 11 AS INTEGER) AS is_monsoon, {hour_period("hour")} AS time_period,
    location_name, zone, latitude, longitude, road_type, 'None' AS severity, 'None' AS vehicle_type,
    0 AS num_vehicles, 0 AS num_injured, 0 AS num_fatalities,
    {draw(k, "junction", 2)} AS is_junction, {draw(k, "school", 2)} AS is_school_zone, 0 AS flood_risk, congestion_pct,
    CAST(least(80, 60 - congestion_pct // 3 + {draw(k, "speed", 21)}) AS INTEGER) AS speed_kmh,
    {pick(dims.NEG_ZONE_WEATHER, draw(k, "weather", len(dims.NEG_ZONE_WEATHER)))} AS weather_condition,
    {dbl_div("280 + " + draw(k, "temp", 81), 10)} AS temperature_c,
    {dbl_div("550 + " + draw(k, "hum", 251), 10)} AS humidity_pct,
    {dbl_div("50 + " + draw(k, "wind", 151), 10)} AS wind_speed_kmh,
    {dbl_div("60 + " + draw(k, "vis", 91), 10)} AS visibility_km,
    CAST(0.0 AS DOUBLE) AS rainfall_mm, 0 AS accident
  FROM neg2),
dataset AS (
  SELECT concat('pos-', CAST(article_id AS VARCHAR)) AS record_id, {ACC_COLS} FROM records
  UNION ALL SELECT record_id, {ACC_COLS} FROM negatives)"""


def dataset_prefix() -> str:
    return with_ctes(zones_train_cte(), ARTICLES, records_ctes(), negatives_cte())


def training_codes() -> str:
    w = "(CASE " + " ".join(f"WHEN weather_condition = {q(a)} THEN {b}" for a, b in dims.TRAIN_WEATHER_CODES.items()) + " ELSE 0 END)"
    r = "(CASE " + " ".join(f"WHEN road_type = {q(a)} THEN {b}" for a, b in dims.TRAIN_ROAD_CODES.items()) + " ELSE 2 END)"
    t = "(CASE " + " ".join(f"WHEN time_period = {q(a)} THEN {b}" for a, b in dims.TRAIN_TIME_CODES.items()) + " ELSE 2 END)"
    return f"{w} AS weather_enc, {r} AS road_enc, {t} AS time_enc"


ENCODED = f"enc AS (SELECT *, {training_codes()} FROM dataset)"

oracle("dashboard_totals", records_prefix() + """
SELECT count(*) AS total_records, count(*) > 0 AS real_data FROM records WHERE accident = 1""")
oracle("year_breakdown", records_prefix() + """
SELECT CAST(year(TRY_STRPTIME(date, '%Y-%m-%d')) AS INTEGER) AS year, count(*) AS records FROM records
WHERE accident = 1 AND TRY_STRPTIME(date, '%Y-%m-%d') IS NOT NULL GROUP BY 1""")
oracle("top_publishers", records_prefix() + """
SELECT publisher, count(*) AS records FROM records WHERE accident = 1 GROUP BY publisher
ORDER BY records DESC, publisher LIMIT 10""")
oracle("dataset_totals", dataset_prefix() + """
SELECT count(*) AS total_records, CAST(sum(accident) AS BIGINT) AS accident_rows, CAST(sum(1 - accident) AS BIGINT) AS negative_rows
FROM dataset""")
oracle("source_month_counts", records_prefix() + """
SELECT source_rank, substr(date, 1, 7) AS month, count(*) AS records FROM records GROUP BY ROLLUP (source_rank, substr(date, 1, 7))""")
oracle("recent_accidents", records_prefix() + f"""
, top AS (SELECT * FROM records WHERE accident = 1 ORDER BY date DESC, article_id LIMIT 10)
SELECT article_id,
  CASE WHEN TRY_STRPTIME(substr(date, 1, 10), '%Y-%m-%d') IS NULL THEN 'Recent'
       WHEN DATE '{AS_OF}' - CAST(TRY_STRPTIME(substr(date, 1, 10), '%Y-%m-%d') AS DATE) > 0
       THEN concat(CAST(DATE '{AS_OF}' - CAST(TRY_STRPTIME(substr(date, 1, 10), '%Y-%m-%d') AS DATE) AS VARCHAR), 'd ago')
       ELSE 'Today' END AS time,
  location_name AS location, zone, substr(headline, 1, 60) AS detail,
  CASE WHEN severity = 'Fatal' THEN '#ff2d55' WHEN severity = 'Major' THEN '#ff6b35' ELSE '#ffcc00' END AS severity,
  source_url AS source
FROM top""")
oracle("union_sources", with_ctes(zones_train_cte(), ARTICLES) + """
SELECT article_id, source_rank, CASE WHEN source_rank = 0 THEN 'feed' ELSE 'site' END AS source_kind FROM articles""")
oracle("training_union", dataset_prefix() + """
SELECT record_id, accident, location_name, date, hour, congestion_pct FROM dataset""")
oracle("negatives_zones", dataset_prefix() + "SELECT * FROM negatives")


def mutate_sql(copies: int) -> str:
    k = "key"
    keys = " UNION ALL ".join(
        f"SELECT r.*, concat_ws('-', CAST(article_id AS VARCHAR), '{c}') AS key FROM records r" for c in range(1, copies + 1))
    hour = f"CAST({pick(dims.NEG_MUTATE_HOURS, draw(k, 'hour', len(dims.NEG_MUTATE_HOURS)))} AS INTEGER)"
    if copies == 1:
        cong, speed = f"CAST(10 + {draw(k, 'cong', 41)} AS INTEGER)", "CAST(least(80, speed_kmh + 20) AS INTEGER)"
        vis, rain, junc = "visibility_km", "rainfall_mm", "is_junction"
    else:
        cong, speed = f"CAST(10 + {draw(k, 'cong', 46)} AS INTEGER)", f"CAST(30 + {draw(k, 'speed', 51)} AS INTEGER)"
        vis = f"CAST(6.0 AS DOUBLE) + CAST({draw(k, 'vis', 900001)} AS DOUBLE) / 100000"
        rain, junc = "CAST(0.0 AS DOUBLE)", f"{draw(k, 'junction', 2)}"
    return records_prefix() + f""", m AS ({keys})
SELECT concat('neg-', key) AS record_id, 'generated-negative' AS source_url, publisher, '' AS headline, keyword, date,
  {hour} AS hour, day_of_week, is_weekend, 0 AS is_peak_hour, month, is_monsoon, time_period, location_name, zone,
  latitude, longitude, road_type, severity, vehicle_type, num_vehicles, num_injured, num_fatalities, {junc} AS is_junction,
  is_school_zone, flood_risk, {cong} AS congestion_pct, {speed} AS speed_kmh, weather_condition, temperature_c,
  humidity_pct, wind_speed_kmh, {vis} AS visibility_km, {rain} AS rainfall_mm, 0 AS accident
FROM m"""


oracle("negatives_1x", mutate_sql(1))
oracle("negatives_3x", mutate_sql(3))
oracle("seeded_shuffle", dataset_prefix() + "SELECT record_id, md5(concat_ws('|', record_id, '42')) AS shuffle_key FROM dataset")
oracle("encode_training", dataset_prefix() + f", {ENCODED} SELECT record_id, weather_enc, road_enc, time_enc FROM enc")
oracle("feature_matrix", dataset_prefix() + f", {ENCODED} SELECT record_id, {', '.join(dims.FEATURES)}, accident FROM enc")
oracle("stratified_split", dataset_prefix() + """
, u AS (SELECT record_id, accident, ('0x' || substr(md5(concat_ws('|', record_id, '42')), 1, 8))::BIGINT AS u FROM dataset),
r AS (SELECT *, row_number() OVER (PARTITION BY accident ORDER BY u, record_id) AS rn,
             count(*) OVER (PARTITION BY accident) AS nc FROM u)
SELECT record_id, accident, CASE WHEN rn <= round(nc * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
oracle("class_weights", dataset_prefix() + """
, c AS (SELECT accident, count(*) AS nc FROM dataset GROUP BY accident)
SELECT accident, CAST((SELECT sum(nc) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * nc) AS class_weight, nc AS n FROM c""")
oracle("feature_stats", dataset_prefix() + f", {ENCODED} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg(CAST({f} AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST({f} AS DOUBLE)), 6) AS std FROM enc"
    for f in dims.FEATURES))

SCORED = "sc AS (SELECT *, CAST(congestion_pct AS DOUBLE) / 100 AS score FROM dataset)"
oracle("roc_auc", dataset_prefix() + f", {SCORED}" + """
, r AS (SELECT accident, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS avg_rank FROM sc),
n AS (SELECT sum(CASE WHEN accident = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN accident = 1 THEN 0 ELSE 1 END) AS n0,
             sum(CASE WHEN accident = 1 THEN avg_rank ELSE 0 END) AS s1 FROM r)
SELECT round((s1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 9) AS auc, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg FROM n""")
oracle("accuracy", dataset_prefix() + f", {SCORED}" + """
SELECT round(avg(CAST(CAST(score > 0.5 AS INTEGER) = accident AS DOUBLE)), 9) AS accuracy, count(*) AS n FROM sc""")
oracle("class_report", dataset_prefix() + f", {SCORED}" + """
, p AS (SELECT accident AS y, CAST(score > 0.5 AS INTEGER) AS p FROM sc),
c AS (SELECT cls AS class, sum(CASE WHEN y = cls AND p = cls THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN y <> cls AND p = cls THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN y = cls AND p <> cls THEN 1 ELSE 0 END) AS fn
      FROM p CROSS JOIN (VALUES (0), (1)) v(cls) GROUP BY cls),
m AS (SELECT class, tp, fn, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 9) AS f1,
       CAST(tp + fn AS BIGINT) AS support FROM m""")
oracle("leakage_report", dataset_prefix() + f", {ENCODED} " + " UNION ALL ".join(
    f"SELECT accident, '{f}' AS feature, min(CAST({f} AS DOUBLE)) AS min_value, max(CAST({f} AS DOUBLE)) AS max_value, "
    f"count(DISTINCT CAST({f} AS DOUBLE)) AS n_distinct, CAST(count(DISTINCT CAST({f} AS DOUBLE)) <= 1 AS INTEGER) AS constant_in_class "
    f"FROM enc GROUP BY accident" for f in dims.FEATURES))
oracle("batch_requests", with_ctes(zones_serving_cte()) + f"""
, h AS (SELECT DISTINCT date_trunc('hour', ts) AS board_ts FROM events)
SELECT strftime(board_ts, '%Y-%m-%d %H:%M') AS board_hour, zone_ord, zone_name, lat AS latitude, lng AS longitude,
       CAST(hour(board_ts) AS INTEGER) AS hour, CAST(isodow(board_ts) >= 6 AS INTEGER) AS is_weekend,
       CAST(base_risk AS DOUBLE) AS congestion_pct, {hour_period("CAST(hour(board_ts) AS INTEGER)")} AS time_period
FROM h CROSS JOIN zones_serving""")
_BOARD = with_ctes(zones_serving_cte()) + """
, h AS (SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS board_hour FROM events),
board AS (SELECT board_hour, zone_name, base_risk,
                 CAST(row_number() OVER (PARTITION BY board_hour ORDER BY base_risk DESC, zone_ord) AS INTEGER) AS board_rank
          FROM h CROSS JOIN zones_serving)"""
oracle("zone_board_base", _BOARD + """
SELECT board_hour, board_rank, zone_name, CAST(base_risk AS DOUBLE) / 100 AS accident_probability FROM board""")
oracle("zone_board_checked", _BOARD + "SELECT board_hour, board_rank, TRUE AS in_order FROM board")
oracle("score_requests_checked", with_ctes(PROBES, REQUESTS) + f"""
SELECT probe_id, concat_ws(' | ', {", ".join(driver_alert_list("rainfall_mm", "visibility_km", "flood_risk", "congestion_pct", "is_junction", "hour"))}) AS alerts,
       TRUE AS in_range, TRUE AS is_blend, TRUE AS level_agrees, TRUE AS prediction_agrees, TRUE AS score_agrees
FROM requests""")
HOLDOUT = """
, u AS (SELECT record_id, accident, ('0x' || substr(md5(concat_ws('|', record_id, '42')), 1, 8))::BIGINT AS u FROM dataset),
holdout AS (SELECT record_id, accident FROM u
            QUALIFY row_number() OVER (PARTITION BY accident ORDER BY u, record_id) <= round(count(*) OVER (PARTITION BY accident) * 0.2)),
sizes AS (SELECT count(*) FILTER (accident = 1) AS n_pos, count(*) FILTER (accident = 0) AS n_neg FROM holdout)
"""
oracle("score_ensemble_checked", dataset_prefix() + HOLDOUT + """
SELECT record_id, CAST(accident AS INTEGER) AS accident, TRUE AS in_range, TRUE AS is_blend, TRUE AS same_after_load FROM holdout""")
oracle("evaluate_checked", dataset_prefix() + HOLDOUT + """
SELECT n_pos, n_neg, TRUE AS gbt_auc_agrees, TRUE AS rf_auc_agrees, TRUE AS ensemble_auc_agrees, TRUE AS accuracy_in_range FROM sizes""")
oracle("model_meta_checked", dataset_prefix() + HOLDOUT + f"""
SELECT (SELECT count(*) FROM dataset) AS total_records, CAST((SELECT sum(accident) FROM dataset) AS BIGINT) AS accident_rows,
       n_pos, n_neg, {q(",".join(dims.FEATURES))} AS features FROM sizes""")
oracle("importances_checked", "SELECT feature, TRUE AS gbt_share, TRUE AS rf_share FROM (VALUES "
       + ", ".join(f"({q(f)})" for f in dims.FEATURES) + ") AS t(feature)")
_STR_COLS = {"source_url", "publisher", "headline", "keyword", "date", "day_of_week", "time_period", "location_name",
             "zone", "road_type", "severity", "vehicle_type", "weather_condition"}
oracle("scan_accidents", dataset_prefix() + "SELECT " + ", ".join(
    f"NULLIF({c}, '') AS {c}" if c in _STR_COLS else c for c in ACC_COLS.split(", ")) + " FROM dataset")
oracle("history_files", dataset_prefix() + """
, f AS (SELECT *, CASE WHEN hour % 2 = 0 THEN 0 ELSE 3 END AS file_rank FROM dataset WHERE accident = 1)
SELECT headline, date, location_name, source_url, file_rank FROM f WHERE length(headline) > 10
QUALIFY row_number() OVER (PARTITION BY headline ORDER BY file_rank, source_url) = 1""")
oracle("sink_roundtrip", dataset_prefix() + f"SELECT record_id, {ACC_COLS} FROM dataset")
KW = "kw AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(k)})" for i, k in enumerate(dims.RSS_KEYWORDS)) + ") AS t(keyword_ord, keyword))"
oracle("month_spine", with_ctes(zones_train_cte(), ARTICLES, KW) + """
, m AS (SELECT unnest(generate_series(date_trunc('month', min(published_ts)), date_trunc('month', max(published_ts)), INTERVAL 1 MONTH)) AS ms FROM articles)
SELECT strftime(ms, '%Y-%m-%d') AS month_start, strftime(ms + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_end, keyword_ord, keyword
FROM m CROSS JOIN kw""")
_ANCHOR = q(r"""(?is)<a\s(?:[^>]*\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a>""")
oracle("page_links", f"""
WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base,
                  regexp_extract_all(html, {_ANCHOR}, 1) AS hrefs, regexp_extract_all(html, {_ANCHOR}, 2) AS texts FROM pages),
u AS (SELECT page_id, base, trim(unnest(hrefs), '"''') AS href, unnest(texts) AS text, generate_subscripts(hrefs, 1) - 1 AS pos FROM a)
SELECT page_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(text, '<[^>]*>', '', 'g')) AS text,
       CASE WHEN starts_with(href, 'http') THEN href ELSE concat(base, href) END AS href FROM u""")
oracle("rss_items", with_ctes(zones_train_cte(), ARTICLES) + """
SELECT title, source_url AS link, COALESCE(summary, '') AS summary, strftime(published_ts, '%a, %d %b %Y %H:%M:%S GMT') AS published,
       strftime(published_ts, '%Y-%m-%d') AS date, CAST(hour(published_ts) AS INTEGER) AS hour
FROM articles WHERE source_rank = 0""")

# ---- streaming (final tables) ------------------------------------------------------

oracle("stream_dedupe", _cand_only() + "SELECT DISTINCT dedupe_key FROM cand WHERE is_relevant")
oracle("stream_latest", with_ctes(WEATHER_OBS, WEATHER_NORM) + """
SELECT cell_lat, cell_lng, obs_id, rainfall_mm, weather_condition,
       count(*) OVER (PARTITION BY cell_lat, cell_lng) AS n_obs,
       (SELECT epoch_us(max(obs_ts)) FROM wn) - epoch_us(obs_ts) >= 600 * 1000000 AS expired
FROM wn QUALIFY row_number() OVER (PARTITION BY cell_lat, cell_lng ORDER BY obs_ts DESC, obs_id DESC) = 1""")
oracle("stream_zone_board", with_ctes(WEATHER_OBS, WEATHER_NORM, zones_serving_cte()) + """
, z AS (
  SELECT w.*, s.zone_name FROM wn w CROSS JOIN zones_serving s
  QUALIFY row_number() OVER (PARTITION BY w.obs_id
          ORDER BY sqrt((w.lat - s.lat) * (w.lat - s.lat) + (w.lng - s.lng) * (w.lng - s.lng)), s.zone_ord) = 1)
SELECT strftime(time_bucket(INTERVAL '30 seconds', obs_ts), '%Y-%m-%d %H:%M:%S') AS window_start, zone_name,
       count(*) AS n_obs, round(avg(rainfall_mm), 9) AS avg_rainfall, max(rainfall_mm) AS max_rainfall,
       min(visibility_km) AS min_visibility
FROM z WHERE time_bucket(INTERVAL '30 seconds', obs_ts) + INTERVAL '30 seconds'
             <= (SELECT max(obs_ts) FROM wn) - INTERVAL '10 minutes'
GROUP BY 1, zone_name""")

oracle("stream_live", with_ctes(WEATHER_OBS, WEATHER_NORM) + """
SELECT cell_lat, cell_lng, obs_id, rainfall_mm, weather_condition FROM (
  SELECT * FROM wn QUALIFY row_number() OVER (PARTITION BY cell_lat, cell_lng ORDER BY obs_ts DESC, obs_id DESC) = 1) l
WHERE obs_ts > (SELECT max(obs_ts) FROM wn) - INTERVAL '86400 seconds'""")
oracle("stream_zone_board_all", with_ctes(WEATHER_OBS, WEATHER_NORM, zones_serving_cte()) + """
, z AS (
  SELECT w.*, s.zone_name FROM wn w CROSS JOIN zones_serving s
  QUALIFY row_number() OVER (PARTITION BY w.obs_id
          ORDER BY sqrt((w.lat - s.lat) * (w.lat - s.lat) + (w.lng - s.lng) * (w.lng - s.lng)), s.zone_ord) = 1)
SELECT strftime(time_bucket(INTERVAL '30 seconds', obs_ts), '%Y-%m-%d %H:%M:%S') AS window_start, zone_name,
       count(*) AS n_obs, round(avg(rainfall_mm), 9) AS avg_rainfall, max(rainfall_mm) AS max_rainfall,
       min(visibility_km) AS min_visibility,
       time_bucket(INTERVAL '30 seconds', obs_ts) + INTERVAL '30 seconds'
         > (SELECT max(obs_ts) FROM wn) - INTERVAL '10 minutes' AS is_open
FROM z GROUP BY time_bucket(INTERVAL '30 seconds', obs_ts), zone_name""")

# ---- accounts and the dashboard as one table ---------------------------------------

_FAULT = """fault AS (
  SELECT obs_id, payload, CASE WHEN payload IS NULL THEN 'no payload' WHEN NOT json_valid(payload) THEN 'not JSON'
    ELSE concat('without ', concat_ws(', ', CASE WHEN temp IS NULL THEN 'main.temp' END,
      CASE WHEN feels_like IS NULL THEN 'main.feels_like' END, CASE WHEN humidity IS NULL THEN 'main.humidity' END,
      CASE WHEN main IS NULL THEN 'weather.main' END, CASE WHEN description IS NULL THEN 'weather.description' END)) END AS fault
  FROM wv JOIN wp USING (obs_id) WHERE NOT is_valid)"""
oracle("weather_quarantine", with_ctes(WEATHER_OBS, WEATHER_PARSED, _FAULT) + "SELECT obs_id, payload, fault FROM fault")
oracle("weather_accounts", with_ctes(WEATHER_OBS, WEATHER_PARSED, _FAULT) + """
SELECT fault, count(*) AS n_rows, (SELECT count(*) FROM weather_obs) AS rows_in, TRUE AS adds_up
FROM wv LEFT JOIN fault USING (obs_id) GROUP BY fault""")
_RECENT = ORACLES["recent_accidents"].split(", top AS", 1)[1]
oracle("dashboard", records_prefix() + ", " + REGIONS + ", " + TOP.replace("top AS", "zt AS") + ", top AS" + _RECENT.replace(
    "SELECT article_id,", """, recent AS (SELECT article_id, CAST(row_number() OVER (ORDER BY date DESC, article_id) AS INTEGER) AS pos,""", 1) + """)
SELECT 'total' AS panel, 1 AS pos, 'accidents' AS name, count(*) AS value, CAST(NULL AS INTEGER) AS risk,
       CAST(NULL AS VARCHAR) AS age, CASE WHEN count(*) > 0 THEN 'data' ELSE 'no data' END AS detail, CAST(NULL AS VARCHAR) AS color
FROM records WHERE accident = 1
UNION ALL SELECT 'zone', region_ord + 1, zone, (SELECT count(*) FROM records r WHERE r.accident = 1 AND r.zone = g.zone), risk,
       NULL, NULL, NULL FROM regions g
UNION ALL SELECT 'prediction', top_ord + 1, name, (SELECT count(*) FROM records r WHERE r.accident = 1
       AND contains(lower(r.location_name), lower(split_part(z.name, ' ', 1)))), risk, NULL, NULL, NULL FROM zt z
UNION ALL SELECT 'recent', pos, location, article_id, NULL, time, detail, severity FROM recent""")

oracle("article_location_any", ORACLES["article_location"])
oracle("nearest_zone_any", ORACLES["nearest_zone"])

# ---- the dataset build: site items have no summary, undated links the base of their site ----
_SITES = ARTICLES.replace("articles AS (", "stored AS (", 1) + f""",
articles AS (SELECT article_id * 1048576 AS article_id, source_rank, published_ts, title,
  CASE WHEN source_rank = 0 THEN summary END AS summary, CASE WHEN source_rank = 0 THEN keyword END AS keyword,
  CASE WHEN source_rank = 0 OR contains(source_url, '/2023/') THEN source_url
       ELSE concat(CASE source_rank {" ".join(f"WHEN {r} THEN {q(b)}" for r, b in dims.SITE_BASES.items())} END,
                   replace(source_url, 'https://news.example.org', '')) END AS source_url FROM stored)"""
oracle("build_dataset", dataset_prefix().replace(ARTICLES, _SITES, 1) + f"SELECT record_id, {ACC_COLS} FROM dataset")

oracle("evaluate_paired_checked", records_prefix() + """
, n AS (SELECT count(*) AS n FROM records)
SELECT training, config, CAST(round(n * 0.2) AS BIGINT) AS n_pos, CAST(round(n * copies * 0.2) AS BIGINT) AS n_neg,
       TRUE AS beats_chance, TRUE AS accuracy_in_range
FROM n CROSS JOIN (VALUES ('builder', 'builder', 1), ('retrain_1x', 'retrain', 1), ('retrain_3x', 'retrain', 3)) AS t(training, config, copies)""")
