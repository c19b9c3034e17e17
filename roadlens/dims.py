"""Fixed values that must equal the reference application's for right results.

Everything here is data, stated plainly and in the reference's own order:
gazetteers, code maps, keyword and pattern lists, region tables.  Order is
part of the contract wherever "first match wins".  The helpers at the end
turn the lists into small broadcast DataFrames and literal Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference)
# ---------------------------------------------------------------------------

# Training gazetteer: lower-case place key, lat, lng, region, road type.
# Order matters: the first key contained in the text wins.
ZONES_TRAIN = [
    ("anna salai", 13.0637, 80.2565, "Central Chennai", "Arterial"),
    ("mount road", 13.0637, 80.2565, "Central Chennai", "Arterial"),
    ("kathipara", 13.0095, 80.2105, "Central Chennai", "Flyover"),
    ("omr", 12.9279, 80.2211, "South Chennai", "Expressway"),
    ("old mahabalipuram", 12.9279, 80.2211, "South Chennai", "Expressway"),
    ("gst road", 12.9716, 80.1999, "West Chennai", "Highway"),
    ("adyar", 13.0067, 80.2571, "South Chennai", "Urban"),
    ("koyambedu", 13.0694, 80.1948, "Central Chennai", "Urban"),
    ("velachery", 13.0068, 80.2209, "South Chennai", "Urban"),
    ("t nagar", 13.0418, 80.2341, "Central Chennai", "Commercial"),
    ("tambaram", 12.9229, 80.1275, "West Chennai", "Highway"),
    ("ambattur", 13.1143, 80.1548, "North Chennai", "Industrial"),
    ("porur", 13.0358, 80.1572, "West Chennai", "Urban"),
    ("pallavaram", 12.9675, 80.1499, "West Chennai", "Urban"),
    ("ecr", 12.9023, 80.2527, "East Chennai", "Coastal Highway"),
    ("east coast road", 12.9023, 80.2527, "East Chennai", "Coastal Highway"),
    ("poonamallee", 13.0458, 80.1533, "West Chennai", "Highway"),
    ("manali", 13.1666, 80.2573, "North Chennai", "Industrial"),
    ("perungudi", 12.9568, 80.2383, "South Chennai", "Urban"),
    ("sholinganallur", 12.9010, 80.2279, "South Chennai", "Urban"),
    ("chromepet", 12.9516, 80.1462, "West Chennai", "Urban"),
    ("guindy", 13.0067, 80.2206, "Central Chennai", "Urban"),
    ("nungambakkam", 13.0569, 80.2425, "Central Chennai", "Urban"),
    ("egmore", 13.0732, 80.2609, "Central Chennai", "Urban"),
    ("royapuram", 13.1109, 80.2918, "North Chennai", "Urban"),
    ("tondiarpet", 13.1163, 80.2876, "North Chennai", "Urban"),
    ("kodambakkam", 13.0519, 80.2247, "Central Chennai", "Urban"),
    ("vadapalani", 13.0505, 80.2124, "Central Chennai", "Urban"),
    ("ashok nagar", 13.0358, 80.2100, "Central Chennai", "Urban"),
    ("medavakkam", 12.9201, 80.1914, "South Chennai", "Urban"),
    ("perambur", 13.1178, 80.2478, "North Chennai", "Urban"),
    ("villivakkam", 13.1019, 80.2100, "North Chennai", "Urban"),
    ("avadi", 13.1147, 80.1009, "North Chennai", "Urban"),
    ("thiruvottiyur", 13.1618, 80.3037, "North Chennai", "Urban"),
    ("besant nagar", 13.0002, 80.2707, "South Chennai", "Coastal"),
    ("thiruvanmiyur", 12.9827, 80.2596, "South Chennai", "Urban"),
    ("mylapore", 13.0339, 80.2619, "Central Chennai", "Urban"),
    ("triplicane", 13.0561, 80.2784, "Central Chennai", "Urban"),
    ("broadway", 13.0878, 80.2863, "Central Chennai", "Urban"),
    ("saidapet", 13.0225, 80.2209, "Central Chennai", "Urban"),
    ("kilpauk", 13.0824, 80.2397, "Central Chennai", "Urban"),
    ("chetpet", 13.0715, 80.2418, "Central Chennai", "Urban"),
    ("arumbakkam", 13.0638, 80.2083, "Central Chennai", "Urban"),
    ("padi", 13.1019, 80.1897, "North Chennai", "Urban"),
    ("kolathur", 13.1178, 80.2209, "North Chennai", "Urban"),
    ("korattur", 13.1095, 80.1786, "North Chennai", "Urban"),
    ("madhavaram", 13.1491, 80.2344, "North Chennai", "Urban"),
]

# Serving gazetteer: display name, lat, lng, base risk, road type (order breaks ties).
ZONES_SERVING = [
    ("Anna Salai", 13.0637, 80.2565, 85, "Arterial"),
    ("Kathipara", 13.0095, 80.2105, 92, "Flyover"),
    ("T Nagar", 13.0418, 80.2341, 78, "Commercial"),
    ("Koyambedu", 13.0694, 80.1948, 70, "Urban"),
    ("Egmore", 13.0732, 80.2609, 70, "Urban"),
    ("Mylapore", 13.0339, 80.2619, 65, "Urban"),
    ("Nungambakkam", 13.0569, 80.2425, 68, "Urban"),
    ("Kodambakkam", 13.0519, 80.2247, 66, "Urban"),
    ("Vadapalani", 13.0505, 80.2124, 64, "Urban"),
    ("Guindy", 13.0067, 80.2206, 72, "Urban"),
    ("Saidapet", 13.0225, 80.2209, 65, "Urban"),
    ("Kilpauk", 13.0824, 80.2397, 62, "Urban"),
    ("Teynampet", 13.0350, 80.2500, 66, "Urban"),
    ("Triplicane", 13.0561, 80.2784, 68, "Urban"),
    ("Broadway", 13.0878, 80.2863, 70, "Urban"),
    ("Chetpet", 13.0715, 80.2418, 60, "Urban"),
    ("Ashok Nagar", 13.0358, 80.2100, 62, "Urban"),
    ("Adyar", 13.0067, 80.2571, 58, "Urban"),
    ("Velachery", 13.0068, 80.2209, 68, "Urban"),
    ("Besant Nagar", 13.0002, 80.2707, 35, "Coastal"),
    ("Thiruvanmiyur", 12.9827, 80.2596, 40, "Urban"),
    ("Sholinganallur", 12.9010, 80.2279, 55, "Urban"),
    ("Perungudi", 12.9568, 80.2383, 52, "Urban"),
    ("Medavakkam", 12.9201, 80.1914, 50, "Urban"),
    ("Nanganallur", 12.9878, 80.1931, 48, "Urban"),
    ("Neelankarai", 12.9447, 80.2489, 30, "Coastal Highway"),
    ("Chromepet", 12.9516, 80.1462, 55, "Urban"),
    ("Porur", 13.0358, 80.1572, 60, "Urban"),
    ("Tambaram", 12.9229, 80.1275, 65, "Highway"),
    ("Pallavaram", 12.9675, 80.1499, 55, "Urban"),
    ("Pammal", 12.9695, 80.1431, 45, "Urban"),
    ("Poonamallee", 13.0458, 80.1533, 28, "Highway"),
    ("Vandalur", 12.8897, 80.0820, 38, "Highway"),
    ("Guduvanchery", 12.8453, 80.0587, 35, "Highway"),
    ("Urapakkam", 12.8690, 80.0726, 36, "Urban"),
    ("Valasaravakkam", 13.0456, 80.1789, 55, "Urban"),
    ("Virugambakkam", 13.0544, 80.1978, 58, "Urban"),
    ("Ambattur", 13.1143, 80.1548, 50, "Industrial"),
    ("Perambur", 13.1178, 80.2478, 52, "Urban"),
    ("Villivakkam", 13.1019, 80.2100, 50, "Urban"),
    ("Avadi", 13.1147, 80.1009, 45, "Urban"),
    ("Manali", 13.1666, 80.2573, 45, "Industrial"),
    ("Madhavaram", 13.1491, 80.2344, 48, "Urban"),
    ("Kolathur", 13.1178, 80.2209, 48, "Urban"),
    ("Korattur", 13.1095, 80.1786, 46, "Urban"),
    ("Padi", 13.1019, 80.1897, 45, "Urban"),
    ("Redhills", 13.1900, 80.1800, 40, "Highway"),
    ("Thiruvottiyur", 13.1618, 80.3037, 42, "Urban"),
    ("Vyasarpadi", 13.1178, 80.2709, 50, "Urban"),
    ("Royapuram", 13.1109, 80.2918, 55, "Urban"),
    ("Tondiarpet", 13.1163, 80.2876, 52, "Urban"),
    ("OMR", 12.9279, 80.2211, 62, "Expressway"),
    ("ECR", 12.9023, 80.2527, 20, "Coastal Highway"),
    ("GST Road", 12.9716, 80.1999, 75, "Highway"),
    ("Perungalathur", 12.9033, 80.1356, 45, "Urban"),
    ("Gerugambakkam", 13.0106, 80.1108, 42, "Urban"),
    ("Kundrathur", 13.0028, 80.0861, 40, "Urban"),
    ("Sriperumbudur", 12.9695, 79.9474, 50, "Highway"),
    ("Palavakkam", 12.9447, 80.2611, 28, "Coastal Highway"),
    ("Kamarajar Salai", 13.0900, 80.2900, 55, "Arterial"),
]

# Dashboard region table: region, static risk (in display order).
REGION_RISK = [
    ("Central Chennai", 82),
    ("South Chennai", 65),
    ("West Chennai", 71),
    ("North Chennai", 48),
    ("East Chennai", 30),
]

# Dashboard highlight zones: name, lat, lng, static risk.
TOP_ZONES = [
    ("Kathipara Junction", 13.0095, 80.2105, 92),
    ("Anna Salai", 13.0637, 80.2565, 85),
    ("T Nagar", 13.0418, 80.2341, 78),
    ("GST Road", 12.9716, 80.1999, 75),
    ("Koyambedu", 13.0694, 80.1948, 70),
    ("OMR Corridor", 12.9279, 80.2211, 62),
    ("ECR Beach", 12.9023, 80.2527, 18),
]

# Congestion base per region for the dataset builder; other regions 50.
REGION_CONGESTION_BASE = {
    "Central Chennai": 70, "South Chennai": 55, "West Chennai": 60,
    "North Chennai": 45, "East Chennai": 25,
}
REGION_CONGESTION_DEFAULT = 50

# Code maps used when training (defaults: weather 0, road 2, time 2).
TRAIN_WEATHER_CODES = {"Clear": 0, "Drizzle": 1, "Light Rain": 2, "Heavy Rain": 3, "Fog": 4, "Unknown": 0}
TRAIN_ROAD_CODES = {"Highway": 0, "Arterial": 1, "Urban": 2, "Coastal": 3, "Industrial": 4,
                    "Flyover": 5, "Expressway": 0, "Commercial": 2, "Coastal Highway": 3}
TRAIN_TIME_CODES = {"Early Morning": 0, "Morning Peak": 1, "Afternoon": 2, "Night": 3, "Evening Peak": 4}
TRAIN_DEFAULTS = {"weather": 0, "road": 2, "time": 2}

# Code maps used when serving (defaults: weather 0, road 2, time 0).
SERVE_WEATHER_CODES = {"Clear": 0, "Drizzle": 1, "Light Rain": 2, "Heavy Rain": 3, "Fog": 4, "Thunderstorm": 5}
SERVE_ROAD_CODES = {"Highway": 0, "Arterial": 1, "Urban": 2, "Coastal": 3, "Industrial": 4, "Flyover": 5}
SERVE_TIME_CODES = {"Early Morning": 0, "Morning Peak": 1, "Afternoon": 2, "Night": 3, "Evening Peak": 4}
SERVE_DEFAULTS = {"weather": 0, "road": 2, "time": 0}

# Relevance words (lower-case substrings).
ACCIDENT_WORDS = ["accident", "crash", "collision", "killed", "injured", "fatal", "dead", "hit",
                  "மரணம்", "விபத்து"]
CITY_WORDS = ["chennai", "tamil nadu"]
TAMIL_TITLE_WORDS = ["விபத்து", "மரணம்"]

# Severity patterns, tested in this order; default Minor.
SEVERITY_PATTERNS = [
    ("Fatal", ["kill", "dead", "fatal", "death", "died", "succumb", "மரணம்"]),
    ("Major", ["injur", "hospitaliz", "critical", "serious", "grievous", "காயம்"]),
    ("Minor", ["minor", "slight", "escape", "unhurt"]),
]
SEVERITY_DEFAULT = "Minor"

# Vehicle patterns (regular expressions), tested in this order; default Car.
VEHICLE_PATTERNS = [
    ("Bike", [r"bike", r"motorcycle", r"two.wheeler", r"scooter", r"motorbike"]),
    ("Car", [r"\bcar\b", r"sedan", r"suv", r"\bvehicle\b"]),
    ("Truck", [r"truck", r"lorry", r"tanker", r"tipper", r"heavy vehicle"]),
    ("Bus", [r"\bbus\b", r"minibus"]),
    ("Auto", [r"auto.rickshaw", r"autorickshaw", r"\bauto\b"]),
]
VEHICLE_DEFAULT = "Car"

# Casualty number patterns on lower-case text (group 1 is the number).
INJURED_PATTERN = r"(\d+)\s+(?:people\s+)?(?:injur|hospitaliz)"
KILLED_PATTERN = r"(\d+)\s+(?:people\s+)?(?:kill|dead|died)"
VEHICLES_PATTERN = r"(\d+)\s+(?:vehicles?|cars?|bikes?|trucks?)"
VEHICLES_DEFAULT = 2
VEHICLES_CAP = 5

JUNCTION_WORDS = ["junction", "signal", "flyover", "bridge", "crossing"]
SCHOOL_WORDS = ["school", "college", "university"]

# Hours drawn for undated articles, and for dated ones without an hour.
IMPUTE_HOURS_UNDATED = [8, 9, 17, 18, 19, 12, 15, 22, 7]
IMPUTE_HOURS_DATED = [8, 9, 17, 18, 19, 12]
IMPUTE_MAX_DAYS = 3000

# Positive-record weather constants.
POSITIVE_WEATHER = {"weather_condition": "Unknown", "temperature_c": 31.0, "humidity_pct": 72.0,
                    "wind_speed_kmh": 15.0, "visibility_km": 8.0, "rainfall_mm": 0.0}

# Negative generators.
NEG_ZONE_HOURS = [6, 11, 13, 14, 15, 16, 21, 22, 23, 3, 4]
NEG_ZONE_MAX_DAYS = 3650
NEG_ZONE_WEATHER = ["Clear", "Clear", "Clear", "Light Rain"]
NEG_MUTATE_HOURS = [6, 7, 11, 13, 14, 15, 21, 22, 23, 2, 3, 4]

# Sources in run order (rank 0 is the news feed), fixed publisher per site.
SOURCES = [
    (0, "feed", None),
    (1, "site", "The Hindu"),
    (2, "site", "Times of India"),
    (3, "site", "New Indian Express"),
    (4, "site", "DT Next"),
    (5, "site", "Maalaimalar"),
]
FEED_PUBLISHER_DEFAULT = "Google News"
URL_DATED_RANKS = [1, 2]
TAMIL_RELAXED_RANKS = [5]

# Listing-site base addresses for relative links (rank -> base).
SITE_BASES = {
    1: "https://www.thehindu.com",
    2: "https://timesofindia.indiatimes.com",
    3: "https://www.newindianexpress.com",
    4: "https://www.dtnext.in",
    5: "https://www.maalaimalar.com",
}

# Feed search keywords (in order).
RSS_KEYWORDS = [
    "Chennai road accident", "Chennai accident killed", "Chennai accident injured",
    "Chennai fatal accident", "Chennai bike accident", "Chennai lorry accident",
    "Chennai bus accident", "Chennai hit and run", "Anna Salai accident",
    "OMR Chennai accident", "GST Road Chennai accident", "Kathipara accident",
    "Tambaram accident Chennai", "Koyambedu accident", "Velachery accident Chennai",
    "Adyar accident Chennai", "Porur accident Chennai", "Ambattur accident Chennai",
    "Perambur accident Chennai", "Guindy accident Chennai", "Chennai car accident dead",
    "Chennai pedestrian accident", "Chennai drunk driving accident", "Chennai signal accident",
    "Chennai flyover accident",
]
RSS_START_DATE = "2015-01-01"

# Scoring request defaults.
REQUEST_DEFAULTS = {
    "latitude": 13.0637, "longitude": 80.2565,
    "temperature_c": 30.0, "humidity_pct": 70.0, "wind_speed_kmh": 15.0, "visibility_km": 8.0,
    "rainfall_mm": 0.0, "congestion_pct": 50.0, "speed_kmh": 30.0,
    "is_junction": 0, "is_school_zone": 0, "flood_risk": 0,
    "weather_condition": "Clear", "road_type": "Urban", "time_period": "Afternoon",
}

# Weather defaults used when a probe has no fresh observation.
WEATHER_FALLBACK = {"temperature_c": 30.0, "humidity_pct": 70.0, "wind_speed_kmh": 15.0,
                    "visibility_km": 8.0, "rainfall_mm": 0.0, "weather_condition": "Clear"}
WEATHER_TTL_S = 600
ROUTE_TTL_S = 300

# Driver alert texts (serving), in rule order.
ALERT_HEAVY_RAIN = "⚠️ Heavy rainfall — reduced braking distance"
ALERT_LOW_VIS = "🌫️ Low visibility — use hazard lights"
ALERT_FLOOD = "🌊 Flood risk — avoid underpasses"
ALERT_CONGESTION = "🚗 Severe congestion — consider alternate route"
ALERT_JUNCTION = "🛑 Intersection zone — slow down"
ALERT_PEAK = "🕔 Peak hour — elevated collision risk"

# Weather advisory texts, in rule order.
ADV_HEAVY_RAIN = "⚠️ HEAVY RAIN — avoid underpasses"
ADV_MODERATE_RAIN = "🌧️ MODERATE RAIN — slow down"
ADV_VERY_LOW_VIS = "🌫️ VERY LOW VISIBILITY — hazard lights"
ADV_REDUCED_VIS = "🌫️ REDUCED VISIBILITY — caution"
ADV_WIND = "💨 STRONG WINDS — two-wheelers caution"
ADV_THUNDER = "⛈️ THUNDERSTORM — avoid travel"
ADV_NORMAL = "✅ CONDITIONS NORMAL — standard safety protocols"

# Route option configurations: type, summary suffix.
ROUTE_CONFIGS = [("fastest", "Fastest Route"), ("shortest", "Shortest Route"), ("eco", "Eco Route")]

# Model features, fixed order.
FEATURES = ["hour", "is_weekend", "temperature_c", "humidity_pct", "wind_speed_kmh", "visibility_km",
            "rainfall_mm", "congestion_pct", "speed_kmh", "is_junction", "is_school_zone", "flood_risk",
            "weather_enc", "road_enc", "time_enc"]

# Named scenario rows for the model check (features in the order above).
SCENARIOS = [
    ("Peak+Busy Road", [9, 0, 31, 72, 15, 8, 0, 85, 25, 1, 0, 0, 0, 1, 1]),
    ("Afternoon Normal", [14, 0, 31, 72, 15, 8, 0, 45, 50, 0, 0, 0, 0, 2, 2]),
    ("Late Night Highway", [23, 1, 28, 65, 10, 10, 0, 15, 70, 0, 0, 0, 0, 0, 3]),
    ("Peak+Junction", [8, 1, 31, 72, 15, 8, 0, 90, 15, 1, 0, 1, 0, 1, 1]),
    ("Early Morning", [3, 0, 29, 68, 12, 9, 0, 20, 65, 0, 0, 0, 0, 2, 0]),
]

# Model configurations: (trees, depth, step, subsample, column share) and forest (trees, depth).
MODEL_CONFIGS = {
    "builder": {"gbt": (200, 5, 0.05, 0.8, 0.8), "forest": (200, 8), "min_split": 5},
    "retrain": {"gbt": (100, 4, 0.1, 1.0, 1.0), "forest": (100, 6), "min_split": 2},
}
ENSEMBLE_WEIGHTS = (0.55, 0.45)
THRESHOLD_SERVE = 0.45
THRESHOLD_ACCURACY = 0.5

# ---------------------------------------------------------------------------
# Helpers
# ---------------------------------------------------------------------------

ZONES_TRAIN_SCHEMA = T.StructType([
    T.StructField("zone_ord", T.IntegerType(), False),
    T.StructField("zone_key", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lng", T.DoubleType(), False),
    T.StructField("zone", T.StringType(), False),
    T.StructField("road_type", T.StringType(), False),
])

ZONES_SERVING_SCHEMA = T.StructType([
    T.StructField("zone_ord", T.IntegerType(), False),
    T.StructField("zone_name", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lng", T.DoubleType(), False),
    T.StructField("base_risk", T.IntegerType(), False),
    T.StructField("road_type", T.StringType(), False),
])


def values_df(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A small fixed table as a SQL VALUES relation (a JVM local relation:
    no Python RDD behind it, broadcast by size, constant-folded by Catalyst)."""
    def lit(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        if t == "string":
            return sql_str(v)
        return f"CAST({v!r} AS {t})"
    body = ", ".join("(" + ", ".join(lit(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def zones_train(spark: SparkSession) -> DataFrame:
    rows = [(i, *z) for i, z in enumerate(ZONES_TRAIN)]
    return values_df(spark, rows, ["zone_ord", "zone_key", "lat", "lng", "zone", "road_type"],
                     ["int", "string", "double", "double", "string", "string"])


def zones_serving(spark: SparkSession) -> DataFrame:
    rows = [(i, *z) for i, z in enumerate(ZONES_SERVING)]
    return values_df(spark, rows, ["zone_ord", "zone_name", "lat", "lng", "base_risk", "road_type"],
                     ["int", "string", "double", "double", "int", "string"])


def region_risk(spark: SparkSession) -> DataFrame:
    rows = [(i, r, k) for i, (r, k) in enumerate(REGION_RISK)]
    return values_df(spark, rows, ["region_ord", "zone", "risk"], ["int", "string", "int"])


def top_zones(spark: SparkSession) -> DataFrame:
    rows = [(i, n, la, ln, r) for i, (n, la, ln, r) in enumerate(TOP_ZONES)]
    return values_df(spark, rows, ["top_ord", "name", "lat", "lng", "risk"], ["int", "string", "double", "double", "int"])


def source_profiles(spark: SparkSession) -> DataFrame:
    """One row a source: run order, kind, publisher, base of relative links, and
    whether its links are dated and its relevance rule is relaxed."""
    rows = [(r, k, p, SITE_BASES.get(r), r in URL_DATED_RANKS, r in TAMIL_RELAXED_RANKS) for r, k, p in SOURCES]
    return values_df(spark, rows, ["source_rank", "source_kind", "site_publisher", "base", "url_dated", "relaxed"],
                     ["int", "string", "string", "string", "boolean", "boolean"])


def title_case(key: str) -> str:
    """Display form of a training gazetteer key (each word capitalised)."""
    return key.title()


def map_lookup(mapping: dict, key: Column, default) -> Column:
    """``mapping.get(key, default)`` as a Column over a literal map."""
    lit_map = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(lit_map, key), F.lit(default))


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_double(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def zones_train_values_sql() -> str:
    rows = ",\n  ".join(
        f"({i},{sql_str(k)},{sql_double(la)},{sql_double(ln)},{sql_str(z)},{sql_str(r)})"
        for i, (k, la, ln, z, r) in enumerate(ZONES_TRAIN))
    return f"SELECT * FROM (VALUES\n  {rows}\n) AS t(zone_ord, zone_key, lat, lng, zone, road_type)"


def zones_serving_values_sql() -> str:
    rows = ",\n  ".join(
        f"({i},{sql_str(n)},{sql_double(la)},{sql_double(ln)},{b},{sql_str(r)})"
        for i, (n, la, ln, b, r) in enumerate(ZONES_SERVING))
    return f"SELECT * FROM (VALUES\n  {rows}\n) AS t(zone_ord, zone_name, lat, lng, base_risk, road_type)"
