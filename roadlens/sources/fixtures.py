"""Input views derived from the driver's tables (FIXTURES.md §3).

Each view is a pure DataFrame transformation of ``events`` (plus the fixed
gazetteers), so its size grows with the input and every downstream job does
real, partitioned work.  Gazetteer lookups use literal arrays (no join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list, idx0: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (idx0 + 1).cast("int"))


ARTICLE_TEMPLATES = [
    "Two-wheeler rider killed after lorry hit him",
    "3 people injured as bus and car collide in accident at signal",
    "College student escapes unhurt in auto crash",
    "12 killed, 7 vehicles damaged in fatal pile-up",
    "Man struck by heavy vehicle on flyover, critical",
    "Council reviews new budget",
    "SUV accident: 1 dead",
    "Minor collision near school",
]


HOT_TITLE = "3 people injured as bus and car collide in accident at kathipara, Chennai"
OTHER_TITLES = ["School opens new library", "Council plans a park", "Metro work moves on", "Market prices ease"]
SUMMARY_ONLY = "Accident near a school, 2 injured; Chennai police at the junction"
SUMMARY_MORE = "Police said 4 people were injured and 2 vehicles towed at the signal"


def articles(events: DataFrame) -> DataFrame:
    """News items: article_id, source_rank, published_ts, title, summary, keyword, source_url.

    One title holds a third of the rows, about half are irrelevant, and the
    other relevant ones carry a story number, so the records grow with the
    input.  A quarter of the story numbers come from two sources each; one
    template in eight is relevant only by its summary."""
    eid = F.col("event_id")
    block = F.floor(eid / 6)
    story = F.when(F.floor(eid / 2) % 4 == 0, eid - eid % 2).otherwise(eid)
    hot = block % 3 == 0
    told = F.floor(eid / 18) % 5 == 1
    zone_key = _pick([z[0] for z in dims.ZONES_TRAIN], (story * 7) % 50)
    place = F.when(zone_key.isNull(), F.lit(" in Salem")).otherwise(F.concat(F.lit(" at "), zone_key, F.lit(", Chennai")))
    what = F.when(told, F.concat(F.lit("Case "), story.cast("string"), F.lit(": "), _pick(ARTICLE_TEMPLATES, block % 8))) \
            .otherwise(F.concat(F.lit("Note "), story.cast("string"), F.lit(": "), _pick(OTHER_TITLES, block % 4)))
    title = F.when(hot, F.lit(HOT_TITLE)).otherwise(
        F.concat(what, place, F.when(story % 5 == 0, F.lit(" - Daily Post")).otherwise(F.lit(""))))
    summary = (F.when(hot | ~told, F.lit(None).cast("string"))
                .when(block % 8 == 5, F.lit(SUMMARY_ONLY))
                .when(eid % 2 == 0, F.lit(SUMMARY_MORE)).otherwise(F.lit("")))
    keyword = F.when(eid % 6 == 0, _pick(dims.RSS_KEYWORDS, block % len(dims.RSS_KEYWORDS)))
    url = (F.when(block % 2 == 0,
                  F.concat(F.lit("https://news.example.org/2023/0"), (block % 9 + 1).cast("string"), F.lit("/"),
                           F.when(eid % 28 < 9, F.lit("0")).otherwise(F.lit("")), (eid % 28 + 1).cast("string"),
                           F.lit("/a"), eid.cast("string")))
           .otherwise(F.concat(F.lit("https://news.example.org/a"), eid.cast("string"))))
    published = F.col("ts") - F.make_dt_interval((eid % 7 * 30).cast("int"))
    return events.select(eid.alias("article_id"), (eid % 6).cast("int").alias("source_rank"),
                         published.alias("published_ts"), title.alias("title"), summary.alias("summary"),
                         keyword.alias("keyword"), url.alias("source_url"))


def probes(events: DataFrame) -> DataFrame:
    """Locations to score/search: probe_id, ts, lat, lng; one in 97 lies far from every place."""
    return events.select(
        F.col("event_id").alias("probe_id"), "ts",
        ((F.when(F.col("event_id") % 97 == 0, 11850).otherwise(12850) + (F.col("event_id") * 13) % 340).cast("double") / 1000).alias("lat"),
        ((F.lit(80000) + (F.col("user_id") * 29 + F.col("event_id")) % 310).cast("double") / 1000).alias("lng"))


def _earlier(seconds: Column) -> Column:
    return F.col("ts") - F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


WEATHER_MAINS = ["Clear", "Rain", "Mist", "Clouds", "Thunderstorm", "Drizzle", "Fog", "Haze"]


def weather_obs(events: DataFrame) -> DataFrame:
    """Stored weather payloads: obs_id, obs_ts, lat, lng, payload (2 % malformed).

    Two thirds lie at the probe of the same event, 0 to 900 seconds before it."""
    eid = F.col("event_id")
    s = lambda c: c.cast("string")
    payload = F.concat(
        F.lit('{"main":{"temp":'), s(24 + eid % 13), F.lit(',"feels_like":'), s(26 + eid % 13),
        F.lit(',"humidity":'), s(55 + eid % 35), F.lit("}"),
        F.lit(',"weather":[{"main":"'), _pick(WEATHER_MAINS, eid % 8), F.lit('","description":"obs"}]'),
        F.when((eid % 8).isin(1, 4), F.concat(F.lit(',"rain":{"1h":'), s(eid % 31), F.lit("}"))).otherwise(F.lit("")),
        F.lit(',"wind":{"speed":'), s(eid % 12), F.lit("}"),
        F.when(eid % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(',"visibility":'), s(400 + (eid % 90) * 100))),
        F.lit("}"))
    return events.select(
        eid.alias("obs_id"), _earlier(eid % 900).alias("obs_ts"),
        ((F.lit(12850) + (eid * F.when(eid % 3 == 0, 17).otherwise(13)) % 340).cast("double") / 1000).alias("lat"),
        ((F.lit(80000) + (F.col("user_id") * F.when(eid % 3 == 0, 31).otherwise(29) + eid) % 310).cast("double") / 1000)
        .alias("lng"),
        F.when(eid % 50 == 0, F.lit("{bad json")).otherwise(payload).alias("payload"))


def route_options(events: DataFrame) -> DataFrame:
    """Three stored route options per trip, 0 to 450 seconds old (free-flow time null for 10 %)."""
    configs = F.array(*[F.struct(F.lit(i).alias("config_ord"), F.lit(t).alias("route_type"))
                        for i, (t, _) in enumerate(dims.ROUTE_CONFIGS)])
    eid, k = F.col("event_id"), F.col("config_ord")
    return events.select("*", F.inline(configs)).select(
        eid.alias("trip_id"), F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("origin"),
        F.concat(F.lit("d"), (eid % 40).cast("string")).alias("destination"), "route_type", "config_ord",
        (F.lit(4000) + (eid * 37 + k * 911) % 11000).cast("int").alias("length_m"),
        (F.lit(900) + (eid * 53 + k * 401) % 2700).cast("int").alias("travel_s"),
        ((eid * 11 + k * 97) % 1200).cast("int").alias("delay_s"),
        F.when(eid % 10 == 0, F.lit(None).cast("int"))
         .otherwise((F.lit(700) + (eid * 53 + k * 401) % 1500).cast("int")).alias("no_traffic_s"),
        _earlier(eid % 450).alias("obs_ts"))


def route_requests(events: DataFrame) -> DataFrame:
    """Trip requests: request_id, ts, origin, destination (null for a quarter)."""
    eid = F.col("event_id")
    return events.select(
        eid.alias("request_id"), "ts",
        F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("origin"),
        F.when(eid % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("d"), ((eid * F.when(eid % 3 == 0, 3).otherwise(1)) % 40).cast("string")))
         .alias("destination"))


def feed_items(events: DataFrame) -> DataFrame:
    """The feed's items of ``articles``."""
    return articles(events).where(F.col("source_rank") == 0)


def listing_pages(events: DataFrame) -> DataFrame:
    """Stored listing pages of the sites: page_id, source_rank, html.  One link each to an
    item of ``articles``, relative where the item's link has no date."""
    path = F.substring_index("source_url", "https://news.example.org", -1)
    href = F.when(path.contains("/2023/"), F.col("source_url")).otherwise(path)
    return articles(events).where(F.col("source_rank") > 0).select(
        F.col("article_id").alias("page_id"), "source_rank",
        F.concat(F.lit('<h3 class="title"><a href="'), href, F.lit('">'), F.col("title"), F.lit("</a></h3>")).alias("html"))
