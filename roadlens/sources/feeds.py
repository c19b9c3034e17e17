"""News feed and listing-page sources.

Fetching is not part of this library; these read what a crawler stored:
RSS/XML item files and raw HTML pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RSS_ITEM

ANCHOR = r"(?is)<a\s(?:[^>]*\s)?href\s*=[^>]*>.*?</a>"
HREF = r"""(?is)^<a\s(?:[^>]*\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """RSS items (``<item>`` rows) with missing fields as empty strings."""
    df = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(o) for c, o in
                       [("title", "title"), ("link", "link"), ("description", "summary"), ("pubDate", "published")]])


def write_rss(items: DataFrame, path: str) -> None:
    """Store feed items (title, link, description, pubDate) as an RSS-like XML file set."""
    items.write.mode("overwrite").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)


def extract_links(pages: DataFrame, base: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Anchors of each page: position, text (tags stripped, trimmed) and
    href (quoted either way or not at all), made absolute with ``base``
    (default: the page's own origin) when it does not start with ``http``."""
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1) if base is None else F.lit(base)
    kept = ["page_id", *(keep or [])]
    df = pages.select(*kept, origin.alias("_base"),
                      F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), 0)).alias("pos", "a"))
    href = F.concat(*[F.regexp_extract("a", HREF, k) for k in (1, 2, 3)])
    return df.select(
        *kept, "pos",
        F.trim(F.regexp_replace("a", "<[^>]*>", "")).alias("text"),
        F.when(href.startswith("http"), href).otherwise(F.concat("_base", href)).alias("href"))


def listing_items(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """S5 by profile: the links of stored listing pages (page_id, source_rank,
    html) as items of their source; relative links get the base of its row.
    Pages of a source without a profile are dropped.  Items are numbered by
    page, those of a page by position."""
    known = pages.join(profiles.select("source_rank", "base"), "source_rank")
    links = extract_links(known.withColumn("url", F.col("base")), keep=["source_rank"])
    return links.select("source_rank", F.col("page_id").alias("article_id"), "pos", F.col("text").alias("title"),
                        F.col("href").alias("source_url"))
