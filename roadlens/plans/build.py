"""The dataset build as one job: stored items to the written training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import records as rec
from ..operators import training as tr
from ..session import materialize, scratch_path
from ..sources import accidents as src
from ..sources import feeds


def build_dataset(feed: DataFrame, pages: DataFrame, profiles: DataFrame, zones: DataFrame, as_of: Column) -> DataFrame:
    """S5 -> U1 -> D1 -> T16 -> L1 -> U2 -> S10: feed items and the links of the
    listing pages are united, follow the rules of their source's profile, become
    records in run order, get a negative each, and are written as the dataset
    files; returns the files read back.  Feed items and pages are numbered apart
    (``article_id`` and ``page_id`` share no value), a page has fewer than 2^20 links."""
    sites = feeds.listing_items(pages, profiles)
    items = rec.union_sources([feed.withColumn("pos", F.lit(0)), sites])
    tagged = rec.tag_sources(items, profiles)
    # one number an item: page and position are the order inside a source
    tagged = tagged.withColumn("article_id", F.col("article_id") * F.lit(1 << 20) + F.col("pos")).drop("pos")
    records = materialize(rec.build_records(tagged, zones, as_of), "build-records")
    negatives = tr.negatives_from_zones(records, zones, as_of)
    path = scratch_path(records.sparkSession, "build-dataset")
    src.write_dataset(tr.training_set(records, negatives), path)
    return src.read_dataset(records.sparkSession, path)
