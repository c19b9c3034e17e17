"""Per-run input DataFrames for the registered queries (lazy, cached by name)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators import geo
from ..operators import records as rec
from ..operators import training as tr
from ..session import apply_runtime_conf, ensure_checkpoint_dir, materialize
from ..sources import fixtures as fx


# Run date for imputation and age labels; a fixed parameter so runs repeat.
AS_OF = _dt.date(2024, 2, 1)


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: _dt.date = AS_OF):
        self.spark, self.sf_dir, self.as_of = spark, sf_dir, as_of
        self._memo: dict[str, DataFrame] = {}
        apply_runtime_conf(spark)
        ensure_checkpoint_dir(spark)

    def _get(self, name, build):
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    def table(self, name: str) -> DataFrame:
        return self._get("t:" + name, lambda: fx.table(self.spark, self.sf_dir, name))

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def zones_train(self) -> DataFrame:
        return self._get("zones_train", lambda: dims.zones_train(self.spark))

    @property
    def zones_serving(self) -> DataFrame:
        return self._get("zones_serving", lambda: dims.zones_serving(self.spark))

    @property
    def articles(self) -> DataFrame:
        return self._get("articles", lambda: fx.articles(self.events))

    @property
    def probes(self) -> DataFrame:
        return self._get("probes", lambda: fx.probes(self.events))

    @property
    def weather_obs(self) -> DataFrame:
        return self._get("weather_obs", lambda: fx.weather_obs(self.events))

    @property
    def route_options(self) -> DataFrame:
        return self._get("route_options", lambda: fx.route_options(self.events))

    @property
    def route_requests(self) -> DataFrame:
        return self._get("route_requests", lambda: fx.route_requests(self.events))

    @property
    def records(self) -> DataFrame:
        """Positive accident records built from the articles (article_id + 34
        columns).  Lazy: a job that reads them once computes only its columns."""
        return self._get("records", lambda: rec.build_records(self.articles, self.zones_train, F.lit(self.as_of)))

    @property
    def record_table(self) -> DataFrame:
        """The records written once in the shared checkpoint folder, as the
        dataset builder writes its file, for jobs that branch on them."""
        return self._get("record_table", lambda: materialize(self.records, "records"))

    @property
    def history(self) -> DataFrame:
        """The history base (D2) with the columns of the proximity search,
        written once: the search reads it as points and as newest rows."""
        return self._get("history", lambda: materialize(geo.history_base(self.records).select(
            "article_id", "latitude", "longitude", "date", "location_name", "zone", "headline", "severity",
            "publisher", "source_url", "vehicle_type"), "history"))

    @property
    def negatives(self) -> DataFrame:
        """L1 negatives, one per positive."""
        return self._get("negatives", lambda: tr.negatives_from_zones(self.record_table, self.zones_train, F.lit(self.as_of)))

    @property
    def dataset(self) -> DataFrame:
        """The builder's training set (record_id + 34 columns)."""
        return self._get("dataset", lambda: materialize(tr.training_set(self.record_table, self.negatives), "dataset"))
