"""Training job and model-backed scoring jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import calendar as cal
from ..operators import model as ml
from ..operators import ranking as rank
from ..operators import training as tr
from ..session import materialize


def train(dataset: DataFrame, config: str = "retrain", seed: int = 42, test_frac: float = 0.2):
    """Encode, weight, split (stratified), fit both models on the train part and
    score the holdout.  Returns (model, scored holdout, metrics row).

    The split frame is written once to the session's shared checkpoint
    folder, so the many passes of tree fitting read a table instead of
    recomputing upstream work, and a lost executor does not restart it."""
    prepared = ml.prepare_training(dataset)
    split = materialize(tr.stratified_split(prepared, "accident", test_frac, seed), "train-split")
    train_df = split.where(F.col("split") == "train")
    test_df = split.where(F.col("split") == "test")
    model = ml.fit_ensemble(train_df, config, seed)
    # the holdout is scored once; the four metrics read the written result
    scored = materialize(ml.score(model, test_df), "holdout-scored")
    return model, scored, ml.evaluate(scored)


def paired_datasets(records: DataFrame, builder: DataFrame) -> dict[str, tuple[str, DataFrame]]:
    """The trainings of the original: name -> (configuration, dataset).  The
    builder trains on its own dataset (L1 negatives), the retrainings on the
    records with one (L2) or three (L3) changed copies each."""
    return {"builder": ("builder", builder),
            "retrain_1x": ("retrain", tr.training_set(records, tr.negatives_mutate(records, 1))),
            "retrain_3x": ("retrain", tr.training_set(records, tr.negatives_mutate(records, 3)))}


def train_paired(records: DataFrame, builder: DataFrame, seed: int = 42) -> DataFrame:
    """L6, L7, L12 for every pairing: one row of holdout metrics a training."""
    rows = [train(data, config, seed)[2].select(F.lit(name).alias("training"), F.lit(config).alias("config"), "*")
            for name, (config, data) in paired_datasets(records, builder).items()]
    return reduce(DataFrame.unionByName, rows)


def zone_board(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """L10 + W3: score every zone request and rank zones per board hour."""
    scored = ml.score_requests(model, requests)
    return rank.rank_zones(scored)


def scenario_scores(spark, model: PipelineModel) -> DataFrame:
    """The five named feature rows scored by both models."""
    rows = [(label, *[float(v) for v in vals]) for label, vals in dims.SCENARIOS]
    df = spark.createDataFrame(rows, ["scenario"] + dims.FEATURES)
    return ml.score(model, df).select("scenario", "gbt_probability", "rf_probability", "probability")


def batch_requests(events: DataFrame, zones: DataFrame) -> DataFrame:
    """Every serving zone for every hour seen in the events, with the
    zone base risk as congestion and serving defaults elsewhere."""
    hours = events.select(F.date_trunc("hour", "ts").alias("board_ts")).distinct()
    zone_rows = F.array(*[F.struct(F.lit(i).alias("zone_ord"), F.lit(n).alias("zone_name"), F.lit(la).alias("lat"),
                                   F.lit(ln).alias("lng"), F.lit(b).alias("base_risk"))
                          for i, (n, la, ln, b, _) in enumerate(dims.ZONES_SERVING)])
    req = hours.select("board_ts", F.inline(zone_rows)).select(
        F.date_format("board_ts", "yyyy-MM-dd HH:mm").alias("board_hour"), "board_ts", "zone_ord", "zone_name",
        F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), F.hour("board_ts").alias("hour"),
        cal.is_weekend(F.to_date("board_ts")).alias("is_weekend"),
        F.col("base_risk").cast("double").alias("congestion_pct"),
        cal.hour_to_period(F.hour("board_ts")).alias("time_period"))
    return req
