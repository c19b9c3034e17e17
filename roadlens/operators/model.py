"""Model fitting and scoring with Spark ML.

Boosted trees on the raw 15 features and a class-balanced random forest on
standardised features, combined 0.55 / 0.45.  Both are one ``Pipeline`` so a
single ``PipelineModel`` is saved, loaded and broadcast to executors by
``transform``.  Parity with the original libraries is by behaviour (AUC,
ordering), not by value: Spark's trees differ in sampling and regularisation.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .. import dims
from ..functions import risk as rk
from ..sources.accidents import path_exists
from . import training as tr


#: training rows up to which the input's own partitions are kept, and most rows of one
FEW_ROWS, PARTITION_ROWS = 50_000, 500_000


def assemble(df: DataFrame, features: list[str] = dims.FEATURES, out: str = "features") -> DataFrame:
    """L4: the 15 features in fixed order as one vector column."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def ensemble_pipeline(config: str = "retrain", seed: int = 42, label: str = "accident") -> Pipeline:
    cfg = dims.MODEL_CONFIGS[config]
    trees, depth, step, sub, colshare = cfg["gbt"]
    ftrees, fdepth = cfg["forest"]
    assembler = VectorAssembler(inputCols=dims.FEATURES, outputCol="features", handleInvalid="keep")
    scaler = StandardScaler(inputCol="features", outputCol="features_sc", withMean=True, withStd=True)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step,
                        subsamplingRate=sub, featureSubsetStrategy=("all" if colshare >= 1.0 else str(colshare)),
                        seed=seed)
    gbt.setPredictionCol("gbt_pred").setProbabilityCol("gbt_prob").setRawPredictionCol("gbt_raw")
    rf = RandomForestClassifier(featuresCol="features_sc", labelCol=label, numTrees=ftrees, maxDepth=fdepth,
                                weightCol="class_weight", seed=seed,
                                minInstancesPerNode=max(1, cfg["min_split"] // 2))
    rf.setPredictionCol("rf_pred").setProbabilityCol("rf_prob").setRawPredictionCol("rf_raw")
    return Pipeline(stages=[assembler, scaler, gbt, rf])


def prepare_training(df: DataFrame) -> DataFrame:
    """T17 encoders + A7 balanced weights + double label."""
    enc = rk.encode_training(df)
    return tr.balanced_weights(enc).withColumn("accident", F.col("accident").cast("double"))


def spread(features: DataFrame, rows: int) -> DataFrame:
    """The rows over all cores: written tables of millions of rows are so small
    that they are read in a few partitions, and tree fitting passes over them
    hundreds of times.  A partition sends the sums of all nodes of a level in
    each pass, so there are no more of them than cores unless the rows ask for it."""
    if rows <= FEW_ROWS:
        return features
    return features.repartition(max(features.sparkSession.sparkContext.defaultParallelism,
                                    -(-rows // PARTITION_ROWS)))


def fit_ensemble(train: DataFrame, config: str = "retrain", seed: int = 42) -> PipelineModel:
    """L6 + L7: fit both models (input must be prepared).

    Assembler and scaler are fitted first; the boosted trees and the forest
    are then fitted concurrently (two driver threads submitting Spark jobs)
    on the same assembled input, and joined into one ``PipelineModel``.  Both
    fits keep the binned rows in memory for their passes and read the assembled
    input a few times only, so that lies on disk."""
    from concurrent.futures import ThreadPoolExecutor

    assembler, scaler, gbt, rf = ensemble_pipeline(config, seed).getStages()
    scaler_model = scaler.fit(assembler.transform(train))
    features = spread(scaler_model.transform(assembler.transform(train))
                      .select("features", "features_sc", rf.getLabelCol(), "class_weight"),
                      train.count()).persist(StorageLevel.DISK_ONLY)
    try:
        with ThreadPoolExecutor(max_workers=2) as pool:
            gbt_job, rf_job = pool.submit(gbt.fit, features), pool.submit(rf.fit, features)
            gbt_model, rf_model = gbt_job.result(), rf_job.result()
    finally:
        features.unpersist()
    return PipelineModel(stages=[assembler, scaler_model, gbt_model, rf_model])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Probabilities of both models and the weighted ensemble."""
    wg, wf = dims.ENSEMBLE_WEIGHTS
    out = model.transform(df)
    return (out.withColumn("gbt_probability", vector_to_array("gbt_prob")[1])
               .withColumn("rf_probability", vector_to_array("rf_prob")[1])
               .withColumn("probability", F.lit(wg) * F.col("gbt_probability") + F.lit(wf) * F.col("rf_probability"))
               .drop("features", "features_sc", "gbt_prob", "gbt_raw", "gbt_pred", "rf_prob", "rf_raw", "rf_pred"))


def score_requests(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """Serving encoders -> both models -> ensemble -> level, outputs, alerts."""
    enc = rk.encode_serving(requests)
    scored = score(model, enc)
    out = rk.risk_outputs(scored)
    return (out.withColumn("gbt_probability", F.round("gbt_probability", 4))
               .withColumn("rf_probability", F.round("rf_probability", 4))
               .withColumn("alerts", rk.driver_alerts("rainfall_mm", "visibility_km", "flood_risk", "congestion_pct",
                                                      "is_junction", "hour")))


def evaluate(scored_test: DataFrame) -> DataFrame:
    """The three AUCs and the ensemble accuracy on the holdout (one row)."""
    parts = [tr.roc_auc(scored_test, c).select(F.lit(n).alias("metric"), F.col("auc").alias("value"))
             for n, c in [("gbt_auc", "gbt_probability"), ("rf_auc", "rf_probability"), ("ensemble_auc", "probability")]]
    parts.append(tr.accuracy(scored_test, "probability").select(F.lit("accuracy").alias("metric"),
                                                                F.col("accuracy").alias("value")))
    counts = scored_test.select(F.explode(F.array(
        F.struct(F.lit("n_pos").alias("metric"), (F.col("accident") == 1).cast("double").alias("value")),
        F.struct(F.lit("n_neg").alias("metric"), (F.col("accident") != 1).cast("double").alias("value")))).alias("m")
    ).groupBy("m.metric").agg(F.sum("m.value").alias("value"))
    long = counts
    for p in parts:
        long = long.unionByName(p)
    names = ["gbt_auc", "rf_auc", "ensemble_auc", "accuracy", "n_pos", "n_neg"]
    wide = long.groupBy().pivot("metric", names).agg(F.first("value"))
    return wide.select(*names[:4], F.col("n_pos").cast("bigint").alias("n_pos"),
                       F.col("n_neg").cast("bigint").alias("n_neg"))


def importances(model: PipelineModel) -> list[tuple[str, float, float]]:
    """(feature, boosted importance, forest importance)."""
    g, f = model.stages[2].featureImportances.toArray(), model.stages[3].featureImportances.toArray()
    return [(n, float(g[i]), float(f[i])) for i, n in enumerate(dims.FEATURES)]


def model_metadata(dataset: DataFrame, metrics: DataFrame, trained_on: _dt.datetime | None = None,
                   name: str | None = None, sources: list[str] | None = None) -> DataFrame:
    """One-row metadata table built from aggregates (no driver loops).

    The builder states the dataset's ``name`` and its ``sources``; retrainings
    leave them out, and the columns too."""
    ts = (trained_on or _dt.datetime.now()).isoformat()
    m = metrics.first()
    totals = dataset.agg(F.count(F.lit(1)).alias("total_records"),
                         F.sum(F.col("accident").cast("int")).cast("bigint").alias("accident_rows"))
    stated = ([F.lit(name).alias("dataset")] if name else []) + (
        [F.array(*[F.lit(s) for s in sources]).alias("sources")] if sources else [])
    return (totals.select("*", *stated, *[F.lit(m[c]).alias(c) for c in metrics.columns])
            .withColumn("trained_on", F.lit(ts))
            .withColumn("features", F.array(*[F.lit(f) for f in dims.FEATURES])))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The stored metadata; without any, no model has been trained."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Model not trained yet: no metadata at {path}")
    return spark.read.json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
