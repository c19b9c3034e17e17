"""Rows of the tree fits over the cores."""

from pyspark.sql import functions as F

from roadlens import dims
from roadlens.operators import model as ml


def rows(spark, n):
    made = spark.range(0, n, 1, 1)
    features = [(F.xxhash64("id", F.lit(f)) % 50).cast("double").alias(f) for f in dims.FEATURES]
    return made.select(*features, (F.col("id") % 2).cast("double").alias("accident"), F.lit(1.0).alias("class_weight"))


def test_many_rows_lie_in_as_many_partitions_as_cores(spark, monkeypatch):
    df, cores = spark.range(0, 1000, 1, 1), spark.sparkContext.defaultParallelism
    assert ml.spread(df, ml.FEW_ROWS).rdd.getNumPartitions() == 1
    assert ml.spread(df, ml.FEW_ROWS + 1).rdd.getNumPartitions() == cores
    assert ml.spread(df, (cores + 3) * ml.PARTITION_ROWS).rdd.getNumPartitions() == cores + 3
    assert sorted(r.id for r in ml.spread(df, ml.FEW_ROWS + 1).collect()) == list(range(1000))
    monkeypatch.setattr(ml, "FEW_ROWS", 100)
    seen = []
    monkeypatch.setattr(ml.GBTClassifier, "fit", lambda self, data: seen.append(data) or real(self, data))
    real = ml.GBTClassifier.__mro__[1].fit
    monkeypatch.setitem(dims.MODEL_CONFIGS, "tiny", {"gbt": (2, 2, 0.1, 1.0, 1.0), "forest": (2, 2), "min_split": 2})
    train = rows(spark, 400)
    assert train.rdd.getNumPartitions() == 1
    model = ml.fit_ensemble(train, "tiny")
    assert seen[0].rdd.getNumPartitions() == cores
    assert ml.score(model, train).where(F.col("probability").between(0, 1)).count() == 400
