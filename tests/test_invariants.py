"""Invariants of the operators on the driver's smallest tables."""

from pyspark.sql import functions as F

from conftest import SMALL
from roadlens.operators import geo
from roadlens.operators import ranking as rank
from roadlens.operators import records as rec
from roadlens.operators import training as tr
from roadlens.plans.inputs import Inputs


def test_dedupe_is_idempotent(spark):
    i = Inputs(spark, SMALL)
    once = rec.dedupe_articles(i.articles)
    twice = rec.dedupe_articles(once.drop("dedupe_key", "is_relevant"))
    assert once.count() == twice.count() == once.select("dedupe_key").distinct().count()


def test_every_probe_gets_one_zone(spark):
    i = Inputs(spark, SMALL)
    z = geo.nearest_zone(i.probes)
    assert z.count() == i.probes.count()
    assert z.where(F.col("zone_name").isNull()).count() == 0


def test_history_limit_and_totals(spark):
    i = Inputs(spark, SMALL)
    h = geo.accidents_near(i.probes, geo.history_base(i.records), 0.05, 10)
    per = h.groupBy("probe_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("mx"), F.first("total").alias("t"))
    assert per.where("mx IS NOT NULL AND (n > 10 OR mx <> n OR t <> n)").count() == 0
    assert per.where("mx IS NULL AND (n <> 1 OR t <> 0)").count() == 0   # probes without hits
    assert per.where("mx IS NULL").count() > 0 and per.count() == i.probes.count()


def test_route_ranks_are_dense(spark):
    i = Inputs(spark, SMALL)
    r = rank.rank_routes(rank.routes_table(i.route_options))
    bad = r.groupBy("trip_id").agg(F.collect_set("rank").alias("s")).where(F.size("s") != 3)
    assert bad.count() == 0
    assert r.where("is_recommended").count() == i.route_options.select("trip_id").distinct().count()


def test_split_disjoint_and_shares(spark):
    i = Inputs(spark, SMALL)
    s = tr.stratified_split(i.dataset, "accident", 0.2, 42)
    assert s.count() == i.dataset.count() == s.select("record_id").distinct().count()
    shares = s.groupBy("accident").agg(F.avg((F.col("split") == "test").cast("double")).alias("sh"),
                                       F.count(F.lit(1)).alias("n")).collect()
    for r in shares:
        assert abs(r.sh * r.n - round(0.2 * r.n)) < 1e-9


def test_same_result_any_partitioning(spark):
    i = Inputs(spark, SMALL)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = Inputs(spark, SMALL).records
            res.append(sorted(tuple(r) for r in df.collect()))
        assert res[0] == res[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_auc_matches_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    i = Inputs(spark, SMALL)
    d = i.dataset.withColumn("score", F.col("congestion_pct") / 100.0 + F.col("hour") / 1000.0)
    ours = tr.roc_auc(d, "score").collect()[0].auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC")
    theirs = ev.evaluate(d.withColumn("label", F.col("accident").cast("double")))
    assert abs(ours - theirs) < 1e-9


def test_dedupe_with_a_hot_key(spark):
    """A third of all items share one title: one survivor, the first relevant
    one in (source_rank, article_id) order, and nothing else is lost."""
    i = Inputs(spark, SMALL)
    hot = "Bus crash kills two at Guindy, Chennai"
    arts = i.articles.withColumn("title", F.when(F.col("article_id") % 3 == 0, F.lit(hot)).otherwise(F.col("title")))
    out = rec.dedupe_articles(arts)
    hot_rows = out.where(F.col("dedupe_key") == hot.lower()[:60]).collect()
    expect = (arts.where(F.col("article_id") % 3 == 0)
              .orderBy("source_rank", "article_id").first())
    assert len(hot_rows) == 1 and hot_rows[0].article_id == expect.article_id
    rest = rec.dedupe_articles(arts.where(F.col("article_id") % 3 != 0))
    assert out.count() == rest.count() + 1


def test_asof_with_a_hot_cell_matches_brute_force(spark):
    """A third of probes and observations fall into one weather cell; the
    time-bucketed as-of lookup equals a brute-force range join."""
    from pyspark.sql import Window

    from roadlens.plans import alerts as al
    i = Inputs(spark, SMALL)
    hot = lambda df, idc: (df.withColumn("lat", F.when(F.col(idc) % 3 == 0, F.lit(13.05)).otherwise(F.col("lat")))
                             .withColumn("lng", F.when(F.col(idc) % 3 == 0, F.lit(80.25)).otherwise(F.col("lng"))))
    probes, obs = hot(i.probes, "probe_id"), hot(i.weather_obs, "obs_id")
    ttl = 86400
    got = al.weather_asof(probes, obs, ttl).select("probe_id", "obs_id")
    w = al.weather_table(obs).select("obs_id", "obs_ts", "cell_lat", "cell_lng")
    p = probes.withColumn("cell_lat", F.floor(F.col("lat") * 100 + 0.5).cast("long")) \
              .withColumn("cell_lng", F.floor(F.col("lng") * 100 + 0.5).cast("long"))
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("obs_ts").cast("timestamp"))
    pairs = (p.join(w, ["cell_lat", "cell_lng"]).where((F.col("obs_ts") <= F.col("ts")) & (age < ttl * 1_000_000))
             .withColumn("rn", F.row_number().over(Window.partitionBy("probe_id")
                                                   .orderBy(F.desc("obs_ts"), F.desc("obs_id"))))
             .where("rn = 1").select("probe_id", "obs_id"))
    brute = p.select("probe_id").join(pairs, "probe_id", "left")
    assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0
    assert got.where("obs_id IS NOT NULL").count() > 0


def test_auc_of_continuous_scores(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 3000)
    s = np.clip(rng.normal(0.4 + 0.1 * y, 0.3), -0.2, 1.2)   # also outside 0..1
    s[:600] = 0.5                                            # one large tie
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, accident int")
    pos, neg = s[y == 1], s[y == 0]
    want = float(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))
    got = tr.roc_auc(df, "score").first()
    assert abs(got.auc - want) < 1e-12 and got.n_pos == len(pos)
    assert tr.roc_auc(df.where("accident = 1"), "score").first().auc is None
    assert tr.roc_auc(df.limit(0), "score").first().auc is None


def test_asof_rows_without_key_skip_the_shuffle(spark):
    from roadlens.operators import asof
    left = spark.sql("SELECT id AS l, CASE WHEN id % 2 = 0 THEN id % 3 END AS k, TIMESTAMP_NTZ '2024-01-01 00:00:00' "
                     "+ make_dt_interval(0, 0, 0, id) AS ts FROM range(40)")
    right = spark.sql("SELECT id AS r, CASE WHEN id % 5 > 0 THEN id % 3 END AS k, TIMESTAMP_NTZ '2024-01-01 00:00:00' "
                      "+ make_dt_interval(0, 0, 0, id) AS ts FROM range(40)")
    out = {x.l: x.m_r for x in asof.asof_latest(left, right, ["k"], "ts", "ts", 7, ["r"], "r").collect()}
    want = {i: (max((r for r in range(40) if r % 5 and r % 3 == i % 3 and 0 <= i - r < 7), default=None)
                if i % 2 == 0 else None) for i in range(40)}
    assert out == want


def test_links_quoted_either_way_or_not_at_all(spark):
    from roadlens.sources import feeds
    html = """<a href="/one">One</a><A class=x HREF='/two'><b>Two</b></A><a href=/three>Three</a><a data-href="/no">No</a>"""
    df = spark.createDataFrame([(1, "https://h.example/p", html)], "page_id int, url string, html string")
    got = [(r.text, r.href) for r in feeds.extract_links(df).orderBy("pos").collect()]
    assert got == [("One", "https://h.example/one"), ("Two", "https://h.example/two"), ("Three", "https://h.example/three")]
