"""Plan-shape checks: the properties the jobs are designed around at scale."""

from conftest import SMALL
from roadlens.plans import registry


def plan(spark, name):
    df = registry.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_history_search_is_an_equi_join(spark):
    p = plan(spark, "history_near")
    assert "NestedLoopJoin" not in p
    assert "HashJoin" in p or "SortMergeJoin" in p


def test_dedupe_limits_before_the_shuffle(spark):
    from roadlens.plans import registry
    df = registry.queries()["article_dedupe"](spark, SMALL)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    exch = [k for k, ln in enumerate(lines) if "Exchange hashpartitioning(dedupe_key" in ln]
    partial = [k for k, ln in enumerate(lines) if "WindowGroupLimit" in ln and "Partial" in ln]
    assert exch and partial and partial[0] > exch[0]   # the partial limit runs map-side, below the exchange


def test_no_python_in_hot_paths(spark):
    for name in ["article_records", "history_near", "full_alerts_rules", "weather_asof", "routes_asof",
                 "stratified_split", "roc_auc", "severity"]:
        p = plan(spark, name)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p, name


def physical(spark, name):
    return registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_relevance_filter_is_below_the_dedupe_shuffle(spark):
    lines = physical(spark, "article_dedupe").splitlines()
    exchange = next(k for k, ln in enumerate(lines) if "Exchange hashpartitioning(dedupe_key" in ln)
    kept = [k for k, ln in enumerate(lines) if "Filter is_relevant" in ln]
    assert kept and kept[0] > exchange


def test_sources_are_scanned_once(spark):
    assert physical(spark, "union_sources").count("FileScan parquet") == 1


def test_region_summary_computes_only_its_columns(spark):
    p = physical(spark, "region_summary")
    assert p.count("FileScan parquet") == 1 and "events.parquet" in p   # no written record table
    assert "headline" not in p and "congestion_pct" not in p
