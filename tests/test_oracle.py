"""Every registered query against its DuckDB oracle on the smallest tables
(row count, column names, order-insensitive value hash), as the driver's
correctness gate does at sf0.01."""

import pytest

import __spark_entry__ as E
from compare import compare, diff
from conftest import SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()
MODEL_KEYS = {"evaluate", "score_ensemble", "score_requests", "zone_board", "importances", "model_meta", "full_alerts"}


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k in ORACLES))
def test_oracle(spark, duck_small, name):
    r = compare(spark, duck_small, name, QUERIES[name], ORACLES[name], SMALL)
    if not (r["cols"] and r["count"] and r["hash"]):
        diff(r)
    assert r["cols"], (r["s_cols"], r["d_cols"])
    assert r["count"], (r["rows_spark"], r["rows_oracle"])
    assert r["hash"]


def test_every_key_has_an_oracle_or_is_model_backed():
    from roadlens.plans import registry
    missing = set(registry.QUERIES) - set(ORACLES)
    assert missing <= MODEL_KEYS, missing
    assert {k + "_checked" for k in MODEL_KEYS} <= set(ORACLES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and df.columns == ["zone", "risk", "incidents"]


def test_model_backed_queries_run(spark):
    ev = QUERIES["evaluate"](spark, SMALL).collect()[0]
    assert 0.0 <= ev.ensemble_auc <= 1.0
    s = QUERIES["score_requests"](spark, SMALL)
    assert s.where("accident_probability < 0 OR accident_probability > 1").count() == 0
    assert QUERIES["full_alerts"](spark, SMALL).count() == QUERIES["full_alerts_rules"](spark, SMALL).count()


def test_scenario_scores(spark):
    """The five named rows scored by the model trained on the driver's data."""
    from roadlens import dims
    from roadlens.plans import registry, train
    from roadlens.plans.inputs import Inputs
    model, _, _ = registry._trained(Inputs(spark, SMALL))
    rows = train.scenario_scores(spark, model).collect()
    assert [r.scenario for r in rows] == [s for s, _ in dims.SCENARIOS]
    for r in rows:
        assert 0.0 <= r.probability <= 1.0
        assert abs(r.probability - (0.55 * r.gbt_probability + 0.45 * r.rf_probability)) < 1e-12
