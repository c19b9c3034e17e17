"""Sources and sinks: many-file history scan (S2), first-existing path (S3),
partitioned dataset sink (S10), feed XML round trip (S4)."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from roadlens.operators import model as ml
from roadlens.plans.inputs import Inputs
from roadlens.sources import accidents as src


def test_history_many_files(spark):
    i = Inputs(spark, SMALL)
    d = tempfile.mkdtemp(prefix="roadlens-src-")
    ds = i.dataset
    src.write_dataset_csv(ds.where("record_id < 'pos-5'"), f"{d}/a")
    src.write_dataset_csv(ds.where("record_id >= 'pos-5' OR record_id LIKE 'neg%'"), f"{d}/b")
    ds.select("record_id", "headline").write.option("header", True).csv(f"{d}/no_label")
    hist = src.read_accident_history(spark, [f"{d}/a", f"{d}/no_label", f"{d}/missing", f"{d}/b"])
    assert hist.where("accident <> 1").count() == 0
    assert hist.count() == ds.where("accident = 1").count()
    assert sorted(r.file_rank for r in hist.select("file_rank").distinct().collect()) == [0, 3]


def test_first_existing(spark):
    d = tempfile.mkdtemp(prefix="roadlens-src-")
    spark.range(3).write.parquet(f"{d}/second")
    assert src.first_existing(spark, [f"{d}/first", f"{d}/second"]) == f"{d}/second"
    assert src.first_existing(spark, [f"{d}/none"]) is None


def test_partitioned_sink_prunes(spark):
    i = Inputs(spark, SMALL)
    d = tempfile.mkdtemp(prefix="roadlens-src-")
    src.write_dataset(i.dataset, f"{d}/ds")
    pos = src.read_dataset(spark, f"{d}/ds", positives_only=True)
    plan = pos._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(accident" in plan
    assert pos.count() == i.dataset.where(F.col("accident") == 1).count()


def test_columns_are_read_by_name(spark, tmp_path):
    """A file with another column order, an unknown column and missing ones keeps its rows."""
    from roadlens.schemas import ACCIDENT_COLUMNS
    from roadlens.sources import accidents as src
    (tmp_path / "a.csv").write_text("accident,hour,extra,zone,latitude\n1,7,x,North,13.05\n0,bad,y,,1\n")
    (tmp_path / "b.csv").write_text("zone,hour\nNorth,3\n")
    df = src.read_accidents(spark, str(tmp_path / "a.csv"))
    assert df.columns == ACCIDENT_COLUMNS
    rows = {r.accident: r for r in df.collect()}
    assert (rows[1].hour, rows[1].zone, rows[1].latitude, rows[1].headline) == (7, "North", 13.05, None)
    assert rows[0].hour is None and rows[0].zone is None
    paths = [str(tmp_path / x) for x in ("a.csv", "b.csv", "missing.csv")]
    assert [(r.accident, r.hour, r.file_rank) for r in src.read_accident_history(spark, paths).collect()] == [(1, 7, 0)]


def test_files_of_a_folder_with_other_column_orders(spark, tmp_path):
    """Each file is read by its own header; what doesn't fit comes back in columns of its own."""
    import gzip
    folder = tmp_path / "some files"
    folder.mkdir()
    (folder / "a.csv").write_text("accident,headline,zone\n1,first,North\n")
    (folder / "b.csv").write_text('headline,zone,accident\n"second, with\na break",South,1\nthird,East,0\n')
    (folder / "c.csv").write_text("accident,headline,zone\n1,short\nyes,odd,West\n1,long,West,9\n")
    (folder / "d.csv").write_text("headline,zone\nno label,North\n")
    (folder / "e.csv").write_text("")
    with gzip.open(folder / "f.csv.gz", "wt") as f:
        f.write("zone,accident,headline\nCentral,1,packed\n")
    rows = {r.headline: r for r in src.read_accidents(spark, str(folder), errors=True).collect()}
    assert {h: (r.accident, r.zone) for h, r in rows.items()} == {
        "first": (1, "North"), "second, with\na break": (1, "South"), "third": (0, "East"), "short": (1, None),
        "odd": (None, "West"), "long": (1, "West"), "no label": (None, "North"), "packed": (1, "Central")}
    assert {h for h, r in rows.items() if r._corrupt_record} == {"short", "long"}
    assert {h: r._bad_fields for h, r in rows.items() if r._bad_fields} == {"odd": ["accident"]}
    assert len(src.read_accidents(spark, str(folder)).columns) == 34
    hist = src.read_accident_history(spark, [str(folder / "missing"), str(folder)]).collect()
    assert sorted(r.headline for r in hist) == ["first", "long", "packed", "second, with\na break", "short"]
    assert {r.file_rank for r in hist} == {1}


def test_no_files_or_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert src.read_accidents(spark, str(tmp_path)).count() == 0
    assert src.read_accident_history(spark, [str(tmp_path), str(tmp_path / "missing")]).count() == 0


def test_metadata_absent_and_variants(spark, tmp_path):
    """No file is an error; the builder's form states name and sources, the retrainings' form doesn't."""
    with pytest.raises(FileNotFoundError, match="not trained"):
        ml.read_metadata(spark, str(tmp_path / "none"))
    data = spark.createDataFrame([(1,), (0,), (1,)], "accident int")
    metrics = spark.createDataFrame([(0.9, 0.8)], "gbt_auc double, rf_auc double")
    plain = ml.model_metadata(data, metrics)
    named = ml.model_metadata(data, metrics, name="News dataset", sources=["feed", "site"])
    assert set(named.columns) - set(plain.columns) == {"dataset", "sources"}
    named.write.json(str(tmp_path / "meta"))
    row = ml.read_metadata(spark, str(tmp_path / "meta")).first()
    assert (row.total_records, row.accident_rows, row.dataset, row.sources) == (3, 2, "News dataset", ["feed", "site"])
