"""Accident dataset sources and sinks.

CSV is the exchange format of the original; Parquet partitioned by the label
is the internal form (``accident = 1`` becomes partition pruning).
"""

from __future__ import annotations

import functools
import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..schemas import ACCIDENT, ACCIDENT_COLUMNS

_LOG = logging.getLogger(__name__)


def _first_line(spark: SparkSession, uri: str) -> str | None:
    """First line of a file, through the cluster's file system and its compression codecs; None for an empty file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        body = codec.createInputStream(stream) if codec else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(body, "UTF-8")).readLine()
    finally:
        stream.close()


def files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files under ``path``, those with the same header line together, in the order of their first file.

    Only the first line of every file is opened for this, by a few threads of the driver."""
    uris = sorted(spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        lines = pool.map(lambda u: _first_line(spark, u), uris)
        groups: dict[str, list[str]] = {}
        for uri, line in zip(uris, lines):
            if line is not None and line.strip():
                jvm = spark.sparkContext._jvm
                groups.setdefault(line, []).append(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString())
    return list(groups.values())


_BROKEN = "_broken_line"


def _read_files(spark: SparkSession, files: list[str], multi_line: bool) -> DataFrame:
    """CSV files of one header, all columns as text, with the line where a row has more or fewer fields than the header."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
    header = reader.csv(files[0]).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _BROKEN]])
    # Spark numbers repeated names of a header, which the check against the file would then refuse
    once = len({c.lower() for c in header}) == len(header) and not any(c[-1:].isdigit() or c.startswith("_c") for c in header)
    return (reader.option("enforceSchema", not once).option("columnNameOfCorruptRecord", _BROKEN).schema(schema).csv(files))


def _typed(raw: DataFrame) -> DataFrame:
    """The 34 columns by name, and what didn't fit: ``_corrupt_record`` and ``_bad_fields``."""
    found = set(raw.columns)
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in ACCIDENT.fields if f.name in found}
    bad = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNotNull() & x.isNull(), F.lit(c)) for c, x in cast.items()],
                           F.lit(None).cast("string")), lambda c: c.isNotNull())
    return raw.select(*[cast.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in ACCIDENT.fields],
                      F.col(_BROKEN).alias("_corrupt_record"), bad.alias("_bad_fields"))


def read_accidents(spark: SparkSession, path: str, multi_line: bool = True, errors: bool = False) -> DataFrame:
    """Header CSV with the declared 34-column schema (no inference).

    Columns are taken by the names in each file's own header: files of a
    folder may have them in different orders.  A column that a file lacks is
    null, and a value that doesn't fit its type is null.  Empty fields read as
    null, as a pandas reader turns them into NaN.  Without line breaks inside
    fields, ``multi_line=False`` lets Spark split large files.

    With ``errors`` two columns follow, so that no loss is silent:
    ``_corrupt_record``, the line of a row with more or fewer fields than its
    header, and ``_bad_fields``, the names of the columns whose value didn't
    fit.  Empty files, and a folder without files, give no rows."""
    frames = [_typed(_read_files(spark, files, multi_line)) for files in files_by_header(spark, path)]
    if not frames:
        frames = [spark.createDataFrame([], T.StructType([*ACCIDENT.fields, *_ERROR_FIELDS]))]
    out = functools.reduce(DataFrame.unionByName, frames)
    return out if errors else out.drop(*[f.name for f in _ERROR_FIELDS])


_ERROR_FIELDS = [T.StructField("_corrupt_record", T.StringType()), T.StructField("_bad_fields", T.ArrayType(T.StringType()))]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the cluster's Hadoop file system (any scheme)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """S3: the first path that exists, in the given precedence order."""
    for p in paths:
        if path_exists(spark, p):
            return p
    return None


def read_accident_history(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """Many CSV files -> positives with a file-rank column.  Files whose
    header lacks ``accident`` and paths that don't exist are skipped, with a
    warning that names them; any other failure is raised."""
    frames = []
    for rank, p in enumerate(paths):
        try:
            groups = files_by_header(spark, p)
        except AnalysisException as error:  # a missing file is skipped as in the original
            _LOG.warning("skipped %s: %s", p, str(error).split("\n")[0])
            continue
        for files in groups:
            raw = _read_files(spark, files, multi_line)
            if "accident" in raw.columns:
                frames.append(_typed(raw).select(*ACCIDENT_COLUMNS, F.lit(rank).alias("file_rank")).where("accident = 1"))
            else:
                _LOG.warning("skipped %s: no column accident", ", ".join(files))
    if not frames:
        return spark.createDataFrame([], T.StructType([*ACCIDENT.fields, T.StructField("file_rank", T.IntegerType())]))
    return functools.reduce(DataFrame.unionByName, frames)


def write_dataset_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """S10 (exchange form): header CSV of the 34 columns, or of those named."""
    df.select(*(columns or ACCIDENT_COLUMNS)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """Parquet partitioned by the label (the positive-only file of the
    original is the ``accident=1`` partition)."""
    df.write.mode("overwrite").partitionBy("accident").parquet(path)


def read_dataset(spark: SparkSession, path: str, positives_only: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("accident") == 1) if positives_only else df


def month_keyword_spine(articles: DataFrame, ts_col: str = "published_ts", keywords: list[str] | None = None) -> DataFrame:
    """Every month between the first and last published month, as
    half-open [month_start, next_month), crossed with the search keywords."""
    kws = keywords if keywords is not None else dims.RSS_KEYWORDS
    kw = F.array(*[F.struct(F.lit(i).alias("keyword_ord"), F.lit(k).alias("keyword")) for i, k in enumerate(kws)])
    rng = articles.agg(F.trunc(F.min(F.to_date(ts_col)), "month").alias("m0"),
                       F.trunc(F.max(F.to_date(ts_col)), "month").alias("m1"))
    months = rng.select(F.explode(F.sequence("m0", "m1", F.expr("INTERVAL 1 MONTH"))).alias("month_start"))
    return (months.withColumn("month_end", F.add_months("month_start", 1))
            .select("*", F.inline(kw))
            .select(F.date_format("month_start", "yyyy-MM-dd").alias("month_start"),
                    F.date_format("month_end", "yyyy-MM-dd").alias("month_end"), "keyword_ord", "keyword"))
