"""Operator 3 (built-in functions only): quality rules and a hashed n-gram likelihood ratio.

Rules on whole texts give the base columns.  The verdict comes from two
multinomials over hashed word n-grams (default: single words): one counted on
trusted documents (label quality 1, not toxic), one on the whole raw corpus.
A document's score is the mean, over its n-grams, of

    log((trusted count + k) / (expected count + k)),

where the expected count is the raw count scaled to the trusted total.  The
ratios are whole numbers of a millionth, so scores don't depend on the order
of additions, and ``score >= threshold`` decides every document.

Counting aggregates by bucket inside every task before the shuffle (at most
``buckets`` rows a task), so no frequent word meets in one place.  The ratios
are one row with an array of ``buckets`` numbers, made by Spark and written; the
scoring plan reads it by a scalar subquery, so no table is part of a plan or
passes through the driver's Python.  Trusted
ids come from a bounded sample of the labels: the ``trusted_rows`` smallest by
hash; all raw counts cover every row.

Cases: null is the empty text (no words, base_failed).  A corpus without
trusted documents has ratios of 0, so only the rules decide.  Repeated rows
are counted and judged each for itself.  Extra columns are carried along
untouched by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BUCKETS = 1 << 18
SMOOTHING = 2.0
THRESHOLD = -0.6
TRUSTED_ROWS = 100_000
UNIT = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def ngram_hashes(hashes: Column, n: int) -> Column:
    """Hashes of the n-grams of an array of word hashes (itself for n = 1)."""
    if n == 1:
        return hashes
    starts = F.when(F.size(hashes) >= n, F.sequence(F.lit(1), F.size(hashes) - (n - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, n))),
                      F.array().cast("array<long>"))


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Adds _words and _hashes, each computed once per row."""
    return (df.withColumn("_words", words_of(F.col(text)))
              .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))))


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds the base columns; expects the columns of ``with_words``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = (df.withColumn("n_words", F.size("_words").cast("long"))
            .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
            .withColumn("n_symbols", F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"))
            .withColumn("_lines", lines)
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("_windows", ngram_hashes(F.col("_hashes"), WINDOW))
            .withColumn("_again", F.size(F.array_distinct("_windows")) < F.size("_windows")))
    # windows in the order of their hashes: equal ones are neighbours
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get("_sorted", k)["h"]
    twice = F.filter("_sorted", lambda x, k: x["h"].eqNullSafe(at(k - 1)) | x["h"].eqNullSafe(at(k + 1)))
    df = df.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a window covers its words up to the next such window
    covered = F.transform("_starts", lambda p, j: F.least(
        F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (df.withColumn("base_failed", failed)
              .drop("_lines", "_windows", "_again", "_sorted", "_starts"))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``limit`` doc_ids of good, non-toxic labels: the smallest by hash."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def ratio_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1,
                buckets: int = BUCKETS, smoothing: float = SMOOTHING, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row: ``ratios``, the log ratio of every bucket in units of 1 / UNIT."""
    trusted = trusted_ids(labels, trusted_rows).select("doc_id", F.lit(1).alias("_trusted"))
    rows = with_words(only(docs, doc_id=id_col, text=text_col), "text")
    rows = rows.select("doc_id", ngram_hashes(F.col("_hashes"), n).alias("g"))
    rows = rows.join(F.broadcast(trusted), "doc_id", "left")
    counts = materialize(rows.select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode("g").alias("h"))
                         .groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("b"))
                         .agg(F.count("*").alias("raw"), F.sum("t").alias("good")), "ratio-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    if not total["good"]:
        return one_row(counts.limit(0).select("b"), {"ratios": F.lit(0)}, buckets)
    expected = F.col("raw") * F.lit(total["good"] / total["raw"])
    return one_row(counts, {"ratios": F.log((F.col("good") + smoothing) / (expected + smoothing))}, buckets)


def one_row(counts: DataFrame, ratios: dict[str, Column], buckets: int) -> DataFrame:
    """A written table of one row with an array of ``buckets`` whole numbers for each of ``ratios``, in units of 1 / UNIT;
    0 for a bucket ``b`` that ``counts`` hasn't.  One task puts the arrays together from as many rows."""
    values = counts.select("b", *[F.rint(x * F.lit(float(UNIT))).cast("int").alias(c) for c, x in ratios.items()])
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(values, "b", "left")
    every = every.agg(F.sort_array(F.collect_list(F.struct("b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ratios]))).alias("x"))
    return materialize(every.select(*[F.col(f"x.{c}").alias(c) for c in ratios]), "ratios")


def settled(df: DataFrame) -> DataFrame:
    """The rows behind a Generate, above which the columns are plain attributes.  A subquery's value that is used once
    there is put where it is used; otherwise the optimizer would keep it as a column, and every row would carry it."""
    return df.select("*", F.explode(F.array(F.lit(0))).alias("_one")).drop("_one")


def total_of(indices: Column, table: str) -> Column:
    """Sum of the entries of the array column ``table`` at the indices."""
    return F.aggregate(indices, F.lit(0).cast("long"), lambda a, i: a + F.get(F.col(table), i))


def with_verdict(df: DataFrame, table: DataFrame, n: int = 1, threshold: float = THRESHOLD,
                 buckets: int = BUCKETS) -> DataFrame:
    """Adds score (mean log ratio, 0 without n-grams) and kept."""
    grams = F.transform(ngram_hashes(F.col("_hashes"), n), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    df = settled(df.withColumn("_grams", grams)).withColumn("_table", table.select("ratios").scalar())
    df = df.withColumn("_total", total_of(F.col("_grams"), "_table")).drop("_table")
    enough = F.col("_total") >= F.lit(round(threshold * UNIT)) * F.size("_grams").cast("long")
    score = F.when(F.size("_grams") > 0, F.col("_total") / F.size("_grams") / UNIT).otherwise(0.0)
    return (df.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & enough)
              .drop("_grams", "_total"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1,
            threshold: float = THRESHOLD, buckets: int = BUCKETS, **options) -> DataFrame:
    """doc_id, the base columns, score and kept of every document."""
    table = ratio_table(docs, labels, id_col, text_col, n, buckets, **options)
    rows = with_base(with_words(only(docs, doc_id=id_col, text=text_col), "text"), "text")
    rows = with_verdict(rows, table, n, threshold, buckets)
    return rows.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1,
              threshold: float = THRESHOLD, buckets: int = BUCKETS, **options) -> DataFrame:
    """The documents that are kept, all columns as they are."""
    table = ratio_table(docs, labels, id_col, text_col, n, buckets, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       F.col(f"`{text_col}`").alias("_text"))
    rows = with_verdict(with_base(with_words(rows, "_text"), "_text"), table, n, threshold, buckets)
    # a generated column: a filter on it is not pushed down, where the rules would be computed again inside it
    return rows.select("_doc", F.explode_outer(F.array("kept")).alias("_keep")).where("_keep").select("_doc.*")
