"""Operator 5 (built-in functions only): soft-membership mixing to target weights.

1. A classifier fitted on labelled documents gives every document a posterior
   over domains (``good``, ``low`` quality, ``toxic``).  It adds up, over the
   hashed words of a document, the log ratio of a domain's count to its
   expected count.  Smoothing and a least weight of evidence leave out words
   that are rare or that a domain merely favours (as one language does), so
   that long documents are not decided by many small biases.  ``good`` is the
   domain without evidence against it: the other domains start at the log odds
   ``NO_EVIDENCE``.  The sums are normalised by the softmax.
2. Rates r >= 0, one per document, are fitted by projected gradient descent on

       sum_k (sum_d r_d n_d p_dk - T_k)^2 / (2 E_k) + ridge / 2 * sum_d n_d (r_d - 1)^2

   with n_d the tokens, p_dk the posteriors, E_k the expected tokens of domain
   k, and targets T_k in the ratio of the weights, scaled so that the domain
   ``good`` keeps its tokens.  A domain with fewer tokens than its target gets
   rates above 1, as high as the target asks.  The ridge makes the solution
   unique and leaves totals within a hundredth of a reachable target.
   The gradient of a rate is a combination of its K posteriors, so from rates
   of 1 every step stays in the form r_d = max(0, 1 - sum_k a_k p_dk): the fit
   moves the K numbers a_k, and no rate is ever written or shuffled.  A step is
   one aggregate: the totals, and the K x K products of the posteriors of the
   documents with a rate above 0, whose inverse scales the step.  Steps are
   halved until the objective falls; they end when every total is within the
   tolerance of the optimum, or when no step lowers the objective any more.
3. Whole copies: every rate ``r`` gives ``floor(r + u)`` with ``u`` uniform by
   the hash of the doc_id, so a domain's expected kept tokens are those of its
   rates.

The sums over documents are taken in whole millionths, so they don't depend on
the order.  The classifier's sample is bounded (``labelled_rows`` smallest
doc_ids by hash); posteriors, tokens and residuals cover every document.

Cases: null or word-less texts have no tokens and the posterior
without evidence; they never move a total.  A domain without tokens is left out of the fit; where
``good`` has none, the other domains share all tokens by their weights.  Where posteriors are so wide that no rates
reach the targets, the fit is the nearest in the sense above.  Documents with equal posteriors get equal rates.
Without labels every document is equally near ``good``.  Repeated rows count each for itself and
share the draw of their doc_id.  An empty table has no rates.  Extra columns
are carried along by ``mix`` whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only
from .quality import UNIT, one_row, settled, total_of, words_of

DOMAINS = ["good", "low", "toxic"]
WEIGHTS = {"good": 0.94, "low": 0.04, "toxic": 0.02}
BUCKETS = 1 << 17
SMOOTHING = 10.0
LEAST_EVIDENCE = 0.8
NO_EVIDENCE = -5.0
LABELLED_ROWS = 100_000
RIDGE = 1e-4
TOLERANCE = 1e-6


def buckets_of(text: Column, buckets: int) -> Column:
    return F.transform(words_of(text), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def labelled_domains(labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, domain index) of at most ``limit`` labelled documents."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    known = labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_classifier(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING,
                   labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """One row with the ratio table of every domain but the first, in units of 1 / UNIT.  ``docs``: doc_id, text."""
    sample = labelled_domains(labels, labelled_rows)
    rows = docs.join(F.broadcast(sample), "doc_id")
    names = [f"c{k}" for k in range(len(DOMAINS))]
    counts = materialize(rows.select("domain", F.explode(buckets_of(F.col("text"), buckets)).alias("b"))
                         .groupBy("b").agg(*[F.count_if(F.col("domain") == k).alias(c) for k, c in enumerate(names)]),
                         "domain-counts")
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    every = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    tables = {}
    for d, c in zip(DOMAINS[1:], names[1:]):
        weight = F.lit(0.0)
        if totals[c]:
            expected = every * F.lit(totals[c] / sum(totals))
            weight = F.log((F.col(c) + smoothing) / (expected + smoothing))
        tables[f"w_{d}"] = F.when(F.abs(weight) >= LEAST_EVIDENCE, weight).otherwise(0.0)
    return one_row(counts, tables, buckets)


def with_posteriors(rows: DataFrame, tables: DataFrame, text: str = "text", no_evidence: float = NO_EVIDENCE,
                    buckets: int = BUCKETS) -> DataFrame:
    """Adds n_tokens (words) and p_<domain>."""
    rows = rows.withColumn("_b", buckets_of(F.col(text), buckets)).withColumn("n_tokens", F.size("_b").cast("long"))
    rows = settled(rows)
    for d in DOMAINS[1:]:
        rows = rows.withColumn("_table", tables.select(f"w_{d}").scalar())
        logit = F.lit(no_evidence) + total_of(F.col("_b"), "_table") * F.lit(1 / UNIT)
        rows = rows.withColumn(f"_l_{d}", F.least(F.lit(500.0), logit)).drop("_table")
    logits = [F.lit(0.0), *[F.col(f"_l_{d}") for d in DOMAINS[1:]]]
    rows = rows.withColumn("_top", F.greatest(*logits))
    powers = [F.exp(x - F.col("_top")) for x in logits]
    whole = sum(powers[1:], powers[0])
    rows = rows.withColumns({f"p_{d}": p / whole for d, p in zip(DOMAINS, powers)})
    return rows.drop("_b", "_top", *[f"_l_{d}" for d in DOMAINS[1:]])


def _rate(pull: np.ndarray) -> Column:
    """The rate of a document for the numbers ``a_k``."""
    rate = F.lit(1.0)
    for d, a in zip(DOMAINS, pull):
        rate = rate - F.col(f"p_{d}") * F.lit(float(a))
    return F.greatest(F.lit(0.0), rate)


def targets_of(expected: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """Tokens that every domain shall have."""
    shares = np.array([weights[d] for d in DOMAINS]) * (expected > 0)
    if not shares.sum():
        return expected * 0
    return shares * (expected[0] / shares[0] if shares[0] else expected.sum() / shares.sum())


def fit_rates(table: DataFrame, weights: dict[str, float], ridge: float = RIDGE,
              tolerance: float = TOLERANCE) -> DataFrame:
    """``table`` (n_tokens, p_<domain>, any more) with the fitted ``_rate``."""
    size = len(DOMAINS)
    pairs = [(j, k) for j in range(size) for k in range(j, size)]

    def sums(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Tokens by domain, products of the posteriors in use, and the sum of squared rates."""
        n, rate, p = F.col("n_tokens"), _rate(pull), [F.col(f"p_{d}") for d in DOMAINS]
        used = F.when(rate > 0, n).otherwise(0)
        parts = [n * rate * x for x in p] + [used * p[j] * p[k] for j, k in pairs] + [n * rate * rate]
        row = table.agg(*[F.sum(F.round(x * UNIT).cast("decimal(38,0)")).alias(f"s{i}")
                          for i, x in enumerate(parts)]).first()
        found = np.array([float(x or 0) / UNIT for x in row])
        products = np.zeros((size, size))
        for (j, k), x in zip(pairs, found[size:-1]):
            products[j, k] = products[k, j] = x
        return found[:size], products, found[-1]

    pull = np.zeros(size)
    now, products, squares = sums(pull)
    expected = now
    targets, open_ = targets_of(expected, weights), expected > 0

    def height(pull: np.ndarray, squares: float) -> float:  # its least point holds the fitted a_k
        return squares / 2 + pull @ targets + ridge / 2 * (expected * pull) @ pull

    while open_.any():
        off = (now - targets - ridge * expected * pull) * open_
        if (np.abs(off) <= tolerance * np.maximum(targets, expected)).all():
            break
        scale = products + np.diag(np.where(open_, ridge * expected, 1.0))
        step, share, at = np.linalg.solve(scale, off), 1.0, height(pull, squares)
        while True:
            after = pull + share * step
            now, products, squares = sums(after)
            if height(after, squares) <= at - 1e-4 * share * (off @ step):
                break
            share /= 2
            if share < 1e-9:  # rounding: nothing left to gain
                return table.withColumn("_rate", _rate(pull))
        pull = after
    return table.withColumn("_rate", _rate(pull))


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies of a document with this rate."""
    draw = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + draw).cast("int")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, **options) -> DataFrame:
    named = only(docs, doc_id=id_col, text=text_col)
    tables = fit_classifier(named, labels, buckets, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_posteriors(rows, tables, buckets=buckets)


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id",
          text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies of every document."""
    scored = _scored(docs, labels, id_col, text_col, **options)
    table = materialize(scored.select("doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS]), "posteriors")
    table = fit_rates(table, weights or WEIGHTS).withColumnRenamed("_rate", "rate")
    return (table.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))
            .withColumnRenamed("doc_id", id_col))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id",
        text_col: str = "text", **options) -> DataFrame:
    """The documents, each as often as its copies, all columns kept as they are."""
    scored = _scored(docs, labels, id_col, text_col, **options)
    table = materialize(scored.withColumn("_row", F.monotonically_increasing_id()).drop("text"), "scored")
    small = ["_row", "doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS]]
    fitted = fit_rates(table.select(*small), weights or WEIGHTS)  # reads the few narrow columns only
    copies = fitted.select("_row", copies_of(F.col("_rate"), F.col("doc_id")).alias("_copies"))
    table = table.select("_row", "_doc").join(copies.where("_copies > 0"), "_row")
    return table.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_n")).select("_doc.*")
