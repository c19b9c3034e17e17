"""Operator 11: ranked lexical search by an Aho-Corasick scan of the documents.

All distinct terms of the items go into one automaton, each between two guards
(a blank), and the automaton is broadcast.  A text is lower-cased (A-Z), every
character outside terms becomes a blank, and one scan finds all occurrences of
all terms: a match is a whole term, as the guards are part of it, and the guard
between two terms serves both.  Nothing is indexed or kept per document.

1. A first scan counts documents, terms, and per item term the documents that
   hold it; every task hands on one row per term found.
2. A second scan counts tf, scores each document for the items its terms map
   to, and keeps per task and item the best ``top`` documents.
3. The tasks' lists are ranked per item in two steps: first within ``SALTS``
   groups of an item's rows, then over the groups' best.

An item is all rows of one item_id.  The broadcast has a bound: items are dealt
into slices by their hash, so many that a slice has about ``slice_terms`` pairs
of item and term; each slice takes its two scans.

The score is in whole numbers: w * ((10^9 tf) div (1000 tf + 20 m)) summed over
an item's distinct terms, with w = floor(1000 ln((2N+2) / (2df+1))) and
m = 50 + (50 n N) div L.

Cases: null texts have no terms; items or documents without terms give no rows;
a null item_id is an item; repeated documents are ranked each; equal scores go
by doc_id, null ids (an integer column) last; empty tables give no rows; extra
columns are not read.  A long text is scanned whole by one task.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, only

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
SLICE_TERMS = 500_000
SALTS = 64
#: cells of documents x items that are scored at once
_CELLS = 1 << 22
#: candidates that a task holds before it keeps the best of every item
_HELD = 1 << 18

#: bytes of a text: A-Z lower-cased, everything outside terms a blank
_GUARDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
                 for b in range(256))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, term)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
    return only(items, item_id=id_col, text=text_col).select("item_id", F.explode(terms).alias("term")).distinct()


class Terms:
    """Terms of one slice and the items they map to, as the tasks use them."""

    def __init__(self, rows: list):
        self.items = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x))
        self.terms = sorted({r["term"] for r in rows})
        item, term = ({x: i for i, x in enumerate(xs)} for xs in (self.items, self.terms))
        pairs = np.array(sorted((term[r["term"]], item[r["item_id"]]) for r in rows), dtype=np.int64).reshape(-1, 2)
        self.owners = pairs[:, 1]  # items of term t: owners[first[t]:first[t + 1]]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))

    @functools.cached_property
    def automaton(self):
        found = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            found.add_word(f" {t} ", i)
        found.make_automaton()
        return found

    def __getstate__(self):  # the automaton is made by the task, once per broadcast
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def scan(self, column) -> Iterator[tuple[int, np.ndarray]]:
        """(number of terms, item terms found with repeats) of every text."""
        for text in column:
            guarded = (text.as_py() or "").encode().translate(_GUARDED)
            n = len(guarded.split())
            hits = [i for _, i in self.automaton.iter(f" {guarded.decode()} ")] if n else []
            yield n, np.array(hits, dtype=np.int64)


def _statistics(texts: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """N, L and the documents that hold each term; at most a slice's terms reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        held = np.zeros(len(terms.terms) + 2, dtype=np.int64)
        for batch in batches:
            for n, hits in terms.scan(batch["text"]):
                held[np.unique(hits)] += 1
                held[-2:] += (n > 0, n)
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], names=["term", "n"])

    out = np.zeros(len(shared.value.terms) + 2, dtype=np.int64)
    summed = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[summed["term"].to_numpy()] = summed["n"].to_numpy()
    return int(out[-2]), int(out[-1]), out[:-2]


class Best:
    """The ``top`` best documents of every item among those offered so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.zeros(n_items, dtype=np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = (score > 0) & (score >= self.least[item])
        self.parts.append((item[good], score[good], doc[good], null[good]))
        self.held += int(good.sum())
        if self.held > _HELD + 2 * self.top * len(self.least):
            self.trim()

    def trim(self) -> tuple[np.ndarray, ...]:
        cols = [np.concatenate(c) for c in zip(*self.parts)] if self.parts else [np.empty(0, np.int64)] * 4
        item, score, doc, null = cols
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.top]
        last = np.flatnonzero(place == self.top - 1)
        self.least[item[last]] = score[order][last]
        self.parts, self.held = [tuple(c[kept] for c in cols)], len(kept)
        return self.parts[0]


def _scored(docs: DataFrame, shared, n_docs: int, length: int, weights: np.ndarray, top: int, kind) -> DataFrame:
    """(item_id, doc_id, score): every task's best of every item; ``kind`` is the type of item ids."""
    in_arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        n_items, n_terms = len(terms.items), len(terms.terms)
        best = Best(n_items, top)
        block = max(1, _CELLS // n_items)
        for batch in batches:
            ids = batch["doc_id"]
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            for base in range(0, len(ids), block):
                scanned = list(terms.scan(batch["text"].slice(base, block)))
                m = np.array([50 + (50 * n * n_docs) // length for n, _ in scanned], dtype=np.int64)
                where = np.repeat(np.arange(len(scanned)), [len(h) for _, h in scanned])
                found, tf = np.unique(where * n_terms + np.concatenate([h for _, h in scanned]), return_counts=True)
                row, term = np.divmod(found, n_terms)
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                # every (document, term) once for each item of the term
                fan = terms.first[term + 1] - terms.first[term]
                again = np.repeat(np.arange(len(term)), fan)
                owner = terms.owners[np.arange(len(again)) - np.repeat(np.cumsum(fan) - fan, fan) + terms.first[term][again]]
                scores = np.zeros(len(scanned) * n_items, dtype=np.int64)
                np.add.at(scores, row[again] * n_items + owner, part[again])
                cells = np.flatnonzero(scores)
                at, item = np.divmod(cells, n_items)
                best.offer(item, scores[cells], doc[base + at], null[base + at])
        item, score, found, null = best.trim()
        yield pa.RecordBatch.from_arrays(
            [pa.array([terms.items[i] for i in item], in_arrow),
             pa.array(found.astype(np.int64), mask=null.astype(bool)), pa.array(score)], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, f"item_id {kind.simpleString()}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", doc_text: str = "text",
           item_id: str = "item_id", item_text: str = "text", slice_terms: int = SLICE_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    named = only(docs, doc_id=doc_id, text=doc_text).withColumn("doc_id", F.col("doc_id").cast("long"))
    pairs = materialize(item_terms(items, item_id, item_text), "item-terms")
    slices = max(1, -(-pairs.count() // slice_terms))
    kind = pairs.schema["item_id"].dataType
    found = []
    for part in range(slices):
        mine = pairs if slices == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == part)
        shared = spark.sparkContext.broadcast(Terms(mine.collect()))  # about ``slice_terms`` pairs
        if not shared.value.terms:
            continue
        n_docs, length, held = _statistics(named, shared)
        if not length:  # no document has a term
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], dtype=np.int64)
        found.append(_scored(named, shared, n_docs, length, weights, top, kind))
    if not found:
        return spark.createDataFrame([], f"{item_id} {kind.simpleString()}, rank int, doc_id long, score long")
    rows = functools.reduce(DataFrame.unionByName, found)
    best_first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("item_id", "salt").orderBy(*best_first)
    rows = (rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
            .withColumn("place", F.row_number().over(salted)).where(F.col("place") <= top))
    rows = (rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best_first)))
            .where(F.col("rank") <= top))
    return rows.select(F.col("item_id").alias(item_id), "rank", "doc_id", "score")


#: The same ranking for the given tables, in DuckDB SQL.
SEARCH_SQL = r"""
WITH words AS (
  SELECT d, doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
tf AS (SELECT d, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, tf.d, tf.doc_id,
         sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM tf JOIN wanted USING (term) JOIN df USING (term) JOIN len ON len.d = tf.d, whole
  GROUP BY item_id, tf.d, tf.doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
