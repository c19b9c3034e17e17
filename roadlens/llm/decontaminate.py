"""Operator 8: benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark items are normalised to words, their windows of ``n`` words (an
item of fewer words is one window) are hashed, and the hash set is broadcast.
Tasks scan the word windows of whole documents: a bitmap of the hashes skips
nearly all windows, a sorted table finds the rest, and every hit is verified
by its words.  Hits become word spans, from which documents are flagged,
cleaned of the spans, or dropped.

The set is broadcast in slices of at most ``slice_windows`` distinct windows:
a benchmark below that size takes one scan, a larger one takes a scan per
slice, whose spans are then merged per document.  So the broadcast has a fixed
bound and no window is left out.

Cases: null texts have no words; an item without words has no windows; an
empty table of documents or items gives no rows or no hits; repeated rows are
scanned each for itself; null item ids are written as the empty string; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, only
from .wordarrays import ALNUM_WORDS, chunks

WINDOW = 10
SLICE_WINDOWS = 500_000
_BITMAP_BITS = 22


def item_windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (size, hash, words, item_id) of the items' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["item_id"]
            for base, w in chunks(batch["text"], ALNUM_WORDS):
                sizes, hashes, texts, owners = [], [], [], []
                counts = np.diff(w.first)
                for size in np.unique(np.minimum(counts[counts > 0], n)):
                    at, h = w.windows(int(size))
                    if size < n:  # only the items that consist of so many words
                        mine = counts[w.row[at]] == size
                        at, h = at[mine], h[mine]
                    sizes += [int(size)] * len(at)
                    hashes += h.view(np.int64).tolist()
                    texts += [w.text(i, i + int(size)) for i in at]
                    owners += [ids[base + int(r)].as_py() for r in w.row[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64()), pa.array(texts, pa.binary()),
                     pa.array(owners, pa.string())], names=["size", "hash", "words", "item_id"])

    named = only(items, item_id=id_col, text=text_col).withColumn("item_id", F.col("item_id").cast("string"))
    return named.mapInArrow(run, "size int, hash long, words binary, item_id string").distinct()


class WindowSet:
    """The windows of one slice, as the tasks use them."""

    def __init__(self, rows: list):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items: dict[bytes, list[str]] = {}
        sizes: dict[int, set[int]] = {}
        for r in rows:
            sizes.setdefault(r["size"], set()).add(r["hash"])
            self.items.setdefault(bytes(r["words"]), []).append(r["item_id"] or "")
        for size, hashes in sizes.items():
            table = np.sort(np.array(list(hashes), dtype=np.int64).view(np.uint64))
            bitmap = np.zeros(1 << _BITMAP_BITS, dtype=bool)
            bitmap[table >> np.uint64(64 - _BITMAP_BITS)] = True
            self.by_size[size] = table, bitmap

    def hits(self, w) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, size, items) of every verified window of the scanned words."""
        for size, (table, bitmap) in sorted(self.by_size.items()):
            at, h = w.windows(size)
            maybe = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITMAP_BITS)])
            if not len(maybe):
                continue
            at, h = at[maybe], h[maybe]
            found = np.minimum(np.searchsorted(table, h), len(table) - 1)
            for i in at[table[found] == h]:
                owners = self.items.get(w.text(int(i), int(i) + size))
                if owners:
                    yield int(i), size, owners


def merge_spans(spans) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _inner_names(columns: list[str], id_col: str, text_col: str) -> dict[str, str]:
    """Name used inside -> column of the caller, for all columns."""
    own = {id_col: "doc_id", text_col: "text"}
    return {own.get(c, f"_k{i}"): c for i, c in enumerate(columns)}


def _scan(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, slice_windows: int,
          carry: bool) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, contaminated; with ``carry`` also the text and
    the other columns, under inner names."""
    slices = max(1, -(-windows.count() // slice_windows))
    spark = docs.sparkSession
    names = _inner_names(docs.columns, id_col, text_col) if carry else {"doc_id": id_col, "text": text_col}
    named = only(docs, **names)
    if slices > 1:
        named = named.withColumn("_row", F.monotonically_increasing_id())
    out_schema = [f for f in named.schema.fields if carry or f.name != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out_schema)
    ddl += ", n_words long, spans array<struct<s:long,e:long>>, items array<string>"
    results = []
    for part in range(slices):
        mine = windows if slices == 1 else windows.where(F.pmod(F.xxhash64("hash", "item_id"), F.lit(slices)) == part)
        shared = spark.sparkContext.broadcast(WindowSet(mine.collect()))  # about slice_windows rows at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for base, w in chunks(batch["text"], ALNUM_WORDS):
                    spans: list[list] = [[] for _ in range(w.n_rows)]
                    items: list[set] = [set() for _ in range(w.n_rows)]
                    for i, size, owners in shared.value.hits(w):
                        row = int(w.row[i])
                        at = i - int(w.first[row])
                        spans[row].append((at, at + size))
                        items[row].update(owners)
                    spans = [merge_spans(s) if s else s for s in spans]
                    cols = {f.name: batch[f.name].slice(base, w.n_rows) for f in out_schema}
                    cols["n_words"] = pa.array(np.diff(w.first).astype(np.int64))
                    cols["spans"] = pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], _SPANS)
                    cols["items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_pydict(cols)

        results.append(named.mapInArrow(run, ddl))
    out = results[0]
    if slices > 1:
        out = _merge_slices(results, [f.name for f in out_schema])
    return (out.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + x.e - x.s)"))
               .withColumn("contaminated", F.size("spans") > 0))


def scan_documents(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """One row per document with n_words, n_hit, spans (hit word spans), items and contaminated.

    ``windows`` is a written table of ``item_windows``."""
    found = _scan(docs, windows, id_col, text_col, slice_windows, carry=False)
    return found.select(F.col("doc_id").alias(id_col), "n_words", "n_hit", "spans", "items", "contaminated")


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _whole(docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str, slice_windows: int) -> DataFrame:
    return _scan(docs, materialize(item_windows(items, n), "bench-windows"), id_col, text_col, slice_windows, carry=True)


def remove_spans(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id",
                 text_col: str = "text", slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """The documents with the hit words cut out of their texts; all other columns as they are."""
    names = _inner_names(docs.columns, id_col, text_col)
    scanned = _whole(docs, items, n, id_col, text_col, slice_windows).select(*names, "spans")
    columns = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for k, spans in enumerate(batch["spans"].to_pylist()):
                if spans:
                    _, w = next(chunks(pa.array([texts[k]]), ALNUM_WORDS))
                    raw, out, at = texts[k].encode(), [], 0
                    for x in spans:
                        out.append(raw[at:int(w.start[x["s"]])])
                        at = int(w.end[x["e"] - 1])
                    texts[k] = b"".join([*out, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch[c]
                                              for c in columns], names=columns)

    return scanned.mapInArrow(run, docs.schema)


def _merge_slices(results: list[DataFrame], same: list[str]) -> DataFrame:
    """Rows of one document from several slices: the union of their spans and items."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"s": s, "e": e} for s, e in merge_spans((x["s"], x["e"]) for y in row for x in y)]
                     for row in batch["spans"].to_pylist()]
            items = [sorted({x for y in row for x in y}) for row in batch["items"].to_pylist()]
            cols = {k: batch[k] for k in batch.schema.names if k not in ("spans", "items")}
            yield pa.RecordBatch.from_pydict(cols | {"spans": pa.array(spans, _SPANS),
                                                     "items": pa.array(items, pa.list_(pa.string()))})

    merged = every.groupBy(*same).agg(F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"),
                                      F.collect_list("items").alias("items"))
    return merged.mapInArrow(run, every.schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report columns: item list as a digest of the sorted, comma-joined ids."""
    joined = F.concat_ws(",", F.array_sort("items"))
    return scanned.select(F.col(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                          F.sha2(joined, 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, **options) -> DataFrame:
    """Scan ``docs`` for the windows of ``items``; options as in ``scan_documents``."""
    windows = materialize(item_windows(items, n), "bench-windows")
    return scan_documents(docs, windows, **options)


def clean_documents(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id",
                    text_col: str = "text", slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """The documents without contaminated ones, all columns kept as they are."""
    names = _inner_names(docs.columns, id_col, text_col)
    scanned = _whole(docs, items, n, id_col, text_col, slice_windows).where(~F.col("contaminated"))
    return scanned.select(*[F.col(inner).alias(c) for inner, c in names.items()])


#: the report over ``documents`` and ``benchmark``, for DuckDB
REPORT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, coalesce(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, words, least(len(words), 10) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
  WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item, size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM items)),
places AS (
  SELECT d, i, size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT d, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
hits AS (SELECT d, i, size, item FROM places JOIN windows USING (size, win)),
words_hit AS (
  SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT d, unnest(range(i, i + size)) AS p FROM hits) GROUP BY d),
items_hit AS (
  SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT d, item FROM hits) GROUP BY d)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (d) LEFT JOIN items_hit USING (d)
"""
