"""Operator 9: cross-entropy difference of matched n-gram models.

A target model (trusted documents) and a background model (all documents) are
bigram models with the same order, smoothing and vocabulary: the words of the
corpus.  The probability of a word after another interpolates the bigram with
the unigram (Witten-Bell), and the unigram with the uniform distribution over
the vocabulary.  A document's score is the mean over its tokens of (target
loss - background loss) in nats: low scores look like the target.

1. The texts are dealt once into groups of about ``group_bytes`` by their row.
   A group counts its pairs of a word and the word before, its words, and its
   texts' last words, by 64-bit hashes.  Its sorted keys go out packed by
   bucket (their first bits), seven bytes for a key seen once.
2. A bucket's task adds up all groups' counts.  It answers every group with the
   corpus counts of the group's keys, in the group's own order, so that the
   answer holds no keys: one byte for most counts.
3. Each group meets its answers, and its texts again (the same shuffle is read
   twice), and scores its documents.  No table is broadcast or collected; a
   frequent word is one key of each group, however often it occurs there.

The totals of the models are one row of sums over the buckets, put to the
answers by a scalar subquery.  Everything grows in proportion to the corpus.
Losses are added in units of 2^-32, so sums don't depend on the order.  The
target is counted over all trusted documents.

Cases: null or word-less texts have no tokens and null scores.  Without
trusted documents the target model is uniform.  Repeated rows count and are
scored each for itself.  Empty tables give no rows; extra columns are not read.
A very long text makes its group as large as itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, only
from .wordarrays import SPACE_WORDS, chunks, mix

GROUP_BYTES = 10 << 20
#: trusted ids that are broadcast at most; more are joined by a shuffle
BROADCAST_IDS = 1 << 20
#: bits of a key that name its bucket, at least; more groups take more, so that a bucket fits into a task
BUCKET_BITS = 10
#: keys that a task adds up at once
MERGED_KEYS = 1 << 20
#: packed rows that are opened at once
_ROWS = 64
UNIT = 2.0 ** 32
_START = np.uint64(0x5EED)
_PAIR, _WORD, _LAST = range(3)
#: what a group is told of each pair, and of each word: corpus counts, trusted counts, and both as a text's last word
_TOLD = {_PAIR: ["b", "t"], _WORD: ["b", "t", "last_b", "last_t"]}


class Group:
    """The grams of a group of texts: hashes of the tokens and of the words before, and the texts they belong to."""

    def __init__(self, texts: pa.Table):
        word, before, last, row, at = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], 0
        for base, w in chunks(texts["text"], SPACE_WORDS):
            full = np.diff(w.first) > 0
            ahead = np.empty_like(w.hash)
            ahead[1:] = w.hash[:-1]
            ahead[w.first[:-1][full]] = _START
            word.append(w.hash)
            before.append(ahead)
            last.append(at + w.first[1:][full] - 1)
            row.append(np.diff(w.first))
            at += len(w.hash)
        self.word, self.before, self.last = (np.concatenate(x) for x in (word, before, last))
        self.tokens = np.concatenate([np.empty(0, np.int64), *row])  # of every text
        trusted = texts["trusted"].to_numpy().astype(bool)
        self.trusted = np.repeat(trusted, self.tokens)
        self.pair = mix(mix(self.before) + self.word)


def _pack(grp: int, kind: int, keys: np.ndarray, good: np.ndarray, bits: int) -> pa.RecordBatch:
    """The counts of ``keys`` (``good``: in a trusted text), one row per bucket: the other bytes of the keys seen once,
    of those in a trusted text, and of the keys seen more often with their counts of 32 bits."""
    order = np.argsort(keys)
    keys, good = keys[order], good[order]
    new = _starts(keys)
    keys, n = keys[new], np.diff(np.append(new, len(keys)))
    good = np.add.reduceat(good, new, dtype=np.int64) if len(new) else new
    bucket = keys >> np.uint64(64 - bits)
    buckets = np.unique(bucket)
    ends = np.append(buckets, buckets[-1:] + np.uint64(1)) if len(buckets) else np.zeros(1, np.uint64)
    cols = {"grp": pa.array(np.full(len(buckets), grp, np.int64)), "kind": pa.array(np.full(len(buckets), kind, np.int8)),
            "bucket": pa.array(buckets.astype(np.int64))}
    for name, mine in (("once", (n == 1) & (good == 0)), ("once_good", (n == 1) & (good == 1)), ("many", n > 1)):
        first = np.searchsorted(bucket[mine], ends)
        cols[name] = _binary(keys[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_width(bits)], first)
        if name == "many":
            cols |= {c: _binary(x[mine].astype("<u4").view(np.uint8).reshape(-1, 4), first) for c, x in (("n", n), ("good", good))}
    return pa.RecordBatch.from_pydict(cols)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted rows."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))


def _width(bits: int) -> int:
    """Bytes of a key without the bits of its bucket."""
    return -(-(64 - bits) // 8)


def _binary(rows: np.ndarray, first: np.ndarray) -> pa.Array:
    """Byte rows, of which first[i] to first[i + 1] make value i."""
    offsets = (first * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1,
                                 [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the length of each value."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    return np.frombuffer(body, dtype=np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.empty(0, np.uint8), np.diff(offsets)


def _unpack(batch: pa.RecordBatch, bits: int) -> list[np.ndarray]:
    """(group, kind, key, n, good) of every key of the rows."""
    owner = [batch[c].to_numpy().astype(np.int64) for c in ("grp", "kind")]
    high = batch["bucket"].to_numpy().astype(np.uint64) << np.uint64(64 - bits)
    width, parts = _width(bits), []
    for name in ("once", "once_good", "many"):
        data, sizes = _bytes(batch[name])
        sizes = sizes // width
        keys = np.zeros((len(data) // width, 8), dtype=np.uint8)
        keys[:, :width] = data.reshape(-1, width)
        keys = keys.view("<u8").ravel() | np.repeat(high, sizes)  # bits that both have are the same
        if name == "many":
            n, good = (_bytes(batch[c])[0].copy().view("<u4").astype(np.int64) for c in ("n", "good"))
        else:
            n = np.ones(len(keys), dtype=np.int64)
            good = n * (name == "once_good")
        parts.append((*[np.repeat(x, sizes) for x in owner], keys, n, good))
    return [np.concatenate(x) for x in zip(*parts)]


def _short(values: np.ndarray, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counts as bytes, and in full those of 255 and more; first[i] to first[i + 1] make row i."""
    large = np.flatnonzero(values >= 255)
    return (_binary(np.minimum(values, 255).astype(np.uint8).reshape(-1, 1), first),
            _binary(values[large].astype("<i8").view(np.uint8).reshape(-1, 8), np.searchsorted(large, first)))


def _answer(parts: list[tuple], bits: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The answers to all groups for whole buckets, and the totals: tokens, texts with words, different words and pairs,
    each of the background and the target."""
    grp, kind, key, n, good = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((grp, key, kind))
    grp, kind, key, n, good = (x[order] for x in (grp, kind, key, n, good))
    new = _starts(kind, key)
    which = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
    first_kind, first_key = kind[new], key[new]
    told = {"b": np.add.reduceat(n, new), "t": np.add.reduceat(good, new)}
    is_last = first_kind == _LAST
    last_keys = first_key[is_last]
    place = np.minimum(np.searchsorted(last_keys, first_key), max(0, len(last_keys) - 1))
    hit = (first_kind == _WORD) & (last_keys[place] == first_key) if len(last_keys) else np.zeros(len(new), bool)
    for c in "bt":
        told[f"last_{c}"] = np.where(hit, told[c][is_last][place], 0) if len(last_keys) else np.zeros(len(new), np.int64)
    words, pairs = first_kind == _WORD, first_kind == _PAIR
    totals = np.array([told[c][m].sum() for m in (words, is_last) for c in "bt"]
                      + [np.count_nonzero(told[c][m]) for m in (words, pairs) for c in "bt"], dtype=np.int64)
    # back to the groups: their keys in ascending order, cut by bucket
    mine = np.flatnonzero(kind != _LAST)
    mine = mine[np.lexsort((key[mine], kind[mine], grp[mine]))]
    bucket = (key[mine] >> np.uint64(64 - bits)).astype(np.int64)
    cut = _starts(grp[mine], kind[mine], bucket)
    first = np.append(cut, len(mine))
    cols = {"grp": pa.array(grp[mine][cut]), "kind": pa.array(kind[mine][cut].astype(np.int8)), "bucket": pa.array(bucket[cut])}
    for c, x in told.items():
        cols[c], cols[f"{c}_more"] = _short(x[which[mine]], first)
    return pa.RecordBatch.from_pydict(cols), totals


def _told(answers: pa.Table, kind: int) -> dict[str, np.ndarray]:
    """The counts of all keys of a group in ascending order of the keys."""
    rows = answers.filter(pa.compute.equal(answers["kind"], kind)).sort_by("bucket").combine_chunks()
    out = {}
    for c in _TOLD[kind]:
        small, more = (_bytes(rows[x].combine_chunks())[0] if rows.num_rows else np.empty(0, np.uint8) for x in (c, f"{c}_more"))
        out[c] = small.astype(np.int64)
        out[c][small == 255] = more.copy().view("<i8")
    return out


def pair_loss(n: np.ndarray, context: np.ndarray, word: np.ndarray, total: int, kinds: int, pairs: int,
              vocabulary: int) -> np.ndarray:
    """Negative log probability of a word in a context, from the counts of the pair, its context and its word."""
    uniform = 1.0 / vocabulary
    lower = (word + kinds * uniform) / (total + kinds) if total else uniform
    spread = np.maximum(1.0, context * (pairs / max(1, total)))
    return -np.log((n + spread * lower) / (context + spread))


_TOTALS = [f"{c}_{m}" for c in ("tokens", "texts", "words", "pairs") for m in "bt"]


def gram_answers(texts: DataFrame, groups: int, merged_keys: int = MERGED_KEYS) -> DataFrame:
    """Rows of answers (grp, kind, bucket and counts) and rows of totals (grp null).  ``texts``: grp, text, trusted."""
    bits = max(BUCKET_BITS, math.ceil(math.log2(max(1, groups))))

    def count(table: pa.Table) -> pa.Table:
        g, grp = Group(table), table["grp"][0].as_py()
        packed = [_pack(grp, kind, keys, good, bits) for kind, keys, good in (
            (_PAIR, g.pair, g.trusted), (_WORD, g.word, g.trusted), (_LAST, g.word[g.last], g.trusted[g.last]))]
        return pa.Table.from_batches(packed)

    blobs = [f"{c}{more}" for c in _TOLD[_WORD] for more in ("", "_more")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, totals = [], 0, np.zeros(len(_TOTALS), dtype=np.int64)

        def whole(some: list[tuple]) -> pa.RecordBatch:
            rows, sums = _answer(some, bits)
            totals[:] += sums
            return pa.RecordBatch.from_pydict(
                {c: rows[c] for c in rows.schema.names} | {c: pa.nulls(rows.num_rows, pa.int64()) for c in _TOTALS})

        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            parts.append(tuple(_unpack(batch, bits)))
            held += len(parts[-1][0])
            if held >= merged_keys:
                every = [np.concatenate(x) for x in zip(*parts)]
                bucket = every[2] >> np.uint64(64 - bits)
                last = bucket == np.uint64(batch["bucket"][-1].as_py())  # may go on
                if not last.all():
                    yield whole([tuple(x[~last] for x in every)])
                parts = [tuple(x[last] for x in every)]
                held = int(last.sum())
        if held:
            yield whole(parts)
        one = {"grp": pa.nulls(1, pa.int64()), "kind": pa.nulls(1, pa.int8()), "bucket": pa.nulls(1, pa.int64())}
        yield pa.RecordBatch.from_pydict(one | {c: pa.nulls(1, pa.binary()) for c in blobs}
                                         | {c: pa.array([x]) for c, x in zip(_TOTALS, totals.tolist())})

    packed = texts.groupBy("grp").applyInArrow(
        count, "grp long, kind byte, bucket long, once binary, once_good binary, many binary, n binary, good binary")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "grp long, kind byte, bucket long, " + ", ".join(f"{c} binary" for c in blobs)
                            + ", " + ", ".join(f"{c} long" for c in _TOTALS))


def _marked(named: DataFrame, labels: DataFrame) -> DataFrame:
    """``named`` with ``trusted``; all good, non-toxic labels count."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    good = materialize(good, "lm-trusted").withColumn("trusted", F.lit(True))
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    known = named.where("doc_id is not null").join(good, "doc_id", "left")
    known = known.select(*named.columns, F.coalesce("trusted", F.lit(False)).alias("trusted"))
    return known.unionByName(named.where("doc_id is null").withColumn("trusted", F.lit(False)))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    group_bytes: int = GROUP_BYTES, merged_keys: int = MERGED_KEYS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means per token), score (their difference)."""
    named = only(docs, doc_id=id_col, text=text_col)
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    marked = _marked(named, labels).withColumn("row", F.monotonically_increasing_id())
    texts = marked.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"), "doc_id", "text", "trusted").repartition("grp")
    rows = gram_answers(texts, groups, merged_keys)
    totals = rows.agg(F.array(*[F.coalesce(F.sum(c), F.lit(0)) for c in _TOTALS]).alias("totals"))
    answers = rows.where("grp is not null").drop(*_TOTALS).withColumn("totals", totals.scalar())

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        n_texts = table.num_rows
        empty = pa.nulls(n_texts, pa.float64())
        out = {"doc_id": table["doc_id"], "n_tokens": pa.array(np.zeros(n_texts, np.int64)), "target_loss": empty,
               "background_loss": empty, "score": empty}
        g = Group(table)
        if len(g.word):
            total = dict(zip(_TOTALS, told["totals"][0].as_py()))
            pair, word = _told(told, _PAIR), _told(told, _WORD)
            pair_at = np.unique(g.pair, return_inverse=True)[1]
            keys, word_at = np.unique(g.word, return_inverse=True)
            begins = g.before == _START
            before_at = np.minimum(np.searchsorted(keys, g.before), len(keys) - 1)
            n = np.maximum(g.tokens, 1)
            none = g.tokens == 0
            means = []
            for m in "tb":
                context = np.where(begins, total[f"texts_{m}"], (word[m] - word[f"last_{m}"])[before_at])
                loss = pair_loss(pair[m][pair_at], context, word[m][word_at], total[f"tokens_{m}"], total[f"words_{m}"],
                                 total[f"pairs_{m}"], max(1, total["words_b"]))
                units = np.append(0, np.cumsum(np.rint(UNIT * loss).astype(np.int64)))
                means.append(np.diff(units[np.append(0, np.cumsum(g.tokens))]) / UNIT / n)
            out |= {"n_tokens": pa.array(g.tokens)} | {c: pa.array(x, mask=none) for c, x in (
                ("target_loss", means[0]), ("background_loss", means[1]), ("score", means[0] - means[1]))}
        return pa.Table.from_pydict(out)

    kind = named.schema["doc_id"].dataType.simpleString()
    scored = texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
        score, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return scored.withColumnRenamed("doc_id", id_col)
