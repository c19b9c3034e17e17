"""Operator 13: byte-level BPE encoding and decoding with overlapping chunks.

1. A text of more than ``chunk`` code points is cut into chunks of that many,
   each with the next ``overlap`` code points behind it.  The chunks are dealt
   over all tasks, so one long text is no task's burden.
2. Every chunk is pre-tokenised from its own start, wherever that falls, and
   once more from the next chunk's start inside the overlap.  Where the two
   scans share a boundary, they agree from there on: that is the stitch.  A
   match counts as known only if the window shows what follows it.
3. The stitches (one small row a chunk) are joined back to the chunks; each
   piece runs from its chunk's stitch to the next one's and is encoded alone.
   Chunks without a stitch lie in one pre-token longer than the overlap; they
   are put together, as this pre-token has to be merged whole anyway.
4. Shorter texts are one chunk and one piece; they are not shuffled.

Why a shared boundary is a true one: by the pattern, a scan from any place is
right from the end of its second match at the latest.  Inside a run of one kind
(letters, digits, white space, others) it ends where the run ends; only an
apostrophe at the end of a run of others can take one or two letters of the
next run, whose end it then meets.  So the first scan must be past two matches.

Pre-tokens are merged by the tiktoken library over the given ranks, once per
distinct pre-token and task (a bounded cache).  Letters and digits that the
regex library knows and tiktoken's engine does not are taken as the latter does.
Decoding looks every id's bytes up and concatenates them.

Cases: null is the empty text (no ids); repeated rows and null ids are
documents of their own; empty tables give no rows; extra columns are not read.
Ids are stored in 16 bits where the vocabulary fits, else 32.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only

CHUNK = 16_384
OVERLAP = 512
CACHE = 200_000
#: rows whose texts a task holds as Python strings at once
_ROWS = 64
#: code points after a match that decide its end: a white-space run and the character behind it, or a contraction
_AHEAD = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of every token and its rank, from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=None)
def newer_characters(pattern: str) -> dict[str, str]:
    """Letters (L) and digits (N) of the regex library that tiktoken's engine doesn't take for such.

    The two libraries may hold different versions of Unicode, of which the
    later only adds characters.  Those that the oldest at hand doesn't know are
    tried with tiktoken: next to a letter, one of ``\\p{L}`` makes one pre-token."""
    out = {}
    for kind, beside in (("L", "a"), ("N", "1")):
        known = regex.compile(rf"\p{{{kind}}}")
        newer = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and known.match(chr(c))
                 and unicodedata.category(chr(c))[0] != kind]
        ranks = {bytes([i]): i for i in range(256)}
        for c in newer:  # tokens that join ``beside`` and the character, if they are one pre-token
            whole = (beside + c).encode()
            for k in range(2, len(whole) + 1):
                ranks.setdefault(whole[:k], len(ranks))
        trial = tiktoken.Encoding("trial", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        out[kind] = "".join(c for c in newer if len(trial.encode_ordinary(beside + c)) > 1)
    return out


class Scanner:
    """Pre-tokens of a text from a place on, as tiktoken's engine splits it."""

    def __init__(self, pattern: str, newer: dict[str, str]):
        exact = pattern
        for kind, characters in newer.items():
            if characters:
                exact = exact.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{characters}]]")
        self.plain, self.exact = regex.compile(pattern).findall, regex.compile("(?V1)" + exact).findall
        self.newer = frozenset("".join(newer.values()))

    def __call__(self, text: str, start: int = 0) -> list[str]:
        # the long list of characters makes the exact pattern slow; hardly a text has one of them
        return (self.plain if self.newer.isdisjoint(text) else self.exact)(text, start)


class Codec:
    """Pre-tokeniser and merges of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, newer: dict[str, str]):
        self.scan = Scanner(pattern, newer)
        self.merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, list[int]] = {}

    def ids(self, text: str, start: int = 0, end: int | None = None) -> list[int]:
        """Ids of the pre-tokens from ``start``; those from ``end`` on are only looked at."""
        out: list[int] = []
        known, at, end = self.known, start, len(text) if end is None else end
        for word in self.scan(text, start):
            if at >= end:
                break
            at += len(word)
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = known[word] = self.merge(word)
            out += ids
        return out


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The codec of a broadcast, made once per Python worker."""
    if shared.value[0] not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.value[0]] = Codec(*shared.value[1:])
    return _CODECS[shared.value[0]]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _share(docs: DataFrame, ranks: dict[bytes, int], pattern: str):
    """Broadcast of the vocabulary: as large as its file, whatever the documents."""
    key = hash((pattern, frozenset(ranks.items())))
    return docs.sparkSession.sparkContext.broadcast((key, ranks, pattern, newer_characters(pattern)))


def boundaries(scan, text: str, start: int, at_end: bool) -> list[int]:
    """Ends of the matches from ``start`` that nothing behind the window can change."""
    lengths = [len(w) for w in scan(text, start)]
    ends = (start + np.cumsum(lengths)).tolist() if lengths else []
    return ends if at_end else [e for e in ends if e + _AHEAD <= len(text)]


def stitch(scan, window: str, chunk: int, first: bool, at_end: bool) -> int | None:
    """Place in the window, from ``chunk`` on, where this chunk's scan and the next one's agree; None without one."""
    mine = boundaries(scan, window, 0, at_end)
    if first:
        mine = [0, 0, *mine]  # the text's own start is a true boundary
    theirs = {chunk, *boundaries(scan, window, chunk, at_end)}
    return next((p for p in mine[1:] if p in theirs), None)


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, chunk, text, last, at_end) of every chunk of the texts, dealt over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                text = text.as_py()
                for at in range(0, len(text), chunk * 64):  # 64 chunks a batch
                    starts = range(at, min(len(text), at + chunk * 64), chunk)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row.as_py()] * len(starts), pa.int64()),
                         pa.array([doc_id.as_py()] * len(starts), batch["doc_id"].type),
                         pa.array([s // chunk for s in starts], pa.int64()),
                         pa.array([text[s:s + chunk + overlap] for s in starts], pa.string()),
                         pa.array([s + chunk >= len(text) for s in starts], pa.bool_()),
                         pa.array([s + chunk + overlap >= len(text) for s in starts], pa.bool_())],
                        names=["row", "doc_id", "chunk", "text", "last", "at_end"])

    kind = long.schema["doc_id"].dataType.simpleString()
    cut = long.mapInArrow(run, f"row long, doc_id {kind}, chunk long, text string, last boolean, at_end boolean")
    return cut.repartition("row", "chunk")


def _stitches(chunks: DataFrame, shared, chunk: int) -> DataFrame:
    """(row, chunk, start, stop, run) of every chunk: its stitch, the next one's (null: none), number of its run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _codec(shared).scan
        for batch in _slices(batches):
            cols = [batch[c].to_pylist() for c in ("text", "chunk", "last", "at_end")]
            stops = [len(t) if last else stitch(scan, t, chunk, k == 0, at_end) for t, k, last, at_end in zip(*cols)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["chunk"], pa.array(stops, pa.int64())],
                                             names=["row", "chunk", "stop"])

    found = chunks.mapInArrow(run, "row long, chunk long, stop long")
    in_order = Window.partitionBy("row").orderBy("chunk")
    start = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.lag("stop").over(in_order) - chunk)
    return found.withColumn("start", start).withColumn("run", F.sum(F.col("start").isNotNull().cast("int")).over(in_order))


def pieces(docs: DataFrame, shared, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, piece, text, start, stop) of the texts of more than one chunk; ``docs``: row, doc_id, text."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap has at most the length of a chunk")
    chunks = _chunks(docs, chunk, overlap)
    placed = chunks.join(_stitches(chunks, shared, chunk), ["row", "chunk"])
    alone = F.col("start").isNotNull() & F.col("stop").isNotNull()
    names = ["row", "doc_id", F.col("chunk").alias("piece"), "text", "start", "stop"]
    # the rest: runs of chunks inside one long pre-token, put together; all but a run's last chunk end at ``chunk``
    part = F.struct("chunk", F.when(F.col("stop").isNull(), F.substring("text", 1, chunk)).otherwise(F.col("text")).alias("text"),
                    "start", "stop")
    joined = (placed.where(~alone).groupBy("row", "run")
              .agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(part)).alias("parts"))
              .select("row", "doc_id", F.col("parts")[0]["chunk"].alias("piece"),
                      F.array_join("parts.text", "").alias("text"), F.col("parts")[0]["start"].alias("start"),
                      ((F.size("parts") - 1) * chunk + F.element_at("parts", -1)["stop"]).alias("stop")))
    return placed.where(alone).select(names).unionByName(joined)


def _encode(texts: DataFrame, shared, wide: bool) -> DataFrame:
    """(row, doc_id, piece, ids) of the pieces."""
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in _slices(batches):
            cols = [batch[c].to_pylist() for c in ("text", "start", "stop")]
            ids = [np.array(codec.ids(*x), dtype=kind).tobytes() for x in zip(*cols)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["piece"], pa.array(ids, pa.binary())],
                                             names=["row", "doc_id", "piece", "ids"])

    return texts.mapInArrow(run, f"row long, doc_id {texts.schema['doc_id'].dataType.simpleString()}, piece long, ids binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> list[DataFrame]:
    """Tables (row, doc_id, piece, ids) that together hold every document; a document lies in one of them.

    In each, the pieces of a document are neighbours in ascending order.  ``ids``
    are little-endian numbers of 16 bits, or 32 for ranks of 65,536 and more."""
    shared = _share(docs, ranks, pattern)
    wide = max(ranks.values(), default=0) >= 1 << 16
    named = only(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    named = named.withColumn("row", F.monotonically_increasing_id())
    short = named.where(F.char_length("text") <= chunk)
    whole = short.select("row", "doc_id", F.lit(0).cast("long").alias("piece"), "text", F.lit(0).cast("long").alias("start"),
                         F.char_length("text").cast("long").alias("stop"))
    parts = _encode(pieces(named.where(F.char_length("text") > chunk), shared, chunk, overlap), shared, wide)
    return [_encode(whole, shared, wide), parts.repartition("row").sortWithinPartitions("row", "piece")]


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with the bytes of its ids; concatenated in order they are the document's text in UTF-8."""
    shared, wide = _table(encoded, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            raw = [b"".join(map(shared.value.__getitem__, _numbers(x, wide))) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "bytes"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{ddl}, bytes binary")


def _table(df: DataFrame, ranks: dict[bytes, int]):
    """Broadcast rank -> bytes, and whether ids have 32 bits."""
    return (df.sparkSession.sparkContext.broadcast({v: k for k, v in ranks.items()}),
            max(ranks.values(), default=0) >= 1 << 16)


def _numbers(ids: bytes, wide: bool) -> list[int]:
    return np.frombuffer(ids, dtype="<u4" if wide else "<u2").tolist()


def digest(encoded: list[DataFrame], ranks: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, from the tables of ``encode``.

    A document's pieces stream through one task, which holds one batch of them."""
    shared, wide = _table(encoded[0], ranks)
    doc_type = encoded[0].schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        row, state, done, kind = None, None, [], pa.null()

        def full() -> pa.RecordBatch:
            cols = list(zip(*[(d, n, a.hexdigest(), b.hexdigest()) for d, n, a, b in done])) or [[], [], [], []]
            done.clear()
            types = (kind, pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in _slices(batches):
            kind = batch["doc_id"].type
            for r, doc_id, raw in zip(*[batch[c].to_pylist() for c in ("row", "doc_id", "ids")]):
                if r != row:
                    if state:
                        done.append(state)
                    row, state = r, [doc_id, 0, hashlib.sha256(), hashlib.sha256()]
                ids = _numbers(raw, wide)
                if ids:
                    state[2].update(((" " if state[1] else "") + " ".join(map(str, ids))).encode())
                    state[3].update(b"".join(map(table.__getitem__, ids)))
                    state[1] += len(ids)
            if done:
                yield full()
        if state:
            done.append(state)
            yield full()

    ddl = f"doc_id {doc_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = functools.reduce(DataFrame.unionByName, [x.mapInArrow(run, ddl) for x in encoded])
    return out.withColumnRenamed("doc_id", id_col)
