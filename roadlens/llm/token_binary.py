"""Operator 2: token ids in binary files with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by doc_id, every partition encodes
its texts and writes blocks of consecutive documents.  A block is one row of
the output files:

    part, block     order of the blocks (ascending doc_id)
    n_docs, n_tokens
    doc_ids         little-endian signed 64-bit
    doc_id_nulls    one byte per document, 1 where the id is null (empty if none)
    id_bytes        2 or 4: width of an id, little-endian unsigned
    ids             the concatenated id arrays, each closed by the end id
    first           ids of the same part before this block
    ef_*            Elias-Fano code of the n_docs + 1 boundaries inside the block

The files are Parquet, so writing is atomic per task, a lost executor repeats
only its partitions, and blocks are found by ``part`` without reading others.
No table of 64-bit offsets is kept: the global start of a document is (ids of
the parts before) + ``first`` + ``select(i)``.

Cases: null text is the empty text (only the end id).  Null doc_ids sort
first.  Repeated doc_ids are kept, ordered by a hash of the text and the text.
An empty table gives no blocks.  Other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only
from .elias_fano import EliasFano

BLOCK_TOKENS = 1 << 18
CACHE_WORDS = 1_000_000
CACHE_OTHERS = 250_000

BLOCKS = ("part int, block int, n_docs int, n_tokens long, first long, doc_ids binary, doc_id_nulls binary, "
          "id_bytes int, ids binary, ef_low_bits int, ef_low binary, ef_high binary, ef_samples binary")

# Words of these characters stand for themselves under NFC, and lower-casing
# them changes one character to one character.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# The split rule of the vocabulary file, for such words in lower case.
_LETTERS = "a-zß-öø-ÿ"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
# Texts of such words, blanks and line ends alone.
_PLAIN_TEXT = re.compile("[ \\n!-~À-ÖØ-öø-ÿ]*")


class _PlainWords(dict):
    """Plain word in lower case -> bytes of its ids.

    A word is put together from its pieces (letters, one digit or symbols),
    which are words of their own here, so that the library is asked once per
    piece and not once per spelling.  Cleared when full."""

    def __missing__(self, word: str) -> bytes:
        pieces = _PIECES.findall(word)
        if len(pieces) > 1:
            out = b"".join([self[piece] for piece in pieces])
        else:
            text = word if word.isascii() else word.translate(self.byte_chars)
            out = array(self.typecode, [t.id for t in self.tokenize(text)]).tobytes() if word else b""
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


class WordEncoder(dict):
    """Word between white space -> bytes of its ids, filled on first sight.

    The tokenizer drops white space and never merges across it, so a text's
    ids are the ids of its words in order.  A text of plain words alone is
    lower-cased and cut at its white space at once; in other texts words are
    looked at one by one, and those that aren't plain go to the library whole."""

    def __init__(self, tokenizer_path: str, split_pieces: bool, dtype: str):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.split_pieces, self.dtype, self.plain = split_pieces, dtype, _PlainWords()
        # the model reads bytes as printable characters; those of ASCII stand for themselves
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.byte_chars = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.plain.tokenize, self.plain.typecode = self.tokenizer.model.tokenize, "H" if dtype == "<u2" else "I"

    def _ask(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        if self.split_pieces and "<|" not in word and _PLAIN.fullmatch(word):
            out = self.plain[word.lower()]
        else:
            out = self._ask(word)
        if len(word) <= 64:
            if len(self) >= CACHE_OTHERS:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.split_pieces and "<|" not in text and _PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.plain.__getitem__, text.lower().replace("\n", " ").split(" ")))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[tuple, WordEncoder] = {}  # kept by a Python worker from task to task


def _word_split(tokenizer_path: str) -> bool:
    """Whether the vocabulary file drops white space and lower-cases (then words are independent)."""
    import json
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    rules = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
    return '"Lowercase"' in rules and '"Removed"' in rules and "[^\\\\s\\\\p{L}\\\\p{N}]+" in rules


def _vocabulary_size(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path).get_vocab_size()


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id",
                  text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The blocks of all documents (schema BLOCKS); write them with ``write``.

    ``tokenizer_path`` must exist on the executors; it has to be a word-split
    vocabulary (white space dropped), which is checked here."""
    if not _word_split(tokenizer_path):
        raise ValueError(f"{tokenizer_path}: not a lower-casing vocabulary that drops white space")
    id_type = "<u2" if max(_vocabulary_size(tokenizer_path), end_id) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, id_type)
        if key not in _ENCODERS:
            _ENCODERS[key] = WordEncoder(tokenizer_path, True, id_type)
        encoder = _ENCODERS[key]
        width = np.dtype(encoder.dtype).itemsize
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        part, block, first = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, bounds = [], [], [0]

        def close() -> pa.RecordBatch:
            ef = EliasFano.encode(np.array(bounds))
            nulls = bytes(x is None for x in doc_ids)
            row = {"part": part, "block": block, "n_docs": len(doc_ids), "n_tokens": bounds[-1], "first": first,
                   "doc_ids": np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(),
                   "doc_id_nulls": nulls if any(nulls) else b"", "id_bytes": width, "ids": b"".join(ids),
                   "ef_low_bits": ef.low_bits, "ef_low": ef.low, "ef_high": ef.high, "ef_samples": ef.samples}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                coded = encoder.encode(text.as_py() or "") + end
                ids.append(coded)
                doc_ids.append(doc_id)
                bounds.append(bounds[-1] + len(coded) // width)
                if bounds[-1] >= block_tokens:
                    yield close()
                    first += bounds[-1]
                    block += 1
                    ids, doc_ids, bounds = [], [], [0]
        if doc_ids:
            yield close()

    ordered = (only(docs, doc_id=id_col, text=text_col)
               .withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text"))
    return ordered.select("doc_id", "text").mapInArrow(run, BLOCKS)


_BLOCK_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()),
    ("first", pa.int64()), ("doc_ids", pa.binary()), ("doc_id_nulls", pa.binary()), ("id_bytes", pa.int32()),
    ("ids", pa.binary()), ("ef_low_bits", pa.int32()), ("ef_low", pa.binary()), ("ef_high", pa.binary()),
    ("ef_samples", pa.binary())])


def write(blocks: DataFrame, path: str) -> str:
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def boundaries(block: dict) -> EliasFano:
    """The boundary code of one block; ``select(i)`` is the start of its i-th document."""
    return EliasFano(block["n_docs"] + 1, block["ef_low_bits"], block["ef_low"], block["ef_high"], block["ef_samples"])


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids.

    The starts of the parts are sums over one row per part (as many as the
    writing job had partitions)."""
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("part_start"))
    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = {name: batch[name][k].as_py() for name in batch.schema.names}
                bound = boundaries(b).decode()
                ids = np.frombuffer(b["ids"], dtype=f"<u{b['id_bytes']}").astype("<u4")
                raw = memoryview(ids.tobytes())
                doc_ids = np.frombuffer(b["doc_ids"], dtype="<i8")
                nulls = np.frombuffer(b["doc_id_nulls"], dtype=bool) if b["doc_id_nulls"] else None
                out = {"part": pa.array(np.full(b["n_docs"], b["part"], dtype=np.int32)),
                       "doc_id": pa.array(doc_ids, mask=nulls), "at": pa.array(bound[:-1] + b["first"]),
                       "n_tokens": pa.array(np.diff(bound)),
                       "ids_crc32": pa.array([zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(bound[:-1], bound[1:])],
                                             pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)),
                                                          pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    docs = blocks.mapInArrow(run, schema).join(F.broadcast(parts), "part")
    return docs.select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
                       *(["ids"] if with_ids else []))
