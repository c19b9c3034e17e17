"""Queries of the operators: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import byte_bpe as bb
from . import chat as ch
from . import decontaminate as dc
from . import html_main as hm
from . import lexical as lx
from . import lm_score as lm
from . import mixing as mx
from . import near_dup as nd
from . import pii
from . import quality as ql
from . import secrets as sc
from . import token_binary as tb
from . import whitening as wh
from .common import materialize, read_table, scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: the queries' key; a caller passes its own to ``pii.pseudonymise``
PSEUDONYM_KEY = b"example key of the registered query"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_chat": ch.READ_BACK_SQL, "op4_near_duplicates": nd.CLASSES_SQL,
                           "op8_decontaminate": dc.REPORT_SQL, "op11_lexical": lx.SEARCH_SQL}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = query
    return fn


@register
def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = tb.encode_blocks(read_table(spark, sf_dir, "documents"), TOKENIZER)
    return tb.read_documents(spark, tb.write(blocks, scratch_path(spark, "token-blocks")), with_ids=False)


@register
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.digest(dc.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


@register
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nd.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, numerator=85, denominator=100)


@register
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.find_secrets(read_table(spark, sf_dir, "documents"))


@register
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, :said AS text FROM VALUES "
                      "(0L, 'user'), (1L, 'assistant') AS x(t, r)", args={"said": said})
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # every row is a message of its own, also where two rows have the same turn
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().alias("message_id"),
                         F.lit("message").alias("kind"), "role", "text")
    return ch.read_back(materialize(ch.format_chat(events), "chat"))


@register
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.pseudonymise(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY))


@register
def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hm.main_text(read_table(spark, sf_dir, "pages"))


@register
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.rates(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bb.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bb.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bb.digest(encoded, ranks)


@register
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, fitted = wh.whiten(read_table(spark, sf_dir, "embeddings"))
    return wh.report(table, fitted)
