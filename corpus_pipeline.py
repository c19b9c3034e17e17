"""Corpus pipeline: raw documents to token files, in five written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadlens.llm import decontaminate as dc
from roadlens.llm import mixing as mx
from roadlens.llm import near_dup as nd
from roadlens.llm import quality as ql
from roadlens.llm import token_binary as tb
from roadlens.llm.common import materialize, read_table, scratch_path
from roadlens.llm.queries import TOKENIZER
from roadlens.session import ensure_checkpoint_dir

#: None: the stages hash n-grams and run a tokenizer, which SQL cannot say.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the likelihood ratio."""
    return ql.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component at a similarity of 0.8 or more on five-word shingles."""
    return nd.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return dc.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mx.mix(docs, read_table(spark, sf_dir, "labels"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents; per document what reading them back gives."""
    blocks = tb.encode_blocks(docs, TOKENIZER)
    return tb.read_documents(spark, tb.write(blocks, scratch_path(spark, "token-blocks")), with_ids=False)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mixing", mix_sources), ("token_files", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read back by the next."""
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
