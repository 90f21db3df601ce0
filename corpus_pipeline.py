"""A corpus from raw documents to packed training batches, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. docs may have null ids and
texts, empty and very long texts, repeated rows, further columns (kept) or no
rows. It is read more than once, so it must be a table or give the same rows each
time. What a stage writes for itself are narrow tables without texts; run()
deletes them when the stage's output is written, other callers' go with the
application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.common import delete_tables, durable, recording
from cargolens.llm.exact_dedup import drop_exact_duplicates
from cargolens.llm.mixing import mix_to_weights
from cargolens.llm.near_copies import drop_near_copies
from cargolens.llm.packing import pack_into_buckets
from cargolens.llm.quality import drop_low_quality
from cargolens.llm.queries import MIX, PACK
from cargolens.llm.token_counts import count_tokens

#: SQL has no tokenizer and no components; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose source isn't rejected. Null text is empty and fails; a null source is a host of its own; repeated rows count each; an empty table gives an empty one."""
    return drop_low_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id (null ids last), one row of repeated ones. Null text equals the empty one; an empty table gives an empty one."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles alike to 0.8 or more: the one with the smallest id (null ids last), one row of repeated ones. Texts without words, null ones too, are alike; an empty table gives an empty one."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights, in tokens of the 49k vocabulary, read them: a document of n epochs is there n times. Null texts hold no tokens; null languages and sources are nodes of their own; rows that repeat an id go together; an empty table gives an empty one."""
    return mix_to_weights(docs, n_tokens=count_tokens(F.col("text")), **MIX).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in length buckets and token-budget batches. Rows that repeat an id and a text are readings of one document: each is an epoch of its own, and no batch holds two. Documents without tokens have a row without batch; an empty table gives an empty one."""
    out = pack_into_buckets(docs, n_tokens=count_tokens(F.col("text")), **PACK)
    return out.select(F.col("id").alias("doc_id"), "epoch", "piece_no", "start_token", "n_tokens", "bucket_len", "batch_no", "slot", "padding")


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's DataFrame over documents; each stage's own tables and its predecessor's output are deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with recording() as own:
            made = stage(spark, docs, sf_dir)
        with recording() as output:
            docs = durable(made, name)
        delete_tables(spark, [*own, *before])
        before = output
    return STAGES[-1][1](spark, docs, sf_dir)
