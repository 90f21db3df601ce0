"""Registered queries of the corpus operators with their production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.collocations import collocations
from cargolens.llm.exact_dedup import exact_groups
from cargolens.llm.licenses import license_matches
from cargolens.llm.line_dedup import drop_shared_lines
from cargolens.llm.mixing import mix_to_weights
from cargolens.llm.packing import pack_into_buckets
from cargolens.llm.quality import host_quality
from cargolens.llm.quality_model import quality_scores
from cargolens.llm.secret_scan import joined, secret_spans
from cargolens.llm.simhash import fingerprint_hex, simhash_components
from cargolens.llm.spelling import spelling_variants
from cargolens.llm.token_counts import token_counts
from cargolens.llm.warc import warc_round_trip

#: The mixing tree of `documents`: four domains by the source's number, then language, then source.
DOMAIN = "concat('domain', coalesce(cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 AS STRING), '-'))"
LEVELS = {"domain": DOMAIN, "lang": "lang", "source": "source"}
WEIGHTS = {"domain": {"domain0": 4, "domain1": 2, "domain2": 2, "domain3": 1, "*": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2, "*": 1}}
MIX = {"levels": LEVELS, "weights": WEIGHTS, "share": 0.8, "max_epochs": 3, "seed": 7}
PACK = {"max_len": 2048, "buckets": 8, "token_budget": 16384, "seed": 7}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_into_buckets(documents(spark, sf_dir), **PACK)
    return out.select(F.col("id").alias("doc_id"), "epoch", "piece_no", "start_token", "n_tokens", "bucket_len", "batch_no", "slot", "padding")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(documents(spark, sf_dir), name="word_bpe_49k.json", limit=2048, carry=["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), carry=["doc_id"]).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_matches(documents(spark, sf_dir), carry=["doc_id"])
    return out.select("row.doc_id", "text_digest", "license_id", F.array_join("notice_ids", ",").alias("notice_ids"), "n_notices")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(documents(spark, sf_dir), min_docs=10, carry=["doc_id"], with_text=False)
    return out.select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_quality(documents(spark, sf_dir), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round(F.col("host_rate") + 1e-9, 4).alias("host_rate"), "kept")


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(documents(spark, sf_dir), carry=["doc_id"])
    return out.select("row.doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_example")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_to_weights(documents(spark, sf_dir), carry=["doc_id"], **MIX)
    return out.select("row.doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", "epoch")


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir), carry=["doc_id"], width=4, seed=42, radius=4)
    return out.select("row.doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), every=199, least_length=6, least_n=5, ratio=5)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), least=100, percent=100, top=2000)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_scores(documents(spark, sf_dir), labels, carry=["doc_id"], folds=5, threshold=0.3, most_rows=4000, most_passages=64)
    return out.select("row.doc_id", "held_out", "score", "predicted")


QUERIES = (op1_length_buckets, op2_token_counts, op3_exact_dedup, op4_license_digests, op5_line_dedup, op6_warc_round_trip, op7_host_quality, op8_secret_ownership, op9_source_mix, op10_simhash_components, op11_spelling_variants, op12_collocations, op13_quality_classifier)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    from cargolens.llm.oracle import ORACLES

    return dict(ORACLES)
