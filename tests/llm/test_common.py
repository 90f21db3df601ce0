"""Shared helpers: written tables and their deletion, Arrow limits, shards of a digest order."""

from __future__ import annotations

from pathlib import Path

import pytest

from pyspark.sql import functions as F

from cargolens.llm import common


def test_written_tables_are_recorded_and_deleted(spark):
    with common.recording() as outer:
        common.durable(spark.range(5), "first")
        with common.recording() as inner:
            second = common.durable(spark.range(3), "second")
    assert len(outer) == 2 and len(inner) == 1
    common.delete_tables(spark, [p for p in outer if p not in inner])
    assert second.count() == 3 and not Path(outer[0].split(":", 1)[-1]).exists()


def test_rows_are_found_again(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 < 2").select("doc_id", F.lit(1).alias("at"))
    first = {r["id"]: r["at"] for r in common.located(docs, id="doc_id").collect()}
    assert first == {r["row"]["doc_id"]: r["at"] for r in common.located(docs).repartition(3).collect()} and len(set(first.values())) == len(first)
    for odd in (spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, _metadata string"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lit("x").alias("_METADATA"))):
        assert len({r["at"] for r in common.located(odd).collect()}) == odd.count()


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_whole_rows_by_key(spark, most):
    rows = spark.range(2000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    keys = common.durable(spark.range(500).select((F.col("id") * 7).alias("id"), F.lit(1).alias("more")), "keys")
    assert {r["id"] for r in common.rows_with(rows, keys, "id", sent_rows=most).collect()} == set(range(0, 2000, 7))
    assert {r["id"] for r in common.rows_with(rows, common.durable(keys.withColumn("many", F.lit(1)), "counted"), "id", many="many", sent_rows=most).collect()} == set(range(0, 2000, 7))
    assert {r["id"] for r in common.rows_without(rows, keys.select("id"), "id", sent_rows=most).collect()} == set(range(2000)) - set(range(0, 2000, 7))
    assert 286 <= common.maybe_in(rows, keys, "id", 500).where("_maybe").count() < 600


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_apart(spark, how):
    rows = common.durable(spark.range(6000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 700).alias("k"), "id"), "rows")
    table = common.durable(rows.where("k <> 5").groupBy("k").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("least")), "table")
    got = common.join_by_count(rows, table, "k", "many", how)
    assert sorted(map(tuple, got.select("k", "id", "many", "least").collect())) == sorted(map(tuple, rows.join(table, "k", how).select("k", "id", "many", "least").collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().simpleString()


def test_arrow_limits_only_fall(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10")
        common.bound_arrow(spark)
        assert spark.conf.get(key) == "10"
        spark.conf.set(key, "0")
        common.bound_arrow(spark)
        assert spark.conf.get(key) == str(common.BATCH_ROWS)
    finally:
        spark.conf.set(key, before)


def test_digests_sort_as_their_shards(spark):
    rows = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("d")).select("d", common.hex_shard(F.col("d"), 37).alias("s")).orderBy("d").collect()
    shards = [r["s"] for r in rows]
    assert shards == sorted(shards) and min(shards) >= 0 and max(shards) <= 36


def test_words_are_counted_between_ascii_space(spark):
    texts = ["", None, " a\tb ", "a\u00a0b", "x" * 10]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", common.word_count(common.whole_text()).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [0, 0, 2, 1, 1]
