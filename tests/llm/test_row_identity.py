"""Rows that share an origin, as joins, unions and explode make them, are rows of their own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cargolens.llm import common
from cargolens.llm.exact_dedup import drop_exact_duplicates, exact_groups
from cargolens.llm.near_copies import drop_near_copies
from cargolens.llm.simhash import drop_near_duplicates
from cargolens.llm.warc import warc_round_trip

TEXTS = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(10)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.mode("overwrite").parquet(path)
    return path


def doubled(spark, path, how):
    """Ten documents twice, the second time with 100 added to their ids."""
    docs = spark.read.parquet(path)
    twice = spark.createDataFrame([(0,), (100,)], "more bigint")
    if how == "explode":
        return docs.withColumn("more", F.explode(F.array(F.lit(0), F.lit(100)))).select((F.col("doc_id") + F.col("more")).alias("doc_id"), "text")
    if how == "union":
        return docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100))
    if how == "cross":
        return docs.crossJoin(twice).select((F.col("doc_id") + F.col("more")).alias("doc_id"), "text")
    if how == "same path":
        return spark.read.parquet(path, path)
    many = spark.range(20).select((F.col("id") % 10).alias("key"), F.when(F.col("id") < 10, 0).otherwise(100).alias("more"))
    return docs.join(many, docs.doc_id == many.key).select((F.col("doc_id") + F.col("more")).alias("doc_id"), "text")


HOWS = ["explode", "union", "cross", "one to many", "same path"]


@pytest.mark.parametrize("how", HOWS)
def test_one_of_each_group_stays(spark, table, how):
    docs = doubled(spark, table, how)
    assert not common.plain_scan(docs) and docs.count() == 20
    for drop in (drop_exact_duplicates, drop_near_copies, drop_near_duplicates):
        assert sorted(r["doc_id"] for r in drop(docs).collect()) == list(range(10)), drop.__name__
    groups = exact_groups(docs).collect()
    assert len(groups) == 20 and sum(r["kept"] for r in groups) == 10 and all(r["group_size"] == 2 and r["keep_id"] < 10 for r in groups)


@pytest.mark.parametrize("how", HOWS[:4])
def test_records_of_joined_pages(spark, table, how):
    pages = doubled(spark, table, how).select(F.col("doc_id").alias("page_id"), F.lit("http://x").alias("url"), F.col("text").alias("html"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["intact"]) for r in warc_round_trip(pages).collect()}
    assert got == {i: ("revisit", i + 100, True) for i in range(10)} | {i + 100: ("response", None, True) for i in range(10)}


def test_which_plans_are_scans(spark, table):
    docs = spark.read.parquet(table)
    docs.createOrReplaceTempView("scanned")
    assert common.plain_scan(docs) and common.plain_scan(spark.table("scanned").where("doc_id > 1").select("text"))
    assert not any(map(common.plain_scan, (docs.limit(3), docs.where(F.rand() < 0.5), docs.distinct(), docs.sample(0.5), spark.range(3))))
