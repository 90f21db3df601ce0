"""Importer names and price floors as the survey lists them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cargolens.functions import names
from cargolens.operators import clusters, quality


def test_country_suffixes_and_fixes(spark):
    given = [*(f"Acme {c} Ltd." for c in names.COUNTRY_SUFFIXES), "ACME POLAND", "Acme UK", "ACME FRANCE UK", "ACME UK POLAND", "UK", "CROP'S FRUITS NV", "Crop s Fruits", "D Arta B.V.", "POLAND FOODS"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, name string")
    got = [r["c"] for r in df.select("k", names.rule_clean_importer(F.col("name")).alias("c")).orderBy("k").collect()]
    assert got == ["ACME"] * 15 + ["ACME", "ACME UK", "UK", "CROPS FRUITS", "CROPS FRUITS", "DARTA", "POLAND FOODS"]
    assert {r["canonical_name"] for r in clusters.rule_clusters(df.where("k in (13, 14)"), "name").collect()} == {"ACME"}


@pytest.mark.parametrize("fruit, floor", [("acai", 1000), ("avocado", 2000), ("banana", 800), ("blueberry", 1800), ("golden_berry", 1000), ("grape", 800), ("mango", 1500), ("pineapple", 1000), ("strawberry", 1500), ("papaya", 500)])
def test_worldwide_floors(spark, fruit, floor):
    df = spark.createDataFrame([(fruit, floor - 0.01), (fruit, float(floor))], "fruit_name string, usd_per_mt double")
    assert [r[0] for r in df.orderBy("usd_per_mt").select(quality.below_floor(quality.WORLDWIDE_RULES)).collect()] == [True, False]
