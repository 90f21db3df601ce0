"""Canonical names that are kept up to date: names that come new are compared with what is known, and appended as a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions import names as N
from cargolens.operators import clusters as C
from cargolens.operators.similar import alike_across, candidate_pairs, pair_test
from cargolens.sources.store import Store
from cargolens.sources.written import written

KINDS = "alias string, cleaned string, canonical_name string, n bigint, version int"


class AliasTable:
    """A table (alias, cleaned, canonical_name, n, version) with a partition for each version; only ever appended to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> AliasTable:
        Store.create(spark.createDataFrame([], KINDS), path, "version")
        return cls(spark, path)

    def read(self, version: int | None = None) -> DataFrame:
        """All aliases, or those up to a version."""
        df = self.store.read()
        return df if version is None else df.where(F.col("version") <= version)

    def version(self) -> int:
        return len(self.store.marks())

    def assign(self, counts: DataFrame, across: int = 90, spacing: int = 95, least_length_ratio: float = 0.7) -> int:
        """Give the names of (name, n) that have no alias yet a canonical name; how many they are. n stays as it was when a name came.

        A new name gets the canonical name of an alias with its cleaned form (the smallest, if there are several);
        else, of the canonical names that its brand name is alike to across groups, the one whose aliases
        have the largest n together (ties by name). The names left are clustered among themselves. Known names are never moved. Only pairs of a new
        and a known name are compared. A name without a core name stays without an alias, as in cluster_names.
        """
        known = self.read()
        new = counts.where("name is not null").join(known.select(F.col("alias").alias("name")).distinct(), "name", "left_anti")
        new = new.withColumn("cleaned", N.clean_company(F.col("name")))
        new = written(new.withColumn("brand", N.brand_name(F.col("cleaned"))).where(N.core_name(F.col("cleaned")) != "").select("name", "n", "cleaned", "brand"), "new")
        by_form = known.groupBy("cleaned").agg(F.min("canonical_name").alias("canonical_name"))
        same = written(new.join(by_form, "cleaned").select("name", "n", "cleaned", "canonical_name"), "same")
        left = written(new.join(same.select("name"), "name", "left_anti"), "left")

        brands, heads = left.select(F.col("brand").alias("name")).distinct(), written(known.groupBy("canonical_name").agg(F.sum("n").alias("weight")), "heads")
        nodes = written(brands.unionByName(heads.select(F.col("canonical_name").alias("name"))).distinct(), "nodes")
        pairs = candidate_pairs(nodes, across, spacing, least_length_ratio)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(nodes.select(F.col("name").alias("a"), F.col("name").alias("b")))
        met = both.join(brands.select(F.col("name").alias("a")), "a").join(heads.select(F.col("canonical_name").alias("b"), "weight"), "b")
        alike = pair_test(lambda x, y: x == y or alike_across(x, y, across, spacing, least_length_ratio))
        best = met.where(alike("a", "b")).groupBy(F.col("a").alias("brand")).agg(F.min(F.struct((-F.col("weight")).alias("less"), "b"))["b"].alias("canonical_name"))
        near = written(left.join(best, "brand").select("name", "n", "cleaned", "canonical_name"), "near")

        rest = left.join(near.select("name"), "name", "left_anti")
        own = C.variations(C.cluster_names(rest.select("name", "n"), across=across, spacing=spacing, least_length_ratio=least_length_ratio)).select(F.col("alias").alias("name"), "canonical_name")
        fresh = rest.join(own, "name").select("name", "n", "cleaned", "canonical_name")
        found = same.unionByName(near).unionByName(fresh).withColumn("version", F.lit(self.version() + 1)).withColumnRenamed("name", "alias")
        return self.store.replace(found, mark=f"{self.version() + 1:06}")["rows"]

    def clusters(self) -> DataFrame:
        """(canonical_name, aliases, count), as cluster_names gives them."""
        return self.read().groupBy("canonical_name").agg(F.array_sort(F.collect_list("alias")).alias("aliases"), F.sum("n").alias("count"))

    def name_shipments(self, df: DataFrame, column: str) -> DataFrame:
        """df with canonical_<column>, null for names without an alias."""
        known = self.read().select(F.col("alias").alias("_alias"), F.col("canonical_name").alias(f"canonical_{column}"))
        return df.drop(f"canonical_{column}").join(known, F.col(column) == F.col("_alias"), "left").drop("_alias")
