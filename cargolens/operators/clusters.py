"""Company-name clusters and canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions import names as N
from cargolens.functions.numbers import r4
from cargolens.operators.similar import block_heads, dealt, greedy_names
from cargolens.sources.written import written


def name_counts(df: DataFrame, column: str) -> DataFrame:
    """(name, n) of the valid names, most frequent first."""
    return df.where(N.is_valid_name(F.col(column))).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name")


def cluster_names(counts: DataFrame, within: int = 80, across: int = 90, spacing: int = 95, least_length_ratio: float = 0.7) -> DataFrame:
    """(canonical_name, aliases, count) of (name, n).

    Names are blocked by core name; in a block the better of token-sort and
    token-set ratio joins a name to a more frequent root. Canonical names of the
    blocks' clusters are then merged in order of count where they are nearly the same with or without
    spaces and of similar length. Ties go by name. Names of one cleaned form, and clusters of one
    canonical name, are compared once; a null name is none.
    """
    told = dealt(counts.where("name is not null")).select("name", "n", N.clean_company(F.col("name")).alias("cleaned"))
    told = told.select("name", "n", "cleaned", N.core_name(F.col("cleaned")).alias("core"), N.brand_name(F.col("cleaned")).alias("brand"))
    # only what is written is filtered: else names are cleaned for the filter too, in the tasks that read them
    cleaned = written(told, "cleaned", "zstd").where("core <> ''")
    forms = cleaned.groupBy(F.col("core").alias("block"), F.col("cleaned").alias("form")).agg(F.min(F.struct((-F.col("n")).alias("less"), "name")).alias("place"))
    forms = written(forms, "forms")
    heads = block_heads(forms, lambda a, b: max(N.token_sort_ratio(a, b), N.token_set_ratio(a, b)) >= within)
    named = heads.join(forms.select("block", F.col("form").alias("head"), F.col("place.name").alias("root")), ["block", "head"]).select(F.col("block").alias("core"), F.col("form").alias("cleaned"), "root")
    placed = cleaned.join(named, ["core", "cleaned"])
    best = F.max_by("brand", F.struct("n", F.length("name"), "name"))
    groups = written(placed.groupBy("root").agg(best.alias("name"), F.sum("n").alias("n"), F.array_sort(F.collect_list("name")).alias("aliases")), "groups")

    nodes = written(groups.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("less"), "name", "root")).alias("place")), "nodes")
    merged = greedy_names(nodes, across, spacing, least_length_ratio)
    top = F.min_by("name", F.struct((-F.col("n")).alias("less"), (-F.length("name")).alias("shorter"), "name", "root"))
    return groups.join(merged, "name").groupBy("head").agg(top.alias("canonical_name"), F.array_sort(F.flatten(F.collect_list("aliases"))).alias("aliases"), F.sum("n").alias("count")).drop("head")


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """One row: names, clusters, clusters of several names, the largest, reduction in percent."""
    n = F.sum(F.size("aliases"))
    return clusters.agg(n.alias("names"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.size("aliases") > 1).alias("merged"), F.max(F.size("aliases")).alias("largest"), r4(100 * (1 - F.count(F.lit(1)) / n)).alias("reduction_pct"))


def variations(clusters: DataFrame, canonical: str | None = None) -> DataFrame:
    """(canonical_name, alias, aliases): each alias of each canonical name, or of one in any case, and how many that name has. The root is an alias already."""
    own = clusters if canonical is None else clusters.where(F.upper("canonical_name") == canonical.upper())
    return own.select("canonical_name", F.explode("aliases").alias("alias"), F.size("aliases").alias("aliases"))


def canonical_list(clusters: DataFrame) -> DataFrame:
    """Canonical names in order."""
    return clusters.select("canonical_name").distinct().orderBy("canonical_name")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(size, clusters, names): how many clusters have so many aliases."""
    return clusters.groupBy(F.size("aliases").alias("size")).agg(F.count(F.lit(1)).alias("clusters"), F.sum(F.size("aliases")).alias("names"))


def look_up(clusters: DataFrame | None, names: DataFrame, column: str = "name") -> DataFrame:
    """names with canonical_name: that of the alias, null for names that no cluster has. Raises if clusters is None, as they weren't loaded."""
    if clusters is None:
        raise RuntimeError("load the clusters first")
    known = clusters.select(F.explode("aliases").alias("_alias"), "canonical_name").groupBy("_alias").agg(F.min("canonical_name").alias("canonical_name"))
    return names.join(known, F.col(column) == F.col("_alias"), "left").drop("_alias")


def canonical_names(df: DataFrame, clusters: DataFrame, column: str, empty: Column | None = None) -> DataFrame:
    """df with canonical_<column>: by alias, else by the first alias with the same cleaned form, else the cleaned name; upper case. An empty name stays, or becomes `empty`."""
    alias = written(clusters.select(F.explode("aliases").alias("_alias"), F.upper("canonical_name").alias("_exact")), "aliases", "zstd")
    exact = alias.groupBy("_alias").agg(F.min("_exact").alias("_exact"))
    names = written(df.select(F.col(column).alias("_name")).distinct().join(exact, F.col("_name") == F.col("_alias"), "left").select("_name", "_exact"), "named", "zstd")
    blank = F.coalesce(F.trim("_name"), F.lit("")) == ""
    known = names.where(F.col("_exact").isNotNull() | blank).select("_name", F.when(blank, F.col("_name") if empty is None else empty).otherwise(F.col("_exact")).alias("_canonical"))
    others = names.where(F.col("_exact").isNull() & ~blank)
    if not others.isEmpty():  # only for these are forms compared: cleaning is the larger part of the work
        by_form = dealt(alias).select(N.clean_company(F.col("_alias")).alias("_form"), "_alias", "_exact").groupBy("_form").agg(F.min_by("_exact", "_alias").alias("_same"))
        own = dealt(others.select("_name")).withColumn("_own", N.clean_company(F.col("_name"))).join(by_form, F.col("_own") == F.col("_form"), "left")
        known = known.unionByName(own.select("_name", F.coalesce("_same", F.upper("_own")).alias("_canonical")))
    return df.join(known, F.col(column).eqNullSafe(F.col("_name"))).withColumn(f"canonical_{column}", F.col("_canonical")).drop("_name", "_canonical")


def name_variations(df: DataFrame, column: str) -> DataFrame:
    """By canonical name: records, number of raw names, and the names in order, cut to 200 characters."""
    c = f"canonical_{column}"
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("records"), F.countDistinct(column).alias("variations"), F.substring(F.array_join(F.array_sort(F.collect_set(column)), ", "), 1, 200).alias("names"))


def importers_by_text(df: DataFrame, column: str = "importer") -> DataFrame:
    """Raw names by their text without punctuation in upper case."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.upper(column), r"(?U)[^\w\s]", " "), r"\s+", " "))
    return df.where(F.col(column).isNotNull()).groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("records"), F.array_sort(F.collect_set(column)).alias("names"))


def canonical_audit(df: DataFrame, column: str, limit: int = 30) -> DataFrame:
    c = f"canonical_{column}"
    return df.select(c, column).distinct().orderBy(c, column).limit(limit)


def rule_clusters(df: DataFrame, column: str = "importer", where: Column | None = None) -> DataFrame:
    """(canonical_name, aliases, count) by the simpler importer rules."""
    rows = df if where is None else df.where(where)
    return rows.where(F.col(column).isNotNull()).groupBy(N.rule_clean_importer(F.col(column)).alias("canonical_name")).agg(F.array_sort(F.collect_set(column)).alias("aliases"), F.count(F.lit(1)).alias("count"))
