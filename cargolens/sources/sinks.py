"""Sinks and table upkeep."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_by_suffix(df: DataFrame, path: str) -> None:
    """Overwrite: .parquet, .csv.gz (compressed CSV) or CSV with a header; a folder of part files."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)


# Headings of summaries.
HEADINGS = {"low_price": "Low$", "mid_price": "Mid$", "high_price": "Hi$", "total_mt": "YTD MT", "records": "Records", "fruits": "Fruits"}


def headed(summary: DataFrame, dimension: str, **given: str) -> DataFrame:
    """A quartile summary under its headings, in whole units; given (dimension: value) are columns of their own in front, as in a drill-down."""
    names = [dimension, *(c for c in HEADINGS if c in summary.columns)]
    if "fruits" in names:
        names.insert(1, names.pop(names.index("fruits")))
    whole = lambda c: F.bround(c, 0).cast("bigint") if c in ("low_price", "mid_price", "high_price", "total_mt") else F.col(c)
    return summary.select(*(F.lit(v).alias(k.title()) for k, v in given.items()), *(whole(c).alias(HEADINGS.get(c, c.title())) for c in names))


def write_result(df: DataFrame, path: str, include_records: bool = False) -> None:
    """Result CSV, without the records' numbers unless wanted."""
    write_by_suffix(df if include_records else df.drop("records"), path)  # in any case, so the heading Records too


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """One folder for each value of the keys; rows of a value come from one task unless it is large."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_table(df: DataFrame, name: str, *, cluster_by: tuple[str, ...] = (), buckets: int = 0) -> None:
    """Create or replace a table; with buckets, co-located for joins on cluster_by."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.bucketBy(buckets, *cluster_by).sortBy(*cluster_by) if buckets else writer).saveAsTable(name)


def write_json(df: DataFrame, path: str, sort: str | None = None) -> None:
    """JSON lines, sorted within and across parts by `sort`."""
    (df.orderBy(sort) if sort else df).write.mode("overwrite").json(path)


def report_json(row: dict) -> str:
    """A one-row report as JSON text."""
    return json.dumps(row, ensure_ascii=False, indent=2, default=str, sort_keys=True)


def add_missing_column(df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
    """df with the column, added as value (null) if it isn't there."""
    return df if name in df.columns else df.withColumn(name, F.lit(None) if value is None else value)


def update_where(df: DataFrame, column: str, where: Column, value: Column) -> DataFrame:
    """The column set to value where the condition is true; null conditions leave it."""
    return df.withColumn(column, F.when(F.coalesce(where, F.lit(False)), value).otherwise(F.col(column)))


def update_by_key(df: DataFrame, mapping: DataFrame, key: str, column: str, found: str) -> DataFrame:
    """The column set from mapping (key, found) where the key is mapped; others stay. mapping must have each key once."""
    new = mapping.select(F.col(key).alias("_key"), F.col(found).alias("_found"))
    return df.join(new, F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce("_found", column)).drop("_key", "_found")


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)
