"""Kept rollups: a table of mergeable sums by all dimensions, month and price, refreshed by increments, from which the summaries, drill-downs and views are read without the facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions.numbers import r4
from cargolens.operators.order import WHOLE, beside, dealt, quantiles_of_counts, quantiles_of_groups
from cargolens.operators.pricing import DIMENSIONS, QUARTILES, region_filter
from cargolens.sources.store import Store, summed
from cargolens.sources.written import once, written

KEYS = ["fruit_name", "exporter", "importer", "format_type", "size_mm", "certification", "country", "region", "usd_per_mt", "weighed", "month"]
SUMS = ["n", "mt", "fob"]


def units(df: DataFrame) -> DataFrame:
    """Each shipment as a state of its own, in the columns of states()."""
    told = df.withColumn("weighed", F.coalesce(F.col("net_weight_mt") > 0, F.lit(False))).withColumn("month", F.date_format("date", "yyyy-MM"))
    return told.select(*KEYS, F.lit(1).cast("bigint").alias("n"), F.col("net_weight_mt").alias("mt"), F.col("fob_usd").alias("fob"))


def states(df: DataFrame) -> DataFrame:
    """Shipments as states: number, tons and value by every key. weighed says whether the weight is positive; month is null without a date."""
    return summed(units(df), KEYS, SUMS)


class Rollup:
    """States in a Store by month. A price is a key of its state, so that counts by price merge and quantiles stay exact."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = Store(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, df: DataFrame) -> Rollup:
        """A rollup of these shipments, or of none if df has no rows."""
        Store.create(states(df), path, "month")
        return cls(spark, path)

    def add(self, df: DataFrame, increment: str) -> bool:
        """Merge further shipments, such as a day's; only their months are written. An increment that was merged already is left out: False. df is read twice, once for its months, and by the merge as summed() tells."""
        return self.store.merge(units(df), KEYS, SUMS, increment) is not None

    def quartiles(self, dimension: str = "fruit", region: str | None = None, where: dict[str, str] | None = None) -> DataFrame:
        """As pricing.quartile_summary, or with `where` (dimension: value) as its drill-down."""
        column = DIMENSIONS[dimension]
        own = region_filter(self.store.read(), region).where(F.col(column).isNotNull() & F.col("usd_per_mt").isNotNull() & F.col("weighed"))
        for name, value in (where or {}).items():
            own = own.where(F.col(DIMENSIONS[name]) == value)
        more = ["fruit_name"] if dimension == "exporter" else []
        own = once(own.withColumn(dimension, F.col(column)), dimension, *more, "usd_per_mt", "n", "mt")
        out = own.groupBy(dimension).agg(F.round(F.sum("mt"), 2).alias("total_mt"), F.sum("n").alias("records"), F.count(F.lit(1)).alias("_m"), *(F.countDistinct(c).alias("fruits") for c in more))
        out = written(out, "totals")
        values = own.select(dimension, F.col("usd_per_mt").cast("double").alias("_v"), F.col("n").alias("_n"))
        most, rows = out.agg(F.max("_m"), F.sum("_m")).first()
        if (most or 0) <= WHOLE:  # one shuffle
            found = quantiles_of_groups(dealt(values, rows or 0, dimension), [dimension], QUARTILES)
        else:
            found = quantiles_of_counts(values.groupBy(dimension, "_v").agg(F.sum("_n").alias("_n")), [dimension], QUARTILES)
        out = beside(out, found, [dimension])
        return out.select(dimension, *(r4(n).alias(n) for n in QUARTILES), "total_mt", "records", *(["fruits"] if more else [])).orderBy(F.col("total_mt").desc(), dimension)

    def price_range(self, keys: Sequence[str], weighed: bool = False) -> DataFrame:
        """As pricing.price_range by these keys; `month` is one."""
        own = self.store.read()
        own = own.where("weighed") if weighed else own
        p, n = F.col("usd_per_mt"), F.col("n")
        mean = F.sum(p * n) / F.sum(F.when(p.isNotNull(), n))
        return own.groupBy(*keys).agg(F.sum("n").alias("shipments"), F.round(F.sum("mt"), 2).alias("total_mt"), r4(mean).alias("avg_price"), r4(F.min(p)).alias("min_price"), r4(F.max(p)).alias("max_price"), F.round(F.sum("fob"), 2).alias("total_fob"))

    def exporter_products(self) -> DataFrame:
        return self.price_range(["exporter", "fruit_name", "format_type", "size_mm", "certification", "region"])

    def destination_products(self) -> DataFrame:
        return self.price_range(["country", "region", "fruit_name", "format_type", "size_mm", "certification"])

    def regional_exports(self) -> DataFrame:
        return self.price_range(["region", "country", "fruit_name", "format_type", "certification"])

    def monthly_exports(self) -> DataFrame:
        out = self.price_range(["fruit_name", "month"], weighed=True).withColumnRenamed("month", "ym")
        year, month = F.substring("ym", 1, 4), F.substring("ym", 6, 2)
        return out.select("fruit_name", year.alias("year"), month.alias("month"), month.cast("int").alias("month_num"), *(c for c in out.columns if c not in ("fruit_name", "ym")))
