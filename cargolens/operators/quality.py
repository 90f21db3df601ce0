"""Shipment quality: predicates, outlier bounds, the cascade, the validity flag and reports.

Missing values decide as documented at each predicate, so every predicate is
true or false, never null.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.operators.order import beside, exact_quantiles, with_quantiles
from cargolens.sources.written import once

# Default and alternative rules.
FLOORS = {
    "mango": 1500, "avocado": 2000, "blueberry": 1800, "strawberry": 1500, "raspberry": 2000, "passion_fruit": 1800, "pineapple": 800, "papaya": 800, "lucuma": 2000, "golden_berry": 1500, "cherimoya": 2500,
    "pomegranate": 1500, "grape": 1000, "banana": 500,
}
SAMPLE_WORDS = ("MUESTRA", "SIN VALOR COMERCIAL", "ENVIO DE MUESTRAS", "SAMPLE", "NO COMMERCIAL VALUE", "TEST SHIPMENT", "TRIAL")
AIR_WORDS = ("AÉREO", "AEREO", "AIR")
OTHER_SAMPLE_WORDS = ("MUESTRA", "SIN VALOR COMERCIAL", "SIN VALOR", "SAMPLE", "TEST")


@dataclass(frozen=True)
class Rules:
    """A set of thresholds; the column names are those of the shipments view."""

    floors: dict[str, float] = field(default_factory=lambda: dict(FLOORS))
    default_floor: float = 500
    sample_words: Sequence[str] = SAMPLE_WORDS
    air_words: Sequence[str] = AIR_WORDS
    min_mt: float = 0.1
    multiplier: float = 1.5
    first: dt.date | None = None
    last: dt.date | None = None


#: The rules of the worldwide price summary: nine floors, its own sample words, twelve months.
WORLDWIDE_RULES = Rules(
    floors={"acai": 1000, "avocado": 2000, "banana": 800, "blueberry": 1800, "golden_berry": 1000, "grape": 800, "mango": 1500, "pineapple": 1000, "strawberry": 1500},
    sample_words=OTHER_SAMPLE_WORDS, first=dt.date(2024, 11, 1), last=dt.date(2025, 10, 31),
)


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return _sure(F.upper(text).rlike("|".join(words)))


def is_air(rules: Rules = Rules()) -> Column:
    """Shipped by air: the word anywhere in the way of transport; missing isn't."""
    return _any_word(F.col("via"), rules.air_words)


def is_sample(rules: Rules = Rules()) -> Column:
    """A sample by its words, under 10 kg, or worth more than 0 and less than 10."""
    return _any_word(F.col("description"), rules.sample_words) | _sure(F.col("net_weight_mt") < 0.01) | _sure((F.col("fob_usd") > 0) & (F.col("fob_usd") < 10))


def is_small(rules: Rules = Rules()) -> Column:
    """Under the least weight; missing is small."""
    return F.col("net_weight_mt").isNull() | _sure(F.col("net_weight_mt") < rules.min_mt)


def below_floor(rules: Rules = Rules()) -> Column:
    """Price missing, not positive, or under the product's floor."""
    floor = F.lit(float(rules.default_floor))
    for name, value in rules.floors.items():
        floor = F.when(F.col("fruit_name") == name, float(value)).otherwise(floor)
    price = F.col("usd_per_mt")
    return price.isNull() | _sure(price <= 0) | _sure(price < floor)


def iqr_bounds(df: DataFrame, keys: Sequence[str] = ("fruit_name",), multiplier: float = 1.5, price: str = "usd_per_mt") -> DataFrame:
    """q1, q3, iqr and the bounds per group; linear quantiles of the non-null prices. Null keys have none."""
    q = exact_quantiles(once(df.dropna(subset=[*keys]), *keys, price), keys, price, {"q1": 0.25, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))
    return q.withColumn("lower", F.col("q1") - multiplier * F.col("iqr")).withColumn("upper", F.col("q3") + multiplier * F.col("iqr"))


def outside_bounds(price: str = "usd_per_mt") -> Column:
    """Price missing, not positive, or outside lower..upper; without bounds only the first two."""
    p = F.col(price)
    return p.isNull() | _sure(p <= 0) | _sure((p < F.col("lower")) | (p > F.col("upper")))


def _with_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    own = bounds.select(F.col("fruit_name").alias("_fruit"), "lower", "upper")
    return df.join(own, F.col("fruit_name") == F.col("_fruit"), "left").drop("_fruit")


def cascade_filter(df: DataFrame, rules: Rules = Rules(), iqr: bool = True) -> DataFrame:
    """Rows that are neither air, sample, small nor below the floor, nor outside bounds taken from the rows that are left; a row without a product has no bounds."""
    df = df if rules.first is None else df.where(F.col("date").between(rules.first, rules.last))
    left = df.where(~(is_air(rules) | is_sample(rules) | is_small(rules) | below_floor(rules)))
    if not iqr:
        return left
    return _with_bounds(left, iqr_bounds(left, multiplier=rules.multiplier)).where(~outside_bounds()).drop("lower", "upper")


def validity_flag(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """df with analysis_valid 0/1: the cascade's tests, but with bounds from all rows that have a price, and a multiplier of 1.5."""
    bounds = iqr_bounds(df.where(F.col("usd_per_mt").isNotNull()))
    bad = is_air(rules) | is_sample(rules) | is_small(rules) | below_floor(rules) | (F.col("lower").isNotNull() & outside_bounds())
    return _with_bounds(df, bounds).withColumn("analysis_valid", (~bad).cast("int")).drop("lower", "upper")


def clean_view(df: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Valid rows in the date range; df is flagged first if it isn't."""
    flagged = df if "analysis_valid" in df.columns else validity_flag(df)
    kept = flagged.where("analysis_valid = 1")
    return kept if first is None else kept.where(F.col("date").between(first, last))


def filter_stats(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row: all records, and how many each criterion hits by itself."""
    return df.agg(F.count(F.lit(1)).alias("total_records"), *(F.count_if(c).alias(n) for n, c in (("air_shipments", is_air(rules)), ("samples", is_sample(rules)), ("small_shipments", is_small(rules)), ("below_price_floor", below_floor(rules)))))


def exclusions(df: DataFrame, rules: Rules) -> DataFrame:
    """Count and tons of the rows that each criterion hits first, in the cascade's order."""
    reason = F.when(is_air(rules), "air").when(is_sample(rules), "sample").when(is_small(rules), "small").when(below_floor(rules), "floor").otherwise("kept")
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"))


def _told(df: DataFrame, keys: Sequence[str], price: str) -> tuple[DataFrame, Column, Column]:
    """df with its groups' statistics, and the tests by quartiles and by deviation."""
    own = once(df, *keys, price)
    stats = own.groupBy(*keys).agg(F.count(price).alias("_n"), F.avg(price).alias("_m"), F.stddev_pop(price).alias("_d"))
    stats = with_quantiles(stats, own, keys, price, {"_q1": 0.25, "_q3": 0.75})
    q1, q3, p = F.col("_q1"), F.col("_q3"), F.col(price)
    far = _sure((p < q1 - 1.5 * (q3 - q1)) | (p > q3 + 1.5 * (q3 - q1))) & (F.col("_n") >= 4)
    high = _sure(F.abs(p - F.col("_m")) > 3 * F.col("_d")) & (F.col("_n") >= 3) & _sure(F.col("_d") > 0)
    return beside(df if {*df.columns} - {*keys, price} else own, stats, keys), far, high


def outliers(df: DataFrame, keys: Sequence[str], price: str = "usd_per_mt") -> DataFrame:
    """df with iqr_outlier (groups of 4 or more), z_outlier (3 or more, population deviation, over 3) and both_outlier (5 or more). Rows meet their group's statistics in a join, as those are few; null keys are a group."""
    told, far, high = _told(df, keys, price)
    return told.withColumns({"iqr_outlier": far, "z_outlier": high, "both_outlier": far & high & (F.col("_n") >= 5)}).drop("_n", "_m", "_d", "_q1", "_q3")


def outlier_counts(df: DataFrame, keys: Sequence[str], price: str = "usd_per_mt") -> DataFrame:
    """Outliers per group; null keys are left out."""
    told, far, high = _told(df.select(*keys, price).dropna(subset=[*keys]), keys, price)
    return told.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(far).alias("iqr_outliers"), F.count_if(high).alias("z_outliers"), F.count_if(far & high & (F.col("_n") >= 5)).alias("both_outliers"))


def quality_report(df: DataFrame) -> DataFrame:
    """One row with the counts of eight checks and whether their share is over its threshold."""
    n = F.count(F.lit(1))
    share = lambda c: 100 * F.count_if(c) / n
    price, mt = F.col("usd_per_mt"), F.col("net_weight_mt")
    none = lambda c: c.isNull() | (c == 0)
    checks = {
        "unknown_fruit": (F.coalesce(F.col("fruit_name"), F.lit("unknown")) == "unknown", 1), "zero_price": (none(price), 5), "zero_volume": (none(mt), 5), "high_price": (_sure(price > 10000), 0), "low_price": (_sure((price > 0) & (price < 500)), 0),
        "unknown_format": (F.coalesce(F.col("format_type"), F.lit("unknown")) == "unknown", 10), "unknown_certification": (F.coalesce(F.col("certification"), F.lit("unknown")) == "unknown", 70),
    }
    out = [n.alias("total_records"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date")]
    for name, (test, most) in checks.items():
        out += [F.count_if(test).alias(name), (share(test) > most).alias(f"{name}_warns")]
    return df.agg(*out)
