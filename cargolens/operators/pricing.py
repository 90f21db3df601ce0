"""Price summaries: quartiles by dimension, drill-downs, dimension views, detailed statistics, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.numbers import r4
from cargolens.operators.order import beside, dealt, exact_quantiles, with_quantiles
from cargolens.sources.written import once, written

DIMENSIONS = {"fruit": "fruit_name", "exporter": "exporter", "importer": "importer", "format": "format_type", "country": "country", "certification": "certification", "size": "size_mm"}


QUARTILES = {"low_price": 0.25, "mid_price": 0.5, "high_price": 0.75}


def region_filter(df: DataFrame, region: str | None) -> DataFrame:
    """Europe, RoW (both without rows of unknown region), anything else keeps all."""
    return {"Europe": lambda: df.where(F.col("region") == "Europe"), "RoW": lambda: df.where(F.col("region") != "Europe")}.get(region, lambda: df)()


def _priced(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & F.col("usd_per_mt").isNotNull() & (F.col("net_weight_mt") > 0))


def quartile_summary(df: DataFrame, dimension: str = "fruit", region: str | None = None) -> DataFrame:
    """Quartile prices, tons and records by a dimension, most tons first; exporters also get their number of products."""
    column = DIMENSIONS[dimension]
    more = [F.countDistinct("fruit_name").alias("fruits")] if dimension == "exporter" else []
    own = _priced(region_filter(df, region), column).withColumn(dimension, F.col(column))
    own = once(own, dimension, *(["fruit_name"] if more else []), "net_weight_mt", "usd_per_mt")
    out = own.groupBy(dimension).agg(F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), F.count("usd_per_mt").alias("records"), *more)
    out = with_quantiles(out, own, [dimension], "usd_per_mt", QUARTILES)
    return out.select(dimension, *(r4(n).alias(n) for n in QUARTILES), "total_mt", "records", *(["fruits"] if more else [])).orderBy(F.col("total_mt").desc(), dimension)


def drill_down(df: DataFrame, dimension: str, value: str, by: str, region: str | None = None) -> DataFrame:
    """quartile_summary by another dimension, of the rows with one value."""
    return quartile_summary(df.where(F.col(DIMENSIONS[dimension]) == value), by, region)


def in_whole_units(summary: DataFrame, columns: Sequence[str] = ("low_price", "mid_price", "high_price", "total_mt")) -> DataFrame:
    """Figures for display, rounded half to even."""
    return summary.select(*(F.bround(c, 0).cast("bigint").alias(c) if c in columns else F.col(c) for c in summary.columns))


def price_range(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records, tons, FOB and least, mean and largest price by keys; null keys are groups."""
    p = "usd_per_mt"
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("shipments"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), r4(F.avg(p)).alias("avg_price"), r4(F.min(p)).alias("min_price"), r4(F.max(p)).alias("max_price"), F.round(F.sum("fob_usd"), 2).alias("total_fob"))


def exporter_products(df: DataFrame) -> DataFrame:
    return price_range(df, ["exporter", "fruit_name", "format_type", "size_mm", "certification", "region"])


def destination_products(df: DataFrame) -> DataFrame:
    return price_range(df, ["country", "region", "fruit_name", "format_type", "size_mm", "certification"])


def regional_exports(df: DataFrame) -> DataFrame:
    return price_range(df, ["region", "country", "fruit_name", "format_type", "certification"])


def monthly_exports(df: DataFrame) -> DataFrame:
    """By product, year and month, of rows with weight."""
    d = F.col("date")
    dated = df.where(F.col("net_weight_mt") > 0).select("*", F.date_format(d, "yyyy").alias("year"), F.date_format(d, "MM").alias("month"), F.month(d).alias("month_num"))
    return price_range(dated, ["fruit_name", "year", "month", "month_num"])


def two_level(df: DataFrame) -> DataFrame:
    """By region, the number of countries and the sum of their sums."""
    inner = df.groupBy("region", "country").agg(F.count(F.lit(1)).alias("n"), F.sum("net_weight_mt").alias("mt"))
    return inner.groupBy("region").agg(F.count("country").alias("countries"), F.sum("n").alias("shipments"), F.round(F.sum("mt"), 2).alias("total_mt"))


def table_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *(F.countDistinct(c).alias(f"{c}s") for c in ("exporter", "importer", "country")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value")


def available_values(df: DataFrame, dimension: str) -> DataFrame:
    """Values of a known dimension with records and tons, most records first."""
    return df.where(F.col(DIMENSIONS[dimension]).isNotNull()).groupBy(F.col(DIMENSIONS[dimension]).alias("value")).agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt")).orderBy(F.col("records").desc(), "value")


def price_analysis(df: DataFrame, least: int = 3, limit: int = 50) -> DataFrame:
    """Price ranges of product, format, size, certification and region with `least` records; the `limit` largest."""
    keys = ["fruit_name", "format_type", "size_mm", "certification", "region"]
    out = df.where("usd_per_mt > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"), r4(F.min("usd_per_mt")).alias("min_price"), r4(F.avg("usd_per_mt")).alias("avg_price"), r4(F.max("usd_per_mt")).alias("max_price"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"))
    out = out.where(F.col("sample_count") >= least).withColumn("spread_pct", r4(F.try_divide(100 * (F.col("max_price") - F.col("min_price")), F.col("min_price"))))
    return out.orderBy(F.col("total_mt").desc(), *keys).limit(limit)


def conditional_sums(df: DataFrame) -> DataFrame:
    """By exporter: tons in all, organic, in Europe, organic in Europe."""
    mt, organic, europe = F.col("net_weight_mt"), F.col("certification") == "organic", F.col("region") == "Europe"
    part = lambda c: F.round(F.coalesce(F.sum(F.when(c, mt)), F.lit(0.0)), 2)
    return df.groupBy("exporter").agg(F.round(F.sum(mt), 2).alias("total_mt"), part(organic).alias("organic_mt"), part(europe).alias("europe_mt"), part(organic & europe).alias("europe_organic_mt"))


def weighted_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean price weighted by tons, its deviation sqrt(sum w (p - mean)^2 / sum w) and its coefficient in percent; two passes, so that large prices don't cancel."""
    p, w = F.col("usd_per_mt"), F.col("net_weight_mt")
    means = df.where((p > 0) & (w > 0)).groupBy(*keys).agg((F.sum(p * w) / F.sum(w)).alias("mean"))
    spread = df.where((p > 0) & (w > 0)).join(means, [*keys]).groupBy(*keys).agg(F.first("mean").alias("m"), F.sqrt(F.sum(w * (p - F.col("mean")) * (p - F.col("mean"))) / F.sum(w)).alias("s"))
    return spread.select(*keys, r4("m").alias("weighted_mean"), r4("s").alias("weighted_std"), r4(100 * F.col("s") / F.col("m")).alias("cv_pct"))


def detail_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, median, sample deviation, extremes, tons, destinations, organic and certifications by keys; null keys are left out."""
    p, own = "usd_per_mt", once(df.dropna(subset=[*keys]), *keys, "usd_per_mt", "net_weight_mt", "country", "certification")
    out = own.groupBy(*keys).agg(
        F.count(p).alias("shipments"), r4(F.avg(p)).alias("avg_price"), r4(F.stddev_samp(p)).alias("std_price"), r4(F.min(p)).alias("min_price"), r4(F.max(p)).alias("max_price"),
        F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), F.array_join(F.array_sort(F.collect_set("country")), ", ").alias("destinations"), F.bool_or(F.col("certification") == "organic").alias("has_organic"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("certification") != "unknown", F.col("certification")))), ", ").alias("certifications"),
    )
    return _with_median(out, own, keys)


def _with_median(out: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return with_quantiles(out, df, keys, "usd_per_mt", {"median_price": 0.5}).withColumn("median_price", r4("median_price"))


def exporter_summary(df: DataFrame) -> DataFrame:
    keys = ["fruit_name", "exporter"]
    p, df = "usd_per_mt", once(df, *keys, "usd_per_mt", "net_weight_mt", "format_type")
    # sums by format first: rows of a group are dealt to several tasks, and sets take a row for each format
    each = dealt(df, df.count(), *keys, "format_type").groupBy(*keys, "format_type").agg(F.count(F.lit(1)).alias("n"), F.count(p).alias("priced"), F.sum(p).alias("sum"), F.sum("net_weight_mt").alias("mt"))
    out = each.groupBy(*keys).agg(F.sum("n").alias("shipments"), r4(F.try_divide(F.sum("sum"), F.sum("priced"))).alias("avg_price"), F.round(F.sum("mt"), 2).alias("total_mt"), F.array_join(F.array_sort(F.collect_set("format_type")), ", ").alias("formats"))
    return _with_median(out, df, keys)


def format_summary(df: DataFrame) -> DataFrame:
    keys = ["fruit_name", "format_type"]
    df = once(df, *keys, "usd_per_mt", "net_weight_mt", "exporter")
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("shipments"), r4(F.avg("usd_per_mt")).alias("avg_price"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), F.countDistinct("exporter").alias("exporters"))
    return _with_median(out, df, keys)


def pivot_median(df: DataFrame, fruits: Sequence[str]) -> DataFrame:
    """Median price by certification and format, a column for each given product."""
    keys = ["certification", "format_type"]
    df = once(df, *keys, "fruit_name", "usd_per_mt")
    medians = exact_quantiles(df.where(F.col("fruit_name").isin(*fruits)), [*keys, "fruit_name"], "usd_per_mt", {"median": 0.5})
    out = df.groupBy(*keys).agg(F.lit(1).alias("_one"))  # rows without any of the products stay
    out = beside(out, medians.groupBy(*keys).pivot("fruit_name", list(fruits)).agg(r4(F.max("median"))), keys)
    return out.select("certification", "format_type", *(F.col(f"`{f}`").alias(f.lower().replace(" ", "_")) for f in fruits))


def master_table(df: DataFrame) -> DataFrame:
    """By product, exporter and certification: count, median, mean, quartiles, tons, destinations and the quartiles' distance."""
    keys = ["fruit_name", "exporter", "certification"]
    df = once(df, *keys, "usd_per_mt", "net_weight_mt", "country")
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("shipments"), r4(F.avg("usd_per_mt")).alias("avg_price"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), F.countDistinct("country").alias("destinations"))
    out = with_quantiles(out, df, keys, "usd_per_mt", {"q1": 0.25, "median_price": 0.5, "q3": 0.75})
    return out.select(*keys, "shipments", "avg_price", r4("q1").alias("q1"), r4("median_price").alias("median_price"), r4("q3").alias("q3"), r4(F.col("q3") - F.col("q1")).alias("width"), "total_mt", "destinations")


def master_totals(df: DataFrame) -> DataFrame:
    """The master table by product: exporters, shipments, tons, median of medians."""
    master = written(master_table(df), "master")
    out = master.groupBy("fruit_name").agg(F.countDistinct("exporter").alias("exporters"), F.sum("shipments").alias("shipments"), F.round(F.sum("total_mt"), 2).alias("total_mt"))
    return with_quantiles(out, master, ["fruit_name"], "median_price", {"median_of_medians": 0.5}).withColumn("median_of_medians", r4("median_of_medians"))


def recommended_ranges(df: DataFrame) -> DataFrame:
    """Price statistics by product with the range inside 1.5 quartile distances, the prices outside it by quartiles, by deviation (over 3) and by either, and count, mean and extremes of the others. The deviation is the sample's under 5 records, else the population's. Groups under 4 records have no quartile outliers, under 3 none by deviation."""
    p, keys = "usd_per_mt", ["fruit_name"]
    own = once(df.where("usd_per_mt > 0"), *keys, p)
    g = own.groupBy(*keys).agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.when(F.count(p) < 5, F.stddev_samp(p)).otherwise(F.stddev_pop(p)).alias("std"), F.stddev_pop(p).alias("dev"), F.min(p).alias("lo"), F.max(p).alias("hi"))
    g = with_quantiles(g, own, keys, p, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    price, n, low, high = F.col(p), F.col("n"), F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    far = (n >= 4) & ((price < low) | (price > high))
    odd = (n >= 3) & (F.col("dev") > 0) & (F.abs(price - F.col("mean")) > 3 * F.col("dev"))
    clean = lambda f: f(F.when(~(far | odd), price))
    told = beside(own.select(*keys, p), g, keys, "inner").groupBy(*keys).agg(
        F.count_if(far).alias("iqr_outliers"), F.count_if(odd).alias("z_outliers"), F.count_if(far | odd).alias("outliers"), clean(F.count).alias("clean_n"), r4(clean(F.avg)).alias("clean_mean"), r4(clean(F.min)).alias("clean_min"), r4(clean(F.max)).alias("clean_max")
    )
    r = lambda c, name: r4(c).alias(name)
    out = g.select(*keys, "n", r("mean", "mean_price"), r("median", "median_price"), r("std", "std_price"), r("q1", "q1"), r("q3", "q3"), r(F.greatest("lo", low), "recommended_min"), r(F.least("hi", high), "recommended_max"))
    return beside(out, told, keys)


def split_volumes(df: DataFrame, test: Column, names: tuple[str, str]) -> DataFrame:
    """Tons by product where the test holds and where it doesn't, missing sides as 0."""
    mt = F.col("net_weight_mt")
    part = lambda c: F.round(F.coalesce(F.sum(F.when(c, mt)), F.lit(0.0)), 2)
    return df.groupBy("fruit_name").agg(part(test).alias(names[0]), part(~test).alias(names[1]), F.round(F.sum(mt), 2).alias("total_mt"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: totals, weighted price, distinct counts, tons by product, format and size, and the ten largest destinations, each as "name=tons" in order, joined by "; ". Tons have two decimals; a null name is "unknown"."""
    totals = df.agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), F.round(F.sum("fob_usd"), 2).alias("total_fob"), r4(F.sum("fob_usd") / F.sum("net_weight_mt")).alias("weighted_price"), F.countDistinct("exporter").alias("exporters"), F.countDistinct("country").alias("countries"))
    # one pass for all four: each row counts once for each dimension
    dimensions = (("by_fruit", "fruit_name"), ("by_format", "format_type"), ("by_size", "size_mm"), ("top_destinations", "country"))
    parts = F.array(*(F.struct(F.lit(d).alias("part"), F.coalesce(F.col(c), F.lit("unknown")).alias("name")) for d, c in dimensions))
    each = df.select(F.explode(parts).alias("p"), "net_weight_mt").groupBy("p.part", "p.name").agg(F.sum("net_weight_mt").cast("decimal(38,2)").alias("mt"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("mt").desc(), "name"))
    heads = each.where("part <> 'top_destinations'").select("part", "name", "mt", F.col("name").alias("at"))
    tops = each.where("part = 'top_destinations'").withColumn("i", place).where("i <= 10").select("part", "name", "mt", F.lpad(F.col("i").cast("string"), 2, "0").alias("at"))
    texts = heads.unionByName(tops).groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "mt"))), lambda x: F.concat_ws("=", x["name"], x["mt"].cast("string"))), "; ").alias("text"))
    maps = texts.agg(*(F.max(F.when(F.col("part") == d, F.col("text"))).alias(d) for d, _ in dimensions))
    return totals.crossJoin(F.broadcast(maps))  # one row by one row


def product_quote(df: DataFrame, fruit: str) -> DataFrame:
    """Quartile prices, tons and records of one product."""
    own = df.where((F.col("fruit_name") == fruit) & F.col("usd_per_mt").isNotNull()).withColumn("fruit", F.lit(fruit))
    own = once(own, "fruit", "usd_per_mt", "net_weight_mt")
    g = with_quantiles(own.groupBy("fruit").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt")), own, ["fruit"], "usd_per_mt", QUARTILES)
    return g.select("fruit", *(r4(n).alias(n) for n in QUARTILES), "records", "total_mt")


def exporter_audit(df: DataFrame, fruits: Sequence[str]) -> DataFrame:
    """By product and exporter, of the given products: tons, shipments and the mean of the positive prices."""
    own = df.where(F.col("fruit_name").isin(*fruits))
    return own.groupBy("fruit_name", "exporter").agg(F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), F.count(F.lit(1)).alias("shipments"), r4(F.avg(F.when(F.col("usd_per_mt") > 0, F.col("usd_per_mt")))).alias("avg_positive_price"))


def fruit_report(df: DataFrame, fruit: str | None = None, region: str = "Europe") -> DataFrame:
    """(part, name, shipments, total_mt, avg_price, exporters): a header, then by country, exporter and format; of one product or all. One pass: each row counts once for each part."""
    own = region_filter(df, region)
    own = own if fruit is None else own.where(F.col("fruit_name") == fruit)
    parts = F.array(*(F.struct(F.lit(p).alias("part"), c.alias("name")) for p, c in (("all", F.lit(None).cast("string")), ("country", F.col("country")), ("exporter", F.col("exporter")), ("format", F.coalesce("format_type", F.lit("Unknown"))))))
    return own.select(F.explode(parts).alias("p"), "net_weight_mt", "usd_per_mt", "exporter").groupBy("p.part", "p.name").agg(F.count(F.lit(1)).alias("shipments"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), r4(F.avg("usd_per_mt")).alias("avg_price"), F.countDistinct("exporter").alias("exporters"))


def product_totals(df: DataFrame) -> DataFrame:
    """By the four product keys: records, tons, value and the weighted price; null keys are left out."""
    keys = ["fruit_name", "format_type", "size_mm", "certification"]
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), F.round(F.sum("fob_usd"), 2).alias("total_fob"), r4(F.sum("fob_usd") / F.sum("net_weight_mt")).alias("weighted_price"))
