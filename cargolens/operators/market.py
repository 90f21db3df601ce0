"""Ranking, shares, time series, comparisons and scorecards."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.dates import period
from cargolens.functions.numbers import r2, r4
from cargolens.functions.places import names_of_country
from cargolens.operators.lookup import gram_index, matches, size_for
from cargolens.operators.order import beside, ranked
from cargolens.operators.pricing import DIMENSIONS

METRICS = {"volume": lambda: F.sum("net_weight_mt"), "value": lambda: F.sum("fob_usd"), "shipment_count": lambda: F.count(F.lit(1)).cast("double"), "price": lambda: F.avg("usd_per_mt")}


def pct(part: Column, whole: Column) -> Column:
    return r4(F.try_divide(100 * part, whole))


def ladder(value: Column, steps: Sequence[tuple[float, float]], rest: float) -> Column:
    """Points of the first step that value is over."""
    out = F.lit(rest)
    for over, points in reversed(steps):
        out = F.when(value > over, points).otherwise(out)
    return out


def below_ladder(value: Column, steps: Sequence[tuple[float, float]], rest: float) -> Column:
    """Points of the first step that value is under."""
    out = F.lit(rest)
    for under, points in reversed(steps):
        out = F.when(value < under, points).otherwise(out)
    return out


def totals(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """(name, total) of a metric by a dimension, rounded to cents so that ranks don't hang on the last bit."""
    return df.groupBy(F.col(DIMENSIONS[dimension]).alias("name")).agg(F.round(METRICS[metric](), 2).alias("total"))


def top_n(df: DataFrame, dimension: str, metric: str = "volume", n: int = 10) -> DataFrame:
    """The n largest with rank, share of all in percent and running share. Only n rows are ranked; the sum of all joins them as one row."""
    t = totals(df, dimension, metric)
    heads = t.orderBy(F.col("total").desc(), "name").limit(n)
    order = Window.orderBy(F.col("total").desc(), "name")
    ranked = heads.crossJoin(F.broadcast(t.agg(F.sum("total").alias("all")))).withColumns({"rank": F.row_number().over(order).cast("bigint"), "run": F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.select("rank", "name", "total", pct(F.col("total"), F.col("all")).alias("share_pct"), pct(F.col("run"), F.col("all")).alias("cumulative_pct")).orderBy("rank")


def top_per_group(df: DataFrame, group: str, dimension: str, n: int, metric: str = "volume") -> DataFrame:
    """The n largest of each group, with rank."""
    g = df.groupBy(F.col(DIMENSIONS.get(group, group)).alias("group"), F.col(DIMENSIONS[dimension]).alias("name")).agg(F.round(METRICS[metric](), 2).alias("total"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.col("total").desc(), "name")).cast("bigint")).where(F.col("rank") <= n)


def rank_of(df: DataFrame, dimension: str, value: str, metric: str = "volume") -> DataFrame:
    """One value's place among all: those with a larger total, or the same total and an earlier name, and it."""
    t = totals(df, dimension, metric)
    own = t.where(F.col("name") == value).select(F.col("name").alias("me"), F.col("total").alias("mine"))
    over = t.join(F.broadcast(own), (F.col("total") > F.col("mine")) | ((F.col("total") == F.col("mine")) & (F.col("name") <= F.col("me"))))
    return over.groupBy("me", "mine").agg(F.count(F.lit(1)).alias("rank")).select(F.col("me").alias("name"), F.col("mine").alias("total"), "rank")


def hhi(df: DataFrame, group: Sequence[str], dimension: str, metric: str = "volume") -> DataFrame:
    """Concentration of a metric over a dimension's values in each group: the sum of squared percent shares."""
    each = df.groupBy(*group, F.col(DIMENSIONS[dimension]).alias("name")).agg(METRICS[metric]().alias("t"))
    sums = each.groupBy(*group).agg(F.sum("t").alias("s"), F.sum(F.col("t") * F.col("t")).alias("ss"), F.count(F.lit(1)).alias("members"))
    return sums.select(*group, r2(F.try_divide(10000 * F.col("ss"), F.col("s") * F.col("s"))).alias("hhi"), "members")


def hhi_band(value: Column, low: float = 1500, high: float = 2500) -> Column:
    return F.when(value < low, "low").when(value < high, "moderate").otherwise("high")


def market_share(df: DataFrame, dimension: str = "exporter", metric: str = "volume", n: int = 10) -> DataFrame:
    """top_n with the market's HHI over all and its band, and the share of the first 3 and 5 (0 if there are fewer)."""
    h = hhi(df, [], dimension, metric).select("hhi", "members")
    top = top_n(df, dimension, metric, max(n, 5))
    heads = top.agg(*(F.coalesce(r4(F.sum(F.when(F.col("rank") <= k, F.col("share_pct")))), F.lit(0.0)).alias(f"top{k}") for k in (3, 5)), F.count(F.lit(1)).alias("rows"))
    one = h.crossJoin(F.broadcast(heads))  # one row by one row
    return top.where(F.col("rank") <= n).crossJoin(F.broadcast(one)).select(
        "rank", "name", "total", "share_pct", "hhi", hhi_band(F.col("hhi")).alias("concentration"), F.when(F.col("members") >= 3, F.col("top3")).otherwise(0.0).alias("top3_share"), F.when(F.col("members") >= 5, F.col("top5")).otherwise(0.0).alias("top5_share")
    )


def others_bucketing(df: DataFrame, dimension: str, share: float = 0.2, label: str = "Others") -> DataFrame:
    """(name, bucket, total): names whose running share is at most 1 - share keep their own; if those are under 3, the first max(3, 80 %) do."""
    return bucketed_names(totals(df, dimension, "volume"), [], share, F.lit(label))


def bucketed_names(sums: DataFrame, group: Sequence[str], share: float, label: Column) -> DataFrame:
    """others_bucketing of (group, name, total) in each group."""
    placed = ranked(sums, group).withColumn("keep", F.coalesce(F.try_divide(F.col("run"), F.col("all")) <= 1 - share, F.lit(False)))
    kept = placed.groupBy(*group).agg(F.count_if("keep").alias("kept"))
    few = F.col("rank") <= F.greatest(F.lit(3), F.floor(F.col("n") * 0.8))
    keep = F.when(F.col("kept") < 3, few).otherwise(F.col("keep"))
    return beside(placed, kept, group).select(*group, "name", F.when(keep, F.col("name")).otherwise(label).alias("bucket"), "total")


def time_series(df: DataFrame, metric: str = "volume", grain: str = "monthly") -> DataFrame:
    """(period, value) with the value before and growth in percent, the value a year of periods before and its growth, and trailing means of 3 and 6."""
    lag = {"monthly": 12, "weekly": 52, "daily": 365}[grain]
    each = df.groupBy(period(F.col("date"), grain).alias("period")).agg(r4(METRICS[metric]()).alias("value"))
    w = Window.orderBy("period")
    v = F.col("value")
    last, year = F.lag("value", 1).over(w), F.lag("value", lag).over(w)
    mean = lambda n: F.when(F.row_number().over(w) >= n, r4(F.avg("value").over(w.rowsBetween(1 - n, 0))))
    return each.select("period", "value", pct(v - last, last).alias("growth_pct"), pct(v - year, year).alias("yoy_pct"), mean(3).alias("ma3"), mean(6).alias("ma6"))


def trend(df: DataFrame, metric: str = "volume", grain: str = "monthly", margin: float = 5) -> DataFrame:
    """One row: means of the first and second half of the periods, and the direction; null under 6 periods."""
    each = df.groupBy(period(F.col("date"), grain).alias("period")).agg(r4(METRICS[metric]()).alias("value"))
    placed = each.withColumns({"i": F.row_number().over(Window.orderBy("period")), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    half = F.floor(F.col("n") / 2)
    g = placed.agg(F.count(F.lit(1)).alias("periods"), r4(F.avg(F.when(F.col("i") <= half, F.col("value")))).alias("first_half"), r4(F.avg(F.when(F.col("i") > half, F.col("value")))).alias("second_half"))
    a, b = F.col("first_half"), F.col("second_half")
    way = F.when(b > a * (1 + margin / 100), "increasing").when(b < a * (1 - margin / 100), "decreasing").otherwise("stable")
    return g.withColumn("direction", F.when(F.col("periods") >= 6, way))


def seasonality(df: DataFrame) -> DataFrame:
    """By product and month: mean tons of the years' month, percent above the mean of the month means, and rank as peak and as low."""
    monthly = df.groupBy("fruit_name", F.year("date").alias("y"), F.month("date").alias("month_num")).agg(F.sum("net_weight_mt").alias("mt"))
    means = monthly.groupBy("fruit_name", "month_num").agg(r4(F.avg("mt")).alias("avg_mt"))
    w = Window.partitionBy("fruit_name")
    return means.select("fruit_name", "month_num", "avg_mt", pct(F.col("avg_mt") - F.avg("avg_mt").over(w), F.avg("avg_mt").over(w)).alias("pct_above_avg"), F.row_number().over(w.orderBy(F.col("avg_mt").desc(), "month_num")).cast("bigint").alias("peak_rank"), F.row_number().over(w.orderBy("avg_mt", "month_num")).cast("bigint").alias("low_rank"))


def compare_periods(df: DataFrame, first: tuple[dt.date, dt.date], second: tuple[dt.date, dt.date]) -> DataFrame:
    """By product: tons, value, shipments and mean price in two closed ranges, with change and percent."""
    a, b = (F.col("date").between(*x) for x in (first, second))
    made = {"mt": "net_weight_mt", "fob": "fob_usd"}
    part = lambda c, x: F.round(F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0.0)), 2)
    g = df.where(a | b).groupBy("fruit_name").agg(*(part(c, col).alias(f"{n}_{k}") for n, col in made.items() for k, c in ((1, a), (2, b))), F.count_if(a).alias("shipments_1"), F.count_if(b).alias("shipments_2"), r4(F.avg(F.when(a, F.col("usd_per_mt")))).alias("price_1"), r4(F.avg(F.when(b, F.col("usd_per_mt")))).alias("price_2"))
    return g.withColumns({"mt_change": F.round(F.col("mt_2") - F.col("mt_1"), 2), "mt_change_pct": pct(F.col("mt_2") - F.col("mt_1"), F.nullif("mt_1", F.lit(0.0)))})


def compare(df: DataFrame, specs: Sequence[dict[str, str]]) -> DataFrame:
    """One row for each spec (dimension: value pairs): tons, value, shipments, mean price; most tons first. All specs are read in one pass."""
    labels = [F.when(_all_equal(s), F.lit(", ".join(f"{k}={v}" for k, v in s.items()))) for s in specs]
    return _compared(df.withColumn("spec", F.explode(F.array_compact(F.array(*labels)))))


def _compared(matched: DataFrame) -> DataFrame:
    return matched.groupBy("spec").agg(F.count(F.lit(1)).alias("shipments"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), F.round(F.sum("fob_usd"), 2).alias("total_fob"), r4(F.avg("usd_per_mt")).alias("avg_price"), F.countDistinct("exporter").alias("exporters"), F.countDistinct("country").alias("countries")).orderBy(F.col("total_mt").desc(), "spec")


def compare_exporters(df: DataFrame, terms: Sequence[str], months: int | None = None, today: dt.date | None = None, threshold: float = 0.4, index: DataFrame | None = None) -> DataFrame:
    """compare() of the exporter that each term matches best (as in fuzzy_search; terms that match none are left out), in the `months` months up to today if given. The matches, a row for each term, join the rows. index is a kept gram_index of the names."""
    index = gram_index(df, "exporter", [size_for(threshold)]) if index is None else index
    best = matches(index, terms, threshold).groupBy("k").agg(F.min_by("name", F.struct(-F.col("score"), "name")).alias("match")).select("match").distinct()
    own = df if months is None else df.where(F.col("date").between(F.add_months(F.lit(today or dt.date.today()), -months), F.lit(today or dt.date.today())))
    found = own.join(F.broadcast(best), F.col("exporter") == F.col("match"))
    return _compared(found.withColumn("spec", F.concat(F.lit("exporter="), F.col("match"))))


def _all_equal(spec: dict[str, str]) -> Column:
    out = F.lit(True)
    for dimension, value in spec.items():
        out = out & (F.col(DIMENSIONS[dimension]) == value)
    return out


def dashboard(df: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """One row: key figures of the range and of the equally long range before, with growth; one pass over both."""
    days = (last - first).days + 1
    before = (first - dt.timedelta(days=days), first - dt.timedelta(days=1))
    now, old = F.col("date").between(first, last), F.col("date").between(*before)
    part = lambda c, x: F.round(F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0.0)), 2)
    g = df.where(now | old).agg(
        F.count_if(now).alias("shipments"), part(now, "net_weight_mt").alias("total_mt"), part(now, "fob_usd").alias("total_fob"), r4(F.avg(F.when(now, F.col("usd_per_mt")))).alias("avg_price"), F.countDistinct(F.when(now, F.col("exporter"))).alias("exporters"),
        F.countDistinct(F.when(now, F.col("country"))).alias("countries"), F.count_if(old).alias("prev_shipments"), part(old, "net_weight_mt").alias("prev_mt"), part(old, "fob_usd").alias("prev_fob"),
    )
    grow = lambda a, b: pct(F.col(a) - F.col(b), F.nullif(F.col(b), F.lit(0).cast("double")))
    return g.withColumns({"mt_growth_pct": grow("total_mt", "prev_mt"), "fob_growth_pct": grow("total_fob", "prev_fob"), "shipment_growth_pct": grow("shipments", "prev_shipments")})


def portfolio(df: DataFrame, dimension: str = "exporter") -> DataFrame:
    """By exporter: tons, share, product and country HHI on percentages rounded to 2 places, their bands, number of each, and price tier within 10 % of the market's weighted price."""
    def concentration(by: str, name: str) -> DataFrame:
        g = df.groupBy(F.col(DIMENSIONS[dimension]).alias("name"), by).agg(F.sum("net_weight_mt").alias("t"))
        shares = g.withColumn("p", r2(100 * F.col("t") / F.sum("t").over(Window.partitionBy("name"))))
        return shares.groupBy("name").agg(r2(F.sum(F.col("p") * F.col("p"))).alias(f"{name}_hhi"), F.count(F.lit(1)).alias(f"n_{name}"))

    base = df.groupBy(F.col(DIMENSIONS[dimension]).alias("name")).agg(F.sum("net_weight_mt").alias("t"), F.sum("fob_usd").alias("f"))
    base = beside(base, base.agg(F.sum("t").alias("all_t"), F.sum("f").alias("all_f")), [])
    base = base.select("name", F.round("t", 2).alias("total_mt"), pct(F.col("t"), F.col("all_t")).alias("share_pct"), r4(F.col("f") / F.col("t")).alias("price"), r4(F.col("all_f") / F.col("all_t")).alias("market_price"))
    out = base.join(concentration("fruit_name", "product"), "name").join(concentration("country", "country"), "name")
    return out.withColumns({"product_band": hhi_band(F.col("product_hhi"), 2500, 5000), "country_band": hhi_band(F.col("country_hhi"), 2500, 5000), "price_tier": F.when(F.col("price") > 1.1 * F.col("market_price"), "premium").when(F.col("price") < 0.9 * F.col("market_price"), "budget").otherwise("market")})


def price_premiums(df: DataFrame) -> DataFrame:
    """By product: organic over conventional and Europe over the rest, weighted prices and percent."""
    fob, mt = F.col("fob_usd"), F.col("net_weight_mt")
    price = lambda c: r4(F.try_divide(F.sum(F.when(c, fob)), F.sum(F.when(c, mt))))
    g = df.groupBy("fruit_name").agg(price(F.col("certification") == "organic").alias("organic_price"), price(F.col("certification") == "conventional").alias("conventional_price"), price(F.col("region") == "Europe").alias("europe_price"), price(F.col("region") != "Europe").alias("row_price"))
    return g.withColumns({"organic_premium_pct": pct(F.col("organic_price") - F.col("conventional_price"), F.col("conventional_price")), "europe_gap_pct": pct(F.col("europe_price") - F.col("row_price"), F.col("row_price"))})


def diversification(df: DataFrame, dimension: str, by: str) -> DataFrame:
    """By dimension: number of values of `by`, the largest one's share, and High (5 or more), Medium (3 or more) or Low."""
    g = df.groupBy(F.col(DIMENSIONS[dimension]).alias("name"), F.col(DIMENSIONS[by]).alias("of")).agg(F.sum("net_weight_mt").alias("t")).groupBy("name").agg(F.count("of").alias("n"), (F.max("t") / F.sum("t")).alias("top"))
    return g.select("name", "n", r4(100 * F.col("top")).alias("top_share_pct"), F.when(F.col("n") >= 5, "High").when(F.col("n") >= 3, "Medium").otherwise("Low").alias("diversification"))


def readiness(df: DataFrame) -> DataFrame:
    """Europe readiness of each exporter: exposure, organic share, countries and product concentration, 25 points each."""
    europe = df.where(F.col("region") == "Europe")
    mt = F.col("net_weight_mt")
    part = lambda c: F.coalesce(F.sum(F.when(c, mt)), F.lit(0.0))
    inside, organic = F.col("region") == "Europe", F.col("certification") == "organic"
    g = df.groupBy("exporter").agg(F.sum(mt).alias("t"), part(inside).alias("e"), part(organic).alias("o"), F.countDistinct(F.when(inside, F.col("country"))).alias("countries"))
    h = hhi(europe, ["exporter"], "fruit").select(F.col("exporter").alias("of"), "hhi")
    j = g.join(h, F.col("exporter") == F.col("of"), "left").select("exporter", pct(F.col("e"), F.col("t")).alias("europe_pct"), pct(F.col("o"), F.col("t")).alias("organic_pct"), "countries", F.coalesce("hhi", F.lit(0.0)).alias("product_hhi"))
    points = {
        "exposure_score": ladder(F.col("europe_pct"), [(20, 25), (10, 15), (5, 10)], 5), "organic_score": ladder(F.col("organic_pct"), [(50, 25), (30, 20), (10, 10)], 5),
        "geo_score": F.when(F.col("countries") > 5, 25).when(F.col("countries") >= 3, 15).otherwise(5), "product_score": below_ladder(F.col("product_hhi"), [(2500, 25), (5000, 15)], 5),
    }
    scored = j.withColumns(points).withColumn("score", sum((F.col(k) for k in points), F.lit(0)))
    return scored.withColumn("level", F.when(F.col("score") >= 75, "high").when(F.col("score") >= 50, "medium").otherwise("low"))


def market_gaps(df: DataFrame, max_suppliers: int = 5, least_mt: float = 100, first: int = 50, limit: int = 20) -> DataFrame:
    """Products and countries with few suppliers and enough volume: the `first` largest are scored, the `limit` best stay."""
    keys = ["fruit_name", "format_type", "certification", "country", "region"]
    g = df.groupBy(*keys).agg(F.countDistinct("exporter").alias("suppliers"), F.count(F.lit(1)).alias("shipments"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), r4(F.avg("usd_per_mt")).alias("avg_price"))
    g = g.where((F.col("total_mt") >= least_mt) & (F.col("suppliers") <= max_suppliers)).orderBy(F.col("total_mt").desc(), *keys).limit(first)
    n = F.col("suppliers")
    score = F.when(n == 1, 40).when(n == 2, 30).when(n == 3, 20).otherwise(10) + ladder(F.col("total_mt"), [(1000, 30), (500, 20), (200, 10)], 5) + ladder(F.col("avg_price"), [(3000, 30), (2500, 20), (2000, 10)], 5)
    scored = g.withColumn("score", score).withColumn("priority", F.when(F.col("score") >= 70, "high").when(F.col("score") >= 50, "medium").otherwise("low"))
    return scored.orderBy(F.col("score").desc(), F.col("total_mt").desc(), *keys).limit(limit)


def competitors(df: DataFrame, dimension: str = "exporter") -> DataFrame:
    """All with share and rank: leader to rank 3, challenger to 10, else follower; position by share over 20, 10 and 5 percent."""
    t = ranked(totals(df, dimension, "volume")).select("name", "total", "rank", pct(F.col("total"), F.col("all")).alias("share_pct"))
    return t.withColumns({"role": F.when(F.col("rank") <= 3, "leader").when(F.col("rank") <= 10, "challenger").otherwise("follower"), "position": F.when(F.col("share_pct") > 20, "dominant").when(F.col("share_pct") > 10, "strong").when(F.col("share_pct") > 5, "moderate").otherwise("minor")})


def attractiveness(df: DataFrame, fruit: str) -> DataFrame:
    """Countries for a product: size, price, supplier concentration and organic demand to 100 points; all countries in one pass."""
    own = df.where(F.col("fruit_name") == fruit)
    mt = F.col("net_weight_mt")
    g = own.groupBy("country").agg(F.round(F.sum(mt), 2).alias("total_mt"), r4(F.avg("usd_per_mt")).alias("avg_price"), pct(F.coalesce(F.sum(F.when(F.col("certification") == "organic", mt)), F.lit(0.0)), F.sum(mt)).alias("organic_pct"))
    h = hhi(own, ["country"], "exporter").select(F.col("country").alias("of"), F.col("hhi").alias("supplier_hhi"))
    score = ladder(F.col("total_mt"), [(500, 30), (200, 25), (100, 20), (50, 15)], 10) + ladder(F.col("avg_price"), [(3000, 25), (2500, 20), (2000, 15)], 10) + below_ladder(F.col("supplier_hhi"), [(1500, 25), (2500, 15)], 5) + ladder(F.col("organic_pct"), [(50, 20), (30, 15), (10, 10)], 5)
    scored = g.join(h, F.col("country") == F.col("of")).drop("of").withColumn("score", score)
    return scored.withColumn("priority", F.when(F.col("score") >= 75, "high").when(F.col("score") >= 60, "medium").otherwise("low"))


def market_details(df: DataFrame, fruit: str | None = None, n: int = 5) -> DataFrame:
    """(country, part, rank, name, total_mt, share_pct): for each country the n largest products and suppliers, and the split by certification, of one product or all. One pass: each row counts once for each part."""
    own = df if fruit is None else df.where(F.col("fruit_name") == fruit)
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.coalesce(F.col(c), F.lit("unknown")).alias("name")) for p, c in (("product", "format_type" if fruit else "fruit_name"), ("supplier", "exporter"), ("certification", "certification"))))
    sums = own.select("country", F.explode(parts).alias("p"), "net_weight_mt").groupBy("country", "p.part", "p.name").agg(F.round(F.sum("net_weight_mt"), 2).alias("total_mt"))
    w = Window.partitionBy("country", "part")
    told = sums.withColumns({"rank": F.row_number().over(w.orderBy(F.col("total_mt").desc(), "name")).cast("bigint"), "all": F.sum("total_mt").over(w)})
    return told.where((F.col("part") == "certification") | (F.col("rank") <= n)).select("country", "part", "rank", "name", "total_mt", pct(F.col("total_mt"), F.col("all")).alias("share_pct"))


def country_outlook(df: DataFrame, edges: DataFrame, fruits: Sequence[str]) -> DataFrame:
    """For each country of the edges and each product: active with its tons; else the largest of its neighbours that buys, with a potential of 30, 50 or 70 % of that by the number of such neighbours (1, 2, more); else 10, 20 or 30 % of the largest of the five largest buyers; else none."""
    sold = df.where(F.col("fruit_name").isin(*fruits)).groupBy("fruit_name", "country").agg(F.round(F.sum("net_weight_mt"), 2).alias("mt"))
    places = edges.select("country").distinct()
    grid = places.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(f,) for f in fruits], "fruit_name string")))  # a row of parameters for each
    near = edges.join(sold.withColumnRenamed("country", "neighbour"), "neighbour").groupBy("country", "fruit_name").agg(F.max("mt").alias("near_mt"), F.count(F.lit(1)).alias("near_n"))
    top = sold.withColumn("r", F.row_number().over(Window.partitionBy("fruit_name").orderBy(F.col("mt").desc(), "country"))).where("r <= 5").groupBy("fruit_name").agg(F.max("mt").alias("top_mt"), F.count(F.lit(1)).alias("top_n"))
    j = grid.join(sold, ["country", "fruit_name"], "left").join(near, ["country", "fruit_name"], "left").join(top, ["fruit_name"], "left")
    by_count = lambda n, a, b, c: F.when(F.col(n) == 1, a).when(F.col(n) == 2, b).otherwise(c)
    potential = F.when(F.col("mt").isNotNull(), F.col("mt")).when(F.col("near_mt").isNotNull(), F.col("near_mt") * by_count("near_n", 0.3, 0.5, 0.7)).when(F.col("top_mt").isNotNull(), F.col("top_mt") * by_count("top_n", 0.1, 0.2, 0.3))
    status = F.when(F.col("mt").isNotNull(), "active").when(F.col("near_mt").isNotNull(), "neighbours").when(F.col("top_mt").isNotNull(), "region").otherwise("none")
    return j.select("country", "fruit_name", status.alias("status"), F.round(potential, 2).alias("potential_mt"))


def predicates(df: DataFrame, **given) -> DataFrame:
    """Rows that meet all given filters: exporters (a list; empty is ignored), exporter, importer, fruit, format, size, certification and country (substrings in any case), destination (a country by its name in either language, one test of both), region, min_price, max_price, min_mt, first, last."""
    tests = {
        "region": lambda v: F.col("region") == F.coalesce(F.lit(v), F.col("region")), "min_price": lambda v: F.col("usd_per_mt") >= v, "max_price": lambda v: F.col("usd_per_mt") <= v, "min_mt": lambda v: F.col("net_weight_mt") >= v,
        "first": lambda v: F.col("date") >= F.lit(v), "last": lambda v: F.col("date") <= F.lit(v), "exporters": lambda v: F.col("exporter").isin(*v) if v else F.lit(True),
        "destination": lambda v: reduce(or_, (F.col("country").ilike(f"%{x}%") for x in names_of_country(v))),
    }
    for name, value in given.items():
        if value is not None:
            df = df.where(tests[name](value) if name in tests else F.col(DIMENSIONS[name]).ilike(f"%{value}%"))
    return df


def detail(df: DataFrame, limit: int = 100, sort: str = "date", **given) -> DataFrame:
    """The latest (or dearest, or largest) rows that meet the filters, in a total order."""
    first = {"date": "date", "price": "usd_per_mt", "volume": "net_weight_mt"}[sort]
    rows = predicates(df, **given).select("date", "exporter", "importer", "fruit_name", "format_type", "size_mm", "certification", "country", "net_weight_mt", r4("usd_per_mt").alias("price"), "fob_usd", "declaration", "usd_per_mt")
    return rows.orderBy(F.col(first).desc(), *(c for c in rows.columns if c != first)).limit(limit).drop("usd_per_mt")


def detail_totals(df: DataFrame, limit: int = 100, **given) -> DataFrame:
    """One row: totals over the limited detail rows."""
    return detail(df, limit, **given).agg(F.count(F.lit(1)).alias("shipments"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), F.round(F.sum("fob_usd"), 2).alias("total_fob"))


def range_summary(df: DataFrame, **given) -> DataFrame:
    """One row: totals over all rows that meet the filters."""
    return predicates(df, **given).agg(F.count(F.lit(1)).alias("shipments"), F.round(F.sum("net_weight_mt"), 2).alias("total_mt"), r4(F.avg("usd_per_mt")).alias("avg_price"), r4(F.min("usd_per_mt")).alias("min_price"), r4(F.max("usd_per_mt")).alias("max_price"))


def search_names(df: DataFrame, term: str, column: str = "exporter", limit: int = 50) -> DataFrame:
    """Names that hold the term, in any case, with their records."""
    return df.where(F.contains(F.lower(column), F.lit(term.lower()))).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("records")).orderBy(F.col("records").desc(), "name").limit(limit)


def fuzzy_search(df: DataFrame, term: str, threshold: float = 0.6, column: str = "exporter", limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """Names that equal the term in any case, alone if there are any; else those that hold it or resemble it enough, best first. index is a kept gram_index of the column."""
    index = gram_index(df, column, [size_for(threshold)]) if index is None else index
    scored = matches(index, [term], threshold).select("name", "score")
    heads = scored.orderBy(F.col("score").desc(), "name").limit(limit).withColumn("best", F.max("score").over(Window.partitionBy()))  # `limit` rows
    return heads.where("best < 2 or score = 2").select("name", r4(F.least("score", F.lit(1.0))).alias("score")).orderBy(F.col("score").desc(), "name")
