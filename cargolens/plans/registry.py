"""Registered shipment queries: each over the whole star-schema shipments view, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions import names as N
from cargolens.functions import product as P
from cargolens.functions.numbers import r4
from cargolens.operators import clusters as C
from cargolens.operators import flows as W
from cargolens.operators import market as M
from cargolens.operators import pricing as R
from cargolens.operators import quality as Q
from cargolens.operators.rollup import KEYS, Rollup
from cargolens.plans.oracles import ORACLES
from cargolens.sources.readers import between_dates, shipments, with_price
from cargolens.sources.store import Store
from cargolens.sources.written import once, shared_path

D = dt.date
RANGE = (D(1998, 1, 1), D(1998, 12, 31))
BEFORE = (D(1997, 1, 1), D(1997, 12, 31))
#: The alternative rules for the test tables: a floor for each of their products, as the worldwide rules have for theirs.
ALT_FLOORS = {"ECONOMY": 700, "LARGE": 950, "MEDIUM": 900, "PROMO": 850, "SMALL": 1000}
ALT_RULES = Q.Rules(floors=ALT_FLOORS, default_floor=800, sample_words=Q.OTHER_SAMPLE_WORDS, min_mt=2.0, first=BEFORE[0], last=RANGE[1])

#: Two nations under the two names of one country.
TWO_NAMES = {"NATION_2": "Germany", "NATION_5": "Alemania"}


def _neighbours(spark: SparkSession) -> DataFrame:
    """Country edges of the test tables: each nation's two following ones."""
    return spark.range(25).select(F.format_string("NATION_%d", "id").alias("country"), F.explode(F.array(*(F.format_string("NATION_%d", (F.col("id") + k) % 25) for k in (1, 2)))).alias("neighbour"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name")


def _parsed(df: DataFrame, key: str, text: str) -> DataFrame:
    c, f = "product.classification", "product.product_format"
    return P.parse_descriptions(df.select(key, text), text).select(key, "product.fruit_name", "product.variety", f"{f}.format_type", f"{f}.size_mm", f"{c}.is_organic", f"{c}.is_conventional", f"{c}.is_iqf", f"{c}.is_aseptic", f"{c}.certification")


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    """One-line descriptions with product words, made of the part table's names, sizes and brands."""
    words = ["MANGO CHUNKS 20X20MM IQF ORGANICO VARIEDAD: EDWARD", "PULPA DE MARACUYA ASEPTICO", "FRESA CONVENCIONAL 10 x 10 mm", "PALTA IQF", "ARANDANO ENTERO", "PIÑA GOLDEN EN TROZOS", "B & P DE UVA"]
    word = F.element_at(F.array(*map(F.lit, words)), (F.col("p_size") % len(words) + 1).cast("int"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat_ws(" ", word, F.col("p_name")).alias("text"))


def _companies(spark: SparkSession, sf: str) -> DataFrame:
    """Company-like names made of customer names by rule. They are dealt to all tasks, as cleaning costs far more than moving them and a table of short rows is few splits."""
    forms = ["S.A.C.", "S.A. DE C.V.", "LTD.", "B.V.", "GMBH & CO. KG", "S.R.L.", "PERU"]
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("c_custkey") % len(forms) + 1).cast("int"))
    dealt = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return dealt.select("c_custkey", F.concat_ws(" ", F.translate(F.col("c_name"), "#_0123456789", "  ABCDEFGHIJ"), form).alias("name"))


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    c = N.clean_company(F.col("name"))
    made = _companies(spark, sf).withColumn("cleaned", c)
    return made.select("c_custkey", "cleaned", N.brand_name(F.col("cleaned")).alias("brand"), N.core_name(F.col("cleaned")).alias("core"), N.rule_clean_importer(F.col("name")).alias("rule_name"))


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return C.cluster_names(C.name_counts(_companies(spark, sf), "name"))


def _rule_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return C.rule_clusters(_companies(spark, sf), "name")


def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    named = _companies(spark, sf)
    return C.canonical_names(named, _clusters(spark, sf), "name").select("c_custkey", "name", "canonical_name")


#: Queries of the shipments view alone.
ON_SHIPMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    **{f"pricing_by_{d}": (lambda d: lambda s: R.quartile_summary(s, d))(d) for d in ("fruit", "exporter", "importer", "format")},
    "pricing_europe": lambda s: R.quartile_summary(s, "fruit", "Europe"),
    "pricing_row": lambda s: R.quartile_summary(s, "fruit", "RoW"),
    "pricing_whole_units": lambda s: R.in_whole_units(R.quartile_summary(s, "format")),
    "drill_fruit_by_exporter": lambda s: R.drill_down(s, "fruit", "ECONOMY", "exporter"),
    "drill_fruit_by_format": lambda s: R.drill_down(s, "fruit", "ECONOMY", "format"),
    "drill_exporter_by_fruit": lambda s: R.drill_down(s, "exporter", "Supplier#000000001", "fruit"),
    "product_quote": lambda s: R.product_quote(s, "ECONOMY"),
    "exporter_products": R.exporter_products,
    "destination_products": R.destination_products,
    "monthly_exports": R.monthly_exports,
    "regional_exports": R.regional_exports,
    "region_two_level": R.two_level,
    "table_stats": R.table_stats,
    "distinct_values": lambda s: R.distinct_values(s, "country"),
    "available_values": lambda s: R.available_values(s, "format"),
    "price_analysis_having": R.price_analysis,
    "region_top_countries": lambda s: M.top_per_group(s, "region", "country", 5),
    "fruit_top_exporters": lambda s: M.top_per_group(s, "fruit_name", "exporter", 3),
    "conditional_sums": R.conditional_sums,
    "weighted_price_stats": lambda s: R.weighted_stats(s, ["fruit_name", "format_type"]),
    "hhi_by_country": lambda s: M.hhi(s, ["country"], "exporter"),
    "detail_stats": lambda s: R.detail_stats(s, ["fruit_name", "exporter", "format_type"]),
    "exporter_summary": R.exporter_summary,
    "format_summary": R.format_summary,
    "pivot_median": lambda s: R.pivot_median(s, ["ECONOMY", "SMALL", "LARGE"]),
    "master_table": R.master_table,
    "master_totals": R.master_totals,
    "recommended_ranges": R.recommended_ranges,
    "frozen_vs_aseptic": lambda s: R.split_volumes(s, F.col("via") == "AIR", ("air_mt", "sea_mt")),
    "top_n_share": lambda s: M.top_n(s, "exporter", "volume", 10),
    "top_20_exporters": lambda s: M.top_n(between_dates(s, *RANGE), "exporter", "volume", 20),
    "rank_of_exporter": lambda s: M.rank_of(s, "exporter", "Supplier#000000007"),
    "others_bucketing": lambda s: M.others_bucketing(s, "exporter"),
    "time_series_daily": lambda s: M.time_series(s, "value", "daily"),
    "time_series_weekly": lambda s: M.time_series(s, "shipment_count", "weekly"),
    "time_series_monthly": lambda s: M.time_series(s, "volume", "monthly"),
    "trend_halves": M.trend,
    "seasonality": M.seasonality,
    "compare_periods": lambda s: M.compare_periods(s, BEFORE, RANGE),
    "compare_products": lambda s: M.compare(s, [{"fruit": "ECONOMY"}, {"fruit": "SMALL", "certification": "organic"}, {"fruit": "LARGE"}]),
    "compare_exporters": lambda s: M.compare(between_dates(s, *RANGE), [{"exporter": "Supplier#000000001"}, {"exporter": "Supplier#000000002"}]),
    "compare_exporters_fuzzy": lambda s: M.compare_exporters(s, ["supplier#000000001", "SUPPLIER#000000003"], months=12, today=RANGE[1]),
    "compare_exporters_typo": lambda s: M.compare_exporters(s, ["sppliet#000000001", "Suplier#00000003"], months=12, today=RANGE[1]),
    "destination_two_names": lambda s: M.detail_totals(s.replace(TWO_NAMES, subset=["country"]), 100, destination="alemania"),
    "dashboard_kpis": lambda s: M.dashboard(s, *RANGE),
    "market_share": M.market_share,
    "portfolio": M.portfolio,
    "price_premium": M.price_premiums,
    "diversification": lambda s: M.diversification(s, "importer", "fruit"),
    "readiness_score": M.readiness,
    "market_gaps": lambda s: M.market_gaps(s, least_mt=20),
    "competitors": M.competitors,
    "attractiveness": lambda s: M.attractiveness(s, "ECONOMY"),
    "market_details": lambda s: M.market_details(s, "ECONOMY"),
    "destination_bilingual": lambda s: M.detail_totals(s, 100, destination="nation_2"),
    "validity_flag": lambda s: Q.validity_flag(s).groupBy("fruit_name", "via", "analysis_valid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net_weight_mt"), 2).alias("mt")),
    "cascade_filter": lambda s: Q.cascade_filter(s).groupBy("fruit_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net_weight_mt"), 2).alias("mt")),
    "cascade_alternative": lambda s: Q.cascade_filter(s, ALT_RULES, iqr=False).groupBy("fruit_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net_weight_mt"), 2).alias("mt")),
    "worldwide_pricing": lambda s: R.quartile_summary(Q.cascade_filter(s, ALT_RULES, iqr=False), "fruit"),
    "exclusions": lambda s: Q.exclusions(s, ALT_RULES),
    "filter_stats": Q.filter_stats,
    "iqr_bounds": lambda s: Q.iqr_bounds(s).select("fruit_name", *(r4(c).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper"))),
    "outliers_iqr_z": lambda s: Q.outlier_counts(s, ["fruit_name"]),
    "outliers_fine": lambda s: Q.outlier_counts(s, ["fruit_name", "format_type"]),
    "quality_report": Q.quality_report,
    "union_flows": W.flows,
    "supply_chain": W.supply_chain,
    "country_flows": lambda s: W.country_flows(s, "NATION_3"),
    "detail_by_exporter": lambda s: M.detail(s, 100, exporter="supplier#000000001"),
    "detail_totals": lambda s: M.detail_totals(s, 100, country="nation_3", fruit="economy"),
    "detail_by_product": lambda s: M.detail(s, 100, "price", fruit="small", certification="organic"),
    "range_query": lambda s: M.range_summary(s, region="Europe", min_price=900.0, max_price=1500.0, min_mt=5.0, first=BEFORE[0], last=RANGE[1]),
    "search_exporters": lambda s: M.search_names(s, "000001"),
    "fuzzy_search": lambda s: M.fuzzy_search(s, "suplier#00000012", 0.6),
    "exporter_audit": lambda s: R.exporter_audit(s, ["ECONOMY", "PROMO"]),
    "fruit_report": lambda s: R.fruit_report(s, "SMALL"),
    "fruit_report_all": R.fruit_report,
    "product_totals": R.product_totals,
    "dataset_summary": R.dataset_summary,
    "value_counts": lambda s: R.available_values(s, "certification"),
    "top_air_exporters": lambda s: M.top_n(s.where("via = 'AIR'"), "exporter", "volume", 10),
    "top_destinations": lambda s: M.top_n(s, "country", "value", 10),
    "name_variations": lambda s: C.name_variations(s.withColumn("canonical_importer", F.substring("importer", 1, 17)), "importer"),
    "canonical_audit": lambda s: C.canonical_audit(s.withColumn("canonical_importer", F.upper("importer")), "importer"),
    "country_flows_of_fruit": lambda s: W.country_flows(s, "NATION_3", "SMALL"),
    "supplier_ranking": lambda s: M.diversification(s, "exporter", "country"),
    "detail_by_destination": lambda s: M.detail(s, 100, "volume", country="nation_1", certification="organic"),
    "importers_by_text": lambda s: C.importers_by_text(s).select("text", "records", F.array_join("names", ",").alias("names")),
}


#: What the lines meet first, in queries that keep few exporters or destinations.
FIRST = {"detail_by_exporter": "exporter", "drill_exporter_by_fruit": "exporter", "detail_by_destination": "order"}


def _rollup(spark: SparkSession, sf: str) -> Rollup:
    """All shipments in three increments, by date; the view is read once for all of them, and its price is made again rather than written."""
    s, day = with_price(once(shipments(spark, sf), *(c for c in KEYS if c not in ("usd_per_mt", "weighed", "month")), "net_weight_mt", "fob_usd", "date")), F.col("date")
    first, second = F.coalesce(day < D(1994, 1, 1), F.lit(False)), F.coalesce(day < D(1996, 7, 15), F.lit(False))
    kept = Rollup.create(spark, shared_path(spark, "rollup"), s.where(first))
    kept.add(s.where(~first & second), "second")
    kept.add(s.where(~second), "third")
    return kept


def _updated(spark: SparkSession, sf: str) -> DataFrame:
    """Shipments in a table by month whose exporters get other names by key, whose certification is set for a range of dates, and whose destinations become upper case; by month."""
    own = shipments(spark, sf).select("exporter", "certification", F.lower("country").alias("country"), "net_weight_mt", "date", F.date_format("date", "yyyy-MM").alias("month"))
    store = Store.create(own, shared_path(spark, "updated"), "month")
    names = spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey % 3 = 0").select(F.col("s_name").alias("exporter"), F.concat(F.lit("canonical "), "s_name").alias("to"))
    store.update_by_key(names, "exporter", "exporter", "to")
    store.update_where("certification", F.col("date").between(*BEFORE) & (F.col("certification") == "unknown"), F.lit("checked"), {"unnamed": (F.count_if(F.col("exporter").isNull()), lambda n: n == 0)})
    store.upper("country")
    return store.read().groupBy("month", "exporter", "certification", "country").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net_weight_mt"), 2).alias("mt"))


#: Queries of other tables.
ON_TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rollup_by_fruit": lambda sp, sf: _rollup(sp, sf).quartiles("fruit"),
    "rollup_by_exporter": lambda sp, sf: _rollup(sp, sf).quartiles("exporter"),
    "rollup_drill_down": lambda sp, sf: _rollup(sp, sf).quartiles("exporter", where={"fruit": "ECONOMY"}),
    "rollup_exporter_products": lambda sp, sf: _rollup(sp, sf).exporter_products(),
    "rollup_monthly_exports": lambda sp, sf: _rollup(sp, sf).monthly_exports(),
    "updated_in_place": _updated,
    "country_outlook": lambda sp, sf: M.country_outlook(shipments(sp, sf), _neighbours(sp), ["ECONOMY", "SMALL"]),
    "text_parse": lambda sp, sf: _parsed(_titles(sp, sf), "p_partkey", "text"),
    "text_parse_documents": lambda sp, sf: _parsed(sp.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"),
    "repeat_suppression": lambda sp, sf: P.without_repeats(sp.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "text").select("doc_id", "clean_text"),
    "name_clean": _cleaned,
    "full_unaccent": lambda sp, sf: sp.read.parquet(f"{sf}/documents.parquet").select("doc_id", N.full_unaccent(F.col("text")).alias("plain")),
    "cluster_names": _clusters,
    "cluster_stats": lambda sp, sf: C.cluster_stats(_clusters(sp, sf)),
    "canonical_names": _canonical,
    "rule_variations": lambda sp, sf: C.variations(_rule_clusters(sp, sf)),
    "rule_cluster_sizes": lambda sp, sf: C.cluster_sizes(_rule_clusters(sp, sf)),
    "rule_clusters": lambda sp, sf: _rule_clusters(sp, sf).select("canonical_name", F.array_join("aliases", "|").alias("aliases"), "count"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: (lambda f, first: lambda spark, sf_dir: f(shipments(spark, sf_dir, first)))(f, FIRST.get(name, "product")) for name, f in ON_SHIPMENTS.items()}
    return own | ON_TABLES


def oracle_sql() -> dict[str, str]:
    known = set(ON_SHIPMENTS) | set(ON_TABLES)
    return {name: sql for name, sql in ORACLES.items() if name in known}
