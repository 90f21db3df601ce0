"""DuckDB statements that say the same as the registered shipment queries, each written on its own."""

from __future__ import annotations

import re

from cargolens.functions import names as N

SHIPMENTS = """s AS (
  SELECT l_orderkey AS declaration, s_name AS exporter, c_name AS importer, p_type AS fruit_name, p_brand AS format_type, CAST(p_size AS VARCHAR) AS size_mm,
    CASE l_returnflag WHEN 'R' THEN 'organic' WHEN 'A' THEN 'conventional' ELSE 'unknown' END AS certification, n_name AS country,
    CASE WHEN r_name = 'EUROPE' THEN 'Europe' ELSE 'Rest of World' END AS region, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS net_weight_mt,
    l_extendedprice AS fob_usd, l_extendedprice / l_quantity AS usd_per_mt, CASE WHEN o_orderpriority = '1-URGENT' THEN 'AIR' ELSE 'SEA' END AS via, p_name AS description
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def _s(body: str, more: str = "") -> str:
    return f"WITH {SHIPMENTS}{', ' + more if more else ''} {body}"


def _quartiles(column: str, name: str, where: str = "", extra: str = "", source: str = "s") -> str:
    q = ", ".join(f"round(quantile_cont(usd_per_mt, {q}) + 1e-9, 4) AS {n}" for q, n in ((0.25, "low_price"), (0.5, "mid_price"), (0.75, "high_price")))
    return f"SELECT {column} AS {name}, {q}, round(sum(net_weight_mt), 2) AS total_mt, count(usd_per_mt) AS records{extra} FROM {source} WHERE {column} IS NOT NULL AND usd_per_mt IS NOT NULL AND net_weight_mt > 0 {where} GROUP BY {column}"


def _range(keys: str, columns: str = "", where: str = "") -> str:
    return f"SELECT {columns or keys}, count(*) AS shipments, round(sum(net_weight_mt), 2) AS total_mt, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price, round(min(usd_per_mt) + 1e-9, 4) AS min_price, round(max(usd_per_mt) + 1e-9, 4) AS max_price, round(sum(fob_usd), 2) AS total_fob FROM s {where} GROUP BY {keys}"


def _totals(column: str, where: str = "") -> str:
    return f"t AS (SELECT {column} AS name, round(sum(net_weight_mt), 2) AS total FROM s {where} GROUP BY 1)"


RANKED = "r AS (SELECT name, total, row_number() OVER w AS rank, sum(total) OVER () AS whole, sum(total) OVER (w ROWS UNBOUNDED PRECEDING) AS run, count(*) OVER () AS n FROM t WINDOW w AS (ORDER BY total DESC, name))"
Y98, Y97 = "date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'", "date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
PCT = "round(100 * ({}) / nullif({}, 0) + 1e-9, 4)"


def _series(key: str, value: str, lag: int) -> str:
    change = lambda b: f"round(100 * (value - {b}) / nullif({b}, 0) + 1e-9, 4)"
    return _s(
        f"SELECT period, value, {change('p')} AS growth_pct, {change('y')} AS yoy_pct, CASE WHEN i >= 3 THEN round(m3 + 1e-9, 4) END AS ma3, CASE WHEN i >= 6 THEN round(m6 + 1e-9, 4) END AS ma6 FROM v",
        f"e AS (SELECT {key} AS period, round({value} + 1e-9, 4) AS value FROM s GROUP BY 1), v AS (SELECT period, value, lag(value, 1) OVER w AS p, lag(value, {lag}) OVER w AS y, row_number() OVER w AS i, "
        "avg(value) OVER (w ROWS 2 PRECEDING) AS m3, avg(value) OVER (w ROWS 5 PRECEDING) AS m6 FROM e WINDOW w AS (ORDER BY period))",
    )


def _hhi(group: str, by: str, source: str = "s") -> str:
    keys = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return f"SELECT {keys}round(10000 * sum(t * t) / nullif(sum(t) * sum(t), 0) + 1e-9, 2) AS hhi, count(*) AS members FROM (SELECT {keys}{by}, sum(net_weight_mt) AS t FROM {source} GROUP BY ALL){tail}"


AIR, SAMPLE = "via = 'AIR'", "(regexp_matches(upper(description), 'MUESTRA|SIN VALOR COMERCIAL|ENVIO DE MUESTRAS|SAMPLE|NO COMMERCIAL VALUE|TEST SHIPMENT|TRIAL') OR net_weight_mt < 0.01 OR (fob_usd > 0 AND fob_usd < 10))"
ALT_SAMPLE = "(regexp_matches(upper(description), 'MUESTRA|SIN VALOR COMERCIAL|SIN VALOR|SAMPLE|TEST') OR net_weight_mt < 0.01 OR (fob_usd > 0 AND fob_usd < 10))"
BOUNDS = "(SELECT fruit_name, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT fruit_name, quantile_cont(usd_per_mt, 0.25) AS q1, quantile_cont(usd_per_mt, 0.75) AS q3 FROM {} GROUP BY 1))"
LEFT = f"l AS (SELECT * FROM s WHERE NOT ({AIR} OR {SAMPLE} OR net_weight_mt < 0.1 OR usd_per_mt < 500))"
ALT_FLOOR = "CASE fruit_name WHEN 'ECONOMY' THEN 700 WHEN 'LARGE' THEN 950 WHEN 'MEDIUM' THEN 900 WHEN 'PROMO' THEN 850 WHEN 'SMALL' THEN 1000 ELSE 800 END"
ALT = f"l AS (SELECT * FROM s WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND NOT ({AIR} OR {ALT_SAMPLE} OR net_weight_mt < 2 OR usd_per_mt < {ALT_FLOOR}))"
BY_FRUIT = "count(*) AS n, round(sum(net_weight_mt), 2) AS mt"


def _outliers(keys: str) -> str:
    using = keys
    return _s(
        f"SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE far) AS iqr_outliers, count(*) FILTER (WHERE high) AS z_outliers, count(*) FILTER (WHERE far AND high AND n0 >= 5) AS both_outliers FROM o GROUP BY {keys}",
        f"g AS (SELECT {keys}, count(usd_per_mt) AS n0, avg(usd_per_mt) AS m, stddev_pop(usd_per_mt) AS d, quantile_cont(usd_per_mt, 0.25) AS q1, quantile_cont(usd_per_mt, 0.75) AS q3 FROM s GROUP BY {keys}), "
        f"o AS (SELECT s.*, n0, (usd_per_mt < q1 - 1.5 * (q3 - q1) OR usd_per_mt > q3 + 1.5 * (q3 - q1)) AND n0 >= 4 AS far, abs(usd_per_mt - m) > 3 * d AND n0 >= 3 AND d > 0 AS high FROM s JOIN g USING ({using}))",
    )


def _flows(where: str = "") -> str:
    pairs = (("exporter", "fruit_name"), ("fruit_name", "importer"), ("importer", "country"))
    return _s(" UNION ALL ".join(f"SELECT {k} AS level, {a} AS source, {b} AS target, round(sum(net_weight_mt), 2) AS value FROM s {where} GROUP BY 2, 3" for k, (a, b) in enumerate(pairs)))


def _compare(specs: dict[str, str], where: str = "TRUE") -> str:
    parts = " UNION ALL ".join(f"SELECT '{n}' AS spec, * FROM s WHERE {w} AND {where}" for n, w in specs.items())
    return _s("SELECT spec, count(*) AS shipments, round(sum(net_weight_mt), 2) AS total_mt, round(sum(fob_usd), 2) AS total_fob, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price, count(DISTINCT exporter) AS exporters, count(DISTINCT country) AS countries FROM m GROUP BY spec", f"m AS ({parts})")


def _bucket(name: str, label: str) -> str:
    """Names of a column with the bucket they fall into."""
    return (
        f"{name}_t AS (SELECT {name} AS name, round(sum(net_weight_mt), 2) AS total FROM s GROUP BY 1), {name}_r AS (SELECT name, total, row_number() OVER w AS rank, count(*) OVER () AS n, sum(total) OVER (w ROWS UNBOUNDED PRECEDING) / sum(total) OVER () <= 0.8 AS keep FROM {name}_t WINDOW w AS (ORDER BY total DESC, name)), "
        f"{name}_b AS (SELECT name, total, CASE WHEN CASE WHEN count(*) FILTER (WHERE keep) OVER () < 3 THEN rank <= greatest(3, floor(n * 0.8)) ELSE keep END THEN name ELSE '{label}' END AS bucket FROM {name}_r)"
    )


def _bucketed_flows() -> str:
    made = ", ".join(_bucket(n, label) for n, label in (("exporter", "Other Exporters"), ("importer", "Other Importers"), ("country", "Other Countries")))
    base = f"{made}, b AS (SELECT e.bucket AS exporter, i.bucket AS importer, c.bucket AS country, fruit_name, net_weight_mt FROM s JOIN exporter_b e ON exporter = e.name JOIN importer_b i ON importer = i.name JOIN country_b c ON country = c.name)"
    pairs = (("exporter", "fruit_name"), ("fruit_name", "importer"), ("importer", "country"))
    return _s(" UNION ALL ".join(f"SELECT {k} AS level, {a} AS source, {b} AS target, round(sum(net_weight_mt), 2) AS value FROM b GROUP BY 2, 3" for k, (a, b) in enumerate(pairs)), base)


DETAIL = "SELECT date, exporter, importer, fruit_name, format_type, size_mm, certification, country, net_weight_mt, round(usd_per_mt + 1e-9, 4) AS price, fob_usd, declaration FROM s WHERE {} ORDER BY {} DESC, {} LIMIT 100"
REST = "exporter, importer, fruit_name, format_type, size_mm, certification, country, net_weight_mt, round(usd_per_mt + 1e-9, 4), fob_usd, declaration"
SEASON = "m AS (SELECT fruit_name, month(date) AS month_num, year(date) AS y, sum(net_weight_mt) AS mt FROM s GROUP BY ALL), a AS (SELECT fruit_name, month_num, round(avg(mt) + 1e-9, 4) AS avg_mt FROM m GROUP BY ALL)"
ORGANIC, EUROPE = "certification = 'organic'", "region = 'Europe'"


def _sum_if(test: str, name: str, column: str = "net_weight_mt") -> str:
    return f"round(coalesce(sum({column}) FILTER (WHERE {test}), 0), 2) AS {name}"


def _points(value: str, steps: tuple[tuple[str, int], ...], rest: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} {test} THEN {p}" for test, p in steps) + f" ELSE {rest} END"


ORACLES: dict[str, str] = {
    "pricing_by_fruit": _s(_quartiles("fruit_name", "fruit")),
    "pricing_by_exporter": _s(_quartiles("exporter", "exporter", extra=", count(DISTINCT fruit_name) AS fruits")),
    "pricing_by_importer": _s(_quartiles("importer", "importer")),
    "pricing_by_format": _s(_quartiles("format_type", "format")),
    "pricing_europe": _s(_quartiles("fruit_name", "fruit", "AND region = 'Europe'")),
    "pricing_row": _s(_quartiles("fruit_name", "fruit", "AND region <> 'Europe'")),
    "pricing_whole_units": _s("SELECT format, " + ", ".join(f"CAST(round_even({c}, 0) AS BIGINT) AS {c}" for c in ("low_price", "mid_price", "high_price", "total_mt")) + ", records FROM q", f"q AS ({_quartiles('format_type', 'format')})"),
    "drill_fruit_by_exporter": _s(_quartiles("exporter", "exporter", "AND fruit_name = 'ECONOMY'", ", count(DISTINCT fruit_name) AS fruits")),
    "drill_fruit_by_format": _s(_quartiles("format_type", "format", "AND fruit_name = 'ECONOMY'")),
    "drill_exporter_by_fruit": _s(_quartiles("fruit_name", "fruit", "AND exporter = 'Supplier#000000001'")),
    "product_quote": _s("SELECT fruit, low_price, mid_price, high_price, records, total_mt FROM q", f"q AS ({_quartiles('fruit_name', 'fruit', 'AND fruit_name = ' + chr(39) + 'ECONOMY' + chr(39))})"),
    "exporter_products": _s(_range("exporter, fruit_name, format_type, size_mm, certification, region")),
    "destination_products": _s(_range("country, region, fruit_name, format_type, size_mm, certification")),
    "regional_exports": _s(_range("region, country, fruit_name, format_type, certification")),
    "monthly_exports": _s(_range("ALL", "fruit_name, strftime(date, '%Y') AS year, strftime(date, '%m') AS month, CAST(month(date) AS INTEGER) AS month_num", "WHERE net_weight_mt > 0")),
    "region_two_level": _s("SELECT region, count(country) AS countries, CAST(sum(n) AS BIGINT) AS shipments, round(sum(mt), 2) AS total_mt FROM (SELECT region, country, count(*) AS n, sum(net_weight_mt) AS mt FROM s GROUP BY ALL) GROUP BY region"),
    "table_stats": _s("SELECT count(*) AS records, min(date) AS first_date, max(date) AS last_date, count(DISTINCT exporter) AS exporters, count(DISTINCT importer) AS importers, count(DISTINCT country) AS countrys FROM s"),
    "distinct_values": _s("SELECT DISTINCT country AS value FROM s WHERE country IS NOT NULL"),
    "available_values": _s("SELECT format_type AS value, count(*) AS records, round(sum(net_weight_mt), 2) AS total_mt FROM s WHERE format_type IS NOT NULL GROUP BY 1"),
    "price_analysis_having": _s("SELECT *, round(100 * (max_price - min_price) / nullif(min_price, 0) + 1e-9, 4) AS spread_pct FROM g ORDER BY total_mt DESC, fruit_name, format_type, size_mm, certification, region LIMIT 50", "g AS (SELECT fruit_name, format_type, size_mm, certification, region, count(*) AS sample_count, round(min(usd_per_mt) + 1e-9, 4) AS min_price, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price, round(max(usd_per_mt) + 1e-9, 4) AS max_price, round(sum(net_weight_mt), 2) AS total_mt FROM s WHERE usd_per_mt > 0 GROUP BY ALL HAVING count(*) >= 3)"),
    "region_top_countries": _s('SELECT * FROM (SELECT "group", name, total, row_number() OVER (PARTITION BY "group" ORDER BY total DESC, name) AS rank FROM g) WHERE rank <= 5', 'g AS (SELECT region AS "group", country AS name, round(sum(net_weight_mt), 2) AS total FROM s GROUP BY ALL)'),
    "fruit_top_exporters": _s('SELECT * FROM (SELECT "group", name, total, row_number() OVER (PARTITION BY "group" ORDER BY total DESC, name) AS rank FROM g) WHERE rank <= 3', 'g AS (SELECT fruit_name AS "group", exporter AS name, round(sum(net_weight_mt), 2) AS total FROM s GROUP BY ALL)'),
    "conditional_sums": _s(f"SELECT exporter, round(sum(net_weight_mt), 2) AS total_mt, {_sum_if(ORGANIC, 'organic_mt')}, {_sum_if(EUROPE, 'europe_mt')}, {_sum_if(ORGANIC + ' AND ' + EUROPE, 'europe_organic_mt')} FROM s GROUP BY exporter"),
    "weighted_price_stats": _s("SELECT fruit_name, format_type, round(any_value(m) + 1e-9, 4) AS weighted_mean, round(sqrt(sum(w * (p - m) * (p - m)) / sum(w)) + 1e-9, 4) AS weighted_std, round(100 * sqrt(sum(w * (p - m) * (p - m)) / sum(w)) / any_value(m) + 1e-9, 4) AS cv_pct FROM j GROUP BY 1, 2", "b AS (SELECT fruit_name, format_type, usd_per_mt AS p, net_weight_mt AS w FROM s WHERE usd_per_mt > 0 AND net_weight_mt > 0), j AS (SELECT b.*, m FROM b JOIN (SELECT fruit_name, format_type, sum(p * w) / sum(w) AS m FROM b GROUP BY 1, 2) USING (fruit_name, format_type))"),
    "hhi_by_country": _s(_hhi("country", "exporter")),
    "detail_stats": _s("SELECT fruit_name, exporter, format_type, count(usd_per_mt) AS shipments, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price, round(median(usd_per_mt) + 1e-9, 4) AS median_price, round(stddev_samp(usd_per_mt) + 1e-9, 4) AS std_price, round(min(usd_per_mt) + 1e-9, 4) AS min_price, round(max(usd_per_mt) + 1e-9, 4) AS max_price, round(sum(net_weight_mt), 2) AS total_mt, coalesce(string_agg(DISTINCT country, ', ' ORDER BY country), '') AS destinations, bool_or(certification = 'organic') AS has_organic, coalesce(string_agg(DISTINCT certification, ', ' ORDER BY certification) FILTER (WHERE certification <> 'unknown'), '') AS certifications FROM s GROUP BY 1, 2, 3"),
    "exporter_summary": _s("SELECT fruit_name, exporter, count(*) AS shipments, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price, round(median(usd_per_mt) + 1e-9, 4) AS median_price, round(sum(net_weight_mt), 2) AS total_mt, string_agg(DISTINCT format_type, ', ' ORDER BY format_type) AS formats FROM s GROUP BY 1, 2"),
    "format_summary": _s("SELECT fruit_name, format_type, count(*) AS shipments, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price, round(median(usd_per_mt) + 1e-9, 4) AS median_price, round(sum(net_weight_mt), 2) AS total_mt, count(DISTINCT exporter) AS exporters FROM s GROUP BY 1, 2"),
    "pivot_median": _s("SELECT certification, format_type, " + ", ".join(f"round(median(usd_per_mt) FILTER (WHERE fruit_name = '{f}') + 1e-9, 4) AS {f.lower()}" for f in ("ECONOMY", "SMALL", "LARGE")) + " FROM s GROUP BY 1, 2"),
    "recommended_ranges": _s(
        "SELECT fruit_name, g.n, round(m + 1e-9, 4) AS mean_price, round(q2 + 1e-9, 4) AS median_price, round(d + 1e-9, 4) AS std_price, round(q1 + 1e-9, 4) AS q1, round(q3 + 1e-9, 4) AS q3, round(greatest(lo, q1 - 1.5 * (q3 - q1)) + 1e-9, 4) AS recommended_min, "
        "round(least(hi, q3 + 1.5 * (q3 - q1)) + 1e-9, 4) AS recommended_max, iqr_outliers, z_outliers, outliers, clean_n, clean_mean, clean_min, clean_max FROM g JOIN t USING (fruit_name)",
        "g AS (SELECT fruit_name, count(*) AS n, avg(usd_per_mt) AS m, quantile_cont(usd_per_mt, 0.25) AS q1, median(usd_per_mt) AS q2, quantile_cont(usd_per_mt, 0.75) AS q3, CASE WHEN count(*) < 5 THEN stddev_samp(usd_per_mt) ELSE stddev_pop(usd_per_mt) END AS d, stddev_pop(usd_per_mt) AS dp, "
        "min(usd_per_mt) AS lo, max(usd_per_mt) AS hi FROM s WHERE usd_per_mt > 0 GROUP BY 1), "
        "o AS (SELECT fruit_name, usd_per_mt AS p, n >= 4 AND (usd_per_mt < q1 - 1.5 * (q3 - q1) OR usd_per_mt > q3 + 1.5 * (q3 - q1)) AS far, n >= 3 AND dp > 0 AND abs(usd_per_mt - m) > 3 * dp AS odd FROM s JOIN g USING (fruit_name) WHERE usd_per_mt > 0), "
        "t AS (SELECT fruit_name, count(*) FILTER (WHERE far) AS iqr_outliers, count(*) FILTER (WHERE odd) AS z_outliers, count(*) FILTER (WHERE far OR odd) AS outliers, count(*) FILTER (WHERE NOT (far OR odd)) AS clean_n, "
        "round(avg(p) FILTER (WHERE NOT (far OR odd)) + 1e-9, 4) AS clean_mean, round(min(p) FILTER (WHERE NOT (far OR odd)) + 1e-9, 4) AS clean_min, round(max(p) FILTER (WHERE NOT (far OR odd)) + 1e-9, 4) AS clean_max FROM o GROUP BY 1)",
    ),
    "frozen_vs_aseptic": _s(f"SELECT fruit_name, {_sum_if(AIR, 'air_mt')}, {_sum_if('NOT ' + AIR, 'sea_mt')}, round(sum(net_weight_mt), 2) AS total_mt FROM s GROUP BY 1"),
    "top_n_share": _s("SELECT rank, name, total, round(100 * total / whole + 1e-9, 4) AS share_pct, round(100 * run / whole + 1e-9, 4) AS cumulative_pct FROM r WHERE rank <= 10", _totals("exporter") + ", " + RANKED),
    "top_20_exporters": _s("SELECT rank, name, total, round(100 * total / whole + 1e-9, 4) AS share_pct, round(100 * run / whole + 1e-9, 4) AS cumulative_pct FROM r WHERE rank <= 20", _totals("exporter", f"WHERE {Y98}") + ", " + RANKED),
    "rank_of_exporter": _s("SELECT name, total, rank FROM r WHERE name = 'Supplier#000000007'", _totals("exporter") + ", " + RANKED),
    "others_bucketing": _s("SELECT name, bucket, total FROM exporter_b", _bucket("exporter", "Others")),
    "time_series_daily": _series("strftime(date, '%Y-%m-%d')", "sum(fob_usd)", 365),
    "time_series_weekly": _series("strftime(date, '%Y-W%W')", "CAST(count(*) AS DOUBLE)", 52),
    "time_series_monthly": _series("strftime(date, '%Y-%m')", "sum(net_weight_mt)", 12),
    "trend_halves": _s("SELECT *, CASE WHEN periods >= 6 THEN CASE WHEN second_half > first_half * 1.05 THEN 'increasing' WHEN second_half < first_half * 0.95 THEN 'decreasing' ELSE 'stable' END END AS direction FROM h", "e AS (SELECT strftime(date, '%Y-%m') AS period, round(sum(net_weight_mt) + 1e-9, 4) AS value FROM s GROUP BY 1), p AS (SELECT value, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS n FROM e), h AS (SELECT count(*) AS periods, round(avg(value) FILTER (WHERE i <= floor(n / 2)) + 1e-9, 4) AS first_half, round(avg(value) FILTER (WHERE i > floor(n / 2)) + 1e-9, 4) AS second_half FROM p)"),
    "seasonality": _s("SELECT fruit_name, CAST(month_num AS INTEGER) AS month_num, avg_mt, round(100 * (avg_mt - avg(avg_mt) OVER f) / avg(avg_mt) OVER f + 1e-9, 4) AS pct_above_avg, row_number() OVER (PARTITION BY fruit_name ORDER BY avg_mt DESC, month_num) AS peak_rank, row_number() OVER (PARTITION BY fruit_name ORDER BY avg_mt, month_num) AS low_rank FROM a WINDOW f AS (PARTITION BY fruit_name)", SEASON),
    "compare_periods": _s("SELECT *, round(mt_2 - mt_1, 2) AS mt_change, round(100 * (mt_2 - mt_1) / nullif(mt_1, 0) + 1e-9, 4) AS mt_change_pct FROM g", f"g AS (SELECT fruit_name, {_sum_if(Y97, 'mt_1')}, {_sum_if(Y98, 'mt_2')}, {_sum_if(Y97, 'fob_1', 'fob_usd')}, {_sum_if(Y98, 'fob_2', 'fob_usd')}, count(*) FILTER (WHERE {Y97}) AS shipments_1, count(*) FILTER (WHERE {Y98}) AS shipments_2, round(avg(usd_per_mt) FILTER (WHERE {Y97}) + 1e-9, 4) AS price_1, round(avg(usd_per_mt) FILTER (WHERE {Y98}) + 1e-9, 4) AS price_2 FROM s WHERE {Y97} OR {Y98} GROUP BY 1)"),
    "compare_products": _compare({"fruit=ECONOMY": "fruit_name = 'ECONOMY'", "fruit=SMALL, certification=organic": "fruit_name = 'SMALL' AND certification = 'organic'", "fruit=LARGE": "fruit_name = 'LARGE'"}),
    "compare_exporters": _compare({f"exporter=Supplier#00000000{k}": f"exporter = 'Supplier#00000000{k}'" for k in (1, 2)}, Y98),
    "compare_exporters_fuzzy": _compare({f"exporter=Supplier#00000000{k}": f"exporter = 'Supplier#00000000{k}'" for k in (1, 3)}, "date BETWEEN DATE '1997-12-31' AND DATE '1998-12-31'"),
    "market_details": _s(
        "SELECT country, part, rank, name, total_mt, round(100 * total_mt / whole + 1e-9, 4) AS share_pct FROM r WHERE part = 'certification' OR rank <= 5",
        "o AS (SELECT * FROM s WHERE fruit_name = 'ECONOMY'), e AS (SELECT country, 'product' AS part, format_type AS name, net_weight_mt FROM o UNION ALL SELECT country, 'supplier', exporter, net_weight_mt FROM o UNION ALL SELECT country, 'certification', certification, net_weight_mt FROM o), "
        "t AS (SELECT country, part, coalesce(name, 'unknown') AS name, round(sum(net_weight_mt), 2) AS total_mt FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY country, part ORDER BY total_mt DESC, name) AS rank, sum(total_mt) OVER (PARTITION BY country, part) AS whole FROM t)",
    ),
    "destination_bilingual": _s("SELECT count(*) AS shipments, round(sum(net_weight_mt), 2) AS total_mt, round(sum(fob_usd), 2) AS total_fob FROM d", f"d AS ({DETAIL.format("country ILIKE '%nation_2%' OR country ILIKE '%NATION_2%'", 'date', REST)})"),
    "dataset_summary": _s(
        "SELECT records, total_mt, total_fob, weighted_price, exporters, countries, "
        + ", ".join(f"(SELECT string_agg(name || '=' || CAST(mt AS DECIMAL(38,2)), '; ' ORDER BY {'place' if n == 'top_destinations' else 'name'}) FROM r WHERE part = '{n}'{' AND place <= 10' if n == 'top_destinations' else ''}) AS {n}" for n in ("by_fruit", "by_format", "by_size", "top_destinations"))
        + " FROM g",
        "g AS (SELECT count(*) AS records, round(sum(net_weight_mt), 2) AS total_mt, round(sum(fob_usd), 2) AS total_fob, round(sum(fob_usd) / sum(net_weight_mt) + 1e-9, 4) AS weighted_price, count(DISTINCT exporter) AS exporters, count(DISTINCT country) AS countries FROM s), "
        "e AS ("
        + " UNION ALL ".join(f"SELECT '{n}' AS part, coalesce({c}, 'unknown') AS name, net_weight_mt FROM s" for n, c in (("by_fruit", "fruit_name"), ("by_format", "format_type"), ("by_size", "size_mm"), ("top_destinations", "country")))
        + "), t AS (SELECT part, name, CAST(sum(net_weight_mt) AS DECIMAL(38,2)) AS mt FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY mt DESC, name) AS place FROM t)",
    ),
    "dashboard_kpis": _s("SELECT *, " + ", ".join(f"round(100 * ({a} - {b}) / nullif({b}, 0) + 1e-9, 4) AS {n}" for a, b, n in (("total_mt", "prev_mt", "mt_growth_pct"), ("total_fob", "prev_fob", "fob_growth_pct"), ("shipments", "prev_shipments", "shipment_growth_pct"))) + " FROM g", f"g AS (SELECT count(*) FILTER (WHERE {Y98}) AS shipments, {_sum_if(Y98, 'total_mt')}, {_sum_if(Y98, 'total_fob', 'fob_usd')}, round(avg(usd_per_mt) FILTER (WHERE {Y98}) + 1e-9, 4) AS avg_price, count(DISTINCT exporter) FILTER (WHERE {Y98}) AS exporters, count(DISTINCT country) FILTER (WHERE {Y98}) AS countries, count(*) FILTER (WHERE {Y97}) AS prev_shipments, {_sum_if(Y97, 'prev_mt')}, {_sum_if(Y97, 'prev_fob', 'fob_usd')} FROM s)"),
    "market_share": _s("SELECT rank, name, total, round(100 * total / whole + 1e-9, 4) AS share_pct, hhi, CASE WHEN hhi < 1500 THEN 'low' WHEN hhi < 2500 THEN 'moderate' ELSE 'high' END AS concentration, CASE WHEN members >= 3 THEN top3 ELSE 0 END AS top3_share, CASE WHEN members >= 5 THEN top5 ELSE 0 END AS top5_share FROM r, h, k WHERE rank <= 10", _totals("exporter") + ", " + RANKED + f", h AS ({_hhi('', 'exporter')}), k AS (SELECT round(sum(round(100 * total / whole + 1e-9, 4)) FILTER (WHERE rank <= 3) + 1e-9, 4) AS top3, round(sum(round(100 * total / whole + 1e-9, 4)) FILTER (WHERE rank <= 5) + 1e-9, 4) AS top5 FROM r)"),
    "price_premium": _s("SELECT *, round(100 * (organic_price - conventional_price) / nullif(conventional_price, 0) + 1e-9, 4) AS organic_premium_pct, round(100 * (europe_price - row_price) / nullif(row_price, 0) + 1e-9, 4) AS europe_gap_pct FROM g", "g AS (SELECT fruit_name, " + ", ".join(f"round(sum(fob_usd) FILTER (WHERE {t}) / sum(net_weight_mt) FILTER (WHERE {t}) + 1e-9, 4) AS {n}" for t, n in ((ORGANIC, "organic_price"), ("certification = 'conventional'", "conventional_price"), (EUROPE, "europe_price"), ("region <> 'Europe'", "row_price"))) + " FROM s GROUP BY 1)"),
    "diversification": _s("SELECT name, count(f) AS n, round(100 * max(t) / sum(t) + 1e-9, 4) AS top_share_pct, CASE WHEN count(f) >= 5 THEN 'High' WHEN count(f) >= 3 THEN 'Medium' ELSE 'Low' END AS diversification FROM (SELECT importer AS name, fruit_name AS f, sum(net_weight_mt) AS t FROM s GROUP BY ALL) GROUP BY name"),
    "readiness_score": _s(
        "SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level FROM (SELECT *, exposure_score + organic_score + geo_score + product_score AS score FROM (SELECT *, "
        + _points("europe_pct", (("> 20", 25), ("> 10", 15), ("> 5", 10)), 5) + " AS exposure_score, " + _points("organic_pct", (("> 50", 25), ("> 30", 20), ("> 10", 10)), 5) + " AS organic_score, " + _points("countries", (("> 5", 25), (">= 3", 15)), 5) + " AS geo_score, " + _points("product_hhi", (("< 2500", 25), ("< 5000", 15)), 5) + " AS product_score FROM j))",
        f"g AS (SELECT exporter, sum(net_weight_mt) AS t, coalesce(sum(net_weight_mt) FILTER (WHERE {EUROPE}), 0) AS e, coalesce(sum(net_weight_mt) FILTER (WHERE {ORGANIC}), 0) AS o, count(DISTINCT country) FILTER (WHERE {EUROPE}) AS countries FROM s GROUP BY 1), eu AS (SELECT * FROM s WHERE {EUROPE}), h AS ({_hhi('exporter', 'fruit_name', 'eu')}), "
        "j AS (SELECT g.exporter, round(100 * e / t + 1e-9, 4) AS europe_pct, round(100 * o / t + 1e-9, 4) AS organic_pct, countries, coalesce(hhi, 0) AS product_hhi FROM g LEFT JOIN h ON g.exporter = h.exporter)",
    ),
    "market_gaps": _s(
        "SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT *, CASE suppliers WHEN 1 THEN 40 WHEN 2 THEN 30 WHEN 3 THEN 20 ELSE 10 END + " + _points("total_mt", (("> 1000", 30), ("> 500", 20), ("> 200", 10)), 5) + " + " + _points("avg_price", (("> 3000", 30), ("> 2500", 20), ("> 2000", 10)), 5) + " AS score FROM g) ORDER BY score DESC, total_mt DESC, fruit_name, format_type, certification, country, region LIMIT 20",
        "g AS (SELECT fruit_name, format_type, certification, country, region, count(DISTINCT exporter) AS suppliers, count(*) AS shipments, round(sum(net_weight_mt), 2) AS total_mt, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price FROM s GROUP BY 1, 2, 3, 4, 5 HAVING round(sum(net_weight_mt), 2) >= 20 AND count(DISTINCT exporter) <= 5 ORDER BY total_mt DESC, fruit_name, format_type, certification, country, region LIMIT 50)",
    ),
    "competitors": _s("SELECT name, total, rank, round(100 * total / whole + 1e-9, 4) AS share_pct, CASE WHEN rank <= 3 THEN 'leader' WHEN rank <= 10 THEN 'challenger' ELSE 'follower' END AS role, CASE WHEN round(100 * total / whole + 1e-9, 4) > 20 THEN 'dominant' WHEN round(100 * total / whole + 1e-9, 4) > 10 THEN 'strong' WHEN round(100 * total / whole + 1e-9, 4) > 5 THEN 'moderate' ELSE 'minor' END" + " AS position FROM r", _totals("exporter") + ", " + RANKED),
    "attractiveness": _s(
        "SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT *, " + _points("total_mt", (("> 500", 30), ("> 200", 25), ("> 100", 20), ("> 50", 15)), 10) + " + " + _points("avg_price", (("> 3000", 25), ("> 2500", 20), ("> 2000", 15)), 10) + " + " + _points("supplier_hhi", (("< 1500", 25), ("< 2500", 15)), 5) + " + " + _points("organic_pct", (("> 50", 20), ("> 30", 15), ("> 10", 10)), 5) + " AS score FROM j)",
        f"o AS (SELECT * FROM s WHERE fruit_name = 'ECONOMY'), h AS ({_hhi('country', 'exporter', 'o')}), g AS (SELECT country, round(sum(net_weight_mt), 2) AS total_mt, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price, round(100 * coalesce(sum(net_weight_mt) FILTER (WHERE {ORGANIC}), 0) / sum(net_weight_mt) + 1e-9, 4) AS organic_pct FROM o GROUP BY 1), j AS (SELECT g.*, hhi AS supplier_hhi FROM g JOIN h USING (country))",
    ),
    "validity_flag": _s(f"SELECT fruit_name, via, CAST(NOT ({AIR} OR {SAMPLE} OR net_weight_mt < 0.1 OR usd_per_mt < 500 OR usd_per_mt < lower OR usd_per_mt > upper) AS INTEGER) AS analysis_valid, {BY_FRUIT} FROM s JOIN {BOUNDS.format('s')} USING (fruit_name) GROUP BY 1, 2, 3"),
    "cascade_filter": _s(f"SELECT fruit_name, {BY_FRUIT} FROM l JOIN {BOUNDS.format('l')} USING (fruit_name) WHERE usd_per_mt BETWEEN lower AND upper GROUP BY 1", LEFT),
    "cascade_alternative": _s(f"SELECT fruit_name, {BY_FRUIT} FROM l GROUP BY 1", ALT),
    "worldwide_pricing": _s(_quartiles("fruit_name", "fruit", source="l"), ALT),
    "exclusions": _s(f"SELECT CASE WHEN {AIR} THEN 'air' WHEN {ALT_SAMPLE} THEN 'sample' WHEN net_weight_mt < 2 THEN 'small' WHEN usd_per_mt < {ALT_FLOOR} THEN 'floor' ELSE 'kept' END AS reason, count(*) AS records, round(sum(net_weight_mt), 2) AS total_mt FROM s GROUP BY 1"),
    "filter_stats": _s(f"SELECT count(*) AS total_records, count(*) FILTER (WHERE {AIR}) AS air_shipments, count(*) FILTER (WHERE {SAMPLE}) AS samples, count(*) FILTER (WHERE net_weight_mt < 0.1) AS small_shipments, count(*) FILTER (WHERE usd_per_mt < 500) AS below_price_floor FROM s"),
    "iqr_bounds": _s("SELECT fruit_name, round(q1 + 1e-9, 4) AS q1, round(q3 + 1e-9, 4) AS q3, round(q3 - q1 + 1e-9, 4) AS iqr, round(q1 - 1.5 * (q3 - q1) + 1e-9, 4) AS lower, round(q3 + 1.5 * (q3 - q1) + 1e-9, 4) AS upper FROM (SELECT fruit_name, quantile_cont(usd_per_mt, 0.25) AS q1, quantile_cont(usd_per_mt, 0.75) AS q3 FROM s GROUP BY 1)"),
    "outliers_iqr_z": _outliers("fruit_name"),
    "outliers_fine": _outliers("fruit_name, format_type"),
    "quality_report": _s(
        "SELECT count(*) AS total_records, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date, "
        + ", ".join(f"count(*) FILTER (WHERE {t}) AS {n}, 100 * count(*) FILTER (WHERE {t}) / count(*) > {m} AS {n}_warns" for n, t, m in (("unknown_fruit", "fruit_name = 'unknown'", 1), ("zero_price", "usd_per_mt = 0", 5), ("zero_volume", "net_weight_mt = 0", 5), ("high_price", "usd_per_mt > 10000", 0), ("low_price", "usd_per_mt > 0 AND usd_per_mt < 500", 0), ("unknown_format", "format_type = 'unknown'", 10), ("unknown_certification", "certification = 'unknown'", 70)))
        + " FROM s"
    ),
    "union_flows": _flows(),
    "supply_chain": _bucketed_flows(),
    "country_flows": _flows("WHERE country = 'NATION_3'"),
    "detail_by_exporter": _s(DETAIL.format("exporter ILIKE '%supplier#000000001%'", "date", REST)),
    "detail_by_product": _s(DETAIL.format("fruit_name ILIKE '%small%' AND certification ILIKE '%organic%'", "usd_per_mt", "date, " + REST)),
    "detail_totals": _s("SELECT count(*) AS shipments, round(sum(net_weight_mt), 2) AS total_mt, round(sum(fob_usd), 2) AS total_fob FROM d", "d AS (" + DETAIL.format("country ILIKE '%nation_3%' AND fruit_name ILIKE '%economy%'", "date", REST) + ")"),
    "range_query": _s("SELECT count(*) AS shipments, round(sum(net_weight_mt), 2) AS total_mt, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price, round(min(usd_per_mt) + 1e-9, 4) AS min_price, round(max(usd_per_mt) + 1e-9, 4) AS max_price FROM s WHERE region = 'Europe' AND usd_per_mt BETWEEN 900 AND 1500 AND net_weight_mt >= 5 AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"),
    "search_exporters": _s("SELECT exporter AS name, count(*) AS records FROM s WHERE contains(lower(exporter), '000001') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "importers_by_text": _s("SELECT trim(regexp_replace(regexp_replace(upper(importer), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS text, count(*) AS records, string_agg(DISTINCT importer, ',' ORDER BY importer) AS names FROM s GROUP BY 1"),
    "country_outlook": _s(
        "SELECT country, fruit_name, CASE WHEN mt IS NOT NULL THEN 'active' WHEN near_mt IS NOT NULL THEN 'neighbours' WHEN top_mt IS NOT NULL THEN 'region' ELSE 'none' END AS status, round(CASE WHEN mt IS NOT NULL THEN mt WHEN near_mt IS NOT NULL THEN near_mt * CASE near_n WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 ELSE 0.7 END WHEN top_mt IS NOT NULL THEN top_mt * CASE top_n WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 ELSE 0.3 END END, 2) AS potential_mt "
        "FROM places CROSS JOIN fruits LEFT JOIN sold USING (country, fruit_name) LEFT JOIN near USING (country, fruit_name) LEFT JOIN top USING (fruit_name)",
        "places AS (SELECT 'NATION_' || i AS country, i FROM range(25) t(i)), fruits AS (SELECT unnest(['ECONOMY', 'SMALL']) AS fruit_name), edges AS (SELECT country, 'NATION_' || ((i + k) % 25) AS neighbour FROM places, (SELECT unnest([1, 2]) AS k)), sold AS (SELECT fruit_name, country, round(sum(net_weight_mt), 2) AS mt FROM s WHERE fruit_name IN ('ECONOMY', 'SMALL') GROUP BY 1, 2), "
        "near AS (SELECT e.country, sold.fruit_name, max(mt) AS near_mt, count(*) AS near_n FROM edges e JOIN sold ON e.neighbour = sold.country GROUP BY 1, 2), top AS (SELECT fruit_name, max(mt) AS top_mt, count(*) AS top_n FROM (SELECT *, row_number() OVER (PARTITION BY fruit_name ORDER BY mt DESC, country) AS r FROM sold) WHERE r <= 5 GROUP BY 1)",
    ),
}
MASTER = "SELECT fruit_name, exporter, certification, count(*) AS shipments, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price, round(quantile_cont(usd_per_mt, 0.25) + 1e-9, 4) AS q1, round(median(usd_per_mt) + 1e-9, 4) AS median_price, round(quantile_cont(usd_per_mt, 0.75) + 1e-9, 4) AS q3, round(quantile_cont(usd_per_mt, 0.75) - quantile_cont(usd_per_mt, 0.25) + 1e-9, 4) AS width, round(sum(net_weight_mt), 2) AS total_mt, count(DISTINCT country) AS destinations FROM s GROUP BY 1, 2, 3"
ORACLES["master_table"] = _s(MASTER)
ORACLES["master_totals"] = _s("SELECT fruit_name, count(DISTINCT exporter) AS exporters, CAST(sum(shipments) AS BIGINT) AS shipments, round(sum(total_mt), 2) AS total_mt, round(median(median_price) + 1e-9, 4) AS median_of_medians FROM m GROUP BY 1", f"m AS ({MASTER})")


def _concentration(by: str, name: str) -> str:
    return f"{name}_c AS (SELECT name, round(sum(p * p) + 1e-9, 2) AS {name}_hhi, count(*) AS n_{name} FROM (SELECT name, round(100 * t / sum(t) OVER (PARTITION BY name) + 1e-9, 2) AS p FROM (SELECT exporter AS name, {by}, sum(net_weight_mt) AS t FROM s GROUP BY ALL)) GROUP BY 1)"


BAND = "CASE WHEN {0} < 2500 THEN 'low' WHEN {0} < 5000 THEN 'moderate' ELSE 'high' END"
ORACLES["portfolio"] = _s(
    f"SELECT b.*, product_hhi, n_product, country_hhi, n_country, {BAND.format('product_hhi')} AS product_band, {BAND.format('country_hhi')} AS country_band, CASE WHEN price > 1.1 * market_price THEN 'premium' WHEN price < 0.9 * market_price THEN 'budget' ELSE 'market' END AS price_tier FROM b JOIN product_c USING (name) JOIN country_c USING (name)",
    "e AS (SELECT exporter AS name, sum(net_weight_mt) AS t, sum(fob_usd) AS f FROM s GROUP BY 1), b AS (SELECT name, round(t, 2) AS total_mt, round(100 * t / sum(t) OVER () + 1e-9, 4) AS share_pct, round(f / t + 1e-9, 4) AS price, round(sum(f) OVER () / sum(t) OVER () + 1e-9, 4) AS market_price FROM e), " + _concentration("fruit_name", "product") + ", " + _concentration("country", "country"),
)


REPORT = "SELECT {part} AS part, {name} AS name, count(*) AS shipments, round(sum(net_weight_mt), 2) AS total_mt, round(avg(usd_per_mt) + 1e-9, 4) AS avg_price, count(DISTINCT exporter) AS exporters FROM s WHERE region = 'Europe' AND {where} GROUP BY ALL"


def _report(where: str) -> str:
    return _s(" UNION ALL ".join(REPORT.format(part=f"'{p}'", name=n, where=where) for p, n in (("all", "CAST(NULL AS VARCHAR)"), ("country", "country"), ("exporter", "exporter"), ("format", "coalesce(format_type, 'Unknown')"))))


TOP = "SELECT rank, name, total, round(100 * total / whole + 1e-9, 4) AS share_pct, round(100 * run / whole + 1e-9, 4) AS cumulative_pct FROM r WHERE rank <= 10"
ORACLES |= {
    "exporter_audit": _s("SELECT fruit_name, exporter, round(sum(net_weight_mt), 2) AS total_mt, count(*) AS shipments, round(avg(usd_per_mt) FILTER (WHERE usd_per_mt > 0) + 1e-9, 4) AS avg_positive_price FROM s WHERE fruit_name IN ('ECONOMY', 'PROMO') GROUP BY 1, 2"),
    "fruit_report": _report("fruit_name = 'SMALL'"),
    "fruit_report_all": _report("TRUE"),
    "product_totals": _s("SELECT fruit_name, format_type, size_mm, certification, count(*) AS records, round(sum(net_weight_mt), 2) AS total_mt, round(sum(fob_usd), 2) AS total_fob, round(sum(fob_usd) / sum(net_weight_mt) + 1e-9, 4) AS weighted_price FROM s GROUP BY 1, 2, 3, 4"),
    "value_counts": _s("SELECT certification AS value, count(*) AS records, round(sum(net_weight_mt), 2) AS total_mt FROM s GROUP BY 1"),
    "top_air_exporters": _s(TOP, _totals("exporter", "WHERE via = 'AIR'") + ", " + RANKED),
    "top_destinations": _s(TOP, "t AS (SELECT country AS name, round(sum(fob_usd), 2) AS total FROM s GROUP BY 1), " + RANKED),
    "name_variations": _s("SELECT substr(importer, 1, 17) AS canonical_importer, count(*) AS records, count(DISTINCT importer) AS variations, substr(string_agg(DISTINCT importer, ', ' ORDER BY importer), 1, 200) AS names FROM s GROUP BY 1"),
    "canonical_audit": _s("SELECT DISTINCT upper(importer) AS canonical_importer, importer FROM s ORDER BY 1, 2 LIMIT 30"),
    "country_flows_of_fruit": _s(" UNION ALL ".join(f"SELECT {k} AS level, {a} AS source, {b} AS target, round(sum(net_weight_mt), 2) AS value FROM s WHERE country = 'NATION_3' AND fruit_name = 'SMALL' GROUP BY 2, 3" for k, (a, b) in enumerate((("exporter", "importer"), ("importer", "country"))))),
    "supplier_ranking": _s("SELECT name, count(c) AS n, round(100 * max(t) / sum(t) + 1e-9, 4) AS top_share_pct, CASE WHEN count(c) >= 5 THEN 'High' WHEN count(c) >= 3 THEN 'Medium' ELSE 'Low' END AS diversification FROM (SELECT exporter AS name, country AS c, sum(net_weight_mt) AS t FROM s GROUP BY ALL) GROUP BY name"),
    "detail_by_destination": _s(DETAIL.format("country ILIKE '%nation_1%' AND certification ILIKE '%organic%'", "net_weight_mt", "date, exporter, importer, fruit_name, format_type, size_mm, certification, country, round(usd_per_mt + 1e-9, 4), fob_usd, declaration")),
    "repeat_suppression": r"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT uid, unnest(range(1, len(w) + 1)) AS i, w FROM d), r AS (SELECT uid, i, w[i] AS word, row_number() OVER (PARTITION BY uid, array_to_string(w[i:i + 4], ' ') ORDER BY i) AS k FROM x),
g AS (SELECT uid, string_agg(word, ' ' ORDER BY i) AS clean_text FROM r WHERE k = 1 GROUP BY uid) SELECT doc_id, coalesce(clean_text, '') AS clean_text FROM d LEFT JOIN g USING (uid)""",
}


def _parsed(key: str) -> str:
    """The parser over rows p (key, t); empty texts have no format. The library's regular expressions have no look-ahead, so a letter after `mango` is matched as itself."""
    from cargolens.functions import product as P

    has = lambda p: f"regexp_matches(t, '(?i){p}')".replace("(?:\\b|(?=[A-Z]))", "(?:\\b|[A-Za-z])")
    case = lambda labels, rest: "CASE " + " ".join(f"WHEN {has(p)} THEN '{n}'" for n, p in labels) + f" ELSE {rest} END"
    got = lambda p, k: f"nullif(regexp_extract(t, '(?i){p}', {k}), '')"
    variety = "coalesce(" + ", ".join(got(p, 1) for p in P.VARIETIES) + ")"
    size = "coalesce(" + ", ".join(f"{got(p, 1)} || 'x' || {got(p, 2)}" for p in P.SIZES) + ")"
    return (
        f"SELECT {key}, {case(P.FRUITS, chr(39) + 'unknown' + chr(39))} AS fruit_name, upper({variety}[1]) || {variety}[2:] AS variety, "
        f"CASE WHEN t <> '' THEN coalesce({case(P.FORMATS, 'NULL')}, CASE WHEN {has(P.IQF)} THEN 'iqf' WHEN {size} IS NOT NULL THEN 'chunks' ELSE 'unknown' END) END AS format_type, {size} AS size_mm, {has(P.ORGANIC)} AS is_organic, {has(P.CONVENTIONAL)} AS is_conventional, {has(P.IQF)} AS is_iqf, {has(P.ASEPTIC)} AS is_aseptic, "
        f"CASE WHEN {has(P.ORGANIC)} THEN 'organic' WHEN {has(P.CONVENTIONAL)} THEN 'conventional' ELSE 'unknown' END AS certification FROM p"
    )


def _parse_titles() -> str:
    words = ["MANGO CHUNKS 20X20MM IQF ORGANICO VARIEDAD: EDWARD", "PULPA DE MARACUYA ASEPTICO", "FRESA CONVENCIONAL 10 x 10 mm", "PALTA IQF", "ARANDANO ENTERO", "PIÑA GOLDEN EN TROZOS", "B & P DE UVA"]
    titles = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"WITH p AS (SELECT p_partkey, lower({titles}[p_size % 7 + 1] || ' ' || p_name) AS t FROM part) {_parsed('p_partkey')}"


ORACLES["text_parse"] = _parse_titles()
ORACLES["text_parse_documents"] = ORACLES["repeat_suppression"].replace(" SELECT doc_id, coalesce(clean_text, '') AS clean_text FROM d", ", p AS (SELECT doc_id, coalesce(clean_text, '') AS t FROM d") + ") " + _parsed("doc_id")

def _rule_clusters() -> str:
    """The importer rules over the made-up company names."""
    from cargolens.functions import names as N

    t = "regexp_replace(regexp_replace(trim(upper(name)), '[''\".,:;()\\-/]+', '', 'g'), '\\s+', ' ', 'g')"
    legal = rf"^(.*?\b(?:{'|'.join(N.CUT_FORMS)})\b)"
    cut = f"CASE WHEN length(t) > 30 AND regexp_matches(t, '{legal}') THEN trim(regexp_extract(t, '{legal}', 1)) ELSE t END"
    for form in N.END_FORMS:
        cut = f"regexp_replace({cut}, '\\s+{form}\\s*$', '', 'g')"
    cut = f"trim(regexp_replace({cut}, '\\s+', ' ', 'g'))"
    for suffix in N.COUNTRY_SUFFIXES:
        cut = f"regexp_replace({cut}, '\\s+{suffix}\\s*$', '', 'g')"
    for wrong, right in N.IMPORTER_FIXES:
        cut = f"replace({cut}, '{wrong}', '{right}')"
    forms = "['S.A.C.', 'S.A. DE C.V.', 'LTD.', 'B.V.', 'GMBH & CO. KG', 'S.R.L.', 'PERU']"
    # translate() drops the characters of the first list that have no partner, as it does in Spark
    named = f"n AS (SELECT trim(translate(c_name, '#_0123456789', '  ABCDEFGHIJ')) || ' ' || {forms}[c_custkey % 7 + 1] AS name FROM customer), t AS (SELECT name, {t} AS t FROM n)"
    return f"WITH {named}, c AS (SELECT trim(regexp_replace({cut}, '\\s+', ' ', 'g')) AS canonical_name, name FROM t), k AS (SELECT canonical_name, list_sort(list(DISTINCT name)) AS names, count(*) AS count FROM c GROUP BY 1)"


ORACLES["rule_clusters"] = _rule_clusters() + " SELECT canonical_name, array_to_string(names, '|') AS aliases, count FROM k"
ORACLES["rule_variations"] = _rule_clusters() + " SELECT canonical_name, unnest(names) AS alias, CAST(len(names) AS INTEGER) AS aliases FROM k"
ORACLES["rule_cluster_sizes"] = _rule_clusters() + " SELECT CAST(len(names) AS INTEGER) AS size, count(*) AS clusters, CAST(sum(len(names)) AS BIGINT) AS names FROM k GROUP BY 1"

ORACLES |= {f"rollup_{name}": ORACLES[same] for name, same in (("by_fruit", "pricing_by_fruit"), ("by_exporter", "pricing_by_exporter"), ("drill_down", "drill_fruit_by_exporter"), ("exporter_products", "exporter_products"), ("monthly_exports", "monthly_exports"))}
ORACLES["compare_exporters_typo"] = ORACLES["compare_exporters_fuzzy"]
ORACLES["destination_two_names"] = _s(
    "SELECT count(*) AS shipments, round(sum(net_weight_mt), 2) AS total_mt, round(sum(fob_usd), 2) AS total_fob FROM d",
    "m AS (SELECT * REPLACE (CASE country WHEN 'NATION_2' THEN 'Germany' WHEN 'NATION_5' THEN 'Alemania' ELSE country END AS country) FROM s), "
    f"d AS ({DETAIL.format("country ILIKE '%alemania%' OR country ILIKE '%germany%'", 'date', REST).replace('FROM s', 'FROM m')})",
)
ORACLES["updated_in_place"] = _s(
    "SELECT strftime(date, '%Y-%m') AS month, CASE WHEN s_suppkey % 3 = 0 THEN 'canonical ' || exporter ELSE exporter END AS exporter, "
    "CASE WHEN certification = 'unknown' AND date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN 'checked' ELSE certification END AS certification, upper(country) AS country, "
    "count(*) AS n, round(sum(net_weight_mt), 2) AS mt FROM s JOIN supplier ON s_name = exporter GROUP BY ALL"
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(text: str, rules, flags: str = "gi") -> str:
    """Replacements in order, of patterns that read the same in both engines."""
    for pattern, instead in rules:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(re.sub('[$]([0-9])', lambda m: chr(92) + m[1], instead))}, '{flags}')"
    return text


def _one_of(words) -> str:
    return f"IN ({', '.join(map(_q, words))})"


def _kept(words: str, test: str, end: str) -> str:
    """The list without the elements x at its head or tail that meet the test."""
    place = f"list_{'min' if end == 'head' else 'max'}(list_filter(range(1, len({words}) + 1), lambda k: NOT ({test.replace('x', f'{words}[k]')})))"
    return f"{words}[coalesce({place}, len({words}) + 1):]" if end == "head" else f"{words}[1:coalesce({place}, 0)]"


_FORMS = ("S.A.C.", "S.A. DE C.V.", "LTD.", "B.V.", "GMBH & CO. KG", "S.R.L.", "PERU")
_ENDINGS = "|".join(w for w in N.STOP_WORDS if len(w) > 2 and w.isalpha())
_CLEAN = _replaced(_replaced("trim(upper(strip_accents(name)))", N.REPAIRS), (*N.SPACING, *N.LEGAL_FORMS, *N.PUNCTUATION, *N.SHORT_FORMS, *N.ADDRESSES))
_CUT = rf"^(.*?\b(?:{'|'.join(N.CUT_FORMS)})\b)"
_RULE = _replaced("trim(upper(name))", ((r"['\".,:;()\-/]+", ""), (r"\s+", " ")), "g")
_SHORT = _replaced(f"CASE WHEN length(u) > 30 AND regexp_matches(u, {_q(_CUT)}) THEN trim(regexp_extract(u, {_q(_CUT)}, 1)) ELSE u END", [(rf"\s+{f}\s*$", "") for f in N.END_FORMS], "g")
_NO_COUNTRY = _replaced(f"trim(regexp_replace({_SHORT}, '\\s+', ' ', 'g'))", [(rf"\s+{c}\s*$", "") for c in N.COUNTRY_SUFFIXES], "g")
for _wrong, _right in N.IMPORTER_FIXES:
    _NO_COUNTRY = f"replace({_NO_COUNTRY}, {_q(_wrong)}, {_q(_right)})"

ORACLES["name_clean"] = (
    f"WITH c AS (SELECT c_custkey, concat_ws(' ', translate(c_name, '#_0123456789', '  ABCDEFGHIJ'), [{', '.join(map(_q, _FORMS))}][c_custkey % 7 + 1]) AS name FROM customer), "
    f"a AS (SELECT c_custkey, regexp_replace({_CLEAN}, '\\s+({_ENDINGS})$', '') AS t, {_RULE} AS u FROM c), "
    # single letters join the next word; what waits for it stands behind chr(1)
    "l AS (SELECT c_custkey, u, list_reduce(list_concat([chr(1)], list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')), lambda acc, w: "
    f"CASE WHEN split_part(acc, chr(1), 2) = '' AND length(w) = 1 AND NOT w {_one_of(N.CONJUNCTIONS)} THEN split_part(acc, chr(1), 1) || chr(1) || w "
    "ELSE split_part(acc, chr(1), 1) || ' ' || split_part(acc, chr(1), 2) || w || chr(1) END) AS j FROM a), "
    "d AS (SELECT c_custkey, u, trim(split_part(j, chr(1), 1) || ' ' || split_part(j, chr(1), 2)) AS cleaned FROM l), "
    "w AS (SELECT *, list_filter(string_split(cleaned, ' '), lambda x: x <> '') AS ws FROM d), "
    f"w1 AS (SELECT *, {_kept('ws', 'x ' + _one_of(w for w in N.STOP_WORDS if w not in N.CONJUNCTIONS), 'tail')} AS b1, {_kept('ws', 'x ' + _one_of(N.LEADING), 'head')} AS c1 FROM w), "
    f"w2 AS (SELECT *, {_kept('b1', 'length(x) = 1 AND x NOT ' + _one_of(N.CONJUNCTIONS), 'tail')} AS b2, list_filter({_kept('c1', 'x ' + _one_of(N.STOP_WORDS), 'tail')}, lambda y: length(y) > 1) AS longer, {_kept('c1', 'x ' + _one_of(N.STOP_WORDS), 'tail')} AS c2 FROM w1), "
    f"w3 AS (SELECT *, {_kept('b2', 'x ' + _one_of(N.LEADING), 'head')} AS b3 FROM w2), w4 AS (SELECT *, {_kept('b3', 'x ' + _one_of(N.CONJUNCTIONS), 'head')} AS b4 FROM w3) "
    f"SELECT c_custkey, cleaned, array_to_string({_kept('b4', 'x ' + _one_of(N.CONJUNCTIONS), 'tail')}, ' ') AS brand, "
    f"CASE WHEN len(longer) > 0 THEN array_to_string(longer[1:2], ' ') ELSE coalesce(c2[1], '') END AS core, trim(regexp_replace({_NO_COUNTRY}, '\\s+', ' ', 'g')) AS rule_name FROM w4"
)
ORACLES["full_unaccent"] = "SELECT doc_id, strip_accents(text) AS plain FROM documents"
