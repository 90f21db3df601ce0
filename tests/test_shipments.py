"""Hand-computed cases: parsing, names, quality rules, ranking, sources, sinks, surfaces."""

from __future__ import annotations

import datetime as dt
import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cargolens import cli
from cargolens.api import Shipments
from cargolens.cache import TtlCache
from cargolens.functions import dates, names, places, product
from cargolens.operators import clusters, flows, market, pricing, quality
from cargolens.sources import readers, schema, sinks
from cargolens.streaming import events

COLUMNS = "declaration bigint, exporter string, importer string, fruit_name string, format_type string, size_mm string, certification string, country string, region string, date date, net_weight_mt double, fob_usd double, usd_per_mt double, via string, description string"


def make(spark, rows):
    base = dict(declaration=1, exporter="E", importer="I", fruit_name="mango", format_type="chunks", size_mm=None, certification="unknown", country="Germany", region="Europe", date=dt.date(2025, 1, 1), net_weight_mt=1.0, fob_usd=2000.0, usd_per_mt=2000.0, via="SEA", description="x")
    return spark.createDataFrame([tuple({**base, **r}[c.split()[0]] for c in COLUMNS.split(", ")) for r in rows], COLUMNS)


def values(spark, expr, texts, kind="string"):
    df = spark.createDataFrame(list(enumerate(texts)), f"i int, t {kind}")
    return [r["x"] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MANGO CONGELADO ORGANICO CHUNKS 20X20MM IQF VARIEDAD: EDWARD", ("mango", "Edward", "chunks", "20x20", "organic", True)),
        ("PALTA IQF", ("avocado", None, "iqf", None, "unknown", True)),
        ("FRESA CONVENCIONAL 10 x 10 mm", ("strawberry", None, "chunks", "10x10", "conventional", False)),
        ("PULPA DE MARACUYA ASEPTICO", ("passion_fruit", None, "pulp", None, "unknown", False)),
        ("", ("unknown", None, None, None, "unknown", False)),
        (None, ("unknown", None, None, None, "unknown", False)),
        ("MANGOCILINDROS PURÉ 1x30", ("mango", None, "puree", "1x30", "unknown", False)),
        ("piña golden b & p", ("pineapple", "Golden", "broken_pieces", None, "unknown", False)),
    ],
)
def test_parser(spark, text, want):
    r = product.parse_descriptions(spark.createDataFrame([(text,)], "t string"), "t").first()["product"]
    assert (r["fruit_name"], r["variety"], r["product_format"]["format_type"], r["product_format"]["size_mm"], r["classification"]["certification"], r["classification"]["is_iqf"]) == want


def test_repeats_are_dropped(spark):
    texts = ["a b c d e f a b c d e f", "x x x x x x x x", "", None, "A  b\tc", " ".join("red green blue".split() * 30)]

    def loop(text):
        words, seen, out = (text or "").lower().split(), set(), []
        for i, w in enumerate(words):
            run = tuple(words[i : i + 5])
            if run not in seen:
                out.append(w)
                seen.add(run)
        return " ".join(out)

    got = product.without_repeats(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()
    assert [r["clean_text"] for r in got] == [loop(t) for t in texts]


def test_repeats_are_found_by_hashes_and_told_apart_by_words(spark, monkeypatch):
    """runs are sorted by hash and place; where runs that differ share a hash, the result is the same."""
    texts = ["a b c d e f a b c d e f", "a b a b a b c a b", "c a b b a c a b b a c a", "a", "", None, "x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = [r["clean_text"] for r in product.without_repeats(df, "t").orderBy("i").collect()]
    assert want[0] == "a b c d e f c d e f"
    for clashing in (lambda *w: F.lit(1).cast("bigint"), lambda *w: F.pmod(F.xxhash64(*w), F.lit(3))):
        monkeypatch.setattr(product, "run_hash", clashing)
        assert [r["clean_text"] for r in product.without_repeats(df, "t").orderBy("i").collect()] == want


def test_sizes_and_units(spark):
    assert values(spark, product.standard_size, ["10 X 20 mm", "abc"]) == ["10x20", "abc"]
    mt, price = product.unit_values(F.col("a"), F.col("b"))
    rows = spark.createDataFrame([(1000.0, 3000.0), (None, 3000.0), (0.0, 1.0), (2000.0, None)], "a double, b double").select(mt.alias("mt"), price.alias("p")).collect()
    assert [(r["mt"], r["p"]) for r in rows] == [(1.0, 3000.0), (0.0, 0.0), (0.0, 0.0), (2.0, 0.0)]


def test_company_names(spark):
    given = ["VIRÚ GROUP PERÚ S.A.", "VIRU S.A.", "CAMPOSOL S.A.", "SUNSHINE EXPORT S.A.C", "MEBOL SAC", "MEBOL GF S.A.C.", "D'ARTA", "FOOD FELLAS B.V.", "", None]
    clean = lambda c: names.brand_name(names.clean_company(c))
    assert values(spark, clean, given) == ["VIRU", "VIRU", "CAMPOSOL", "SUNSHINE EXPORT", "MEBOL", "MEBOL GF", "DARTA", "FOOD FELLAS", "", ""]
    core = lambda c: names.core_name(names.clean_company(c))
    assert values(spark, core, ["SOCIEDAD AGRICOLA VIRU S.A.", "AGRANA FRUIT MEXICO S.A. DE C.V.", "PERUVIAN IMPORT CO INC"]) == ["VIRU", "AGRANA FRUIT", "PERUVIAN IMPORT"]
    assert values(spark, names.repair_encoding, ["NATURE?S", "DA??X"]) == ["NATURE'S", "DAX"]
    assert values(spark, names.full_unaccent, ["ÅÉñ", None]) == ["AEn", None] and values(spark, names.unaccent, ["ÅÉñ"]) == ["AEn"]
    assert values(spark, names.rule_clean_importer, ["Foo Bar GmbH", "A.B. Co, Ltd."]) == ["FOO BAR", "AB CO"]
    assert values(spark, names.is_valid_name, ["x", " ", "n/a", None]) == [True, False, False, False]


def test_name_ratios():
    assert names.ratio("abcd", "abcd") == 100 and names.ratio("", "") == 100 and names.ratio("ab", "cd") == 0
    assert names.token_sort_ratio("B A", "A B") == 100 and names.token_set_ratio("A B C", "A B") == 100


def test_clusters(spark):
    rows = [("NATURES TOUCH S.A.", 5), ("NATURE TOUCH SAC", 3), ("FOOD FELLAS BV", 4), ("FOODFELLAS", 2), ("VIRU S.A.", 7), ("VIRÚ PERU SAC", 1), ("ALPHA FRUITS", 1)]
    found = clusters.cluster_names(spark.createDataFrame(rows, "name string, n bigint"))
    got = {r["canonical_name"]: (sorted(r["aliases"]), r["count"]) for r in found.collect()}
    assert got["VIRU"] == (["VIRU S.A.", "VIRÚ PERU SAC"], 8) and got["FOOD FELLAS"][1] == 6 and got["NATURES TOUCH"][1] == 8 and "ALPHA FRUITS" in got
    stats = clusters.cluster_stats(found).first()
    assert (stats["names"], stats["clusters"], stats["merged"]) == (7, 4, 3)
    df = spark.createDataFrame([("VIRU S.A.",), ("viru s.a",), ("Other Ltd",), ("",), (None,)], "exporter string")
    named = {r["exporter"]: r["canonical_exporter"] for r in clusters.canonical_names(df, found, "exporter").collect()}
    assert named == {"VIRU S.A.": "VIRU", "viru s.a": "VIRU", "Other Ltd": "OTHER", "": "", None: None}
    unknown = clusters.canonical_names(df, found, "exporter", F.lit("Unknown")).where("exporter = ''").first()
    assert unknown["canonical_exporter"] == "Unknown"
    audit = clusters.name_variations(clusters.canonical_names(df, found, "exporter"), "exporter").where("canonical_exporter = 'VIRU'").first()
    assert (audit["records"], audit["variations"]) == (2, 2)


def test_quality_predicates(spark):
    air = [r["x"] for r in make(spark, [{"via": "FAIRWAY"}, {"via": None}, {"via": "Aéreo"}]).select(quality.is_air().alias("x")).collect()]
    assert air == [True, False, True]
    sample = [{"fob_usd": 0.0}, {"fob_usd": 9.99}, {"net_weight_mt": 0.0099}, {"description": "muestra sin costo"}, {"description": None, "net_weight_mt": None, "fob_usd": None}]
    assert [r["x"] for r in make(spark, sample).select(quality.is_sample().alias("x")).collect()] == [False, True, True, True, False]
    assert [r["x"] for r in make(spark, [{"net_weight_mt": 0.1}, {"net_weight_mt": None}]).select(quality.is_small().alias("x")).collect()] == [False, True]
    floor = [{"usd_per_mt": 1500.0}, {"usd_per_mt": 1499.99}, {"fruit_name": None, "usd_per_mt": 499.0}, {"fruit_name": None, "usd_per_mt": 500.0}, {"usd_per_mt": None}, {"usd_per_mt": 0.0, "fruit_name": "kiwi"}]
    assert [r["x"] for r in make(spark, floor).select(quality.below_floor().alias("x")).collect()] == [False, True, True, False, True, True]


def test_outlier_rules(spark):
    prices = [1000.0, 1100.0, 1200.0, 1300.0, 5000.0]
    df = make(spark, [{"usd_per_mt": p, "fruit_name": "kiwi"} for p in prices] + [{"usd_per_mt": 700.0, "fruit_name": None}])
    b = quality.iqr_bounds(df).first()
    assert (b["q1"], b["q3"], b["lower"], b["upper"]) == (1100, 1300, 800, 1600)
    flags = quality.outliers(df.where("fruit_name = 'kiwi'"), ["fruit_name"]).where("iqr_outlier").collect()
    assert [r["usd_per_mt"] for r in flags] == [5000] and not flags[0]["z_outlier"] and not flags[0]["both_outlier"]
    assert quality.outliers(make(spark, [{"usd_per_mt": p} for p in (1.0, 1.0, 900.0)]), ["fruit_name"]).where("iqr_outlier or z_outlier").isEmpty()
    many = make(spark, [{"usd_per_mt": 1000.0 + k} for k in range(20)] + [{"usd_per_mt": 90000.0}])
    assert quality.outlier_counts(many, ["fruit_name"]).first()["both_outliers"] == 1


def test_cascade_and_flag_differ(spark):
    rows = [{"usd_per_mt": p, "fruit_name": "kiwi"} for p in (1000.0, 1100.0, 1200.0, 1300.0, 1650.0)] + [{"usd_per_mt": 0.0, "fruit_name": "kiwi"}] * 3 + [{"usd_per_mt": 800.0, "fruit_name": None}]
    df = make(spark, rows)
    kept = sorted(r["usd_per_mt"] for r in quality.cascade_filter(df).collect())
    flagged = sorted(r["usd_per_mt"] for r in quality.validity_flag(df).where("analysis_valid = 1").collect())
    assert kept == [800, 1000, 1100, 1200, 1300] and flagged == [800, 1000, 1100, 1200, 1300, 1650]
    assert quality.cascade_filter(df, iqr=False).count() == 6
    assert quality.clean_view(df, dt.date(2025, 1, 1), dt.date(2025, 1, 1)).count() == 6


def test_worked_figures(spark):
    df = make(spark, [{"usd_per_mt": p} for p in (1.0, 2.0, 3.0, 10.0)])
    r = pricing.quartile_summary(df, "fruit").first()
    assert (r["low_price"], r["mid_price"], r["high_price"]) == (1.75, 2.5, 4.75)
    shares = make(spark, [{"exporter": e, "net_weight_mt": w} for e, w in (("a", 50.0), ("b", 30.0), ("c", 20.0))])
    assert market.hhi(shares, ["fruit_name"], "exporter").first()["hhi"] == 3800
    w = pricing.weighted_stats(make(spark, [{"usd_per_mt": 1000.0, "net_weight_mt": 1.0}, {"usd_per_mt": 2000.0, "net_weight_mt": 3.0}]), ["fruit_name"]).first()
    assert (w["weighted_mean"], round(w["weighted_std"], 2), round(w["cv_pct"], 2)) == (1750, 433.01, 24.74)
    four = make(spark, [{"exporter": e, "net_weight_mt": v} for e, v in (("a", 50.0), ("b", 30.0), ("c", 15.0), ("d", 5.0))])
    assert {r["name"]: r["bucket"] for r in market.others_bucketing(four, "exporter").collect()} == {"a": "a", "b": "b", "c": "c", "d": "Others"}
    assert pricing.drill_down(df, "fruit", "none", "exporter").isEmpty()
    whole = pricing.in_whole_units(pricing.quartile_summary(df, "fruit")).first()
    assert (whole["mid_price"], whole["low_price"]) == (2, 2)


def test_ranking_properties(spark, sf):
    s = readers.shipments(spark, sf)
    top = market.top_n(s, "exporter", "value", 1000).collect()
    assert math.isclose(sum(r["share_pct"] for r in top), 100, abs_tol=0.01) and math.isclose(top[-1]["cumulative_pct"], 100, abs_tol=0.01)
    assert all(0 < r["hhi"] <= 10000 for r in market.hhi(s, ["country"], "importer").collect())
    edges = flows.supply_chain(s).groupBy("level").agg(F.sum("value").alias("v")).collect()
    total = s.agg(F.sum("net_weight_mt")).first()[0]
    assert len(edges) == 3 and all(math.isclose(r["v"], total, rel_tol=1e-6) for r in edges)
    assert quality.cascade_filter(s).count() <= quality.cascade_filter(s, iqr=False).count() <= s.count()
    assert flows.mermaid(flows.country_flows(s, "NATION_1"), "to one").startswith("---\ntitle: to one\n---\nsankey-beta\n")


def test_growth_from_zero_is_null(spark):
    rows = [{"date": dt.date(2025, m, 1), "net_weight_mt": v} for m, v in ((1, 0.0), (2, 5.0), (3, 10.0))]
    got = market.time_series(make(spark, rows)).orderBy("period").collect()
    assert [r["growth_pct"] for r in got] == [None, None, 100.0] and [r["ma3"] for r in got] == [None, None, 5.0]
    assert market.trend(make(spark, rows)).first()["direction"] is None


def test_relative_dates():
    today = dt.date(2025, 5, 20)
    want = {"qtd": dt.date(2025, 4, 1), "q3_2024": dt.date(2024, 7, 1), "last_30_days": dt.date(2025, 4, 20), "nonsense": None, "mtd": dt.date(2025, 5, 1), "ytd": dt.date(2025, 1, 1), "yesterday": dt.date(2025, 5, 19), "2024-02-03T10:00": dt.date(2024, 2, 3), "2024-13-01": None}
    assert {k: dates.relative_date(k, today) for k in want} == want


def test_places(spark):
    assert values(spark, places.english_country, ["alemania", "PERÚ", "CHIPRE", None]) == ["Germany", "Peru", "CHIPRE", None]
    assert values(spark, places.region, ["Germany", "CHIPRE", None]) == ["Europe", "Rest of World", "Rest of World"]
    assert [places.spanish_country(x) for x in ("Germany", "uk", "spain", "Nowhere")] == ["ALEMANIA", "REINO UNIDO", "ESPAÑA", "NOWHERE"]
    assert places.country_parameter("alemania") == "ALEMANIA" and places.neighbour_edges(spark).where("country = 'Spain'").count() == 2


def test_sources_and_sinks(spark, tmp_path):
    df = make(spark, [{"exporter": "a"}, {"exporter": "b", "fruit_name": None}]).select("exporter", "fruit_name", "usd_per_mt").withColumn("records", F.lit(1))
    for name in ("x.csv", "x.csv.gz", "x.parquet"):
        sinks.write_by_suffix(df, str(tmp_path / name))
        assert readers.read_shipments(spark, str(tmp_path / name)).count() == 2
    sinks.write_result(df, str(tmp_path / "r.csv"))
    assert "records" not in readers.read_csv(spark, str(tmp_path / "r.csv")).columns
    sinks.write_partitioned(df, str(tmp_path / "p"), "exporter")
    assert {p.name for p in (tmp_path / "p").glob("exporter=*")} == {"exporter=a", "exporter=b"}
    sinks.write_json(df, str(tmp_path / "j"), "exporter")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    pd.DataFrame({"a": ["1", "x", "2.5"]}).to_csv(tmp_path / "n.csv", index=False)
    assert readers.read_numeric_csv(spark, str(tmp_path / "n.csv"), ["a"]).agg(F.sum("a")).first()[0] == 3.5
    (tmp_path / "c.json").write_text(json.dumps([{"canonical_name": "A", "aliases": ["A", "A1"], "count": 3}]))
    assert readers.read_clusters(spark, str(tmp_path / "c.json")).first()["aliases"] == ["A", "A1"]
    assert readers.run_sql(spark, "SELECT count(*) AS n FROM {df} WHERE exporter = :e", {"e": "a"}, df=df).first()["n"] == 1
    with pytest.raises(ValueError):
        schema.check_columns(["Date"])
    with pytest.raises(ValueError):
        readers.read_shipments(spark, "a/b.xyz")
    assert len(schema.RAW_COLUMNS) == 33


def test_upkeep(spark):
    df = make(spark, [{"exporter": "a"}, {"exporter": "b"}])
    assert "new" in sinks.add_missing_column(df, "new").columns and sinks.add_missing_column(df, "via") is df
    changed = sinks.update_where(df, "importer", F.col("exporter") == "a", F.lit("Z"))
    assert {(r["exporter"], r["importer"]) for r in changed.collect()} == {("a", "Z"), ("b", "I")}
    mapping = spark.createDataFrame([("b", "B2")], "exporter string, to string")
    assert {r["exporter"] for r in sinks.update_by_key(df, mapping, "exporter", "exporter", "to").collect()} == {"a", "B2"}


def test_ingestion(spark):
    row = {n: None for n, _ in schema.RAW_COLUMNS} | {"HTS Code": "0811909100", "Date": dt.date(2025, 1, 2), "Exporter": "VIRU S.A.", "Net kg": 20000.0, "U$ FOB Tot": 40000.0, "Commercial Description": "MANGO CHUNKS IQF", "Destination Country": "ALEMANIA"}
    frozen = spark.createDataFrame([tuple(row[n] for n, _ in schema.RAW_COLUMNS)], schema.RAW_SCHEMA)
    aseptic = frozen.withColumn("HTS Code", F.lit("2008991000")).withColumn("Date", F.lit(dt.date(2025, 2, 2)))
    both, wrong = product.combine_sources(frozen, aseptic)
    assert wrong == {"frozen": 0, "aseptic": 0}
    out = product.enrich(both).orderBy("Date").collect()
    assert [(r["fruit_name"], r["format_type"], r["net_weight_mt"], r["usd_per_mt"], r["region"], r["data_source"], r["is_iqf"]) for r in out] == [("mango", "chunks", 20.0, 2000.0, "Europe", "frozen", True), ("mango", "chunks", 20.0, 2000.0, "Europe", "aseptic", False)]


def test_api(spark, sf):
    api = Shipments(readers.shipments(spark, sf).cache(), today=dt.date(1998, 12, 31))
    assert api.summary("fruit") == api.summary("fruit") and api.cache.stats()["hits"] == 1
    assert api.drill("fruit", "ECONOMY", "exporter", limit=3) and api.search("000001") and api.values("certification")
    assert api.fuzzy("supplier#000000003") == ["Supplier#000000003"]
    found = api.detail(5, exporter_like="supplier#000000003", first="ytd", last="today", country="NATION_1")
    assert found["shipments"] == len(found["rows"]) <= 5 and "error" in api.detail(exporter_like="qqqqqq")
    board = api.dashboard("ytd", "today")
    assert len(board["top_products"]) == 5 and board["shipments"] > 0
    assert api.top("country", "value", 3, fruit="small")[0]["rank"] == 1 and api.series("price", "weekly", country="nation_1")
    assert "sankey-beta" in api.sankey(top=5)


def test_cli(sf, capsys, spark, tmp_path):
    assert cli.main(["--data", sf, "summary", "fruit", "--limit", "2"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 3
    assert cli.main(["--data", sf, "drill", "ECONOMY", "--by", "format", "--output", str(tmp_path / "o.txt")]) == 0
    assert cli.main(["--data", sf, "export", "exporter", str(tmp_path / "e.csv")]) == 0
    assert "low_price" in (tmp_path / "o.txt").read_text() and (tmp_path / "e.csv").exists()


def test_cache():
    now = [0.0]
    cache = TtlCache(10, lambda: now[0])
    assert cache.get_or_compute("a", lambda x: [x], x=1) == [1] and cache.get(cache.key("a", x=1)) == [1]
    now[0] = 11
    assert cache.get(cache.key("a", x=1)) is None
    cache.set("b:1", 2)
    assert cache.invalidate("b") == 1 and cache.stats()["entries"] == 0


def test_streaming_equals_batch(spark, sf, tmp_path):
    folder = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").coalesce(1).write.parquet(folder)
    events.run_to_table(events.tumbling(events.read_events(spark, folder)), "windows", str(tmp_path / "ck"), "complete")
    batch = events.tumbling(spark.read.parquet(f"{sf}/events.parquet"))
    assert sorted(spark.table("windows").collect()) == sorted(batch.collect())
    assert events.sessions(spark.read.parquet(f"{sf}/events.parquet")).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and len(__spark_entry__.queries()) >= 80


def test_plain_search_before_patterns_changes_no_product(spark):
    odd = ["MANGOS", "İQF Dſ", "freſa org", "PLATANOS b  & P 10x20", "PLÁTANO PURÉ var: kent", "tommy atkins Kent", "mangofoo MangoX", "dragon fruit camu-camu ASÉPTICO", "", "bıts and pieces pıña organico", "Kent Keitt IQF", "UVAS Enteras Convencional"]
    df = spark.createDataFrame([(t,) for t in odd], "t string").withColumn("low", product.folded(F.col("t")))
    rows = df.select(product.product(F.col("t")).alias("plain"), product.product(F.col("t"), F.col("low")).alias("guarded")).collect()
    assert all(r["plain"] == r["guarded"] for r in rows) and len({r["plain"]["fruit_name"] for r in rows}) > 5
