"""Quantiles and ranks that are dealt over shards, against plain ones; flows from one pass; look-ups and settings."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens import config
from cargolens.functions import product as P
from cargolens.functions.places import names_of_country
from cargolens.operators import clusters as C
from cargolens.operators import flows as W
from cargolens.operators import market as M
from cargolens.operators import order as O
from cargolens.operators import quality as Q
from cargolens.plans import registry

QS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


@pytest.fixture(scope="module")
def priced(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["x", "y", None]), rnd.choice([None, 0.0, -3.5, 1e-9, 7.0, 7.0, rnd.uniform(-100, 1e6), rnd.uniform(0, 10)])) for _ in range(3000)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 4.0), ("none", None)] + [("same", 2.5)] * 50
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(5)


def test_quantiles_are_exact(priced):
    rows, df = priced
    got = {r["k"]: [r[q] for q in QS] for r in O.exact_quantiles(df, ["k"], "v", QS).collect()}
    want = {k: list(np.quantile([v for kk, v in rows if kk == k and v is not None], list(QS.values()))) for k in {"x", "y", None, "one", "two", "same"}}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)
    whole = O.exact_quantiles(df, [], "v", QS).first()
    assert [whole[q] for q in QS] == pytest.approx(list(np.quantile([v for _, v in rows if v is not None], list(QS.values()))), rel=1e-12)
    assert O.exact_quantiles(df.where("false"), ["k"], "v", QS).isEmpty()


@pytest.mark.parametrize("whole", [0, 40, 100, 1 << 17])
def test_quantiles_of_small_and_large_groups(priced, monkeypatch, whole):
    """groups of up to WHOLE values are sorted whole, larger ones by shards, each group by one of both."""
    rows, df = priced
    monkeypatch.setattr(O, "WHOLE", whole)
    got = [(r["k"], [r[q] for q in QS]) for r in O.exact_quantiles(df, ["k"], "v", QS).collect()]
    want = {k: list(np.quantile([v for kk, v in rows if kk == k and v is not None], list(QS.values()))) for k in {"x", "y", None, "one", "two", "same"}}
    assert sorted(str(k) for k, _ in got) == sorted(str(k) for k in want)
    for k, values in got:
        assert values == pytest.approx(want[k], rel=1e-12)


def test_small_groups_are_shuffled_once(priced, monkeypatch):
    """one shuffle for groups that a task can sort. F20: it deals the rows to more tasks as they get more."""
    _, df = priced
    monkeypatch.setattr(O, "SHARE", 100)
    plan = O.exact_quantiles(df, ["k"], "v", QS)._jdf.queryExecution().executedPlan().toString()
    valued = df.where("v is not null").count()
    assert plan.count("hashpartitioning(") == 1 and f", {-(-valued // 100)})" in plan


def test_exporter_summary_deals_rows_by_their_number(spark, sf, monkeypatch):
    """what a task holds of the sums doesn't grow with the table."""
    monkeypatch.setattr(O, "SHARE", 100)
    plan = registry.queries()["exporter_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(fruit_name" in line and "format_type" in line]
    assert any(f", {-(-n // 100)})" in line for line in dealt), plan


def test_groups_without_values_keep_their_row(priced):
    _, df = priced
    out = {r["k"]: r["m"] for r in O.with_quantiles(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), df, ["k"], "v", {"m": 0.5}).collect()}
    assert out["none"] is None and out["two"] == 2.5 and len(out) == 7


def test_shards_keep_the_order(spark):
    rnd = random.Random(2)
    values = sorted([0.0, -0.0, 1e-300, -1e300, 1e300, *(rnd.uniform(-1, 1) * 10 ** rnd.randint(-6, 9) for _ in range(500))])
    shards = [r["s"] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(O.shard_of(F.col("v")).alias("s")).collect()]
    assert shards == sorted(shards)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_ranks_and_running_sums(spark, group):
    rnd = random.Random(3)
    rows = [(rnd.choice(["p", "q", None]), f"n{k:04d}", round(rnd.choice([0.0, 5.0, rnd.uniform(0, 9000)]), 2)) for k in range(800)] + [("p", None, 3.0)]
    got = O.ranked(spark.createDataFrame(rows, "g string, name string, total double").repartition(7), group).collect()
    for g in {r[0] for r in rows} if group else {0}:
        own = sorted((r for r in rows if not group or r[0] == g), key=lambda r: (-r[2], r[1] or ""))
        found = sorted((r for r in got if not group or r["g"] == g), key=lambda r: r["rank"])
        assert [(r["name"], r["rank"]) for r in found] == [(r[1], k) for k, r in enumerate(own, 1)]
        assert [r["run"] for r in found] == pytest.approx(list(np.cumsum([r[2] for r in own])), abs=0.005)
        assert {r["n"] for r in found} == {len(own)} and found[0]["all"] == pytest.approx(sum(r[2] for r in own), abs=0.005)


SHIPPED = "exporter string, fruit_name string, importer string, country string, net_weight_mt double"


def bucket(totals, share, label):
    order = sorted(totals, key=lambda n: (-round(totals[n], 2), n or ""))
    run, keep = 0.0, {}
    for n in order:
        run += round(totals[n], 2)
        keep[n] = run / sum(round(t, 2) for t in totals.values()) <= 1 - share
    if sum(keep.values()) < 3:
        keep = {n: k < max(3, int(len(order) * 0.8)) for k, n in enumerate(order)}
    return {n: n if keep[n] else label for n in totals}


@pytest.mark.parametrize("fruits", [1, 3])
def test_supply_chain_by_loop(spark, fruits):
    rnd = random.Random(fruits)
    rows = [(f"e{rnd.randint(0, 12)}", f"f{rnd.randrange(fruits)}", rnd.choice([None, "i1", "i2", "i3", "i4"]), f"c{rnd.randint(0, 5)}", float(rnd.randint(1, 50))) for _ in range(300)]
    sums = [{}, {}, {}]
    for e, _, i, c, t in rows:
        for d, n in zip(sums, (e, i, c), strict=True):
            d[n] = d.get(n, 0) + t
    be, bi, bc = (bucket(d, 0.2, label) for d, label in zip(sums, ("Other Exporters", "Other Importers", "Other Countries"), strict=True))
    want = {}
    for e, f, i, c, t in rows:
        path = [be[e], *([f] if fruits > 1 else []), bi[i], bc[c]]
        for level, ends in enumerate(zip(path, path[1:], strict=False)):
            want[level, *ends] = want.get((level, *ends), 0) + t
    got = W.supply_chain(spark.createDataFrame(rows, SHIPPED))
    assert {(r["level"], r["source"], r["target"]): r["value"] for r in got.collect()} == {k: round(v, 2) for k, v in want.items()}
    text = W.mermaid(got, "T", most=2)
    assert text.count(",") == 4 and "the 2 largest flows" in text and "largest" not in W.mermaid(got)


def test_names_by_either_language(spark):
    assert "ALEMANIA" in names_of_country("Germany") and "Germany" in [n.title() for n in names_of_country("ALEMANIA")]
    df = spark.createDataFrame([("GERMANY",), ("ALEMANIA",), ("FRANCE",)], "country string")
    assert M.predicates(df, destination="Germany").count() == M.predicates(df, destination="alemania").count() == 2


def test_best_match_of_each_term(spark):
    rows = [("ACME FOODS", "mango", "FR", "2024-05-01", 2.0), ("ACME FOODS", "mango", "DE", "2023-01-01", 3.0), ("BETA FRUIT", "kiwi", "FR", "2024-06-01", 4.0), (None, "kiwi", "FR", "2024-06-01", 1.0)]
    df = spark.createDataFrame(rows, "exporter string, fruit_name string, country string, d string, net_weight_mt double").selectExpr("*", "to_date(d) AS date", "10.0D AS fob_usd", "5.0D AS usd_per_mt")
    import datetime as dt

    got = M.compare_exporters(df, ["acme food", "beta fruit", "zzzz"], months=6, today=dt.date(2024, 7, 1)).collect()
    assert [(r["spec"], r["shipments"], r["total_mt"]) for r in got] == [("exporter=BETA FRUIT", 1, 4.0), ("exporter=ACME FOODS", 1, 2.0)]
    assert M.compare_exporters(df, ["acme food"]).first()["total_mt"] == 5.0


def test_look_ups(spark):
    clusters = spark.createDataFrame([("Acme", ["ACME SA", "ACME S.A."], 5), ("Beta", ["BETA"], 2)], "canonical_name string, aliases array<string>, count bigint")
    assert [(r["alias"], r["aliases"]) for r in C.variations(clusters, "ACME").orderBy("alias").collect()] == [("ACME S.A.", 2), ("ACME SA", 2)]
    assert [r["canonical_name"] for r in C.canonical_list(clusters).collect()] == ["Acme", "Beta"]
    assert sorted(map(tuple, C.cluster_sizes(clusters).collect())) == [(1, 1, 1), (2, 1, 2)]
    names = spark.createDataFrame([("ACME SA",), ("nobody",)], "name string")
    assert {r["name"]: r["canonical_name"] for r in C.look_up(clusters, names).collect()} == {"ACME SA": "Acme", "nobody": None}
    with pytest.raises(RuntimeError):
        C.look_up(None, names)


def test_outliers_keep_every_row(spark):
    rows = [("a", float(v)) for v in [10] * 20 + [10000]] + [(None, 1.0), ("b", None)]
    out = Q.outliers(spark.createDataFrame(rows, "fruit_name string, usd_per_mt double"), ["fruit_name"])
    assert out.count() == len(rows) and [r["usd_per_mt"] for r in out.where("both_outlier").collect()] == [10000.0]


def test_missing_stays_missing(spark):
    mt, price = P.model_unit_values(F.col("kg"), F.col("fob"))
    rows = spark.createDataFrame([(2000.0, 50.0), (None, 50.0), (2000.0, None), (0.0, 1.0)], "kg double, fob double").select(mt, price).collect()
    assert list(map(tuple, rows)) == [(2.0, 25.0), (None, None), (2.0, None), (0.0, None)]


def test_settings(tmp_path):
    path = tmp_path / "run.json"
    path.write_text(json.dumps({"pipeline": {"inputs": {"raw": "in/a.csv", "far": "hdfs://x/y"}, "outputs": {"out": "/abs/o"}, "processing": {"n": 3}}}))
    c = config.load_config(str(path))
    assert config.input_path(c, "raw") == str(tmp_path / "in/a.csv") and config.input_path(c, "far") == "hdfs://x/y" and config.output_path(c, "out") == "/abs/o"
    assert config.processing(c, "n") == 3 and config.processing(c, "m", 4) == 4
    with pytest.raises(KeyError):
        config.input_path(c, "none")
    path.write_text("{}")
    with pytest.raises(ValueError):
        config.load_config(str(path))


def test_equal_totals_are_parted(spark):
    rows = spark.range(100_000).select(F.format_string("n%07d", "id").alias("name"), F.lit(5.0).alias("total"))
    sizes = [r["count"] for r in O.in_ranges(rows, []).groupBy("_s").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 50_000
    got = O.ranked(rows).where("name in ('n0000000', 'n0050000', 'n0099999')").orderBy("rank").collect()
    assert [(r["rank"], r["run"], r["n"]) for r in got] == [(1, 5.0, 100_000), (50_001, 250_005.0, 100_000), (100_000, 500_000.0, 100_000)]


@pytest.mark.parametrize("name", ["pricing_by_exporter", "detail_stats", "master_totals", "recommended_ranges", "pivot_median", "outliers_fine", "supply_chain", "cascade_filter", "validity_flag"])
def test_the_view_is_read_once_or_twice(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") == 0 or name in ("cascade_filter", "validity_flag"), plan
    assert plan.count("/lineitem.parquet") <= 1 and plan.count("Relation [l_orderkey") <= 1
