"""Changes in place, their checks and their recovery; kept rollups; named files."""

from __future__ import annotations

import csv
import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cargolens.api import Shipments
from cargolens.operators import pricing as R
from cargolens.operators import rollup as rollups
from cargolens.operators.rollup import KEYS, SUMS, Rollup, states
from cargolens.sources import readers
from cargolens.sources.readers import shipments
from cargolens.sources.store import CheckFailed, Store, summed, write_split
from cargolens.streaming.rollups import follow

ROWS = [(1, "a", 5.0, "x"), (2, "b", None, "x"), (3, "a", 7.0, "y"), (4, None, 1.0, "z"), (5, "c", 2.0, None), (6, "Ünï", 2.0, "w w/=%")]


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark.createDataFrame(ROWS, "id int, name string, v double, p string"), str(tmp_path / "t"), "p")


def files_of(store):
    return {str(f.parent.name): {x.name for x in f.parent.glob("*.parquet")} for f in Path(store.path).glob("p=*/*.parquet")}


def rows_of(store):
    return sorted((tuple(r) for r in store.read().collect()), key=str)


def test_only_touched_partitions_are_written(spark, store):
    before = files_of(store)
    assert len(before) == 5 and rows_of(store) == sorted(ROWS, key=str)
    assert store.update_where("v", F.col("name") == "a", F.col("v") * 2) == {"rows": 3, "changed": 2}
    after = files_of(store)
    assert {k for k in before if before[k] != after[k]} == {"p=x", "p=y"}
    assert {r[0]: r[2] for r in rows_of(store)} == {1: 10.0, 2: None, 3: 14.0, 4: 1.0, 5: 2.0, 6: 2.0}
    assert store.update_where("v", F.col("id") > 100, F.lit(0.0)) == {"rows": 0, "changed": 0} and files_of(store) == after
    with pytest.raises(ValueError, match="partition"):
        store.update_where("p", F.lit(True), F.lit("q"))
    with pytest.raises(ValueError, match="already"):
        Store.create(store.read(), store.path, "p")


def test_updates_by_key(spark, store):
    before = files_of(store)
    mapping = spark.createDataFrame([("a", "A1"), ("c", "C1"), ("c2", "x"), (None, "no"), ("b", None)], "name string, to string")
    assert store.update_by_key(mapping, "name", "name", "to") == {"rows": 4, "changed": 3}
    assert {r[0]: r[1] for r in rows_of(store)} == {1: "A1", 2: "b", 3: "A1", 4: None, 5: "C1", 6: "Ünï"}
    assert {k for k, v in files_of(store).items() if before[k] != v} == {"p=x", "p=y", "p=__HIVE_DEFAULT_PARTITION__"}
    with pytest.raises(ValueError, match="twice"):
        store.update_by_key(mapping.unionByName(mapping), "name", "name", "to")


def test_upper_case_is_checked_in_the_pass_that_writes(spark, store):
    assert store.upper("name") == {"rows": 5, "changed": 5, "left": 0}
    assert {r[1] for r in rows_of(store)} == {"A", "B", None, "C", "ÜNÏ"}
    assert store.upper("name")["changed"] == 0


def test_a_failed_check_leaves_the_table(spark, store):
    before, rows = files_of(store), rows_of(store)
    with pytest.raises(CheckFailed, match="lost"):
        store.update_where("v", F.lit(True), F.lit(None), {"lost": (F.count_if(F.col("v").isNull()), lambda n: n == 0)})
    assert files_of(store) == before and rows_of(store) == rows and not list(Path(store.path).glob("_staged/*"))


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_a_change_that_was_cut_off_is_completed(spark, store, moved):
    """The journal stands, some folders are in place, the others still staged."""
    staged = f"{store.path}/_staged/one"
    new = store.read().withColumn("v", F.lit(99.0))
    new.where("p in ('x', 'y')").write.partitionBy("p").parquet(staged)
    store.files.write(f"{store.path}/_journal", json.dumps({"staged": staged, "moves": ["p=x", "p=y"], "mark": "m"}))
    for name in ["p=x", "p=y"][:moved]:
        store.files.delete(f"{store.path}/{name}")
        store.files.rename(f"{staged}/{name}", f"{store.path}/{name}")
    again = Store(spark, store.path)
    assert {r[0]: r[2] for r in rows_of(again)} == {1: 99.0, 2: 99.0, 3: 99.0, 4: 1.0, 5: 2.0, 6: 2.0} and again.marks() == ["m"]


def test_merges_count_once(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, "k string, p string, n bigint")
    store = Store.create(made([("a", "x", 1), (None, "x", 2), ("a", "y", 3)]), str(tmp_path / "m"), "p")
    assert store.merge(made([("a", "x", 10), (None, "x", 20), ("b", "z", 5)]), ["k", "p"], ["n"], "day1")["rows"] == 3
    assert store.merge(made([("a", "x", 10)]), ["k", "p"], ["n"], "day1") is None
    assert sorted(map(tuple, store.read().select("k", "p", "n").collect()), key=str) == [("a", "x", 11), ("a", "y", 3), ("b", "z", 5), (None, "x", 22)]


def test_rollup_of_increments_equals_the_queries(spark, sf, tmp_path):
    s = shipments(spark, sf)
    cut = [s.where(F.col("date") < dt.date(1994, 6, 10)), s.where(F.col("date").between(dt.date(1994, 6, 10), dt.date(1996, 2, 5))), s.where((F.col("date") > dt.date(1996, 2, 5)) | F.col("date").isNull())]
    kept = Rollup.create(spark, str(tmp_path / "r"), cut[0])
    before = {f.parent.name: f.name for f in Path(kept.store.path).glob("month=1992-*/*.parquet")}
    assert kept.add(cut[1], "two") and kept.add(cut[2], "three") and not kept.add(cut[1], "two")
    assert before == {f.parent.name: f.name for f in Path(kept.store.path).glob("month=1992-*/*.parquet")}
    pairs = [(kept.quartiles(d), R.quartile_summary(s, d)) for d in ("fruit", "exporter")]
    pairs += [(kept.quartiles("format", "Europe", {"fruit": "ECONOMY"}), R.drill_down(s, "fruit", "ECONOMY", "format", "Europe"))]
    pairs += [(getattr(kept, v)(), getattr(R, v)(s)) for v in ("exporter_products", "destination_products", "regional_exports", "monthly_exports")]
    for got, want in pairs:
        a, b = (sorted((tuple(round(x, 2) if isinstance(x, float) else x for x in r) for r in df.select(*want.columns).collect()), key=str) for df in (got, want))
        assert len(a) == len(b) > 0
        for x, y in zip(a, b, strict=True):
            assert all(p == q or isinstance(p, float) and abs(p - q) < 0.02 for p, q in zip(x, y, strict=True)), (x, y)


def test_rollup_keeps_odd_rows(spark, tmp_path):
    kinds = "fruit_name string, exporter string, importer string, format_type string, size_mm string, certification string, country string, region string, date date, net_weight_mt double, fob_usd double, usd_per_mt double"
    rows = [("f", None, "i", "o", "s", "c", "n", "Europe", None, None, 3.0, None), ("f", "e", "i", "o", "s", "c", "n", "Europe", dt.date(2024, 1, 2), 0.0, 1.0, 5.0)] * 2
    df = spark.createDataFrame(rows, kinds)
    kept = Rollup.create(spark, str(tmp_path / "r"), df.where("false"))
    assert kept.quartiles("fruit").isEmpty() and kept.add(df, "a")
    assert kept.store.read().select(*KEYS, *SUMS).count() == states(df).count() == 2 and kept.quartiles("fruit").isEmpty()
    assert sorted(r["shipments"] for r in kept.exporter_products().collect()) == [2, 2]


@pytest.mark.parametrize("suffix", [".csv", ".csv.gz"])
def test_named_files(spark, tmp_path, suffix):
    rows = [(k, ["MANGO", "Passion fruit/é", None][k % 3], "a,\"b\"\nc") for k in range(60)] + [(k, "BIG", "") for k in range(100, 200)]
    df = spark.createDataFrame(rows, "id int, fruit string, text string")
    for _ in range(2):
        told = write_split(df, str(tmp_path), "fruit", rows_per_file=40, suffix=suffix)
    names = {f.name for f in tmp_path.iterdir() if not f.name.startswith(".")}
    assert names == {n + suffix for n in ("mango", "passion_fruit_é", "unknown", "big-1", "big-2", "big-3")} and {Path(r["file"]).name for r in told.collect()} == names
    if suffix == ".csv":
        got = {n: list(csv.DictReader(open(tmp_path / n, newline=""), escapechar="\\")) for n in names}
        assert sorted(int(r["id"]) for n in names for r in got[n]) == sorted(r[0] for r in rows) and all(r["fruit"] == "MANGO" for r in got["mango.csv"])


def test_rollup_follows_a_stream(spark, sf, tmp_path):
    s = shipments(spark, sf).withColumn("half", (F.col("date") < dt.date(1995, 1, 1)).cast("int"))
    kept = Rollup.create(spark, str(tmp_path / "r"), s.where("false"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(s.drop("half").schema).parquet(str(tmp_path / "in"))
    for half in (1, 0):
        s.where(F.coalesce("half", F.lit(0)) == half).drop("half").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        follow(stream, kept, "days", str(tmp_path / "checkpoint"), all_there_is=True).awaitTermination()
    assert kept.store.marks() == ["days-000000000000", "days-000000000001"]
    want = {r["fruit"]: (r["records"], r["mid_price"]) for r in R.quartile_summary(s, "fruit").collect()}
    assert {r["fruit"]: (r["records"], r["mid_price"]) for r in kept.quartiles("fruit").collect()} == want
    asked = Shipments(s, rollup=kept)
    assert {r["fruit"]: (r["records"], r["mid_price"]) for r in asked.summary("fruit", limit=100)} == want
    assert [r["exporter"] for r in asked.drill("fruit", "ECONOMY", "exporter", limit=5)] == [r["exporter"] for r in Shipments(s).drill("fruit", "ECONOMY", "exporter", limit=5)]
    with pytest.raises(ValueError, match="clean"):
        Shipments(s, clean=True, rollup=kept)


def test_a_small_mapping_is_sent(spark, sf, tmp_path, monkeypatch):
    """F16: the table isn't shuffled to meet a small mapping, whatever the session's own threshold."""
    names = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_name").alias("name"), F.concat(F.lit("new "), "s_name").alias("to"))
    store, plans, replace = Store.create(names.select("name", F.lit("x").alias("p")), str(tmp_path / "t"), "p"), [], Store.replace
    monkeypatch.setattr(Store, "replace", lambda self, rows, *a: (plans.append(rows._jdf.queryExecution().sparkPlan().toString()), replace(self, rows, *a))[1])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert store.update_by_key(names, "name", "name", "to")["changed"] == names.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


@pytest.mark.parametrize("sent", [readers.SENT_BYTES, 0])
def test_sums_by_keys_equal_a_grouping(spark, monkeypatch, sent):
    """whether hashes that repeat are few or too many to be sent."""
    monkeypatch.setattr(readers, "SENT_BYTES", sent)
    keys = [("a", 1.0), ("a", 1.0), (None, 1.0), (None, 1.0), ("a", None), ("b", float("nan")), ("b", float("nan")), ("c", 0.0), ("c", -0.0), ("d", 2.0), (None, None)]
    df = spark.createDataFrame([(k, p, n, None if n == 3 else n / 2, n) for n, (k, p) in enumerate(keys)], "k string, p double, n bigint, v double, i int").repartition(3)
    told = lambda d: sorted((tuple(str(0.0 if x == 0 else x) for x in r) for r in d.collect()))
    got, want = summed(df, ["k", "p"], ["n", "v", "i"]), df.groupBy("k", "p").agg(*(F.sum(c).alias(c) for c in ("n", "v", "i")))
    assert told(got) == told(want) and len(told(want)) == 7 and got.dtypes == want.dtypes
    assert summed(df.where("false"), ["k", "p"], ["n"]).isEmpty()


def test_quartiles_of_small_groups_equal_those_by_shards(spark, sf, tmp_path, monkeypatch):
    """values are shuffled once where tasks can sort the groups."""
    kept = Rollup.create(spark, str(tmp_path / "r"), shipments(spark, sf))
    assert kept.add(shipments(spark, sf), "again")  # so that states count for two
    at_once = kept.quartiles("exporter", where={"fruit": "ECONOMY"})
    assert "_s#" not in at_once._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(rollups, "WHOLE", 0)
    by_counts = kept.quartiles("exporter", where={"fruit": "ECONOMY"})
    assert "_s#" in by_counts._jdf.queryExecution().optimizedPlan().toString()
    assert at_once.collect() == by_counts.collect() and at_once.count() > 0
