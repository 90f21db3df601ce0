"""Plans: what is shuffled, and how often."""

from __future__ import annotations

from cargolens.operators import rollup
from cargolens.plans import registry
from cargolens.sources.readers import shipments


def test_lines_are_not_shuffled_by_buyer(spark, sf):
    """the lines' columns aren't among those that meet the customers."""
    plan = shipments(spark, sf)._jdf.queryExecution().optimizedPlan()
    tops = [plan]
    while tops:
        node = tops.pop()
        tops += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and "c_custkey" in node.condition().toString():
            assert "l_orderkey" not in node.output().mkString(",")
            return
    raise AssertionError("no join with the customers")


def test_an_increment_is_summed_once(spark, sf, monkeypatch):
    """merging sums an increment's rows; they aren't summed before. The view is read once for all increments."""
    seen, views = [], []
    merge, view = rollup.Store.merge, registry.shipments
    monkeypatch.setattr(rollup.Store, "merge", lambda self, rows, *a: (seen.append(rows._jdf.queryExecution().optimizedPlan().toString()), merge(self, rows, *a))[1])
    monkeypatch.setattr(registry, "shipments", lambda *a: (views.append(a), view(*a))[1])
    registry._rollup(spark, sf)
    assert len(seen) == 2 and len(views) == 1
    assert not any("Aggregate" in p or "Join" in p for p in seen)


def joins(df):
    """(condition, output) of each join of df's optimized plan."""
    tops = [df._jdf.queryExecution().optimizedPlan()]
    while tops:
        node = tops.pop()
        tops += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            yield node.condition().toString(), node.output().mkString(",")


def test_states_with_keys_of_their_own_are_not_shuffled(spark, sf, monkeypatch):
    """what is grouped whole, when an increment is summed, are rows whose keys may repeat."""
    plans, replace = [], rollup.Store.replace
    monkeypatch.setattr(rollup.Store, "replace", lambda self, rows, *a, **b: (plans.append(rows._jdf.queryExecution().optimizedPlan()), replace(self, rows, *a, **b))[1])
    registry._rollup(spark, sf)
    assert len(plans) == 3
    for tops in map(lambda p: [p], plans):
        grouped = []
        while tops:
            node = tops.pop()
            tops += [node.children().apply(i) for i in range(node.children().size())]
            grouped += [node.toString()] if node.nodeName() == "Aggregate" else []
        assert len(grouped) == 1 and "LeftSemi" in grouped[0]


def test_few_suppliers_are_sent(spark, sf):
    """the lines aren't shuffled by supplier, whatever the session's own threshold."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shipments(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert any("BroadcastHashJoin" in line and "s_suppkey" in line for line in plan.splitlines())


def test_lines_meet_the_wanted_exporters_first(spark, sf):
    """only the lines of the exporters that are asked for meet products and orders."""
    for name, key, kept in (("detail_by_exporter", "p_partkey", "s_name"), ("drill_exporter_by_fruit", "p_partkey", "s_name"), ("detail_by_destination", "p_partkey", "n_name")):
        df = shipments(spark, sf, registry.FIRST[name])
        assert [kept in output for condition, output in joins(df) if key in condition] == [True], name
