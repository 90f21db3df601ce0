"""Registered shipment queries without a DuckDB twin, row by row against plain Python."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cargolens.functions import names as N
from cargolens.plans import registry
from test_similar import clusters_by_hand

Q = registry.queries()


@pytest.fixture(scope="module")
def companies(spark, sf):
    """(c_custkey, name, cleaned, core, brand) of the companies that the queries read."""
    c = N.clean_company(F.col("name"))
    made = registry._companies(spark, sf).withColumn("cleaned", c)
    return made.select("c_custkey", "name", "cleaned", N.core_name(F.col("cleaned")).alias("core"), N.brand_name(F.col("cleaned")).alias("brand")).collect()


@pytest.fixture(scope="module")
def clusters(companies):
    counts = {}
    for r in companies:
        if r["name"].strip() and r["name"].strip().upper() not in N.INVALID:
            counts[r["name"]] = counts.get(r["name"], 0) + 1
    told = {r["name"]: r for r in companies}
    return clusters_by_hand([{**told[n].asDict(), "n": k} for n, k in counts.items()])


def test_cluster_names(spark, sf, clusters):
    got = sorted((r["canonical_name"], list(r["aliases"]), r["count"]) for r in Q["cluster_names"](spark, sf).collect())
    assert got == clusters and len(got) > 5


def test_cluster_stats(spark, sf, clusters):
    sizes = [len(a) for _, a, _ in clusters]
    got = Q["cluster_stats"](spark, sf).first()
    assert (got["names"], got["clusters"], got["merged"], got["largest"]) == (sum(sizes), len(sizes), sum(s > 1 for s in sizes), max(sizes))
    assert got["reduction_pct"] == pytest.approx(100 * (1 - len(sizes) / sum(sizes)), abs=1e-3)


def test_canonical_names(spark, sf, companies, clusters):
    exact = {}
    for canonical, aliases, _ in clusters:
        for a in aliases:
            exact[a] = min(exact.get(a, canonical.upper()), canonical.upper())
    got = {r["c_custkey"]: r["canonical_name"] for r in Q["canonical_names"](spark, sf).collect()}
    assert got == {r["c_custkey"]: exact.get(r["name"], r["cleaned"].upper()) for r in companies}


def test_fuzzy_search(spark, sf):
    term = "suplier#00000012"
    names = [r["s_name"] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_name").distinct().collect()]
    score = lambda n: 2 if n.lower() == term else 1 if term in n.lower() else SequenceMatcher(None, term, n.lower()).ratio()
    want = sorted(((-score(n), n) for n in names if score(n) >= 0.6))[:10]
    assert [(r["name"], r["score"]) for r in Q["fuzzy_search"](spark, sf).collect()] == [(n, pytest.approx(min(1, -s), abs=1e-4)) for s, n in want]


def test_full_unaccent(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
    assert {r["doc_id"]: r["plain"] for r in Q["full_unaccent"](spark, sf).collect()} == {i: plain(t) for i, t in texts.items()}


def test_names_are_dealt_to_all_tasks(spark, sf):
    """A table in one split isn't cleaned by one task."""
    assert registry._companies(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
