"""Look-ups through grams against full scans; canonical names in increments; names and headings of outputs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cargolens.functions import names as N
from cargolens.operators import clusters as C
from cargolens.operators import lookup as L
from cargolens.operators import market as M
from cargolens.operators import pricing as R
from cargolens.operators import similar as S
from cargolens.operators.aliases import AliasTable
from cargolens.sources import readers, sinks


def score(term, name):
    low, other = term.lower(), name.lower()
    return 2.0 if low == other else 1.0 if low in other else SequenceMatcher(None, low, other).ratio()


@pytest.fixture(scope="module")
def names():
    rnd = random.Random(8)
    words = ["Acme", "Foods", "Supplier", "del", "Sur", "Ñandú", "aaa", "B", "Trading"]
    return sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", f" #{k}"]) for k in range(300)} | {"", "x", "ab", "Acme" * 20})


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.75, 0.9, 0.0, 1.0])
def test_matches_equal_the_full_scan(spark, names, threshold):
    index = L.gram_index(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), "name")
    terms = ["acme foods", "ACMEFOODS", "suplier tradng", "x", "ab", "", "ñandu", "acme"]
    got = sorted((r["k"], r["name"], round(r["score"], 9)) for r in L.matches(index, terms, threshold).collect())
    assert got == sorted((k, n, round(score(t, n), 9)) for k, t in enumerate(terms) for n in names if score(t, n) >= threshold)


def test_few_names_are_scored(spark, names):
    many = [f"{n} {k}" for n in names for k in range(5)]
    index = L.gram_index(spark.createDataFrame([(n,) for n in many], "name string"), "name")
    assert L.candidates(index, ["Ñandú Trading 3"], 0.8).count() < len(many) / 3


def test_terms_with_two_wrong_letters(spark, sf):
    s = readers.shipments(spark, sf)
    index = L.gram_index(s, "exporter")
    assert M.fuzzy_search(s, "Sppliet#000000003", 0.6, index=index).first()["name"] == "Supplier#000000003"
    a, b = (sorted(map(tuple, M.compare_exporters(s, t, index=index).collect())) for t in (["sppliet#000000003", "Suplier#00000001"], ["Supplier#000000003", "Supplier#000000001"]))
    assert a == b and len(a) == 2


def assigned_by_hand(known, rows):
    """The rule of AliasTable.assign: known is alias to (cleaned, canonical, n); rows are (name, n, cleaned, brand, core)."""
    out = {}
    weight = {}
    for _, canonical, n in known.values():
        weight[canonical] = weight.get(canonical, 0) + n
    for name, n, cleaned, brand, core in rows:
        if name in known or core == "":
            continue
        same = sorted(c for form, c, _ in known.values() if form == cleaned)
        near = [h for h in weight if h == brand or S.alike_across(brand, h, 90, 95, 0.7)]
        if same:
            out[name] = same[0]
        elif near:
            out[name] = min(near, key=lambda h: (-weight[h], h))
    return out


def test_names_in_two_halves(spark, tmp_path):
    rnd = random.Random(5)
    base = ["NATURES TOUCH FROZEN", "FOOD FELLAS", "ANDES FRUIT", "HG FOODS", "AGRO SUR DEL PACIFICO", "VALLE VERDE", "MAR Y SOL"]
    forms = ["", " S.A.C.", " LTD", " GMBH", " PERU"]
    odd = ["NATURE TOUCH FROZEN LTD", "FOODFELLAS", "ANDES FRUITS", "HG FOOD SAC", "NEW NAME ONE", "NEW NAMES ONE", "", "PERU"]
    names = sorted({rnd.choice(base) + rnd.choice(forms) for _ in range(25)}) + odd
    rnd.shuffle(names)
    rows = [(n, rnd.randint(1, 40)) for n in names]
    table = AliasTable.create(spark, str(tmp_path / "aliases"))
    first, all_ = (spark.createDataFrame(r, "name string, n bigint") for r in (rows[:14], rows))
    assert table.assign(first) == C.variations(C.cluster_names(first)).count()
    assert sorted((r["canonical_name"], list(r["aliases"]), r["count"]) for r in table.clusters().collect()) == sorted((r["canonical_name"], list(r["aliases"]), r["count"]) for r in C.cluster_names(first).collect())
    known = {r["alias"]: (r["cleaned"], r["canonical_name"], r["n"]) for r in table.read().collect()}
    c = N.clean_company(F.col("name"))
    told = [tuple(r) for r in all_.select("name", "n", c.alias("cleaned")).select("name", "n", "cleaned", N.brand_name(F.col("cleaned")), N.core_name(F.col("cleaned"))).collect()]
    want = assigned_by_hand(known, told)
    left = [(n, k) for n, k, _, _, core in told if n not in known and n not in want and core != ""]
    for r in C.cluster_names(spark.createDataFrame(left, "name string, n bigint")).collect():
        want |= {a: r["canonical_name"] for a in r["aliases"]}
    assert table.assign(all_) == len(want) > 4 and table.version() == 2
    got = {r["alias"]: r["canonical_name"] for r in table.read().where("version = 2").collect()}
    assert got == want and table.read(1).count() == len(known)
    assert table.assign(all_) == 0
    named = table.name_shipments(spark.createDataFrame([("FOODFELLAS",), ("nobody",), (None,)], "importer string"), "importer")
    assert {r["importer"]: r["canonical_importer"] for r in named.collect()} == {"FOODFELLAS": {**{k: v[1] for k, v in known.items()}, **got}["FOODFELLAS"], "nobody": None, None: None}


def test_names_of_flows_and_headings(spark):
    df = spark.createDataFrame([("raw", "CANON", None), ("raw2", None, "imp"), (None, None, None)], "exporter string, canonical_exporter string, importer string")
    assert [tuple(r) for r in readers.with_known_names(df).select("exporter", "importer").collect()] == [("CANON", "Unknown Importer"), ("raw2", "imp"), ("Unknown Exporter", "Unknown Importer")]
    s = spark.createDataFrame([("e", "f", 2.5, 1.0), ("e", "g", 3.5, 2.0)], "exporter string, fruit_name string, usd_per_mt double, net_weight_mt double")
    out = sinks.headed(R.quartile_summary(s, "exporter"), "exporter", fruit="all")
    assert out.columns == ["Fruit", "Exporter", "Fruits", "Low$", "Mid$", "Hi$", "YTD MT", "Records"] and tuple(out.first()) == ("all", "e", 2, 3, 3, 3, 3, 2)
