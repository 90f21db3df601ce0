"""Similar names: pairs, greedy heads and clusters against plain loops."""

from __future__ import annotations

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cargolens.functions import names as N
from cargolens.operators import clusters as C
from cargolens.operators import similar as S


def changed(rnd, name):
    """A name with a word, a letter or a space more, fewer or elsewhere."""
    words = name.split()
    for _ in range(rnd.randint(0, 2)):
        kind, k = rnd.randrange(6), rnd.randrange(len(words))
        if kind == 0:
            words.insert(k, rnd.choice(["FOODS", "DEL", "SUR", "X", "TRADING"]))
        elif kind == 1 and len(words) > 1:
            words.pop(k)
        elif kind == 2:
            words[k] = words[k] + rnd.choice("SNA")
        elif kind == 3 and len(words[k]) > 1:
            at = rnd.randrange(len(words[k]))
            words[k] = words[k][:at] + words[k][at + 1 :]
        elif kind == 4 and len(words) > 1:
            words[k - 1 : k + 1] = ["".join(words[k - 1 : k + 1])] if k else words[:1]
        else:
            rnd.shuffle(words)
    return " ".join(w for w in words if w) or "A"


def some_names(seed, n):
    rnd = random.Random(seed)
    parts = ["NATURE", "TOUCH", "FROZEN", "FOOD", "FELLAS", "ANDES", "FRUIT", "VERDE", "MAR", "DI", "LA", "B", "KROPS", "INTERNATIONAL", "AGROEXPORTACIONES", "SUNSHINE", "VALLE", "PACIFICO"]
    out = set()
    while len(out) < n:
        base = " ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))
        out |= {base, changed(rnd, base), changed(rnd, changed(rnd, base))}
    return sorted(out)[:n] if seed % 2 else rnd.sample(sorted(out), n)


def pairs_by_hand(names, across=90, spacing=95, ratio=0.7):
    return sorted((a, b) for i, x in enumerate(names) for y in names[i + 1 :] for a, b in [sorted((x, y))] if S.alike_across(a, b, across, spacing, ratio))


@pytest.mark.parametrize(("seed", "across", "spacing"), [(1, 90, 95), (2, 90, 95), (3, 85, 92)])
def test_no_similar_pair_is_left_out(spark, seed, across, spacing):
    names = some_names(seed, 260) + ["", "A", "B", "AB", "A B", "A B C", "ÑANDÚ", "ÑANDU", "X" * 400, "X" * 399]
    names = sorted(set(names))
    df = spark.createDataFrame([(n,) for n in [*names, names[3], None]], "name string")
    got = S.similar_names(df, across, spacing)
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    got = sorted(map(tuple, got.collect()))
    assert got == pairs_by_hand(names, across, spacing) and len(got) > 40


def test_candidates_are_few_of_all_pairs(spark):
    rnd = random.Random(9)
    letters = "ABCDEFGHIKLMNOPRSTUV"
    names = sorted({" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(4, 9))) for _ in range(3)) + " FOODS" for _ in range(1200)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    n = S.candidate_pairs(df, 90, 95, 0.7).count()
    assert n < 0.2 * len(names) * (len(names) - 1) / 2


def heads_by_hand(order, pairs):
    alike = {frozenset(p) for p in pairs}
    head = {}
    for i, x in enumerate(order):
        if x not in head:
            head[x] = x
            for y in order[i + 1 :]:
                if y not in head and frozenset((x, y)) in alike:
                    head[y] = x
    return head


@pytest.mark.parametrize("links", [0, 60, 400])
def test_greedy_heads_equal_the_loop(spark, links):
    rnd = random.Random(links)
    order = [f"n{k:03}" for k in range(100)]
    rnd.shuffle(order)
    pairs = {tuple(sorted(rnd.sample(order, 2))) for _ in range(links)} | {tuple(sorted(p)) for p in zip(order[:12], order[1:13], strict=True)}
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, place int")
    got = {r["name"]: r["head"] for r in S.greedy_heads(nodes, spark.createDataFrame(sorted(pairs), "a string, b string")).collect()}
    assert got == heads_by_hand(order, pairs)


@pytest.mark.parametrize(("heads", "members"), [(256, 20_000), (3, 7)])
def test_block_heads_equal_the_loop(spark, heads, members):
    rnd = random.Random(heads)
    alike = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) >= 5
    rows = [(f"b{rnd.choice((0, 0, 1, 2, k))}", "".join(rnd.choice("xyz") for _ in range(7)), k) for k in range(160)]
    rows = list({(b, f): (b, f, k) for b, f, k in rows}.values())
    got = {(r["block"], r["form"]): r["head"] for r in S.block_heads(spark.createDataFrame(rows, "block string, form string, place int"), alike, heads, members).collect()}
    want = {}
    for block in {b for b, _, _ in rows}:
        order = [f for _, f in sorted((k, f) for b, f, k in rows if b == block)]
        own = heads_by_hand(order, [(x, y) for x in order for y in order if x < y and alike(x, y)])
        want |= {(block, f): h for f, h in own.items()}
    assert got == want and len(got) == len(rows)


def clusters_by_hand(rows):
    """rows (name, n, cleaned, core, brand) to (canonical_name, aliases, count), by two plain loops."""

    def greedy(order, alike):
        out = []
        for x in order:
            mine = next((g for g in out if alike(g[0], x)), None)
            out.append([x]) if mine is None else mine.append(x)
        return out

    groups = []
    for core in {r["core"] for r in rows} - {""}:
        order = sorted((r for r in rows if r["core"] == core), key=lambda r: (-r["n"], r["name"]))
        near = lambda a, b: max(N.token_sort_ratio(a["cleaned"], b["cleaned"]), N.token_set_ratio(a["cleaned"], b["cleaned"])) >= 80
        for own in greedy(order, near):
            best = max(own, key=lambda r: (r["n"], len(r["name"]), r["name"]))
            groups.append({"root": own[0]["name"], "name": best["brand"], "n": sum(r["n"] for r in own), "aliases": [r["name"] for r in own]})
    out = []
    for own in greedy(sorted(groups, key=lambda g: (-g["n"], g["name"], g["root"])), lambda a, b: S.alike_across(a["name"], b["name"], 90, 95, 0.7)):
        top = max(own, key=lambda g: (g["n"], len(g["name"])))
        out.append((top["name"], sorted(a for g in own for a in g["aliases"]), sum(g["n"] for g in own)))
    return sorted(out)


@pytest.mark.parametrize("seed", [4, 5])
def test_clusters_equal_the_loops(spark, seed):
    rnd = random.Random(seed)
    forms = ["", " S.A.C.", " LTD", " S.A. DE C.V.", " GMBH & CO. KG", " PERU"]
    rows = sorted({(n + rnd.choice(forms), rnd.choice((1, 1, 2, 5, 40))) for n in some_names(seed, 250) for _ in range(2)})
    counts = spark.createDataFrame(list(dict(rows).items()), "name string, n bigint")
    c = N.clean_company(F.col("name"))
    told = counts.select("name", "n", c.alias("cleaned")).select("*", N.core_name(F.col("cleaned")).alias("core"), N.brand_name(F.col("cleaned")).alias("brand")).collect()
    got = sorted((r["canonical_name"], list(r["aliases"]), r["count"]) for r in C.cluster_names(counts).collect())
    want = clusters_by_hand(told)
    assert got == want and any(len(a) > 2 for _, a, _ in want)


def test_no_names(spark):
    none = spark.createDataFrame([], "name string, n bigint")
    assert C.cluster_names(none).count() == 0
    assert C.cluster_names(spark.createDataFrame([(None, 3), ("", 2), ("ACME", 1)], "name string, n bigint")).collect()[0]["aliases"] == ["ACME"]


def test_numbered_names_meet_few_others(spark):
    """Names that differ in a number only share most grams, and have chains of pairs as long as they are many."""
    names = [f"CUSTOMER {''.join('ABCDEFGHIJ'[int(d)] for d in f'{k:09}')}{' SR' if k % 7 == 5 else ''}" for k in range(0, 1000, 3)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    met = {tuple(r) for r in S.candidate_pairs(df, 90, 95, 0.7).collect()}
    alike = pairs_by_hand(sorted(names))
    assert met >= set(alike) and len(met) < 3 * len(alike) and len(alike) > 500
    order = sorted(names)
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, place int")
    got = {r["name"]: r["head"] for r in S.greedy_heads(nodes, spark.createDataFrame(alike, "a string, b string")).collect()}
    assert got == heads_by_hand(order, alike)


@pytest.mark.parametrize("edges", [15, 40])
def test_greedy_heads_in_rounds_equal_the_loop(spark, edges):
    rnd = random.Random(edges)
    order = [f"n{k:03}" for k in range(60)]
    rnd.shuffle(order)
    pairs = {tuple(sorted(rnd.sample(order, 2))) for _ in range(160)}
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, place int")
    got = {r["name"]: r["head"] for r in S.greedy_heads(nodes, spark.createDataFrame(sorted(pairs), "a string, b string"), edges).collect()}
    assert got == heads_by_hand(order, pairs)


@pytest.mark.parametrize(("words", "n"), [(("AB", "CDE"), 1), (("A", "BC", "D"), 2), (("ABBA",), 2), (("",), 0)])
def test_remnants_hold_all_deletions(words, n):
    text = " ".join(words)
    by_hand = {" ".join(sorted("".join(c for i, c in enumerate(text) if i not in gone).split())) for gone in itertools.combinations(range(len(text)), n)}
    assert S.remnants(words, n) >= by_hand


def test_matched_characters_equal_difflib():
    rnd = random.Random(6)
    for letters in ("A", "AB", "ABC", "ABCDEFGHIJ "):
        for _ in range(600):
            a = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 24)))
            b = changed(rnd, a) if a.strip() and rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 24)))
            m = SequenceMatcher(None, a, b, autojunk=False)
            assert N.matched(a, b) == sum(x.size for x in m.get_matching_blocks()) and N.ratio(a, b) == round(100 * m.ratio())


def numbered_names(many, step):
    return [f"CUSTOMER {''.join('ABCDEFGHIJ'[int(d)] for d in f'{k:09}')}{' SR' if k % 7 == 5 else ''}" for k in range(0, many * step, step)]


@pytest.mark.parametrize(("rows", "held"), [(4_000_000, 1_000_000), (400, 1_000_000), (4_000_000, 60)])
def test_greedy_names_equal_the_loop(spark, rows, held):
    """In one round, and in several by either limit."""
    order = numbered_names(160, 3) + some_names(7, 60) + ["CUSTOMER", "CUSTOMER SR", "SR", ""]
    order = list(dict.fromkeys(order))
    random.Random(8).shuffle(order)
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, place int")
    got = {r["name"]: r["head"] for r in S.greedy_names(nodes, rows=rows, held=held).collect()}
    want, heads = {}, []
    for x in order:  # the earlier name is the first one: matched characters depend on it
        want[x] = next((h for h in heads if S.alike_across(h, x, 90, 95, 0.7)), x)
        heads += [x] if want[x] == x else []
    assert got == want and 40 < len(heads) < len(order) - 40


def test_names_are_compared_with_heads_only():
    """Of names that differ in a number each has many others alike, but is compared with few."""
    import pyarrow as pa

    names, lengths = sorted(numbered_names(2000, 1)), S.Lengths({17, 19}, (), "CUSTOMER", {(18, 2), (21, 3)})
    keys = [S.remnant_keys(n, 90, 95, lengths) for n in names]
    assert max(map(len, keys)) < 100  # more than 1,000 if any characters were deleted
    ids = {k: i for i, k in enumerate({x for own in keys for x, _ in own})}
    own, ask = ([[4 * ids[x] + (r if mine else (3 - r) % 3) for x, r in made] for made in keys] for mine in (True, False))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(names), pa.array(own), pa.array(ask), pa.array([[]] * 2000, pa.list_(pa.int64()))], ["number", "name", "own", "ask", "early"])
    asked = []
    alike = lambda a, b: asked.append(a) or S.alike_across(a, b, 90, 95, 0.7)
    (out,) = S.settled(alike, 1_000_000)(iter([batch]))
    assert out.num_rows == 2000 and len(asked) < 2 * len(names) and len(set(out.column("head").to_pylist())) < 100


def test_names_are_cleaned_once(spark, monkeypatch):
    """Cleaning isn't repeated for the filter by core name in the tasks that read the names."""
    plans = []
    keep = C.written
    monkeypatch.setattr(C, "written", lambda df, name, *more: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, name, *more))
    C.cluster_names(spark.createDataFrame([("ACME S.A.", 2), ("ACME FOODS LTD", 1)], "name string, n bigint"))
    (plan,) = [p for n, p in plans if n == "cleaned"]
    assert sum(line.count("GMBH") > 0 for line in plan.splitlines()) == 1 and "Repartition" in plan


def test_known_names_are_not_cleaned(spark):
    clusters = spark.createDataFrame([("Acme", ["ACME S.A.", "ACME LTD"], 3)], "canonical_name string, aliases array<string>, count bigint")
    known = C.canonical_names(spark.createDataFrame([("ACME LTD",), ("ACME S.A.",), (" ",), (None,)], "name string"), clusters, "name")
    assert "GMBH" not in known._jdf.queryExecution().optimizedPlan().toString()
    assert {r["name"]: r["canonical_name"] for r in known.collect()} == {"ACME LTD": "ACME", "ACME S.A.": "ACME", " ": " ", None: None}
    more = C.canonical_names(spark.createDataFrame([("ACME LTD",), ("Acmé GmbH",), ("Other Ltd",)], "name string"), clusters, "name")
    assert {r["name"]: r["canonical_name"] for r in more.collect()} == {"ACME LTD": "ACME", "Acmé GmbH": "ACME", "Other Ltd": "OTHER"}


def test_small_blocks_are_no_groups(spark):
    """Blocks of few forms are settled by batch, not each as a group of its own."""
    rows = [(f"b{k // 3}", f"f{k // 3} {'X' * (k % 3)}", k) for k in range(60)]
    found = S.block_heads(spark.createDataFrame(rows, "block string, form string, place int"), lambda a, b: abs(len(a) - len(b)) < 2)
    assert "FlatMap" not in found._jdf.queryExecution().toString()
    assert sorted(r["head"] for r in found.collect()) == sorted(f for k in range(20) for f in (f"f{k} ", f"f{k} ", f"f{k} XX"))
