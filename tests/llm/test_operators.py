"""The operators' own interfaces: budgets, buckets, tables of chunks, indexes, collisions, and rows that are odd."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from cargolens.llm import exact_dedup as X
from cargolens.llm import licenses as L
from cargolens.llm import line_dedup as D
from cargolens.llm import mixing as M
from cargolens.llm import packing as P
from cargolens.llm import queries as q
from cargolens.llm import simhash as S
from cargolens.llm import token_counts as T
from cargolens.llm import warc as W
from cargolens.llm.quality import drop_low_quality, host_quality, host_rates
from cargolens.llm.secret_scan import secret_spans

DOCS = "doc_id bigint, text string, lang string, source string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_prefix_counts_equal_the_library(spark):
    own = Tokenizer.from_file(T.vocabulary("word_bpe_49k.json"))
    count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aab'sretlv dm !1é<|\n ") for _ in range(rnd.randint(0, 40))) for _ in range(60)] + ["x<|endoftext|>y", "I'll won't they're", "aaaaaaaaaaaaaaaaaaaa" * 5]
    table = T.prefix_table(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), carry=["doc_id", "text"])
    ends = table.withColumn("n", F.explode(F.sequence(F.lit(0), F.length("row.text")))).select("row.text", "n", T.tokens_at("prefix_changes", F.col("n")).alias("tokens")).collect()
    assert len(ends) > 1000
    for r in ends:
        assert r["tokens"] == count(r["text"][: r["n"]]), (r["text"], r["n"])
    for r in table.select("row.text", T.chars_within("prefix_changes", F.lit(5)).alias("n")).collect():
        assert r["n"] == max(k for k in range(len(r["text"]) + 1) if count(r["text"][:k]) <= 5)


def test_chunk_fingerprints_compose(spark):
    rnd = random.Random(5)
    for size in (0, 1, 4095, 4096, 4097, 20000):
        b = rnd.randbytes(size)
        for k in (0, 1):
            at = rnd.randint(0, size)
            parts = [(X.fingerprint(b[:at], k), at), (X.fingerprint(b[at:], k), size - at)]
            assert X.combine(parts, k) == (X.fingerprint(b, k), size)
            prime, base = X.FIELDS[k]
            assert X.fingerprint(b, k) == sum(v * pow(base, size - 1 - i, prime) for i, v in enumerate(b)) % prime
    texts = {"a": rnd.randbytes(100_000), "b": b"", "c": rnd.randbytes(7000), "d": rnd.randbytes(7001)}
    rows = [(d, i // 7000, len(t), t[i : i + 7000]) for d, t in texts.items() for i in range(0, max(len(t), 1), 7000)]
    found = X.combine_chunks(spark.createDataFrame(rows, "doc string, chunk_no bigint, n_bytes bigint, chunk binary").repartition(3), key=["doc"], size=7000).collect()
    assert {r["doc"]: tuple(r["fp"]) for r in found} == {d: (X.fingerprint(t, 0), X.fingerprint(t, 1), len(t)) for d, t in texts.items()}


def test_long_texts_are_hashed_in_chunks(spark):
    """Through the operator: many chunks, borders inside runs of spaces and letters of two bytes."""
    long = "".join(f"w{k}é" + " \t\n"[: k % 4] for k in range(3000))
    rows = [(1, long, "en", "s"), (2, long.replace("\t", "  "), "en", "s"), (3, long + "x", "en", "s"), (4, "x" + long, "en", "s"), (5, " ", "en", "s"), (6, "\n\n", "en", "s"), (7, None, "en", "s")]
    want = brute.exact([(i, t) for i, t, _, _ in rows])
    for chunk in (7, 1000):
        assert {r["id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in X.exact_groups(docs_of(spark, rows), chunk=chunk).collect()} == want
    parts = X.pieces_of(1000, "n")(spark.createDataFrame([(1, long)], "n int, text string"))
    assert parts.count() == -(-len(long.encode()) // 1000) > 20


def test_colliding_fingerprints_are_told_apart(spark):
    rows = [(1, "a b", "en", "s"), (2, "a  b", "en", "s"), (3, "c d", "en", "s"), (4, "c\td", "en", "s"), (5, "longer text", "en", "s"), (6, None, "en", "s"), (7, "", None, None)]
    found = X.exact_groups(docs_of(spark, rows), prints=F.length("text") % 3, chunk=2)
    want = brute.exact([(i, t) for i, t, _, _ in rows])
    assert {r["id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found.collect()} == want


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "same", "en", "s")] * 5 + [(None, "same", "en", "s"), (None, "lone", "en", "s"), (2, "other", None, None)]
    kept = X.drop_exact_duplicates(docs_of(spark, rows))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "lone"), (1, "same"), (2, "other")]
    near = S.drop_near_duplicates(docs_of(spark, rows))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near.collect()) == [(0, "lone"), (1, "same"), (2, "other")]


@pytest.mark.parametrize("spread", [1, 3, 64])
def test_links_are_those_of_all_pairs(spark, spread):
    rnd = random.Random(spread)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, spread))) for c in centres for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    links = {(r["a"], r["b"]) for r in S.near_links(rows, radius=4).collect()}
    root = {p: p for p in map(signed, prints)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[top(a)] = top(b)
    mine = {p: top(p) for p in root}
    root.update({p: p for p in root})
    items = sorted(prints)
    for i, a in enumerate(items):
        for b in items[:i]:
            if (a ^ b).bit_count() <= 4:
                assert mine[signed(a)] == mine[signed(b)]
                root[top(signed(a))] = top(signed(b))
    assert all(((a % (1 << 64)) ^ (b % (1 << 64))).bit_count() <= 4 for a, b in links)
    assert len(set(mine.values())) == len({top(p) for p in root})


def test_blocks_split_when_large(monkeypatch):
    rnd = random.Random(1)
    centre = rnd.getrandbits(40)
    prints = np.array(sorted({centre ^ sum(1 << b for b in rnd.sample(range(40), rnd.randint(0, 4))) for _ in range(300)}), np.uint64)
    spare = np.full(len(prints), 2)
    group = lambda found: {frozenset(map(int, p)) for part in found for p in part if p[0] != p[1]}

    def parts(edges):
        root = {int(p): int(p) for p in prints}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for e in edges:
            a, b = e
            root[top(a)] = top(b)
        return sorted(sorted(p for p in root if top(p) == t) for t in {top(p) for p in root})

    whole = parts(group(S.collisions(prints, spare, 40)))
    monkeypatch.setattr(S, "BLOCK", 20)
    assert parts(group(S.collisions(prints, spare, 40))) == whole


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (103, 101), (7, 7)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in S.components(links).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100, 103: 100}


def test_perfect_hash_is_minimal_and_exact():
    rnd = np.random.default_rng(2)
    hashes = rnd.integers(0, 1 << 63, (5000, 2), dtype=np.int64).view(np.uint64)
    counts = rnd.integers(1, 1000, 5000)
    blob = D.Shard.build(hashes, counts).dump()
    shard = D.Shard.load(blob)
    assert sorted(shard.places.rank(hashes[:, 0])) == list(range(5000)) and not len(shard.others)
    assert (shard.count(hashes) == counts).all() and len(blob) < 13 * 5000
    assert not shard.count(rnd.integers(0, 1 << 63, (20000, 2), dtype=np.int64).view(np.uint64)).any()
    assert len(D.Shard.build(hashes[:0], counts[:0]).count(hashes)) == 5000
    assert D.Shard.build(hashes[:1], np.array([1 << 40])).count(hashes[:2]).tolist() == [D.MOST, 0]


def test_keys_that_agree_in_64_bits_are_told_apart():
    rnd = np.random.default_rng(3)
    hashes = rnd.integers(0, 1 << 63, (300, 2), dtype=np.int64).view(np.uint64)
    hashes[100:103, 0] = hashes[5, 0]
    hashes[200, 0] = 0
    counts = np.arange(300) + 1
    shard = D.Shard.load(D.Shard.build(hashes, counts).dump())
    assert len(shard.others) == 4
    assert (shard.count(hashes) == counts).all()
    strange = hashes[[5]].copy()
    strange[0, 1] ^= np.uint64(1)
    assert shard.count(strange).tolist() == [0]


def test_colliding_line_keys_through_both_routes(spark, monkeypatch):
    """Keys' placing bits cut to two: nearly all of them collide."""
    plain = D.line_hashes
    rows = [(k, f"line {k % 7}\nline {k % 7}\nown {k}\n") for k in range(84)]
    cut = lambda lines: np.ascontiguousarray(plain(lines) & np.array([3, (1 << 64) - 1], np.uint64))
    hashes = np.concatenate([D.distinct(cut(t.encode().split(b"\n"))) for _, t in rows])
    keys, n = np.unique(hashes.view("V16"), return_counts=True)
    shard = D.Shard.load(D.Shard.build(keys.view("<u8").reshape(-1, 2), n).dump())
    assert len(shard.others) > 60
    want = brute.lines(rows)
    for i, t in rows:
        own = t.encode().split(b"\n")
        own_hashes = cut(own)
        drop = (shard.count(own_hashes) >= 10) & own_hashes.any(axis=1)
        assert D.kept_lines(t.encode(), drop, True)["kept_text"] == want[i][3]


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("probes", [200_000, 40])
def test_lines_by_sent_and_by_routed_index(spark, sf, monkeypatch, limit, probes):
    monkeypatch.setattr(D, "PROBES", probes)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + k, f"common\n COMMON \nown {k}") for k in range(30)], "doc_id bigint, text string"))
    want = brute.lines([tuple(r) for r in docs.collect()])
    out = D.drop_shared_lines(docs, carry=["doc_id"], sent_bytes=limit, shard_keys=3)
    assert {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"], r["kept_text"]) for r in out.collect()} == want


def test_bucket_lengths_waste_least():
    rnd = random.Random(4)
    for _ in range(40):
        histogram = Counter(rnd.randint(1, 14) for _ in range(rnd.randint(1, 60)))
        k = rnd.randint(1, 5)
        ends = P.bucket_lengths(list(histogram), list(histogram.values()), k)
        assert len(ends) <= k and ends[-1] == max(histogram)
        assert sum(n * (next(e for e in ends if e >= x) - x) for x, n in histogram.items()) == brute.best_padding(histogram, k)


def test_packing_places_every_token_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (9999, " ", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    rows = P.pack_into_buckets(docs, max_len=300, buckets=5, token_budget=1000, seed=1).collect()
    length = {r["doc_id"]: len(brute.words(r["text"])) for r in docs.collect()}
    covered, places, batches = defaultdict(int), set(), defaultdict(list)
    for r in rows:
        if r["bucket_len"] is None:
            assert length[r["id"]] == r["n_tokens"] == 0
            continue
        covered[r["id"]] += r["n_tokens"]
        assert r["start_token"] == 300 * r["piece_no"] and r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        place = (r["bucket_len"], r["batch_no"], r["slot"])
        assert place not in places
        places.add(place)
        batches[r["bucket_len"]].append((r["batch_no"], r["slot"]))
    assert dict(covered) == {i: n for i, n in length.items() if n}
    for size, own in batches.items():
        assert sorted(own) == [(k // (1000 // size), k % (1000 // size)) for k in range(len(own))]
    histogram = Counter(r["n_tokens"] for r in rows if r["bucket_len"])
    assert sum(r["padding"] for r in rows if r["bucket_len"]) == sum(n * (next(e for e in sorted(batches) if e >= x) - x) for x, n in histogram.items())
    assert len(batches) <= 5


def test_copies_never_share_a_batch(spark):
    rows = [(k % 40, f"t{k % 40} " * (1 + k % 7 * (k % 40 < 20)), "en", "s") for k in range(200)] + [(None, "a b", None, None)] * 3 + [(None, "c d", None, None), (7, "other text of seven", "en", "s"), (50, "long " * 950, "en", "s"), (50, "long " * 950, "en", "s")] + [(60, None, "en", "s")] * 2
    out = P.pack_into_buckets(docs_of(spark, rows), max_len=100, buckets=3, token_budget=300, seed=2).collect()
    assert sum(r["n_tokens"] for r in out) == sum(len(brute.words(t)) for _, t, _, _ in rows)
    copies = Counter((r["bucket_len"], r["batch_no"], r["id"], r["piece_no"], r["n_tokens"]) for r in out if r["bucket_len"] and r["id"] is not None and r["id"] != 7)
    assert max(copies.values()) == 1
    assert sorted(r["epoch"] for r in out if r["id"] is None) == [0, 0, 1, 2] and sorted(r["epoch"] for r in out if r["id"] == 60) == [0, 1]
    for size in {r["bucket_len"] for r in out if r["bucket_len"]}:
        of = defaultdict(list)
        for r in out:
            if r["bucket_len"] == size:
                of[r["batch_no"]].append((r["epoch"], r["slot"]))
        assert sorted(of) == list(range(len(of)))
        epochs = [{e for e, _ in of[k]} for k in sorted(of)]
        assert all(len(e) == 1 for e in epochs) and [min(e) for e in epochs] == sorted(min(e) for e in epochs)
        assert all(sorted(s for _, s in own) == list(range(len(own))) and len(own) <= 300 // size for own in of.values())
    given = P.pack_into_buckets(docs_of(spark, rows), epoch=F.lit(4), max_len=100, token_budget=300)
    assert {r["epoch"] for r in given.collect()} == {4}


def test_many_readings_are_spread(spark):
    docs = docs_of(spark, [(1, "same", "en", "s")] * 25 + [(2, "other", "en", "s")]).select(F.lit(1).alias("row"), F.col("doc_id").alias("id"), F.lit(1).alias("total"), F.lit(0).alias("print"))
    assert sorted((r["id"], r["epoch"]) for r in P.readings(docs, most=4).collect()) == [(1, k) for k in range(25)] + [(2, 0)]


def test_packing_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    assert P.pack_into_buckets(docs).isEmpty()


def budgets_by_loop(leaves, weights, budget, epochs):
    """Shares by repeated redistribution: {path: tokens} to {path: budget}."""

    def give(paths, depth, amount):
        children = sorted({p[depth] for p in paths})
        cap = {c: epochs * sum(t for p, t in leaves.items() if p in paths and p[depth] == c) for c in children}
        weight = {c: weights[depth].get(c, weights[depth].get("*", 1)) for c in children}
        given, left = {}, float(amount)
        open_ = list(children)
        while open_:
            level = left / sum(weight[c] for c in open_)
            full = [c for c in open_ if cap[c] <= level * weight[c] + 1e-9]
            if not full:
                given |= {c: level * weight[c] for c in open_}
                break
            for c in full:
                given[c] = cap[c]
                left -= cap[c]
            open_ = [c for c in open_ if c not in full]
        out = {}
        for c in children:
            own = {p for p in paths if p[depth] == c}
            if depth == 2:
                out |= {p: given[c] for p in own}
            else:
                out |= give(own, depth + 1, int(given[c] + 1e-6))
        return out

    return give(set(leaves), 0, budget)


def test_mixing_budgets_and_prefixes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(None, "one two", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    rows = M.mix_to_weights(docs, carry=["doc_id"], **q.MIX).collect()
    base = docs.select("doc_id", "text", *(F.coalesce(F.expr(e).cast("string"), F.lit("<null>")).alias(n) for n, e in q.LEVELS.items())).collect()
    leaves, size, path = defaultdict(int), {}, {}
    for r in base:
        p = (r["domain"], r["lang"], r["source"])
        size[r["doc_id"]], path[r["doc_id"]] = len(brute.words(r["text"])), p
        leaves[p] += size[r["doc_id"]]
    want = budgets_by_loop(leaves, [q.WEIGHTS["domain"], q.WEIGHTS["lang"], {}], min(int(sum(leaves.values()) * 0.8), 3 * sum(leaves.values())), 3)
    read, epochs = defaultdict(list), defaultdict(set)
    for r in rows:
        p = (r["domain"], r["lang"], r["source"])
        assert p == path[r["id"]] and abs(r["leaf_budget"] - want[p]) <= 2
        read[p].append((r["epoch"], r["id"], r["n_tokens"]))
        epochs[r["id"]].add(r["epoch"])
        budget_of = r["leaf_budget"]
        assert budget_of > 0
    given = {(r["domain"], r["lang"], r["source"]): r["leaf_budget"] for r in rows}
    for p, own in read.items():
        total, largest = sum(t for _, _, t in own), max(t for _, _, t in own)
        assert given[p] <= total < given[p] + largest
    import hashlib

    for p, own in read.items():  # the last epoch's part is a prefix of its seeded order
        last = max(e for e, _, _ in own)
        key = lambda i, e: hashlib.md5(f"7:{e}:{'null' if i is None else i}".encode()).hexdigest()
        inside = {i for e, i, _ in own if e == last}
        outside = {i for i, pp in path.items() if pp == p} - inside
        assert not outside or max(key(i, last) for i in inside) < min(key(i, last) for i in outside)
        for e in range(last):
            assert {i for ee, i, _ in own if ee == e} == {i for i, pp in path.items() if pp == p}


def test_mixing_of_awkward_rows(spark):
    """Nulls anywhere, ties, repeated ids and rows, empty and very long texts, a leaf without tokens: row by row."""
    rnd = random.Random(9)
    rows = [(k, "w " * rnd.randint(0, 40), rnd.choice(["en", "de", None]), rnd.choice([None, "src1", "src2", "other", ""])) for k in range(150)]
    rows += [(None, "a b c", None, None)] * 4 + [(7, "same id", "en", "src1"), (7, "same id", "en", "src1"), (900, None, "fr", "none"), (901, "", "fr", "none"), (902, "long " * 20000, "es", "src3")]
    for how in (q.MIX, q.MIX | {"share": 2.5}, q.MIX | {"share": 5.0, "max_epochs": 2}, q.MIX | {"share": 0.0}):
        found = M.mix_to_weights(docs_of(spark, rows), carry=["doc_id", "text", "lang", "source"], **how).collect()
        want = brute.mixed(rows, lambda r: len(brute.words(r[1])), q.WEIGHTS, how["share"], how["max_epochs"], how["seed"])
        assert sorted(((*r["row"], r["epoch"]) for r in found), key=repr) == sorted(((*r, e) for r, e in want), key=repr)


@pytest.mark.parametrize("children", [1, 7, 400])
def test_water_fills_to_one_level(spark, children):
    rnd = random.Random(children)
    rows = [(p, f"n{k}", rnd.choice((0, 5, 5, rnd.randint(1, 10**6))), rnd.randint(1, 9), b) for p, b in (("a", 10**6), ("b", 0), ("c", 10**12)) for k in range(children)]
    nodes = spark.createDataFrame(rows, "parent string, name string, cap bigint, weight bigint, budget bigint")
    given = {(r["parent"], r["name"]): r["given"] for r in M.water_fill(nodes, ["parent"], "name").collect()}
    for p, budget in (("a", 10**6), ("b", 0), ("c", 10**12)):
        own = [(cap, w, given[p, n]) for pp, n, cap, w, _ in rows if pp == p]
        total = sum(cap for cap, _, _ in own)
        spent = sum(g for _, _, g in own)
        assert min(budget, total) - children <= spent <= min(budget, total)
        levels = [g / w for cap, w, g in own if g < cap]
        assert all(g / w <= min(levels) + 1 for _, w, g in own) if levels else spent == total


def test_mixing_of_nothing(spark, sf):
    assert M.mix_to_weights(spark.read.parquet(f"{sf}/documents.parquet").where("false"), **q.MIX).isEmpty()


def test_licences_in_other_dress(spark):
    mit = L.MIT.replace("Copyright (c) <year> <copyright holders>", "Copyright © 2019 Somebody Else, Inc. All rights reserved.").replace("MIT License", "The-MIT  LICENCE").replace("The-", "").replace("sublicense", "sub-licence")
    bsd = (L.BSD_HEAD + L.BSD_NAMES + L.BSD_TAIL).upper().replace("\n", "\r\n")
    rows = [(1, mit, "en", "s"), (2, bsd, "en", "s"), (3, "Some words.\nReleased under the MIT Licence!\n", "en", "s"), (4, None, None, None), (5, "Copyright 2020 X", "en", "s"), (6, mit + " and more", "en", "s")]
    found = {r["row"]["doc_id"]: (r["license_id"], r["notice_ids"], r["n_notices"]) for r in L.license_matches(docs_of(spark, rows)).collect()}
    assert found == {1: ("MIT", [], 0), 2: ("BSD-3-Clause", [], 0), 3: (None, ["MIT"], 1), 4: (None, [], 0), 5: (None, [], 0), 6: (None, [], 0)}


GOOD, BAD = "these are ten quite ordinary words for one good text", "short"


def test_hosts_are_rejected_by_their_rate(spark):
    rows = [(i, GOOD, "en", "big") for i in range(95)] + [(100 + i, BAD, "en", "big") for i in range(5)] + [(200, BAD, "en", "tiny"), (201, GOOD, "en", "tiny")] + [(300 + i, BAD, "en", "worst") for i in range(90)] + [(400, GOOD, "en", "worst"), (500, GOOD, None, None)]
    found = {r["row"]["doc_id"]: (r["base_failed"], r["kept"], r["host_rate"]) for r in host_quality(docs_of(spark, rows)).collect()}
    assert found[0][1] and not found[100][1] and found[500][1]
    assert found[400][:2] == (False, False) and found[400][2] > 0.5
    assert {r["doc_id"] for r in drop_low_quality(docs_of(spark, rows)).collect()} == {i for i, x in found.items() if x[1]}


def prior(hosts):
    """(mean, rho) of [(n, failed)] by the formula of moments, in plain floats."""
    total, failed = sum(n for n, _ in hosts), sum(f for _, f in hosts)
    m = failed / total if total else 0.0
    weight = sum((1 - n / total) * (n - 1) for n, _ in hosts)
    if not 0 < m < 1 or weight <= 1e-9:
        return m, 0.0
    spread = sum(n * (f / n - m) ** 2 for n, f in hosts)
    return m, max(0.0, min(1.0, (spread / (m * (1 - m)) - (len(hosts) - 1)) / weight))


@pytest.mark.parametrize("case", ["small hosts of one rate", "hosts that differ", "one host", "single documents", "none fails", "all fail", "no host"])
def test_host_prior_takes_out_chance(spark, case):
    rnd = random.Random(7)
    binomial = lambda n, p: (n, sum(rnd.random() < p for _ in range(n)))
    hosts = {
        "small hosts of one rate": [binomial(1, 0.3) for _ in range(2000)] + [binomial(3, 0.3) for _ in range(200)],
        "hosts that differ": [binomial(rnd.choice((1, 2, 5, 40, 400)), rnd.betavariate(2, 6)) for _ in range(1500)],
        "one host": [(10, 4)], "single documents": [(1, k % 2) for k in range(9)], "none fails": [(5, 0), (1, 0)], "all fail": [(5, 5), (1, 1)], "no host": [],
    }[case]
    table = spark.createDataFrame([(f"h{k}", n, f) for k, (n, f) in enumerate(hosts)], "host string, n bigint, failed bigint")
    rates = {r["host"]: r["rate"] for r in host_rates(table).collect()}
    m, rho = prior(hosts)
    assert rates == {f"h{k}": pytest.approx((f * rho + m * (1 - rho)) / (n * rho + 1 - rho)) for k, (n, f) in enumerate(hosts)}
    if case == "small hosts of one rate":  # 2 of 3 failing isn't evidence here
        assert max(rates.values()) < 0.4
    if case == "hosts that differ":  # true correlation 1 / (2 + 6 + 1)
        assert abs(rho - 1 / 9) < 0.04


def test_owner_specific_tokens_are_added(spark):
    token, copied = "aB3xY9qLmN8pRsT2uVwZ4cDe", "Zz9yX8wV7uT6sR5qP4oN3mLk"
    rows = [(1, f"see {token} here", "en", "src1"), (2, f"use {copied}", "en", "src1"), (3, f"use {copied}", "en", "src2"), (4, "password=hunter2222", "en", "src1"), (5, "password=hunter2222", "de", "src3"), (6, None, None, None)]
    found = {r["row"]["doc_id"]: r for r in secret_spans(docs_of(spark, rows)).collect()}
    assert [(s["start"], s["end"], s["live"]) for s in found[1]["spans"]] == [(4, 28, True)]
    assert found[2]["spans"] == found[3]["spans"] == []
    assert [(s["kind"], s["live"], s["n_owners"]) for s in found[4]["spans"]] == [(0, False, 2)] and found[6]["n_live"] == 0


def test_warc_chunks_stream_long_payloads(spark, tmp_path):
    html = "".join(chr(33 + k % 90) + "é" * (k % 3) for k in range(400_000))
    pages = spark.createDataFrame([(1, "http://a/ b", html), (2, None, ""), (3, "u", html), (None, "n", "x"), (9, "r", "again"), (9, "r", "again"), (9, "r", "other"), (4, "z", None)], "page_id bigint, url string, html string")
    rows = W.read_warc_chunks(spark, W.write_warc(pages)).collect()
    parts = sorted((r["chunk_no"], r["chunk_offset"], bytes(r["chunk"])) for r in rows if r["page_id"] == 3)
    assert len(parts) > 40 and max(len(p) for _, _, p in parts) <= W.CHUNK
    assert b"".join(p for _, _, p in parts).decode() == html
    kinds = {(r["archive"], r["record_no"]): (r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows}
    assert sorted(kinds.values(), key=str) == sorted([(1, "revisit", 3), (2, "revisit", 4), (3, "response", None), (4, "response", None), (0, "response", None), (9, "response", None), (9, "response", None), (9, "response", None)], key=str)
    small = W.warc_round_trip(pages, min_bytes=10_000_000).collect()
    assert {r["record_type"] for r in small} == {"response"} and all(r["intact"] for r in small)
    # the same through the registered query
    pages.repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    found = q.op6_warc_round_trip(spark, str(tmp_path)).collect()
    assert all(r["intact"] for r in found) and len(found) == 8
    want = brute.warc([(1, html), (2, ""), (3, html), (4, None)])
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found if r["page_id"] in want} == want


def test_payload_chunks_cover_the_payload(spark):
    rows = spark.createDataFrame([(k, bytes(range(k))) for k in (0, 1, 7, 8, 9, 200)], "k int, html binary")
    got = defaultdict(list)
    for r in W.payload_chunks(rows, 8).collect():
        got[r["k"]].append((r["chunk_no"], bytes(r["chunk"])))
    assert {k: b"".join(c for _, c in own) for k, own in got.items()} == {k: bytes(range(k)) for k in (0, 1, 7, 8, 9, 200)}
    assert all([n for n, _ in own] == list(range(max(1, -(-k // 8)))) for k, own in got.items())


def test_clashing_columns_pass_through(spark, sf):
    names = ("row", "uid", "fp", "id", "of", "words", "kept", "key", "shard", "epoch", "level0", "tokens", "n_tokens", "threshold", "component", "host")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    wide = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns, name
        assert out.count() > 0
    assert not corpus_pipeline.STAGES[-1][1](spark, wide, sf).isEmpty()
