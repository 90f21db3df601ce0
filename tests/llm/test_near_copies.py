"""The pipeline's near-copy stage against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import brute
import corpus_pipeline
import numpy as np
import pytest

from pyspark.sql import functions as F

from cargolens.llm import near_copies as N
from cargolens.llm.common import durable


def shingles(text, width=5):
    w = brute.words(brute.lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_pairs(texts):
    """Pairs of ids whose shingle sets have a Jaccard similarity of 0.8 or more."""
    sets, holders, common = {i: shingles(t) for i, t in texts.items()}, defaultdict(list), Counter()
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    for ids in holders.values():
        common.update(combinations(ids, 2))
    return [(a, b) for (a, b), c in common.items() if 10 * c >= 8 * (len(sets[a]) + len(sets[b]) - c)]


def survivors(texts):
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in near_pairs(texts):
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i for i in top if find(i) == i}


def stage(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_all_near_copies_of_a_table_are_found(spark, size):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").collect()}
    want = survivors(texts)
    assert len(want) < len(texts)
    assert stage(spark, texts) == sorted(want)


def test_copies_near_the_limit_and_chains(spark):
    """Sparse edits at similarities from 0.7 to 1, a chain whose ends are unlike, and a large group."""
    rng, texts = random.Random(5), {}
    words = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    for k in range(60):
        base = words(200)
        other = list(base)
        for at in rng.sample(range(200), k % 8):
            other[at] = "changed"
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(other)
    chain = words(200)
    for k in range(8):
        texts[1000 + k] = " ".join(chain[k * 10 : k * 10 + 120])
    group = words(300)
    for k in range(150):
        group[rng.randrange(300)] = f"x{k % 9}"
        texts[2000 + k] = " ".join(group)
    assert stage(spark, texts) == sorted(survivors(texts))


def test_texts_without_words(spark):
    assert stage(spark, {1: "", 2: None, 3: " \n", 4: "a b", 5: "A  b"}) == [1, 4]
    assert stage(spark, {}) == []


def test_bands_follow_similarity():
    rng, hits, agree = np.random.default_rng(3), [], []
    for _ in range(300):
        both = rng.integers(0, 1 << 64, 900, np.uint64)  # 720 of 900 are common
        a, b = np.sort(both[:810]), np.sort(both[90:])
        hits.append(int((N.band_keys(N.minima(a)) == N.band_keys(N.minima(b))).sum()))
        agree.append(int(N.agreements(*(np.frombuffer(N.sketch(N.minima(x)), "<u8") for x in (a, b)))))
    assert min(hits) > 0 and min(agree) > N.AGREE
    assert abs(np.mean(hits) / N.BANDS - 0.8**N.MINIMA) < 0.03


def test_large_buckets_are_cut_into_parts(spark):
    """Many texts of one bucket in parts of a few: the same components."""
    rng, texts = random.Random(6), {}
    base = [f"w{k}" for k in range(120)]
    for k in range(90):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(0, 9)):
            own[at] = f"y{rng.randrange(1000)}"
        texts[k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "at bigint, text string").withColumn("of", N.bands_udf(5, 42)("text"))
    rows = durable(docs.select("at", F.col("at").alias("uid"), "of.n", "of.keys", "of.sketch"), "bands")
    for part in (7, 2048):
        links = [tuple(r) for r in N.similar_links(rows, docs.select("at", "text"), part=part).collect()]
        top = {k: k for k in texts}
        for _ in texts:
            for a, b in links:
                top[a] = top[b] = min(top[a], top[b])
        assert {k for k in texts if top[k] == k} == survivors(texts)


def test_sketches_agree_as_minima_do():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 64, N.BANDS * N.MINIMA, np.uint64) for _ in range(2))
    b[::3] = a[::3]
    x, y = (np.frombuffer(N.sketch(m), "<u8") for m in (a, b))
    two = lambda m: (m >> np.uint64(13)) & np.uint64(3)
    assert N.agreements(x, y) == (two(a) == two(b)).sum() and N.agreements(x, x) == N.BANDS * N.MINIMA


@pytest.mark.parametrize("n", [40, 200, 255, 256, 400, 5000])
def test_least_hashes_keep_all_alike_pairs(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        both = rng.integers(0, 1 << 64, n, np.uint64)
        cut = n // 10
        a, b = np.unique(both[: n - cut]), np.unique(both[cut:])  # 0.8 and a little more
        assert N.alike_by_least(a[: N.LEAST], b[: N.LEAST], 80)
        other = np.unique(np.concatenate((both[: n // 2], rng.integers(0, 1 << 64, n // 2, np.uint64))))
        assert not N.alike_by_least(a[: N.LEAST], other[: N.LEAST], 80)


def test_links_by_fingerprints_come_first(spark):
    """Pairs by op10's method are made of the rows' fingerprints: copies of one, and those within four bits."""
    rows = spark.createDataFrame([(0, 7), (1, 7), (2, 7 ^ (0b1111 << 40)), (3, 7 ^ (0b11111 << 20)), (4, -1), (5, -1 ^ 1)], "uid bigint, fp bigint")
    found = {tuple(sorted(r)) for r in N.print_pairs(rows).collect()}
    assert found == {(0, 1), (0, 2), (4, 5)}
