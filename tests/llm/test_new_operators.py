"""Spelling variants, collocations and the quality classifier against brute force and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cargolens.llm import collocations as C
from cargolens.llm import quality_model as M
from cargolens.llm import queries as q
from cargolens.llm import spelling as S

DOCS = "doc_id bigint, text string, lang string, word string, n bigint"


def docs_of(spark, texts, langs=("en",)):
    return spark.createDataFrame([(i, t, langs[i % len(langs)], "clash", 7) for i, t in enumerate(texts)], DOCS)


def words_by_hand(docs, every=199, least_length=6, least_n=5):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            total[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least_n}


def variants_by_hand(words, ratio=5):
    letters = set("".join(words))
    near, form = {}, {}
    for w in words:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + j :] for k in range(len(w) + 1) for c in letters for j in (0, 1)}
        near[w] = [x for x in edits if x in words and x != w]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def rows_of(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_spelling_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(q.op11_spelling_variants(spark, sf))
    assert len(got) > 100 and got == variants_by_hand(words_by_hand(docs))


@pytest.mark.parametrize(("shard_halves", "hot"), [(20_000, 2048), (40, 2048), (40, 3)])
def test_spelling_of_random_words(spark, shard_halves, hot):
    """Few letters, so that halves are shared by many words, with insertions at borders, repeats of letters and long words."""
    rnd = random.Random(hot)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))) for _ in range(150)] + ["z" * 40, "z" * 41, "y" * 3000, "y" * 2999]
    bag = [w for w in stems for _ in range(rnd.choice((5, 6, 30, 200)))]
    bag += [w for a in "abcd" for b in "abcd" for c in "abcd" for w in [f"shared{a}{b}{c}def"] for _ in range(5)]  # a half that 64 words share
    bag += ["chainword"] * 200 + ["chainwort"] * 30 + ["chainwart"] * 5
    rnd.shuffle(bag)
    texts = [" ".join(bag[k::20]) for k in range(20)] + [None, "", "short", "×÷×÷×÷ " * 6]
    docs = docs_of(spark, texts)
    got = rows_of(S.spelling_variants(docs, shard_halves=shard_halves, hot=hot))
    want = variants_by_hand(words_by_hand(list(enumerate(texts))))
    assert got == want and any(r[2] not in (r[0], r[1]) for r in want)


def test_spelling_of_odd_tables(spark):
    assert S.spelling_variants(docs_of(spark, ["only"]).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "Letters " * 5), (None, None)], "doc_id bigint, text string")
    assert rows_of(S.spelling_variants(nulls)) == variants_by_hand(words_by_hand([(None, "Letters " * 5)]))
    with pytest.raises(ValueError):
        S.spelling_variants(nulls, ratio=1)


def collocations_by_hand(rows, least, percent, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f[lang].update(" ".join(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least and " " in p}
        rows = []
        for p, a in kept.items():
            words = p.split(" ")
            if any(100 * b >= percent * a for long, b in kept.items() if len(long) > len(p) and f" {p} " in f" {long} " and long != p):
                continue
            cuts = [(1000 * a * n[lang] // (counts[x] * counts[y]), k, counts[x], counts[y]) for k in range(1, len(words)) for x, y in [(" ".join(words[:k]), " ".join(words[k:]))]]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, p.encode(), p, a, left, right, score))
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (_, _, _, p, a, left, right, score) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 6, 1 << 14])
@pytest.mark.parametrize("percent", [100, 60])
def test_collocations_equal_brute_force(spark, cells, percent):
    rnd = random.Random(percent)
    words = ["New", "york", "the", "of", "état", "a", "b", "x y", "日本"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, "", "...", "the of " * 400]
    langs = ("en", None, "de")
    got = C.collocations(docs_of(spark, texts, langs), least=8, percent=percent, top=40, cells=cells)
    got = sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert len(got) > 100 and got == collocations_by_hand([(langs[i % 3], t) for i, t in enumerate(texts)], 8, percent, 40)


def test_collocations_of_odd_tables(spark):
    assert C.collocations(docs_of(spark, ["a b"]).limit(0), cells=64).count() == 0
    assert C.collocations(docs_of(spark, [None, ""]), cells=64).count() == 0
    with pytest.raises(ValueError):
        C.collocations(docs_of(spark, [None]), cells=100)


def test_scores_of_large_counts_are_exact(spark):
    big = 3_000_000_000_000
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 7)]
    out = C.cut_scores(spark.createDataFrame(rows, "lang string, phrase string, size int, f bigint"), spark.createDataFrame([("en", 10**15 + 3)], "lang string, words bigint")).first()
    assert out["score"] == 1000 * big * (10**15 + 3) // ((big + 1) * (big + 7))


def test_gradients_are_those_of_the_loss():
    random_ = np.random.default_rng(4)
    model = M.fit([], np.array([]))
    p = {k: random_.normal(0, 0.3, v.shape) for k, v in model.weights.items()}
    sizes, y = np.array([1, 4, 2]), np.array([1.0, 0.0, 1.0])
    x = random_.normal(size=(7, M.WIDTH))

    def loss(p):
        own = M.Model(np.zeros(M.WIDTH), np.ones(M.WIDTH), p)
        s = own.score(*own.embedded(x), np.cumsum(sizes) - sizes)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in M.gradients(p, x, sizes, y).items():
        at = tuple(random_.integers(0, n) for n in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert np.isclose((loss(up) - loss(down)) / 2e-5, np.asarray(g)[at], rtol=1e-4, atol=1e-8), k


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op13_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    good, bad = ([r["score"] for r in held if r["quality"] == k] for k in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.98


def test_labels_of_the_held_out_fold_and_other_columns_teach_nothing(spark):
    docs = docs_of(spark, ["good words here " * (5 + k) if k % 2 else "BAD$ &&& " * (5 + k) for k in range(80)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id bigint, quality int")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = (M.quality_scores(d, x, carry=["doc_id"]).orderBy("id").select("score").collect() for d, x in ((docs, labels), (docs.selectExpr("doc_id", "text", "'other' as lang"), flipped)))
    assert a == b


def test_quality_of_odd_rows(spark):
    texts = [None, "", " \n ", "fine words", "fine words", "x" * 100_000, "many words here " * 120_000]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(3, 1), (4, 1), (5, 0), (6, 1), (6, 0), (None, 1), (1, None)], "doc_id bigint, quality int")
    got = {r["id"]: r for r in M.quality_scores(docs, labels).collect()}
    assert len(got) == 7 and got[0]["score"] == got[1]["score"] == got[2]["score"] and got[3]["score"] == got[4]["score"] and got[3]["row"]["word"] == "clash"
    assert M.quality_scores(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in M.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
