"""The pipeline against its brute-force version, stage by stage and row by row."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from cargolens.llm import packing
from cargolens.llm import queries as q
from cargolens.llm.token_counts import vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PACKED = ["doc_id", "epoch", "piece_no", "start_token", "n_tokens", "bucket_len", "batch_no", "slot", "padding"]
NAMES = [n for n, _ in corpus_pipeline.STAGES]


def prose(k, n=60):
    return " ".join(f"w{(k * 7919 + j * j * 31) % 9973}" for j in range(n))


AWKWARD = [
    *((k, prose(k), ["en", "de", None][k % 3], [None, "src0", "src1", "other"][k % 4]) for k in range(40)),
    (100, None, "en", "src0"), (101, "", None, None), (None, None, None, None), (None, prose(900), None, None), (None, prose(901), "en", "src2"), (102, " \t\n", "en", "src0"),
    (3, prose(3), "en", "src1"), (3, prose(3), "en", "src1"), (4, prose(950, 70), "en", "src1"), (110, prose(5) + " \n", "de", "src1"), (111, prose(5).replace("w", "W"), "fr", "src1"), (112, prose(6) + " one more", "en", "src3"),
    (120, prose(7, 9000), "en", "src0"), (121, "x" * 60000 + " " + prose(8), "en", "src1"),
    *((200 + k, "bad", "en", "spam") for k in range(60)), (300, prose(960), "en", "spam"),
]


@pytest.fixture(scope="module")
def length():
    own, known = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), {}

    def of(row):
        text = row[1] or ""
        if text not in known:
            known[text] = len(own.encode(text, add_special_tokens=False).ids)
        return known[text]

    return of


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def stages(spark, docs, folder):
    """Each stage's result, written and read again as the next one's docs."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


@pytest.mark.parametrize("which", ["given", "awkward", "empty"])
def test_each_stage_row_by_row(spark, sf, tmp_path, length, which):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if which != "given":
        rows = [(i, t, a, s, len(t or "")) for i, t, a, s in AWKWARD] if which == "awkward" else []
        spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "in" / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / "in" / "documents.parquet"))
    seen = stages(spark, docs, tmp_path)
    rows = [[tuple(r) for r in d.collect()] for d in (docs, *seen)]
    assert all(d.columns == docs.columns for d in seen[:-1]) and seen[-1].columns == PACKED
    assert order(rows[1]) == order(brute.kept_by_quality(rows[0]))
    if which == "awkward":  # a host is rejected, its good document too
        assert not any(r[3] == "spam" for r in rows[1])
    strip = lambda found: Counter((r[0], r[1]) for r in found)  # noqa: E731  of rows alike in id and text any may stay
    exact = brute.one_of_each(rows[1], lambda r: " ".join(brute.WORD.findall(" " + (r[1] or ""))) + str(brute.re.findall(r"^\s|\s$", r[1] or "")))
    assert strip(rows[2]) == strip(exact)
    groups = dict(zip(map(id, rows[2]), brute.near_groups([r[1] for r in rows[2]]), strict=True))
    assert strip(rows[3]) == strip(brute.one_of_each(rows[2], lambda r: groups[id(r)]))
    mixed = brute.mixed(rows[3], length, q.WEIGHTS, q.MIX["share"], q.MIX["max_epochs"], q.MIX["seed"])
    assert order(rows[4]) == order(r for r, _ in mixed)
    lengths = Counter(r[4] for r in rows[5] if r[4])
    chosen = packing.bucket_lengths(list(lengths), list(lengths.values()), q.PACK["buckets"])
    assert order(rows[5]) == order(brute.packed(rows[4], length, chosen))
    copies = Counter((r[5], r[6], r[0], r[2], r[4]) for r in rows[5] if r[5] and r[0] is not None and r[0] != 4)
    assert not copies or max(copies.values()) == 1
    if which == "given":
        assert order(corpus_pipeline.run(spark, sf).collect()) == order(rows[5])
    elif which == "awkward":
        assert order(corpus_pipeline.run(spark, str(tmp_path / "in")).collect()) == order(rows[5])


def test_stages_may_be_read_late_and_in_turns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    for name, stage in corpus_pipeline.STAGES:
        first, second = stage(spark, a, sf), stage(spark, b, sf)
        one, two = first.count(), second.count()
        assert one > 0 < two and (first.count(), second.count()) == (one, two), name
    runs = [corpus_pipeline.run(spark, sf) for _ in range(2)]
    assert runs[0].count() == runs[1].count()
