"""Licences as they are usually printed."""

from __future__ import annotations

import hashlib
import textwrap

import pytest
import regex
from pyspark.sql import functions as F

from cargolens.llm import licenses as L

NAMED = {"MIT": L.MIT, "ISC": L.ISC, "BSD-2-Clause": L.BSD_HEAD + L.BSD_TAIL, "BSD-3-Clause": L.BSD_HEAD + L.BSD_NAMES + L.BSD_TAIL, "Zlib": L.ZLIB}


def found(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["row"]["doc_id"]: r for r in L.license_matches(docs, **how).collect()}


def wrapped(text, width):
    own = text.replace("<year>", "2019").replace("<owner>", "A. Person").replace("<copyright holders>", "A. Person")
    return "\n\n".join(textwrap.fill(x, width) for x in own.split("\n\n"))


def test_wrapped_licenses(spark):
    cases = [(i, w) for i in NAMED for w in range(60, 81)]
    out = found(spark, [wrapped(NAMED[i], w) for i, w in cases])
    assert [(out[k]["license_id"], *c) for k, c in enumerate(cases)] == [(i, i, w) for i, w in cases]


@pytest.mark.parametrize("line", ["copyright notice and this permission notice appear", "(c) You must retain notices", "Copyright holders may do so", "all rights reserved by the holder may be waived"])
def test_body_lines_count(spark, line):
    out = found(spark, ["one\nthree", f"one\n{line}\nthree"])
    assert out[0]["text_digest"] != out[1]["text_digest"]


@pytest.mark.parametrize("line", ["Copyright (c) 2019 A. Person", " * (C) 2001-2004 Somebody", "© 2020 X", "Copyright: 2011 X", "Copyright by X", "Copyright [yyyy] [name]", "All rights reserved.", "# Copyright © X"])
def test_statements_do_not(spark, line):
    out = found(spark, ["one\nthree", f"one\n{line}\nthree"])
    assert out[0]["text_digest"] == out[1]["text_digest"]


def test_whole_licenses(spark):
    files = [(i, (L.Path(L.__file__).parent / "license_texts" / f"{f}.txt").read_text()) for f, i, _ in L.FILES]
    titled = [("BSD-3-Clause", "BSD 3-Clause License\n\n" + NAMED["BSD-3-Clause"]), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + NAMED["BSD-2-Clause"]), ("MIT", "The MIT License (MIT)\n\n" + L.MIT.removeprefix("MIT License\n\n"))]
    plain = [("GPL-2.0", files[7][1].split("Version 2, June 1991", 1)[1]), ("Apache-2.0", files[0][1].split("http://www.apache.org/licenses/", 1)[1]), ("Apache-2.0", files[0][1].split("   APPENDIX")[0]), ("MPL-2.0", files[13][1].split("=\n", 1)[1])]
    cases = [*files, *titled, *plain]
    out = found(spark, [t for _, t in cases] + [files[8][1] + "\nand more"])
    assert [out[k]["license_id"] for k in range(len(cases))] == [i for i, _ in cases]
    assert out[len(cases)]["license_id"] is None


def plain_form(text):
    """Canonical form by single steps over characters and words."""
    low = regex.sub("(?m)" + L.COPYRIGHT_LINE, "", (text or "").lower())
    lines = ["".join(c if regex.match(r"[\p{L}\p{N}]", c) else " " for c in line).split() for line in low.split("\n")]
    lines = [" " + " ".join(words) + " " for words in lines]
    for word, instead in L.SPELLINGS.items():
        lines = [x.replace(f" {word} ", f" {instead} ").replace(f" {word} ", f" {instead} ") for x in lines]
    return [" ".join(x.split()) for x in lines]


def test_against_brute_force(spark, sf):
    """Whole table and planted licence texts: digests, identifiers, notices."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [t for _, t in L.entire_texts()] + [f"Some file\n{t}\nSPDX-License-Identifier: MIT\nspdx license identifier mit" for _, t in L.KNOWN] + ["a\rcopyright 2019 x\rb", "é licence\u2028© 2020 y", None, ""]
    digest = lambda lines: hashlib.sha256(" ".join(x for x in lines if x).encode()).hexdigest()
    known = {}
    for i, t in L.LICENSES:
        d = digest(plain_form(t))
        known[d] = min(i, known.get(d, i))
    out = found(spark, texts)
    for k, t in enumerate(texts):
        lines = plain_form(t)
        hits = [known[digest([x])] for x in lines if x and digest([x]) in known]
        got = out[k]
        assert (got["text_digest"], got["license_id"], got["notice_ids"], got["n_notices"]) == (digest(lines), known.get(digest(lines)), sorted(set(hits)), len(hits)), t
    assert sum(r["license_id"] is not None for r in out.values()) >= len(list(L.entire_texts()))


def test_known_texts_as_a_table(spark):
    table = spark.createDataFrame([("Own", "My own licence."), ("Zeta", "my own license"), ("None", None), ("Mark", "...")], "license_id string, text string")
    out = found(spark, ["My OWN license!", "x\nmy own licence\nmy own licence", "..."], known=table)
    assert [(out[k]["license_id"], out[k]["notice_ids"], out[k]["n_notices"]) for k in range(3)] == [("Own", ["Own"], 1), (None, ["Own"], 2), (None, [], 0)]
    assert "Python" not in L.license_matches(spark.range(3).select(F.lit("a").alias("text")))._jdf.queryExecution().simpleString()


def test_long_lines_are_looked_up(spark):
    mit = " ".join(L.MIT.removeprefix("MIT License\n\nCopyright (c) <year> <copyright holders>\n\n").split())
    own = "word " * 100 + "end"
    out = found(spark, [f"/* {mit} */\nvar x = 1;", f"first\n{own}\nlast", "", None], known=(*L.KNOWN, ("Own", own)))
    assert [(out[k]["license_id"], out[k]["notice_ids"], out[k]["n_notices"]) for k in range(4)] == [(None, ["MIT"], 1), (None, ["Own"], 1), (None, [], 0), (None, [], 0)]
    assert found(spark, ["one"], known=())[0]["n_notices"] == 0
