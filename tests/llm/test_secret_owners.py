"""Values of one owner in many of its repositories."""

from cargolens.llm import secret_scan as S


def test_one_owner_in_four_languages(spark):
    value, other = "aB3dE5gH7jK9mN1pQ3sT5vW7", "zY9xW8vU7tS6rQ5pO4nM3lK2"
    rows = [(k, f"see {value} there", lang, "s1") for k, lang in enumerate(("en", "de", "fr", "es"))]
    rows += [(10 + k, f"see {other} there", "en", s) for k, s in enumerate(("s1", "s2"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    out = {r["row"]["doc_id"]: [(s["n_owners"], s["n_repos"], s["live"]) for s in r["spans"]] for r in S.secret_spans(docs).collect()}
    assert out == {**{k: [(1, 4, True)] for k in range(4)}, 10: [], 11: []}
