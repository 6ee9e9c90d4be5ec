"""The pipeline against its operators' brute-force versions, on whole small tables."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import components, lines_wanted, shingles  # noqa: E402


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    one = steps["language_id"](spark, docs, sf).cache()
    assert one.columns == docs.columns and one.count() == docs.where("text rlike '\\\\p{L}'").count()
    two = steps["line_dedup"](spark, one, sf).cache()
    want = {}
    before = {r.doc_id: r.text for r in one.collect()}
    for d, gone in lines_wanted(list(before.items())).items():
        lines = before[d].split("\n")
        kept = [x for i, x in enumerate(lines) if i not in gone]
        if not gone or any(x.strip(" ") for x in kept):
            want[d] = "\n".join(kept)
    assert {r.doc_id: r.text for r in two.collect()} == want
    three = steps["ngram_join"](spark, two, sf).cache()
    comp = components({d: shingles(t) for d, t in want.items()})
    assert {r.doc_id for r in three.collect()} == set(comp.values())
    four = steps["mixing"](spark, three, sf).cache()
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= set(comp.values())
    assert four.groupBy("doc_id").count().where("count > 3").count() == 0
    five = steps["bpe"](spark, four, sf)
    assert five.count() == four.count() and five.where("n_tokens = 0").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, `a.b` int, rest string, _key long, lang_id string, n_runs int, ids string"


def test_stages_on_odd_rows(spark):
    rng, words = random.Random(7), {"en": ["the", "thing", "and", "with", "other"], "de": ["schon", "ung", "nicht", "über", "sein"]}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(n))
    of = lambda i, text, lang="en", source="s": (i, text, lang, source, None if text is None else len(text), 1, "r", 5, "x", 6, "y")
    rows = [of(i, prose(lang, 40), lang, source) for i in range(40) for lang in [["en", "de"][i % 2]] for source in [["s", "t", None][i % 3]]]
    long, block = prose("de", 30000), "\n".join(prose("en", 9) for _ in range(4))
    rows += [of(None, None), of(50, ""), of(51, "  \n "), of(52, "123 !!"), of(None, prose("en", 30), None, None), of(None, prose("de", 30)), of(7, prose("de", 50)), of(60, long), of(61, long), of(60, long), of(70, block), of(71, f"{prose('en', 12)}\n{block}"), of(72, block)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    steps = dict(corpus_pipeline.STAGES)
    one = steps["language_id"](spark, docs, "").cache()
    assert one.columns == docs.columns and one.count() == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
    two = steps["line_dedup"](spark, one, "").cache()
    assert two.columns == docs.columns and two.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = {r.doc_id: r for r in two.collect() if r.doc_id is not None}
    assert 61 not in got and 72 not in got and got[70].text == block and "\n" not in got[71].text and got[71].n_chars == len(got[71].text) and two.where("doc_id IS NULL").count() == 2
    three = steps["ngram_join"](spark, two, "").cache()
    assert three.columns == docs.columns and three.where("doc_id = 7").count() == 2 and three.where("doc_id IS NULL").count() == 2 and three.where("doc_id = 60").count() == 1
    four = steps["mixing"](spark, three, "").cache()
    assert four.columns == docs.columns and {(r["a.b"], r["rest"], r["_key"], r["lang_id"], r["n_runs"]) for r in four.collect()} == {(1, "r", 5, "x", 6)}
    assert {r.text for r in four.collect()} <= {r.text for r in three.collect()} and four.where("doc_id IS NULL").count() > 0
    five = steps["bpe"](spark, four, "")
    assert five.columns == ["doc_id", "source", "lang", "n_tokens", "ids"] and five.count() == four.count()
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), "").count() == 0, name
    assert steps["bpe"](spark, docs, "").where("n_tokens = 0").count() == 3  # no text, an empty one, and blanks
