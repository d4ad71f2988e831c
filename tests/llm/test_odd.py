"""Odd input: null and string ids, null and very long texts, repeated rows, empty tables, columns with the operators' own names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, language, lines, packing, quality, simhash, substrings, toxicity, urls, warc

CLASHING = ("id", "own", "h", "key", "label", "size", "n", "score", "lang_pred", "predicted", "_y", "y", "bag", "x", "__key", "__doc", "fp", "set", "start")
WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "Straße", "漢字"]


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice((".", "", "", "")) or "") for _ in range(n))


ROWS = [(1, words(1, 80)), (2, words(2, 80)), (2, words(3, 80)), (None, words(4, 80)), (None, None), (3, None), (4, ""), (5, " \n\t\n"), (6, words(1, 80)), (7, words(7, 40)), (7, words(7, 40))]


@pytest.fixture(scope="module", params=["long", "string"])
def docs(request, spark):
    rows = [(None if i is None else str(i) if request.param == "string" else i, t) for i, t in ROWS]
    df = spark.createDataFrame(rows, f"doc_id {request.param}, text string")
    return df.withColumns({c: F.lit("own") for c in CLASHING} | {"lang": F.lit("en")})


def labels(docs, name):
    return docs.select("doc_id", F.when(F.col("text").isNull(), None).otherwise(F.length("text") % 2).cast("int").alias(name), F.lit("own").alias("text"))


def model(docs, part):
    return {
        "language": lambda: language.fit(docs, held_out_fold=None),
        "toxicity": lambda: toxicity.fit(docs, labels(docs, "toxic"), held_out_fold=None),
        "quality": lambda: quality.fit(docs, labels(docs, "quality")),
    }[part]()


#: Operators that return a row for each row, and how.
EACH = {
    "substrings": lambda d: substrings.deduplicate_substrings(d),
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(2)),
    "language": lambda d: language.identify(d, model(d, "language")),
    "toxicity": lambda d: toxicity.score(d, model(d, "toxicity"), spans=True),
    "quality": lambda d: quality.judge(d, model(d, "quality")),
    "lines": lambda d: lines.remove_duplicate_lines(d),
    "simhash": lambda d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", list(EACH))
def test_a_row_for_each_row(docs, name):
    got = EACH[name](docs)
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, (r.doc_id for r in docs.collect())))
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType


@pytest.mark.parametrize("name", list(EACH))
def test_an_empty_table(docs, name):
    assert EACH[name](docs.limit(0)).count() == 0


def test_values(docs):
    got = [r for r in simhash.near_duplicates(docs).collect() if r.doc_id is None]
    assert len(got) == 2
    kept = simhash.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "2", "None", "None", "3", "7"]) and all(r.h == r.own == r["__key"] == "own" for r in kept)
    good = quality.keep_good(docs, model(docs, "quality"))
    assert good.columns == docs.columns and all(r.text for r in good.collect())
    pieces = packing.pack(docs).collect()
    assert sum(r.start == 0 for r in pieces) == len(ROWS) and sum(r.doc_tokens == 1 for r in pieces) == 4  # two nulls, an empty text and white space
    assert packing.pack(docs.limit(0)).count() == 0
    lang = {r.lang_pred for r in language.identify(docs, model(docs, "language")).where("score = 0").collect()}
    assert lang == {"und"}


def test_urls_and_archives(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None), (None, None, None), (1, "a://h/p", "x"), (1, "a://h/p", "x"), (2, "", "x")], "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("host", "path", "rule", "label", "digest", "size", "key", "copy", "payload")})
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert urls.filter_urls(pages, marks, []).count() == 5
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == 5 and sorted(r.record_type for r in got) == ["response"] * 2 + ["revisit"] * 3


def test_a_text_of_ten_megabytes(spark):
    """One text of 1.6 million words in 50,000 lines, one without a space, and a copy of part of the first."""
    rng = np.random.default_rng(5)
    vocabulary = np.array(["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(5000)])
    long = "\n".join(" ".join(x) for x in rng.choice(vocabulary, (50_000, 32)))
    solid = "".join(map(chr, rng.integers(97, 123, 300_000)))
    assert len(long) > 9_000_000
    df = spark.createDataFrame([(1, long), (2, solid), (3, long[1000:2000]), (4, "a few words")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    cut = {r.doc_id: r for r in substrings.deduplicate_substrings(df).collect()}
    assert cut[1].n_removed == 1000 and cut[3].n_removed == 1000 and cut[2].n_removed == 0
    hit = {r.doc_id: r for r in decontaminate.contamination_digest(decontaminate.decontaminate(df, df.where("doc_id = 3").select(F.lit("i").alias("item_id"), "text"))).collect()}
    assert hit[1].n_words == 1_600_000 and hit[1].contaminated and not hit[2].contaminated
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {1, 2, 3, 4}
    assert quality.judge(df, model(df.where("doc_id > 2"), "quality")).where("n_words = 1600000").count() == 1
    assert toxicity.score(df, toxicity.train([], [])).where("score between 0 and 1").count() == 4
    small = language.estimate({"en": {b" word": 3}, "de": {b" wort": 3}}, language.default_path())
    assert language.identify(df, small).where("score between 0 and 1").count() == 4
    assert packing.pack(df).where("doc_id = 2").agg(F.sum("length") == F.max("doc_tokens")).first()[0]
