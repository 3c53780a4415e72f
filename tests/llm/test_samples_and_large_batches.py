"""Samples of rows that share ids, compressed sizes against plain ones, and more texts in a batch than two bytes count."""

import random

import zstandard
from pyspark.sql import functions as F

from siltmark.llm import language, nearduplicates, quality

DOCS = "doc_id long, text string, lang string"


def prose(rng, letters, n=60):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_languages_of_rows_that_share_an_id(spark):
    rng = random.Random(2)
    rows = [(83, prose(rng, "abc"), "x") for _ in range(1500)] + [(None, prose(rng, "xyz"), "y") for _ in range(1500)]
    rows += [(7, rows[0][1], "x")] * 3000
    made = language.fit(spark.createDataFrame(rows, DOCS), texts=20, chars=100)
    assert set(made) == {"x", "y"}
    # texts by a hash of id and text, equal rows once: no more than asked for, of different texts
    for d in made.values():
        assert 500 < len(d) <= (20 + language.LIMIT_TEXTS) * 101
        assert len(set(d.split())) > 100
    got = language.identify(spark.createDataFrame([(1, prose(rng, "abc"), None), (2, prose(rng, "xyz"), None)], DOCS), made).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["x", "y"]


def test_few_texts_many_times(spark):
    rows = [(k % 3, prose(random.Random(k % 3), "abc"), "x") for k in range(9000)] + [(5, prose(random.Random(9), "xyz"), "y")]
    made = language.fit(spark.createDataFrame(rows, DOCS), texts=4, chars=80)
    assert set(made) == {"x", "y"} and all(len(d) > 0 for d in made.values())


def test_choice_is_that_of_plain_compression(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, {"x": "abcde", "y": "cdefg", "z": "efghi"}[l], 30), l) for k in range(200) for l in "xyz"]
    docs = spark.createDataFrame(rows, DOCS)
    made = language.fit(docs, texts=40)
    asked = [(1000 + k, t, None) for k, t in enumerate([prose(rng, "abcdefghi", n) for n in (1, 3, 20, 400) for _ in range(5)])]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(asked, DOCS), made).collect()}
    for k, text, _ in asked:
        raw = language.normal(text).encode()
        size = {}
        for l, d in made.items():
            plain = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=plain, write_checksum=False, write_content_size=False, write_dict_id=False)
            size[l] = sum(len(c.compress(raw[a : a + language.PIECE])) for a in range(0, len(raw), language.PIECE))
        assert got[k] == min(made, key=lambda l: size[l])


def test_quality_sample_is_bounded_where_ids_repeat(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(7, prose(rng, "abc", 5)) for _ in range(3000)] + [(8, "one two")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] * 400 + [(8, 0)] * 400 + [(9, 1)] * 5000, "doc_id long, quality int")
    model = quality.fit(docs, labels, sample=50)
    assert 0 < len(model.labels) <= 50
    few = quality.fit(docs.where("doc_id = 8"), labels, sample=50)
    assert few.labels.tolist() == [0.0]


def test_more_texts_in_a_batch_than_two_bytes_count(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        base = " ".join(f"common{k}" for k in range(60))
        copies = [base.replace("common7 ", f"other{k} ") for k in range(40)]
        short = spark.range(90_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
        near = spark.createDataFrame([(100_000 + k, t) for k, t in enumerate(copies)], "doc_id long, text string")
        got = nearduplicates.near_duplicates(short.unionByName(near).coalesce(1)).where("doc_id >= 100000")
        assert got.count() == 40
        assert got.select("class_id").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
