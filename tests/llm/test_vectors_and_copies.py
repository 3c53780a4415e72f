"""Neighbours, near-duplicates and the pipeline against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltmark.llm import nearduplicates as near
from siltmark.llm import neighbours


def test_cosines_and_exclusions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[7] = x[3]
    x[9] = x[3]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] + [1.0] * 15), (404, [1.0] * 3), (405, []), (406, [float("inf")] * 16), (407, [1e300] * 16), (408, [1e-300] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 3, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [3, 53, 103, 153, 203, 253, 303, 353]
    full = np.vstack([x.astype(float), np.ones((2, 16))])
    ids = np.array([*range(400), 407, 408])
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        s = unit @ unit[q]
        for _, i, score in found:
            assert abs(score - s[list(ids).index(i)]) < 1e-12 and i != q
        order = sorted((-round(v, 12), i) for v, i in zip(s, ids, strict=True) if i != q)
        hit += len({i for _, i in order[:5]} & {f[1] for f in found})
    assert hit >= 0.9 * 5 * len(got)
    assert [f[1] for f in got[3]][:2] == [7, 9]


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, [1.0, 0.0])], schema), F.lit(True)).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], schema)
    got = neighbours.search(three, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return out


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))]


def idf(rows, of):
    return 1 + math.log(of / rows) / math.log(of)


def alike(a, b):
    both = sum(min(w, b[g]) for g, w in a.items() if g in b)
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if every else 0.0


def brute_classes(spark, df, threshold=near.THRESHOLD):
    rows = df.select("doc_id", "text").collect()
    texts = sorted({r.text for r in rows if r.text is not None})
    held = Counter(g for r in rows if r.text is not None for g in set(shingles(r.text)))
    sets = [{g: c * idf(held[g], len(rows)) for g, c in Counter(shingles(t)).items()} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= threshold - 1e-9:
                root[find(i)] = find(j)
    key = {t: find(i) for i, t in enumerate(texts)} | {None: "null"}
    least = {}
    for r in rows:
        least[key[r.text]] = min(least.get(key[r.text], r.doc_id), r.doc_id)
    return sorted((r.doc_id, least[key[r.text]]) for r in rows)


def fixture(rng):
    words = [f"v{i}" for i in range(5000)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 120]))]
        for k in range(rng.choice([1, 2, 4])):
            rows.append(" ".join(edited(rng, base, k)))
    passage = [rng.choice(words) for _ in range(40)]
    rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.choice([2, 20, 60]))]) for _ in range(60)]
    hot = [rng.choice(words) for _ in range(100)]
    rows += [" ".join(edited(rng, hot, rng.randrange(5))) for _ in range(90)]
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(6):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 1)
    rows += [None, None, "", "...", "one two", "One, TWO!", rows[0], rows[0], "long " * 50000]
    return rows


def test_classes_match_brute_force(spark):
    rows = fixture(random.Random(2))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("class_id", F.lit("y"))
    got = near.near_duplicates(df)
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute_classes(spark, df)
    assert got.where("kept").count() == got.select("class_id").distinct().count()


def test_signatures_agree_as_weighted_similarity():
    rng = np.random.default_rng(3)
    sampler = near.Sampler(rows=512, bands=128)
    h = np.sort(rng.integers(0, 1 << 63, 120, dtype=np.uint64))
    a = np.r_[np.full(60, 3.0), np.full(40, 1.0)]
    b = np.r_[np.full(60, 2.0), np.full(40, 1.0)]
    one, two = h[:100], np.r_[h[:80], h[100:]]
    s = sampler.sign(np.r_[one, two], np.r_[a, b], np.array([0, 100, 200]))
    assert abs((s[0] == s[1]).mean() - near.similarity(one, a, two, b)) < 0.07


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50) if i != 25] + [(100, 7)], "a long, b long")
    got = {r.node: r.root for r in near.components(links).collect()}
    assert all(got[i] == (0 if i <= 25 else 26) for i in range(1, 51) if i != 26) and got[100] == 0


def test_one_of_each_class_stays(spark):
    rows = fixture(random.Random(4))
    df = spark.createDataFrame([*enumerate(rows), (0, rows[0])], "doc_id long, text string")
    classes = {c for _, c in brute_classes(spark, df)}
    kept = [r.doc_id for r in near.one_of_each(df).collect()]
    assert sorted(kept) == sorted(classes)
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    words = {"en": ["the", "thing", "shore", "with", "other", "stone", "hand"], "de": ["und", "schön", "nicht", "auch", "eine", "hundert", "dort"]}
    item = " ".join(f"item{i}" for i in range(30))
    rows = []
    for i in range(120):
        l = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(words[l]) + str(rng.randrange(50)) * (k % 2) for k in range(80)), l, f"s{i % 3}", 0))
    rows.append((200, rows[1][1], "en", "s1", 0))
    rows.append((201, rows[2][1] + " " + item + " " + rows[4][1], "en", "s2", 0))
    rows.append((202, None, "en", "s2", 0))
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    at = table
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != "sharding":
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in at.select("doc_id").collect()}
    assert 202 not in seen["language"] and {*range(120)} <= seen["language"]
    assert 200 not in seen["near_duplicates"] and 201 in seen["near_duplicates"]
    text = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/decontamination").collect()}
    assert "item3" not in text[201].text and text[201].n_chars == len(text[201].text)
    assert text[5].text == rows[5][1]
    run = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in run.select("doc_id").collect()) == sorted(r.doc_id for r in at.select("doc_id").collect())


@pytest.mark.parametrize("chunk, span", [(1 << 21, 1 << 20), (700, 300)])
def test_exchanged_frequencies_are_exact(spark, monkeypatch, chunk, span):
    """Over all rows, whatever the chunks and ranges; and of the texts that hold enough of them, no others."""
    monkeypatch.setattr(near, "CHUNK_SHINGLES", chunk)
    monkeypatch.setattr(near, "RANGE_SHINGLES", span)
    rng = random.Random(6)
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(200)) for _ in range(30)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"{passage} {i}" for i in range(40)] + [texts[0]] * 3 + ["again and " * 20 + str(i % 7) for i in range(9)] + [f"{passage} {texts[1]}"]
    held = Counter(g for t in texts for g in set(shingles(t)))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    exchange = near.Exchange(len(texts), sum(map(len, texts)), 0.8)

    def asked(batches):  # many small batches
        for b in batches:
            for i in range(0, b.num_rows, 3):
                yield b.slice(i, 3)

    rows = docs.select(F.xxhash64("text").alias("node"), "text").mapInArrow(asked, "node long, text string").mapInArrow(exchange.ask, exchange.schema)
    answers = rows.groupBy("range").applyInArrow(lambda t: exchange.count(t), exchange.schema).groupBy("chunk").applyInArrow(lambda t: exchange.answer(t), "node long, dh array<long>, dn array<long>")
    of = {r.node: r.text for r in docs.select(F.xxhash64("text").alias("node"), "text").collect()}
    got = {}
    for r in answers.collect():
        assert got.setdefault(of[r.node], (r.dh, r.dn)) == (r.dh, r.dn)
    able = set()
    for t in set(texts):
        w = {g: c * idf(held[g], len(texts)) for g, c in Counter(shingles(t)).items()}
        if sum(x for g, x in w.items() if held[g] > 1) >= 0.8 * sum(w.values()):
            able.add(t)
    assert got.keys() == able
    for t, (_, dn) in got.items():
        assert sorted(dn) == sorted(held[g] for g in set(shingles(t)) if held[g] > 1)


def test_packed_order_is_that_of_both_keys():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5000, 7), (5000, 1), (3000, 1 << 40)):
        high = np.sort(rng.integers(0, top, n))
        h = rng.choice(np.r_[rng.integers(0, 1 << 63, 200, dtype=np.uint64), np.uint64(5) + np.arange(9, dtype=np.uint64)], n)
        order = near.ordered(h, high)
        assert sorted(order.tolist()) == list(range(n))
        assert list(zip(high[order], h[order])) == sorted(zip(high.tolist(), h.tolist()))


def test_one_of_each_with_repeated_and_null_ids(spark):
    rng = random.Random(10)
    a, b, c = (" ".join(f"x{rng.randrange(9999)}" for _ in range(60)) for _ in range(3))
    rows = [(7, a), (8, a), (3, b), (7, b), (None, c), (None, c + " end"), (None, None), (None, None)]
    got = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)[:60]) for r in got if r.text is None or not r.text.startswith(c)) == sorted([("7", a[:60]), ("3", b[:60]), ("None", "None")])
    assert len(got) == 4


def test_nearest_within_tight_groups(spark):
    # rows of a group differ by far less than the group's own direction is long
    rng = np.random.default_rng(11)
    c = rng.normal(size=(5, 32))
    x = c[rng.integers(0, 5, 6000)] + 0.001 * rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, 6000, 50)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -9
    want = {(int(q), int(j)) for q, row in zip(asked, np.argsort(-s, axis=1)[:, :5], strict=True) for j in row}
    got = {(r.query_id, r.vec_id) for r in neighbours.search(df, F.col("vec_id") % 50 == 0, k=5, rerank=64).collect()}
    assert len(want & got) >= 0.9 * len(want)
