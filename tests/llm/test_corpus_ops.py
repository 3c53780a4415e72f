"""Corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.llm import decontamination, language, mixing, pii, quality, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], SCHEMA)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 40, 300]), words), "en", f"s{i % 4 if i % 3 else 0}") for i in range(120)]
    rows += [(120, None, None, None), (121, "", "en", None), (122, "w1 " * 20000, "en", "s0"), (5, rows[5][1], "en", rows[5][3]), (123, rows[7][1], "en", "s1")]
    return rows


def test_no_local_folder_is_made_on_a_cluster():
    from types import SimpleNamespace

    from siltmark.llm import store

    none = SimpleNamespace(get=lambda *a: None)
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        context = SimpleNamespace(master=master, getConf=lambda: none, getCheckpointDir=lambda: None)
        with pytest.raises(RuntimeError):
            store.shared_dir(SimpleNamespace(conf=none, sparkContext=context))


# --- mixing


def test_mix_meets_targets(spark, corpus):
    got = mixing.mix_plan(docs(spark, corpus), bucket_rows=10).collect()
    assert len(got) == len(corpus)
    size = {}
    for r in got:
        size.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    longest = max(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in corpus)
    total = sum(r["size"] for r in got)
    assert sum(v[0] for v in size.values()) == pytest.approx(min(1.5 * total, 2 * total))
    for s, (target, taken) in size.items():
        assert target <= 2 * s + 1e-6 and abs(taken - target) <= longest
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got) <= 1.5 * total


def test_mix_does_not_depend_on_buckets_or_partitions(spark, corpus):
    a = mixing.mix_plan(docs(spark, corpus), bucket_rows=10).select("doc_id", "size", "taken").collect()
    b = mixing.mix_plan(docs(spark, corpus).repartition(5), bucket_rows=10_000).select("doc_id", "size", "taken").collect()
    assert sorted(a) == sorted(b)


def test_mixed_rows_are_those_of_the_plan(spark, corpus):
    rows = corpus[:100]
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs(spark, rows)).collect()}
    got = mixing.mix_documents(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in plan.items() if v}


def test_mix_of_nothing(spark):
    assert mixing.mix_plan(docs(spark, [])).count() == 0
    assert mixing.mix_documents(docs(spark, [])).count() == 0


def test_repeated_rows_are_in_the_mix_as_often_as_planned(spark):
    rng = random.Random(5)
    rows = [(k % 3 if k < 9 else None, prose(rng, 4, ["a", "b"]) if k % 2 else "same words here", "en", f"s{k % 2}") for k in range(12)]
    rows += [(5, "one two three", "en", "s3")] * 7 + [(20 + k, "word " * 9, "en", "s4") for k in range(3)]
    df = docs(spark, rows).withColumn("size", F.lit("clash"))
    plan = mixing.mix_plan(df).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    got = mixing.mix_documents(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.n for r in plan if r.n} == {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    spent = sum(len((r.text or "").split()) for r in got.collect())
    assert spent <= 1.5 * sum(len((r[1] or "").split()) for r in rows)


# --- sharding


def least_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, s = (low + high) // 2, 1, 0
        for x in sizes:
            n, s = (n + 1, x) if s + x > mid else (n, s + x)
        low, high = (low, mid) if n <= k else (mid + 1, high)
    return low


def test_shards_are_minimal_whole_and_gapless(spark, corpus):
    got = sharding.shard_documents(docs(spark, corpus), shards=7, keep=["doc_id", "text"]).collect()
    assert len(got) == len(corpus)
    of, slots = {}, {}
    for r in got:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        of.setdefault(r.text, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = docs(spark, corpus).select(F.xxhash64("text").alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("b")).groupBy("h").agg(F.sum("b").alias("b")).orderBy("h").collect()
    most = max(sum(r["size"] for r in got if r.shard == s) for s in slots)
    assert most <= least_capacity([r.b for r in order], 7)


def test_sketch_is_refined_to_the_optimum(spark):
    sized = spark.range(3000).select(F.xxhash64("id").alias("__h"), (F.col("id") % 97 + 1).alias("__size"))
    _, capacity, _ = sharding.plan(sized, 6, cells=64)
    order = [r[1] for r in sized.orderBy("__h").collect()]
    assert capacity == least_capacity(order, 6)


def test_shards_of_few_groups_clashing_columns_and_nothing(spark):
    one = docs(spark, [(i, "same", "en", "s") for i in range(9)]).withColumn("shard", F.lit("x")).withColumn("size", F.lit(1))
    got = sharding.shard_documents(one, shards=4)
    assert {r.shard for r in got.collect()} == {0} and got.columns.count("shard") == 1
    assert sharding.shard_documents(docs(spark, []), shards=4).count() == 0


# --- decontamination


def brute_hits(text, items, n=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for k, t in items:
        v = words(t)
        m = min(n, len(v))
        for j in range(len(v) - m + 1 if v else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[j : j + m]:
                    hit.update(range(i, i + m))
                    found.add(str(k))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("automaton_words", [100_000, 15])
def test_windows_match_brute_force(spark, short, automaton_words):
    rng = random.Random(11)
    words = ["a", "b", "c", "Ä", "1"]
    items = [(i, prose(rng, rng.choice([12, 15, 30]), words)) for i in range(8)] + [(8, None), (9, "...")]
    if short:
        items += [(10, "Zebra"), (11, "zebra b, c"), (12, "c zebra b c a")]
    rows = []
    for i in range(60):
        t = prose(rng, rng.choice([0, 3, 20, 60]), [*words, "zebra"])
        if i % 3 == 0:
            part = items[i % 8][1].split()
            t += ". " + ", ".join(part[rng.randrange(3) :]).upper() + " " + prose(rng, 5, words)
        rows.append((i, t, "en", "s"))
    rows += [(60, None, "en", "s"), (61, "", "en", "s"), (0, rows[0][1], "en", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.scan(docs(spark, rows).withColumn("n_hit", F.lit("clash")), bench, automaton_words=automaton_words).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = brute_hits(r.text, items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found), r.text
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_spans_are_cut_and_clean_texts_stay(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(1, f"{long} ONE, two three four five six seven eight nine ten eleven! {long}", "en", "s"), (2, long, "en", "s"), (3, item, "en", "s"), (4, None, "en", "s")]
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {1: f"{long} ! {long}", 2: long, 4: None}
    assert decontamination.scan(docs(spark, []), bench).count() == 0
    assert decontamination.scan(docs(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_columns_named_as_results_stay(spark):
    bench = spark.createDataFrame([(None, "a b c d e f g h i j"), (2, None)], "item_id long, text string")
    rows = [(1, "x y z " * 9 + "a b c d e f g h i j", "en", "s"), (None, "a b", "en", "s")]
    df = docs(spark, rows).select(F.lit("x").alias("n_words"), "doc_id", F.lit(7).alias("coverage"), "text", F.lit(None).cast("int").alias("items"))
    got = decontamination.decontaminate(df, bench)
    assert got.columns == df.columns and {(r.n_words, r.coverage, r["items"]) for r in got.collect()} == {("x", 7, None)}


# --- personal data and secrets


def luhn(d):
    return sum((v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
]
TRICKY = [
    None, "", "a@b.c_d@e.f x", "é@b.fr \U0001f600 x@y.z.w+1 (555) 123-4567", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.256 0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111-2",
    "4111111111111111 5 x", "1" * 20000, "a" * 30000 + "@" + "b." * 5000 + "c", "+12345678 9", "++123456789", "a@b..c", "1.2.3.4@x.y", "4111 1111 1111 1111.2.3.4", "٣٣.1.1.1 1٣1.2.3.4",
]


def brute(text, kinds):
    return sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))


def test_base_spans_match_brute_force(spark):
    rng = random.Random(3)
    rows = [*TRICKY, *["".join(rng.choice(list("ab@.+-( )0123456789 ")) for _ in range(80)) for _ in range(200)]]
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(rows)]).withColumn("pii", F.lit(0))
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.start, s["rank"], s.end) for s in r.pii if s["rank"] < 4] == brute(r.text, BASE), r.text
        assert all(r.text[s.start : s.end] == s.value for s in r.pii)
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_many_spans_of_one_text(spark):
    """Over several chunks of running totals, against brute force; the time is near linear in the spans."""
    import time

    rng = random.Random(8)
    parts = ["a@b.co ", "1.2.3.4 ", "ssn 123-45-6789 ", "+12 345 678 901 x ", "4111111111111111 x ", "é\U0001f600 ", "born 12/10/1980, ", "12.10.1980.1.2.3 "]
    text = "".join(rng.choice(parts) for _ in range(4000))
    got = pii.find_pii(docs(spark, [(1, text, "en", "s")])).first().pii
    base = brute(text, BASE)
    assert [(s.start, s["rank"], s.end) for s in got if s["rank"] < 4] == base
    added = [s for s in got if s["rank"] >= 4]
    assert added and all(text[s.start : s.end] == s.value for s in added)
    assert not any(s.start < e and b < s.end for s in added for b, _, e in base)
    assert sum(s.kind == "ssn" for s in added) == text.count("ssn ")
    began = time.time()
    many = pii.find_pii(docs(spark, [(1, "1.2.3.4 123-45-6789 ssn\n" * 50_000, "en", "s")]))
    assert many.select(F.size("pii")).first()[0] == 100_000
    assert time.time() - began < 60


def test_checksums_and_context_decide(spark):
    texts = ["GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "ssn 123-45-6789", "code 123-45-6789", "born 12/10/1980", "on 12/10/1980"]
    got = {r.text: [s.kind for s in r.pii] for r in pii.find_pii(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [got[t] for t in texts] == [["iban"], [], ["ssn"], [], ["birth"], []]
    red = pii.find_pii(docs(spark, [(1, "to a@b.c, +1 (555) 123-4567!", "en", "s")])).select(pii.redact(F.col("text"), F.col("pii"))).first()[0]
    assert red == "to [email], [phone]!"


SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_secret_base_spans_match_brute_force(spark):
    rng = random.Random(4)
    parts = ["password", "PASSWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "x", "\n"]
    rows = [None, "", "f" * 50000, "toKen=abcdefgh", *["".join(rng.choice(parts) for _ in range(25)) for _ in range(300)]]
    got = secrets.find_secrets(docs(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()
    for r in got:
        assert [(s.start, s["rank"], s.end) for s in r.secrets if s["rank"] < 3] == brute(r.text, SECRETS), r.text
    assert secrets.find_secrets(docs(spark, [])).count() == 0


def test_long_tokens_take_linear_time():
    import time

    began = time.time()
    for token in ("abcDefg1" * 130_000, "a" * 10**6 + "12345", "abc-" * 250_000 + "A1B2"):
        secrets.allowed(token)
    secrets.find_in("Ab1" * 300_000)
    assert time.time() - began < 10
    assert secrets.allowed("some-long-slug12_with-parts/X9") and not secrets.allowed("some-lonG-slug12") and not secrets.allowed("some-long12345-x")


def test_entropy_windows():
    s = "Zx9Qm3Lp7Ks2Vt8Bn4Wd6Rf1"
    assert secrets.find_in(f"see {s} here") == [(4, 3, 4 + len(s))]
    for quiet in ("z" * 40, "the-quick-brown-fox-jumps-over", "123e4567-e89b-12d3-a456-426614174000", "2024-01-01_2024-01-02_2024", "internationalisation", "EXAMPLE" + s):
        assert secrets.find_in(quiet) == []
    import math

    for text in (s, "ab" * 20, s + "a" * 30):
        want = [sum(-c / 20 * math.log2(c / 20) for c in map(text[i : i + 20].count, set(text[i : i + 20]))) for i in range(len(text) - 19)]
        covered = {k for a, b in secrets.high_windows(text, 3.6) for k in range(a, b)}
        assert covered == {k for i, w in enumerate(want) if w >= 3.6 - 1e-9 for k in range(i, i + 20)}


# --- language and quality


def test_languages_are_told_apart(spark):
    rng = random.Random(9)
    words = {"en": ["the", "thing", "shore", "with", "other"], "de": ["und", "schön", "nicht", "auch", "eine"], "es": ["que", "año", "los", "ción", "pero"]}
    rows = [(i, prose(rng, 30, words[l]), l, "s") for i, l in enumerate(list(words) * 40)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "1234 !!!", "de", "s"), (903, "THE THING WITH OTHER SHORE!!", "es", "s"), (0, rows[0][1], "en", "s"), (904, "nicht auch " * 30000, "en", "s"), (905, "x\u00b2"[1:] + " \u00bd \u2167", "en", "s")]
    df = docs(spark, rows)
    model = language.fit(df.where(~language.held_out(df) & (F.col("doc_id") < 900)))
    got = language.identify(df.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert all(of[i].lang_pred == l for i, _, l, _ in rows[:120])
    assert [of[i].lang_pred for i in (900, 901, 902, 903, 904, 905)] == ["und", "und", "und", "en", "de", "und"]
    assert all(0 <= r.score <= 1 for r in got) and of[900].rejected and not of[903].rejected
    assert {r.lang_pred for r in language.identify(df, language.fit(df.limit(0))).collect()} == {"und"}
    assert language.identify(docs(spark, []), model).count() == 0


def test_quality_votes(spark):
    rng = random.Random(1)
    words = ["thing", "shore", "other", "stone", "water"]
    rows = [(i, prose(rng, 40, words) + "." if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 40, words).split()), "en", "s") for i in range(300)]
    rows += [(300, None, "en", "s"), (301, "", "en", "s"), (302, "stone " * 20000, "en", "s"), (1, rows[1][1], "en", "s")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(299, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = quality.score_quality(df.withColumn("predicted", F.lit("clash")), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    empty = quality.score_quality(df, quality.fit(df, labels.limit(0)))
    assert {r.score for r in empty.collect()} == {0.5}
    assert quality.score_quality(docs(spark, []), model).count() == 0


def test_quality_sees_words(spark):
    """Texts of one shape whose words alone tell the label."""
    rng = random.Random(2)
    good, bad = ["stone", "water", "shore", "field", "cloud", "river"], ["cheap", "click", "money", "prize", "promo", "sales"]
    df = docs(spark, [(i, prose(rng, 40, good if i % 3 else bad), "en", "s") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(df, quality.fit(df, labels)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)


def test_votes_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["aa", "B!", "c1", "dd", "12"]) for _ in range(rng.choice([0, 1, 9, 30, 40, 50]))), "en", "s") for i in range(120)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)

    def plain(text):
        counts = quality.term_counts(next(quality.words_of(quality.pa.array([text]))))[0]
        x = []
        for of, part in ((range(quality.SHAPES), 1 - quality.WORD_PART), (range(quality.SHAPES, quality.TERMS), quality.WORD_PART)):
            total = max(1, sum(float(counts[k]) for k in of))
            w = [math.log1p(float(counts[k]) * 1000 / total) * float(model.idf[k]) if counts[k] else 0.0 for k in of]
            norm = math.sqrt(sum(v * v for v in w))
            x += [v * math.sqrt(part) / norm if norm else 0.0 for v in w]
        y = np.array(x) @ model.axes
        y = y / max(np.linalg.norm(y), 1e-9)
        cosines = sorted(((float(y @ v), float(l)) for v, l in zip(model.vectors, model.labels, strict=True)), reverse=True)
        kth = cosines[quality.NEIGHBOURS - 1][0]
        tie = sum(abs(c - kth) < 1e-5 for c, _ in cosines) > 1
        weights = [(max(c, 0) ** 8, l) for c, l in cosines[: quality.NEIGHBOURS]]
        return tie, (sum(w * l for w, l in weights) + model.prior) / (sum(w for w, _ in weights) + 1)

    checked = 0
    for r in quality.score_quality(df, model).collect():
        tie, want = plain(r.text)
        if not tie:
            checked += 1
            assert abs(r.score - want) < 1e-4
    assert checked > 20


# --- licences


def test_notices_match_the_plain_classifier(spark):
    from siltmark.llm import licences

    rng = random.Random(6)
    words = ["the", "work", "of", "law", "general", "driver", "software", "license", "fee"]
    rows = []
    for i in range(40):
        lines = [prose(rng, 12, words) for _ in range(3)]
        if i % 2:
            family = rng.choice(list(licences.TEMPLATES))
            lines.insert(rng.randrange(4), rng.choice(licences.TEMPLATES[family]))
        rows.append((i, "\n".join(lines), "en", "s"))
    rows += [(40, None, "en", "s"), (41, "", "en", "s"), (42, "\n\n1 2\n" + "word " * 30000, "en", "s"), (1, rows[1][1], "en", "s"), (43, "The driver lost her license after the accident.", "en", "s")]
    df = docs(spark, rows)
    model = licences.fit(df.limit(0))
    got = licences.find_licences(df.withColumn("licences", F.lit("clash")), model).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [(i, f) for i, line in enumerate((r.text or "").split("\n")) if (f := model.predict(line)[0]) != licences.UNKNOWN]
        assert [(x.paragraph, x.family) for x in r.licences] == want, r.text
    assert model.predict("Released under the MIT License.")[0] == "mit" and model.predict("Licensed under CC BY-NC 3.0.")[0] == "cc_by_nc"
    assert licences.find_licences(docs(spark, []), model).count() == 0


def test_unlearned_languages_are_rejected_at_all_lengths(spark):
    rng = random.Random(12)

    def language_of(letters):
        return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(400)]

    words = {"en": language_of("etaoinshrdlu"), "de": language_of("enirsatdhuäß"), "es": language_of("eaosrnidlcóñ")}
    rows = [(i, prose(rng, 120, words[l]), l, "s") for i, l in enumerate(list(words) * 150)]
    model = language.Model(language.fit(docs(spark, rows)))
    for other in (language_of("zwiaoyeckłżś"), language_of("abcdefghijklmnopqrstuvwxyz")):
        for n in (20, 100, 400, 2000):
            assert all(model.predict(prose(rng, n, other))[1] <= language.MARGIN for _ in range(20)), n
    for l, own in words.items():
        for n in (20, 100, 400, 2000):
            found = [model.predict(prose(rng, n, own)) for _ in range(20)]
            assert sum(f == l and s > language.MARGIN for f, s in found) >= 19, (l, n)


def test_licences_over_several_lines_and_several_in_one(spark):
    import textwrap

    from siltmark.llm import licences

    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish and distribute copies of the Software.'
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    prose_ = " ".join(["The river ran past the old mill and nobody knew who had built it."] * 12)
    rows, want = [], {}
    for k, (family, notice) in enumerate({"mit": mit, "gpl": gpl, "bsd": bsd}.items()):
        for j, width in enumerate((40, 72, 80)):
            lines = textwrap.wrap(notice, width)
            rows.append((10 * k + j, "\n".join(["int x;", "", *("# " + x for x in lines), "", prose_]), "en", "s"))
            want[10 * k + j] = [(2, family)]
        rows.append((10 * k + 8, "\n".join([*textwrap.wrap(prose_, 72), *textwrap.wrap(notice, 72), *textwrap.wrap(prose_, 72)]), "en", "s"))
        want[10 * k + 8] = [(len(textwrap.wrap(prose_, 72)), family)]
    rows.append((50, "Licensed under the MIT license or the Apache License, Version 2.0.", "en", "s"))
    rows.append((51, f"{prose_} {gpl} {prose_} {bsd} {prose_}", "en", "s"))
    rows.append((52, textwrap.fill(prose_, 72) + "\n\n" + "The general public was free to\nmodify the terms of the license.", "en", "s"))
    got = {r.doc_id: [(x.paragraph, x.family) for x in r.licences] for r in licences.find_licences(docs(spark, rows), licences.fit(docs(spark, []))).collect()}
    assert {k: got[k] for k in want} == want
    assert sorted(f for _, f in got[50]) == ["apache", "mit"] and sorted(f for _, f in got[51]) == ["bsd", "gpl"] and got[52] == []
