import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.functions import scalars, tails
from siltmark.operators import guards, metrics, running, sampling, stats


def scored(spark, y, s):
    return spark.createDataFrame(list(zip(y, s, strict=True)), "y_true int, y_score double")


def drawn(n, seed, steps=40):
    """Labels, and scores with ties that lean to the labels."""
    rng = random.Random(seed)
    y = [int(rng.random() < 0.3) for _ in range(n)]
    return y, [(rng.randrange(steps) + 8 * v) / steps for v in y]


def test_threshold_metrics_follow_from_counts(spark):
    y, s = drawn(400, 3)
    r = metrics.threshold_metrics(scored(spark, y, s), 0.55).first()
    tp, fp = (sum(v == k and x >= 0.55 for v, x in zip(y, s, strict=True)) for k in (1, 0))
    fn, tn = y.count(1) - tp, y.count(0) - fp
    assert (r.tp, r.tn, r.fp, r.fn) == (tp, tn, fp, fn)
    sens, spec, prec = tp / (tp + fn), tn / (tn + fp), tp / (tp + fp)
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / 400**2
    want = {"sensitivity": sens, "specificity": spec, "tss": sens + spec - 1, "precision": prec, "f1": 2 * tp / (2 * tp + fp + fn), "kappa": ((tp + tn) / 400 - chance) / (1 - chance), "pred_frac": (tp + fp) / 400}
    assert {k: r[k] for k in want} == pytest.approx(want)
    assert r.hss == pytest.approx(2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))


def test_youden_is_the_best_of_all_thresholds(spark):
    y, s = drawn(300, 4)
    j = {t: sum(v for v, x in zip(y, s, strict=True) if x >= t) / sum(y) - sum(1 - v for v, x in zip(y, s, strict=True) if x >= t) / (len(y) - sum(y)) for t in s}
    r = metrics.youden_threshold(scored(spark, y, s)).first()
    assert r.tss == pytest.approx(max(j.values())) and r.threshold == max(t for t, v in j.items() if v > max(j.values()) - 1e-12)


def test_auc_ties_empty_and_one_class(spark):
    assert metrics.auc(scored(spark, [1, 0, 1, 0], [0.5, 0.5, 0.7, 0.1])).first().auc == pytest.approx(0.875)
    assert metrics.auc(scored(spark, [1, 1], [0.5, 0.6])).first().auc is None
    assert metrics.auc(scored(spark, [1, 0, 1], [0.5, float("nan"), None])).first().n_pos == 1


def test_auc_over_many_ranges(spark):
    rows = [(i * 7919 % 3, float(i * 31 % 997)) for i in range(4000)]
    df = spark.createDataFrame([(int(a == 0), b) for a, b in rows], "y_true int, y_score double")
    pos, neg = [b for a, b in rows if a == 0], [b for a, b in rows if a]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.auc(df).first().auc == pytest.approx(want)


def test_success_and_prediction_rate(spark):
    rng = random.Random(7)
    rows = [(float(rng.randrange(60)), rng.random() < 0.2) for _ in range(500)]
    df = spark.createDataFrame(rows, "v double, p boolean")
    ladder = sorted({float(rng.randrange(-3, 64)) for _ in range(45)})
    got = metrics.rates_at(df, spark.createDataFrame([(x,) for x in ladder], "t double"), "v", "p").orderBy("t").collect()
    for kind, name in ((True, "success_rate"), (False, "area_rate")):
        own = [v for v, p in rows if p is kind]
        assert [r[name] for r in got] == pytest.approx([sum(v >= t for v in own) / len(own) for t in ladder])


def test_mask_overlap_counts_cells(spark):
    rng = random.Random(8)
    cells = [(r, c, rng.random() < 0.5, rng.random() < 0.4, rng.random() < 0.9) for r in range(7) for c in range(5)]
    df = spark.createDataFrame(cells, "r int, c int, p boolean, q boolean, v boolean")
    for valid in (None, "v"):
        own = [x for x in cells if valid is None or x[4]]
        tp, fp, fn = (sum(x[2] is a and x[3] is b for x in own) for a, b in ((True, True), (True, False), (False, True)))
        r = metrics.overlap(df, "p", "q", valid).first()
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, len(own) - tp - fp - fn)
        assert r.iou == pytest.approx(tp / (tp + fp + fn)) and r.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
    empty = metrics.overlap(df.withColumn("p", F.lit(False)).withColumn("q", F.lit(False)), "p", "q").first()
    assert empty.iou is None and empty.hit_rate is None


def test_aicc(spark):
    rng = random.Random(9)
    raw = [rng.uniform(0.01, 0.4) for _ in range(12)]
    df = spark.createDataFrame([(x,) for x in raw], "raw double").agg(F.sum(F.ln("raw")).alias("ll"), F.count("raw").alias("n"))
    r = df.select(scalars.aicc(F.col("ll"), F.lit(3), F.col("n")).alias("a"), scalars.aicc(F.col("ll"), F.lit(11), F.col("n")).alias("b")).first()
    assert r.a == pytest.approx(2 * 3 - 2 * sum(map(math.log, raw)) + 2 * 3 * 4 / (12 - 3 - 1)) and math.isinf(r.b)


def test_corrected_t(spark):
    rng = random.Random(10)
    diffs = [rng.gauss(0.02, 0.03) for _ in range(7)]
    r = stats.corrected_t(spark.createDataFrame([(x,) for x in diffs], "d double"), "d", 90, 15).first()
    mean, sd = statistics.mean(diffs), statistics.stdev(diffs)
    assert (r.mean_diff, r.sd_diff, r.t) == pytest.approx((mean, sd, mean / math.sqrt((1 / 7 + 15 / 90) * sd * sd)))
    assert stats.corrected_t(spark.createDataFrame([(0.0,), (0.0,)], "d double"), "d", 90, 15).first().t == 0


def test_mcnemar_counts_where_models_differ(spark):
    y, s = drawn(200, 11)
    rows = [(m, i, a, b, t) for m, t in (("a", 0.7), ("b", 0.25)) for i, (a, b) in enumerate(zip(y, s, strict=True))]
    r = stats.mcnemar(spark.createDataFrame(rows, "m string, k int, y int, s double, t double"), "m", "k", "y", "s", "t").first()
    right = [((x >= 0.7) == v, (x >= 0.25) == v) for v, x in zip(y, s, strict=True)]
    b, c = right.count((True, False)), right.count((False, True))
    assert (r.b, r.c) == (b, c) and r.chi2 == pytest.approx((abs(b - c) - 1) ** 2 / (b + c))


def test_tails_are_integrals_of_their_densities():
    def integral(f, a, b, n=20_000):
        h = (b - a) / n
        return h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(a + k * h) for k in range(n + 1))

    for x, df in ((3.7, 3), (9.4, 6)):
        density = lambda v, k=df: v ** (k / 2 - 1) * math.exp(-v / 2) / 2 ** (k / 2) / math.gamma(k / 2)
        assert tails.chi2_sf(x, df) == pytest.approx(integral(density, x, x + 120), rel=1e-6)
    for t, df in ((-1.7, 7), (0.4, 12)):
        scale = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2)
        middle = integral(lambda v, d=df, s=scale: s * (1 + v * v / d) ** (-(d + 1) / 2), -abs(t), abs(t))
        assert tails.t_two_sided(t, df) == pytest.approx(1 - middle, rel=1e-6)
        assert tails.t_two_sided(tails.t_quantile(0.9, df), df) == pytest.approx(0.2, rel=1e-6)
    assert tails.normal_two_sided(1.3) == pytest.approx(2 * (1 - statistics.NormalDist().cdf(1.3)))


def test_guards(spark):
    a, b = spark.range(5), spark.range(4, 9)
    with pytest.raises(guards.GuardError):
        guards.assert_no_leakage(a, b, "id")
    guards.assert_no_leakage(spark.range(4), b, "id")
    with pytest.raises(guards.GuardError):
        guards.assert_counts(rows=(3, 4))


def test_split_sizes_and_reruns(spark):
    df = spark.range(450)
    one = sampling.holdout_split(df, "id", 0.2).where("is_test").select("id").collect()
    two = sampling.holdout_split(df.repartition(7), "id", 0.2).where("is_test").select("id").collect()
    assert len(one) == 90 and sorted(one) == sorted(two)


def test_top_groups(spark):
    rows = [(g,) for g, n in (("river", 3), ("brook", 7), ("lake", 3), ("mere", 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "e string")
    assert [r.e for r in sampling.top_groups(df, "e", 2).collect()] == ["brook", "lake"] and sampling.top_groups(df, "e", 9).count() == 4


def test_small_blocks_merge(spark):
    at = {4: (0, 0, 5), 7: (40, 0, 4), 9: (0, 90, 2), 12: (33, 5, 1)}
    rows = [(i, x + i * 0.1, float(y), b) for b, (x, y, n) in at.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id int, x double, y double, b int").withColumn("was", F.col("b"))
    got = {r.was: r.b for r in sampling.merge_small_blocks(df, "x", "y", "b", 3).collect()}
    assert got == {4: 4, 7: 7, 9: 4, 12: 7}
    assert all(r.b is None for r in sampling.merge_small_blocks(df, "x", "y", "b", 10).collect())


def test_cramers_v_and_ranks(spark):
    same = spark.createDataFrame([(i % 4, i % 4) for i in range(100)], "a int, b int")
    assert stats.cramers_v(same, "a", "b").first().v == pytest.approx(1.0)
    up = spark.createDataFrame([(float(i + 100 * (i % 2)), i % 2) for i in range(20)], "v double, g int")
    r = stats.mann_whitney(up, "v", "g").first()
    assert r.r == pytest.approx(1.0) and r.direction == "higher"


def test_morans_i_of_halves(spark):
    rows = [(i, float(i % 9), float(i // 9), 2.0 if i // 9 < 4 else 0.5) for i in range(72)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double")
    links = stats.neighbours(df, "id", "x", "y", 4, 1.0)
    assert stats.morans_i(df, links, "id", "z").first().morans_i > 0.7
    mixed = df.withColumn("z", F.pmod(F.xxhash64("id"), F.lit(97)).cast("double"))
    assert abs(stats.morans_i(mixed, links, "id", "z").first().morans_i) < 0.3


def test_permutation_p_is_that_of_plain_permutations(spark):
    rng = np.random.default_rng(5)
    clustered = [(i, float(i % 12), float(i // 12), float(i // 12 < 5) + 0.1 * rng.random(), float(rng.random()), "a" if i % 2 else "b") for i in range(120)]
    df = spark.createDataFrame(clustered, "id int, x double, y double, z double, r double, g string").repartition(3)
    links = stats.neighbours(df, "id", "x", "y", 4, 1.5)
    near = links.select("i", "j").collect()
    for c, column in ((3, "z"), (4, "r")):
        v = np.array([row[c] for row in clustered])
        z = v - v.mean()
        w = np.zeros((120, 120))
        for r in near:
            w[r.i, r.j] = 1
        w /= w.sum(axis=1, keepdims=True)
        i_of = lambda q: 120 / w.sum() * (q @ w @ q) / (z @ z)
        over = sum(i_of(np.random.default_rng([7, k]).permutation(z)) >= i_of(z) - 1e-12 for k in range(1, 61))
        got = stats.permutation_p(df, links, "id", column, permutations=60, seed=7).first()
        assert got.morans_i == pytest.approx(i_of(z)) and got.p == pytest.approx((over + 1) / 61) and got.n == 120 and got.links == len(near)
        assert got.verdict == ("clustered" if got.p < 0.05 else "spatially_random") and got.expected == pytest.approx(-1 / 119)
    by = stats.permutation_p(df, links.join(df.select(F.col("id").alias("i"), "g"), "i"), "id", "z", ["g"], permutations=20)
    assert {r.g for r in by.collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        stats.permutation_p(df, links, "id", "z", most=10)


def test_dense_cells_are_divided(spark):
    rng = np.random.default_rng(2)
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.3, (150, 2)))]
    p = spark.createDataFrame(at, "i long, x double, y double")
    whole, parts = ({(r.i, r.j) for r in stats.pairs_within(p, p, 0.5, cell).collect()} for cell in (4096, 7))
    expected = {(a[0], b[0]) for a in at for b in at if a[0] != b[0] and math.dist(a[1:], b[1:]) <= 0.5}
    assert whole == parts == expected


def test_running_sums_of_a_hot_group(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else f"g{i % 40}", float(v), int(i % 7)) for i, v in enumerate(rng.permutation(900))]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    for r in running.running_sums(df, "v", {"upto": "n"}, within=["g"], rows=40).collect():
        assert r.upto == sum(n for g, v, n in rows if g == r.g and v <= r.v)
    whole = {r.v: r.upto for r in running.running_sums(df, "v", {"upto": "n"}, descending=True, rows=40).collect()}
    assert whole == {v: sum(n for _, o, n in rows if o >= v) for _, v, _ in rows}


def test_nearest_reaches_as_far_as_it_must(spark):
    rng = np.random.default_rng(3)
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (60, 2)))] + [(60, 400.0, 0.0), (61, 400.0, 0.0), (62, None, 1.0), (63, float("nan"), 1.0)]
    got = {(r.i, r.n): r.j for r in stats.nearest(spark.createDataFrame(at, "id long, x double, y double"), "id", "x", "y", 3, 0.25).collect()}
    known = at[:62]
    want = {}
    for i, x, y in known:
        others = sorted((np.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in known if j != i)
        want |= {(i, n + 1): j for n, (_, j) in enumerate(others[:3])}
    assert got == want
    few = spark.createDataFrame(at[:2], "id long, x double, y double")
    assert stats.nearest(few, "id", "x", "y", 3, 0.25).count() == 2
    assert stats.nearest(few.limit(0), "id", "x", "y", 3, 0.25).count() == 0


def test_screen_choices():
    m = np.array([[1, 0.85, 0.2, 0.3, 0.1], [0.85, 1, 0.5, 0.55, 0.4], [0.2, 0.5, 1, 0, 0], [0.3, 0.55, 0, 1, 0], [0.1, 0.4, 0, 0, 1]])
    names = ["slope", "rough", "wet", "clay", "road"]
    assert stats.choose_of_pair("slope", "rough", names, m) == "rough"
    assert stats.choose_of_pair("slope", "rough", names, m, {frozenset(("slope", "rough")): "slope"}) == "slope"


def test_bootstrap_brackets_auc(spark):
    df = spark.createDataFrame([("a", int(i % 3 == 0), float((i * 37) % 100 + 40 * (i % 3 == 0))) for i in range(300)], "m string, y int, s double")
    r = stats.bootstrap_auc(df, "y", "s", ["m"], replicates=200).first()
    assert r.low < metrics.auc(df, "y", "s").first().auc < r.high and r.replicates == 200


def test_quantiles_over_many_ranges(spark):
    rng = random.Random(12)
    rows = [(g, float(rng.randrange(400))) for g in ("a", "b", None) for _ in range({"a": 3000, "b": 40, None: 7}[g])]
    df = spark.createDataFrame([*rows, ("a", None), ("c", None)], "g string, v double")
    ps = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = {r.g: r.quantiles for r in running.quantiles(df, "v", ps, ["g"]).collect()}
    assert got.keys() == {"a", "b", None}
    for g, found in got.items():
        assert found == pytest.approx(list(np.quantile([v for h, v in rows if h == g], ps)))
    assert running.quantiles(df, "v", ps).first().quantiles == pytest.approx(list(np.quantile([v for _, v in rows], ps)))
    distinct = df.where("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in running.running_sums(distinct, "v", {"upto": "n"}, descending=True, within=["g"], parts=50, rows=9).collect():
        assert r.upto == sum(v >= r.v for g, v in rows if g == r.g)
    cuts = sorted(rng.choice(range(60)) for _ in range(75))
    probe = spark.range(-2, 63).select("id", running.count_below(F.array(*[F.lit(c).cast("long") for c in cuts]), F.col("id")).alias("under"), running.count_below(F.array(*[F.lit(c).cast("long") for c in cuts]), F.col("id"), True).alias("upto"))
    assert all((r.under, r.upto) == (sum(c < r.id for c in cuts), sum(c <= r.id for c in cuts)) for r in probe.collect())


def test_within_reach_to_the_last_digit(spark):
    # what SQL finds: x between the rounded bounds, and squares that aren't over reach's
    at = [(2 * k + s, (k + 50 * s) / 100) for k in range(0, 6600, 60) for s in (0, 1)]
    at += [(20000 + 2 * k + s, (k + 50 * s) / 100) for k in (1, 2, 3, 4) for s in (0, 1)]
    p = spark.createDataFrame([(i, x, 0.0) for i, x in at], "i long, x double, y double")
    want = {(i, j) for i, x in at for j, u in at if i != j and x - 0.5 <= u <= x + 0.5 and (x - u) * (x - u) <= 0.25}
    roots = {(i, j) for i, x in at for j, u in at if i != j and math.sqrt((x - u) * (x - u)) <= 0.5}
    assert want != roots
    assert {(r.i, r.j) for r in stats.pairs_within(p, p, 0.5).collect()} == want


def test_neighbours_of_copies_and_crowds(spark):
    # many rows of one place, a crowd and loners: places search near first, and ties go to the smaller key
    rng = np.random.default_rng(8)
    at = [(i, 1.0, 1.0) for i in range(0, 90, 3)] + [(i, float(x), float(y)) for i, (x, y) in zip(range(1, 900, 3), np.round(rng.normal(1, 0.5, (300, 2)), 1), strict=True)] + [(5000, 9.0, 9.0), (5001, 11.9, 9.0), (5002, 40.0, 40.0)]
    df = spark.createDataFrame(at, "id long, x double, y double")
    want = {}
    for i, x, y in at:
        others = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in at if j != i and (x - u) ** 2 + (y - v) ** 2 <= 9)
        want |= {(i, n + 1): j for n, (_, j) in enumerate(others[:4])}
    assert {(r.i, r.n): r.j for r in stats.neighbours(df, "id", "x", "y", 4, 3.0).collect()} == want
    groups = [(i, x, y, i % 5) for i, x, y in at]
    least = {}
    for i, x, y, g in groups:
        d = min((math.sqrt((x - u) ** 2 + (y - v) ** 2) for _, u, v, h in groups if h != g), default=9.0)
        if d <= 3:
            least[g, round(d, 9)] = least.get((g, round(d, 9)), 0) + 1
    found = stats.nearest_of_others(spark.createDataFrame(groups, "id long, x double, y double, g long"), "x", "y", "g", 3.0)
    assert {(r.g, r.d): r.n for r in found.groupBy("g", F.round("d", 9).alias("d")).agg(F.sum("n").alias("n")).collect()} == least
    # the same pairs whichever side is sent around
    p = stats.points(df, "id", "x", "y")
    sides = [{(r.i, r.j) for r in stats._met(p, p.withColumnRenamed("i", "j"), 0.4, 7, side).collect()} for side in (True, False)]
    assert sides[0] == sides[1]
