"""Ensembles against plain loops: splits, leaf order, stopping, attributions by subsets, ordered statistics by windows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.operators import metrics, trees

RNG = np.random.default_rng(3)
#: Splits are found among all: none is drawn.
WHOLE = trees.Recipe(rows=1.0, columns=1.0, patience=0, trees=1)


def counted(n=120, layers=3, bins=6):
    x = RNG.integers(0, bins, (n, layers))
    y = (RNG.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 3 + (x[:, 1] > 2))))).astype(float)
    return x, y, RNG.integers(1, 4, n).astype(float), [np.arange(bins - 1) + 0.5] * layers


def gain_of(g, h, w, go, r):
    def score(m):
        return g[m].sum() ** 2 / (h[m].sum() + r.l2)

    if min(w[go].sum(), w[~go].sum()) < r.least_rows or min(h[go].sum(), h[~go].sum()) < r.least_curvature:
        return -1.0
    return score(go) + score(~go) - score(np.ones(len(g), bool))


@pytest.mark.parametrize("recipe", [trees.replace(WHOLE, depth=3), trees.replace(WHOLE, depth=4, leaves=5, l2=0.5, least_rows=7.0)])
def test_splits_are_the_best_of_all(recipe):
    x, y, w, cuts = counted()
    p = np.full(len(y), 0.5)
    g, h = (p - y) * w, p * (1 - p) * w
    nodes = trees._Nodes()
    value = trees.grow(x, cuts, g, h, w, recipe, np.random.default_rng(0), nodes)
    waiting, leaves, depth = {0: np.ones(len(y), bool)}, 1, {0: 0}
    expected = {}
    while leaves < recipe.leaves:
        offers = []
        for n, m in waiting.items():
            if depth[n] < recipe.depth:
                best = max(((gain_of(g[m], h[m], w[m], x[m, f] <= k, recipe), -f, -k) for f in range(3) for k in range(5) if 0 < (x[m, f] <= k).sum() < m.sum()), default=(0, 0, 0))
                if best[0] > 1e-9:
                    offers.append((best[0], -n, -best[1], -best[2]))
        if not offers:
            break
        _, n, f, k = max(offers, key=lambda o: (round(o[0], 9), o[1]))
        n = -n
        m = waiting.pop(n)
        assert (nodes.layer[n], nodes.threshold[n]) == (f, k + 0.5)
        for child, part in ((nodes.left[n], m & (x[:, f] <= k)), (nodes.right[n], m & (x[:, f] > k))):
            waiting[child], depth[child] = part, depth[n] + 1
        leaves += 1
    for n, m in waiting.items():
        expected[n] = -g[m].sum() / (h[m].sum() + recipe.l2)
        assert nodes.layer[n] == -1 and nodes.value[n] == pytest.approx(expected[n]) and value[m] == pytest.approx(expected[n])
    assert len(nodes.layer) == 2 * leaves - 1


def loss(y, w, margin):
    return float((w * np.logaddexp(0, np.where(y == 1, -margin, margin))).sum())


@pytest.mark.parametrize("name", ["boosted_depth_wise", "boosted_leaf_wise", "boosted_ordered"])
def test_boosting_lowers_the_loss(name):
    x, y, w, cuts = counted(300)
    r = trees.replace(trees.RECIPES[name], rows=1.0, columns=1.0, trees=40, patience=0, least_rows=3.0)
    m = trees.train(x, y, w, np.zeros(len(y), bool), cuts, ["a", "b", "c"], r, 1)
    weight = w * np.where(y == 1, w[y != 1].sum() / w[y == 1].sum(), 1.0)
    losses, margin = [loss(y, weight, np.zeros(len(y)))], np.zeros(len(y))
    for k in range(len(m.start)):
        one = trees.replace(m, start=m.start[k : k + 1])
        margin = margin + one.margins(x.astype(float))
        losses.append(loss(y, weight, margin))
    assert all(b <= a + 1e-9 for a, b in itertools.pairwise(losses)) and losses[-1] < 0.9 * losses[0]
    assert m.predict(x) == pytest.approx(1 / (1 + np.exp(-margin)))


def test_rounds_stop_where_a_plain_loop_stops():
    x, y, w, cuts = counted(400)
    held = RNG.random(400) < 0.3
    r = trees.replace(trees.RECIPES["boosted_depth_wise"], trees=120, patience=8)
    m = trees.train(x, y, w, held, cuts, ["a", "b", "c"], r, 1)
    # areas of every prefix, again from the ensemble without stopping
    whole = trees.train(x, y, w, held, cuts, ["a", "b", "c"], trees.replace(r, patience=1000), 1)
    areas = []
    full = trees.train(x, y, w, held, cuts, ["a", "b", "c"], trees.replace(r, patience=0), 1)
    for k in range(len(full.start)):
        score = trees.replace(full, start=full.start[: k + 1]).margins(x.astype(float))
        pairs = [(w[i] * w[j], (score[i] > score[j]) + 0.5 * (abs(score[i] - score[j]) < 1e-12)) for i in np.flatnonzero(held & (y == 1)) for j in np.flatnonzero(held & (y == 0))]
        areas.append(sum(a * b for a, b in pairs) / sum(a for a, _ in pairs))
        if k == 25:
            break
    assert whole.history[: len(areas)] == pytest.approx(areas, abs=1e-9)
    best, stop = 0, None
    for k, v in enumerate(full_history := whole.history):
        if v > full_history[best]:
            best = k
        elif k - best >= 8:
            stop = k
            break
    assert len(m.start) == best + 1 and (stop is None or len(m.history) == stop + 1)


def test_attributions_are_those_of_all_subsets():
    x, y, w, cuts = counted(200, 3)
    for name in ("boosted_depth_wise", "boosted_ordered", "random_forest"):
        m = trees.train(x, y, w, np.zeros(len(y), bool), cuts, ["a", "b", "c"], trees.replace(trees.RECIPES[name], trees=4, patience=0), 2)

        def expected(row, known, m=m):
            def walk(n):
                f = m.layer[n]
                if f < 0:
                    return m.value[n]
                l, r = m.left[n], m.right[n]
                if f in known:
                    return walk(l if row[f] <= m.threshold[n] else r)
                return (m.cover[l] * walk(l) + m.cover[r] * walk(r)) / m.cover[n]

            return m.base + sum(walk(s) for s in m.start)

        rows = x[:15].astype(float)
        phi, base = m.attributions(rows)
        assert phi.sum(axis=1) + base == pytest.approx(m.margins(rows))
        for i, row in enumerate(rows):
            assert expected(row, set()) == pytest.approx(base)
            for f in range(3):
                rest = [o for o in range(3) if o != f]
                total = 0.0
                for size in range(3):
                    for s in itertools.combinations(rest, size):
                        total += math.factorial(size) * math.factorial(2 - size) / 6 * (expected(row, {*s, f}) - expected(row, set(s)))
                assert phi[i, f] == pytest.approx(total, abs=1e-9)


def test_a_forest_is_the_mean_of_its_parts():
    x, y, w, cuts = counted(150)
    r = trees.replace(trees.RECIPES["random_forest"], trees=6)
    parts = [trees.train(x, y, w, np.zeros(len(y), bool), cuts, ["a", "b", "c"], r, k, 3) for k in range(2)]
    m = trees.joined(parts)
    assert m.predict(x) == pytest.approx(sum(p.predict(x) for p in parts)) and len(m.start) == 6
    assert (m.cover[m.layer < 0] >= 5).all() and 0 <= m.predict(x).min() and m.predict(x).max() <= 1


def table(spark, n=600):
    rng = random.Random(2)
    data = []
    for k in range(n):
        a, c = rng.uniform(0, 9), rng.choice([3, 3, 3, 5, 8])
        data.append((k, a, None if k % 40 == 0 else rng.gauss(0, 1), c, int(rng.random() < (0.8 if (a > 6) != (c == 5) else 0.1)), k % 3))
    return spark.createDataFrame(data, "key long, a double, b double, c int, y int, fold int")


def test_models_of_folds_are_made_together(spark):
    df = table(spark)
    small = {n: trees.replace(r, trees=20) for n, r in trees.RECIPES.items()}
    sets = {str(v): F.col("fold") != v for v in range(3)}
    made = trees.fit_trees(df, "y", ["a", "b", "c"], "key", small, sets, categorical=["c"])
    assert set(made) == {(s, n) for s in sets for n in small}
    again = trees.fit_trees(df.repartition(5), "y", ["a", "b", "c"], "key", small, sets, categorical=["c"])
    models = {f"{s}|{n}": m for (s, n), m in made.items()}
    got = trees.scores(df, models, {k: F.col("fold") == int(k[0]) for k in models})
    assert got.count() == 600 * 4 and got.where("y_score is null").count() == got.where("b is null").count()
    auc = {r["model"]: r["auc"] for r in metrics.auc(got, "y", "y_score", ["model"]).collect()}
    assert len(auc) == 12 and min(auc.values()) > 0.6
    x = np.array([[5.0, 0.1, 3.0], [8.0, -1.0, 5.0], [8.0, -1.0, 77.0]])
    for k in made:
        assert made[k].predict(x) == pytest.approx(again[k].predict(x))
    # an unseen category stands at the mean label
    stat, other = made["0", "boosted_ordered"].statistics["c"]
    train = df.where("b is not null")
    mean, own = train.agg(F.avg("y")).first()[0], train.where("c = 5").agg(F.sum("y"), F.count("*")).first()
    assert other == pytest.approx(mean) and stat[5.0] == pytest.approx((own[0] + mean) / (own[1] + 1))


def test_more_rows_than_a_task_may_have_are_drawn(spark):
    made = trees.fit_trees(table(spark), "y", ["a", "b"], "key", {"f": trees.replace(trees.RECIPES["random_forest"], trees=2)}, most=100)
    assert 20 < made["all", "f"].cover[made["all", "f"].start].mean() < 200


def test_statistics_are_those_of_rows_drawn_before(spark):
    df = table(spark).withColumn("c", F.when(F.col("key") % 10 > 0, F.col("c")))
    got = {r["key"]: r["statistic"] for r in trees.ordered_statistics(df, "c", "y", "key").collect()}
    rows = df.withColumn("d", trees.draw(F.col("key"), 42)).collect()
    mean = sum(r["y"] for r in rows) / len(rows)
    for r in rows:
        before = [o["y"] for o in rows if o["c"] == r["c"] and o["d"] < r["d"]]
        assert got[r["key"]] == pytest.approx((sum(before) + mean) / (len(before) + 1))


def test_attributions_of_rows(spark):
    df = table(spark)
    made = trees.fit_trees(df, "y", ["a", "b", "c"], "key", {n: trees.replace(r, trees=15) for n, r in trees.RECIPES.items()}, categorical=["c"])
    models = {n: m for (_, n), m in made.items()}
    phi = trees.attributions(df, models, "key")
    whole = df.where("b is not null").count()
    assert phi.count() == whole * 3 * 4
    sums = phi.groupBy("model", "key").agg((F.sum("phi") + F.first("expected")).alias("margin"))
    scored = trees.scores(df.where("b is not null"), models).withColumn("m", F.when(F.col("model").startswith("boosted"), F.ln(F.col("y_score") / (1 - F.col("y_score")))).otherwise(F.col("y_score")))
    assert sums.join(scored, ["model", "key"]).where(F.abs(F.col("margin") - F.col("m")) > 1e-6).count() == 0
    summary = trees.attribution_summary(phi).collect()
    assert len(summary) == 12 and all(abs(sum(r["share"] for r in summary if r["model"] == n) - 1) < 1e-9 for n in models)
    assert all(r["direction"] > 0 for r in summary if r["layer"] == "a")


def test_scores_walk_rows_between_the_same_thresholds_once(monkeypatch):
    x, y, w, cuts = counted(200)
    for name in ("boosted_depth_wise", "boosted_ordered", "random_forest"):
        m = trees.train(x, y, w, np.zeros(len(y), bool), cuts, ["a", "b", "c"], trees.replace(trees.RECIPES[name], trees=6, patience=0), 2)
        walked, margins, scorer = [], trees.Ensemble.margins, trees._Scorer(m)
        monkeypatch.setattr(trees.Ensemble, "margins", lambda self, rows, margins=margins, walked=walked: (walked.append(len(rows)), margins(self, rows))[1])
        batches = [RNG.uniform(-1, 7, (1000, 3)) for _ in range(4)]
        got = [scorer(b) for b in batches]
        assert sum(walked) <= 6**3
        monkeypatch.setattr(trees.Ensemble, "margins", margins)
        assert all(np.array_equal(p, m.predict(b)) for p, b in zip(got, batches, strict=True))
    monkeypatch.setattr(trees, "KNOWN", 3)
    short = trees._Scorer(m)
    assert np.array_equal(short(batches[0]), m.predict(batches[0])) and len(short.known) == 3
    assert np.array_equal(short(batches[1]), m.predict(batches[1])) and len(short.known) == 3


def test_encodings_are_compared_on_counted_rows(spark, monkeypatch):
    from siltmark.operators import protocols

    rows = spark.createDataFrame([(k, float(k % 7), k % 4, int(k % 7 > 3 or k % 4 == 1 and k % 5 > 0)) for k in range(2000)], "key long, a double, c int, y int").withColumn("is_test", F.col("key") % 10 >= 7)
    small = {n: trees.replace(trees.RECIPES[n], trees=8) for n in ("random_forest", "boosted_leaf_wise")}
    seen, scores = [], trees.scores
    monkeypatch.setattr(trees, "scores", lambda df, models, *a, **k: (seen.append((df.count(), models)), scores(df, models, *a, **k))[1])
    got = {r["model"]: r for r in protocols.encoding_comparison(rows, "key", "y", ["a"], ["c"], "is_test", small).collect()}
    test = [r for r in rows.collect() if r.is_test]
    assert seen[0][0] == len({(r.a, r.c, r.y) for r in test})
    y = np.array([r.y for r in test])
    for n in small:
        for kind, x in (("ordinal", [[r.a, r.c] for r in test]), ("nominal", [[r.a, *(float(r.c == v) for v in range(4))] for r in test])):
            p = seen[0][1][f"{kind}|{n}"].predict(np.array(x, float))
            assert got[n][kind] == pytest.approx(trees.weighted_auc(y, p, np.ones(len(y))))


def test_all_rows_train_whatever_their_number(spark):
    n = 260_000
    df = spark.range(n).select(F.col("id").alias("key"), (F.col("id") * 1.0).alias("a"), (F.pmod(F.xxhash64("id"), F.lit(10)) < F.when(F.col("id") < n / 2, 2).otherwise(7)).cast("int").alias("y"))
    recipes = {"forest": trees.replace(trees.RECIPES["random_forest"], trees=2, depth=1), "boosted": trees.replace(trees.RECIPES["boosted_depth_wise"], rows=1.0, trees=2)}
    made = trees.fit_trees(df, "y", ["a"], "key", recipes)
    forest, boosted = made["all", "forest"], made["all", "boosted"]
    assert forest.cover[forest.start] == pytest.approx(n, rel=0.01)
    held = df.where(F.pmod(F.xxhash64("key", F.lit("held")), F.lit(1 << 30)) < int(trees.HELD * (1 << 30))).count()
    assert set(boosted.cover[boosted.start].tolist()) == {n - held}


def test_rows_that_one_model_does_not_tell_apart_are_one():
    x, y, w, _ = counted(150)
    held = np.arange(len(y)) % 4 == 0
    got = trees.merged(np.concatenate([x, x[:50]]), np.concatenate([y, y[:50]]), np.concatenate([w, w[:50]]), np.concatenate([held, held[:50]]))
    total = {}
    for row, of, n, h in [*zip(x.tolist(), y, w, held, strict=True), *zip(x[:50].tolist(), y[:50], w[:50], held[:50], strict=True)]:
        total[*row, of, h] = total.get((*row, of, h), 0) + n
    assert {(*row, of, h): n for row, of, n, h in zip(got[0].tolist(), got[1], got[2], got[3], strict=True)} == pytest.approx(total) and len(got[1]) == len(total)
    assert len(trees.merged(x[:0], y[:0], w[:0], held[:0])[0]) == 0
