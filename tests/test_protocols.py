import math
import random

import pytest
from pyspark.sql import functions as F

from siltmark.functions import projection
from siltmark.operators import arms, fitting, guards, protocols


def conic_forward(lat, lon, c):
    """Of degrees, from the projection's definition."""
    n, f, r0 = c.constants
    r = f * c._t(math.radians(lat)) ** n
    t = n * math.radians(lon - c.longitude)
    return c.x0 + r * math.sin(t), c.y0 + r0 - r * math.cos(t)


def test_conic_coordinates_come_back(spark):
    places = [(lat, lon) for lat in (37.5, 38 + 20 / 60, 39.2, 40.0) for lon in (-102.0, -98.0, -95.3)]
    rows = [(k, *conic_forward(*p, projection.STATE_PLANE)) for k, p in enumerate(places)]
    lat, lon = projection.STATE_PLANE.geographic(F.col("x"), F.col("y"))
    got = spark.createDataFrame(rows, "k int, x double, y double").select("k", F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon")).collect()
    assert all((r.lat, r.lon) == pytest.approx(places[r.k], abs=1e-9) for r in got)
    assert rows[4][1:] == pytest.approx((400000.0, 0.0), abs=1e-6)


def test_mercator_keeps_the_meridian_and_angles(spark):
    e2, a = projection._E2, projection.A
    grid = projection.UTM_14

    def arc(lat, n=2000):
        h = math.radians(lat) / n
        f = lambda p: a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
        return h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(k * h) for k in range(n + 1))

    step = 1e-5
    rows = [(k, lat, lon + dx, dy) for k, (lat, lon) in enumerate([(39.0, -99.0), (38.4, -96.6), (40.1, -101.2)]) for dx, dy in ((0.0, 0.0), (step, 0.0), (0.0, step))]
    x, y = grid.project(F.radians(F.col("lat") + F.col("dy")), F.radians("lon"))
    got = spark.createDataFrame(rows, "k int, lat double, lon double, dy double").select("k", x.alias("x"), y.alias("y")).collect()
    assert (got[0].x, got[0].y) == pytest.approx((500000.0, 0.9996 * arc(39.0)), abs=1e-3)
    for k in range(3):  # conformal: steps to the east and north are at right angles
        p, e, n = got[3 * k : 3 * k + 3]
        (a1, b1), (a2, b2) = (e.x - p.x, e.y - p.y), (n.x - p.x, n.y - p.y)
        assert abs(a1 * a2 + b1 * b2) < 1e-3 * math.hypot(a1, b1) * math.hypot(a2, b2)


def test_survey_points_drop_what_is_missing_or_out_of_bounds(spark):
    df = spark.createDataFrame([(1, 1312333.0, 100.0), (2, None, 5.0), (3, 9e6, 9e6)], "id int, easting_ft double, northing_ft double")
    assert [r.id for r in protocols.survey_points(df, bounds=(4e5, 4e6, 8e5, 5e6)).collect()] == [1]
    assert {r.id for r in protocols.survey_points(df).collect()} == {1, 3}


def rows_of(spark, n=240):
    rng = random.Random(3)
    return spark.createDataFrame([(i, rng.uniform(0, 30), rng.uniform(0, 30), i % 3, int(rng.random() < 0.3), float(rng.randrange(9)), f"g{i % 5}") for i in range(n)], "key int, x double, y double, fold int, presence int, a double, g string")


def test_buffers_leave_out_what_is_near(spark):
    df = rows_of(spark)
    rows = df.collect()
    for r in protocols.buffered_sizes(df, "fold", "key", "x", "y", "presence", (0.0, 1.5, 4.0)).collect():
        held = [t for t in rows if t.fold == r.fold and t.presence]
        far = [q for q in rows if q.fold != r.fold and (not r.buffer or all(math.dist((q.x, q.y), (t.x, t.y)) > r.buffer for t in held))]
        assert (r.n_train, r.n_test) == (len(far), 80)
        test = df.where(F.col("fold") == r.fold)
        left = protocols.beyond(df.where(F.col("fold") != r.fold), test.where("presence = 1"), "x", "y", r.buffer)
        assert {q.key for q in left.collect()} == {q.key for q in far}


def test_buffered_folds_train_on_what_is_beyond(spark):
    df = rows_of(spark)
    got = {r.buffer: r for r in protocols.buffered_folds(df, "fold", "key", "x", "y", "presence", ["a", "x"], (0.0, 1.5, 50.0), least=10).collect()}
    assert [(r.folds, r.skipped) for r in (got[0.0], got[1.5], got[50.0])] == [(3, 0), (3, 0), (0, 3)]
    for b in (0.0, 1.5):
        auc = []
        for v in range(3):
            test = df.where(F.col("fold") == v)
            train = protocols.beyond(df.where(F.col("fold") != v), test.where("presence = 1"), "x", "y", b)
            fitted = fitting.fit_all(train, "presence", {"one": fitting.Fit(("a", "x"))})["one"]
            auc.append(fitting.scored(test, "presence", {"one": (fitted, ["a", "x"], None)}).first()["auc"])
        assert got[b]["mean"] == pytest.approx(sum(auc) / 3, abs=1e-6)


def test_nested_tuning_takes_the_best_of_the_other_folds(spark):
    df = rows_of(spark, 300)
    got = protocols.nested_tuning(df, "fold", "key", "presence", ["a", "x"], betas=(0.5, 2.0), classes=("L", "LQ")).collect()
    assert len(got) == 3
    for r in got:
        grid = arms.aicc_grid(df.where(F.col("fold") != int(r.fold)), "presence", ["a", "x"], (0.5, 2.0), ("L", "LQ")).collect()
        assert r.aicc == pytest.approx(min(g.aicc for g in grid), rel=1e-6) and (r.beta, r.classes) in {(g.beta, g.classes) for g in grid if g.aicc < r.aicc + 1e-3}


def test_nested_models_and_their_increments(spark):
    df = rows_of(spark)
    found = {(r.arm, r.against): (r.auc, r.increment) for r in protocols.conditional_importance(df, df, "presence", ["a", "x", "y"], "a", ["x"]).collect()}
    assert {k[0] for k in found} == {"confounders", "focal", "confounders+focal", "full", "full-focal"}
    for a, b in (("confounders+focal", "confounders"), ("confounders+focal", "focal"), ("full", "full-focal")):
        assert found[a, b][1] == pytest.approx(found[a, None][0] - found[b, None][0])
    single = {r.arm: r for r in protocols.single_predictors(df, df, "presence", ["a", "x"], {"both": ["x", "a"]}).collect()}
    assert single["both"].delta == pytest.approx(0, abs=1e-6) and single["baseline"].layers == 2 and single["a"].auc == pytest.approx(found["focal", None][0])
    assert single["a"].pct_of_full == pytest.approx(100 * single["a"].auc / single["baseline"].auc)
    arm = protocols.pooled_groups_arm(df, "g", "presence", ["a"], 2).first()
    top = {r.g for r in protocols.top_groups(df.where("presence = 1"), "g", 2).collect()}
    background = df.where("presence = 0").count()
    assert arm.n_train == background + df.where(F.col("presence") == 1).where(F.col("g").isin(*top)).count() and arm.n_train + arm.n_test == 240 + background


def test_refits_on_parts_of_the_rows(spark):
    df = rows_of(spark, 400)
    train, test = df.where("key % 3 > 0"), df.where("key % 3 = 0")
    one = protocols.stratum_refit("s", train, test, F.col("a") > 3, "presence", ["x", "y"]).first()
    assert (one.n_train, one.n_test) == (train.where("a > 3").count(), test.where("a > 3").count())
    own = fitting.fit_all(train.where("a > 3"), "presence", {"f": fitting.Fit(("x", "y"))})["f"]
    assert one.auc == pytest.approx(fitting.scored(test.where("a > 3"), "presence", {"f": (own, ["x", "y"], None)}).first()["auc"], abs=1e-6)
    coarse = {r.arm: r for r in protocols.coarse_arm(df.withColumns({"r": F.col("key") % 40, "c": F.col("key") % 7}), "r", "c", 2, "presence", ["x", "y"], "key").collect()}
    assert coarse["baseline"].n_train + coarse["baseline"].n_test == 400 and coarse["baseline"].delta == 0 and coarse["coarse_2"].n_train == round(0.7 * (coarse["coarse_2"].n_train + coarse["coarse_2"].n_test))
    train, test = (d.withColumn("presence", ((F.col("x") > 20) | (F.col("key") % 7 == 0) & (F.col("a") > 4)).cast("int")) for d in (train, test))
    lost = protocols.matched_importances(train, test, "presence", ["a", "x"], "x", "key", 80).collect()
    assert sorted(r.baseline_rank for r in lost) == [1, 2] and all(r.change == pytest.approx(r.matched - r.baseline) for r in lost)


def test_a_key_in_two_folds_is_an_error(spark):
    df = rows_of(spark).unionByName(rows_of(spark, 1).withColumn("fold", F.lit(2)))
    with pytest.raises(guards.GuardError):
        arms.fold_aucs(df, "fold", "presence", ["a"], "key")


def test_detected_parts_and_summaries(spark):
    cells = spark.createDataFrame([(r, c, -20.0 if (r < 2 and c < 2) or (r, c) == (5, 5) else -3.0) for r in range(7) for c in range(7)], "row long, col long, value double")
    assert {(r.row, r.col) for r in protocols.detected_mask(cells, "value", -10.0, 3).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    one = protocols.over_replicates(spark.createDataFrame([(2.5,)], "auc double"), ["auc"]).first()
    assert (one.n, one["mean"], one.sd) == (1, 2.5, 0.0)
    assert arms.summary_of_folds(spark.createDataFrame([(0.8, 10), (0.6, 30), (None, 5)], "auc double, n_test long")).first().weighted_mean == pytest.approx(0.65)
