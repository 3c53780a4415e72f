"""Fits in shared scans: optima, against another solver, row sets, categories, missing values."""

import random

import pytest
from pyspark.sql import functions as F

from siltmark.operators import arms, fitting


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for k in range(900):
        u, v, c = rng.uniform(-2, 5), rng.gauss(0, 2), rng.choice([1, 2, 7])
        data.append((k, u, None if k % 50 == 0 else v, c, k % 4, int(rng.random() < 1 / (1 + 2.7 ** -(u - 2 + 0.3 * v + (c == 7))))))
    return spark.createDataFrame(data, "key int, u double, v double, c int, fold int, presence int")


def test_fits_are_optima_and_do_not_depend_on_company(spark, rows):
    sets = {f"not{k}": F.col("fold") != k for k in range(3)}
    fits = {f"{s}|{b}|{c}": fitting.Fit(("u", "v"), s, b, c) for s in ("all", *sets) for b in (0.25, 4.0) for c in ("L", "LQ")}
    models = fitting.fit_all(rows, "presence", fits, sets)
    conditions = {"all": F.lit(True)} | sets
    for r in fitting.gradients(rows, "presence", {n: (m, ["u", "v"], conditions[fits[n].rows]) for n, m in models.items()}).collect():
        assert r.worst < 1e-3 and models[r.arm].fitted["converged"]
        train = rows.where(conditions[fits[r.arm].rows]).dropna(subset=["v"])
        assert (r.n, r.presences) == (train.count(), train.where("presence = 1").count()) == (models[r.arm].fitted["rows"], models[r.arm].fitted["presences"])
    alone = fitting.fit_all(rows.where("fold <> 1"), "presence", {"x": fitting.Fit(("u", "v"), beta=0.25)})["x"]
    for table in ("linear", "quadratic"):
        for c, t in getattr(alone, table).items():
            assert getattr(models["not1|0.25|LQ"], table)[c] == pytest.approx(t, abs=1e-4)


def test_coefficients_are_those_of_another_solver(spark, rows):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    own = fitting.fit_all(rows, "presence", {"x": fitting.Fit(("u",), beta=2.0, classes="L")})["x"]
    low, high = rows.agg(F.min("u"), F.max("u")).first()
    n, m = rows.where("presence = 1").count(), rows.where("presence = 0").count()
    ready = VectorAssembler(inputCols=["f"], outputCol="features").transform(rows.select(F.col("presence").cast("double").alias("label"), ((F.col("u") - low) / (high - low)).alias("f"), F.when(F.col("presence") == 1, 1.0).otherwise(100.0).alias("w")))
    other = LogisticRegression(elasticNetParam=1.0, regParam=2.0 * n**0.5 / (n + 100 * m), weightCol="w", maxIter=500, tol=1e-10, standardization=False).fit(ready)
    assert own.linear["u"][0] == pytest.approx(other.coefficients[0], rel=1e-3)
    assert own.fitted["intercept"] == pytest.approx(other.intercept, rel=1e-3)


def test_categories_have_a_term_each(spark, rows):
    m = fitting.fit_all(rows, "presence", {"x": fitting.Fit(("u", "c"), classes="L")}, categorical=["c"])["x"]
    assert m.categorical["c"][7.0] > max([0.0, *(v for k, v in m.categorical["c"].items() if k != 7.0)])
    assert set(m.linear) == {"u"}


def test_fits_of_constant_and_missing_rows(spark, rows):
    flat = rows.withColumn("u", F.lit(3.0))
    m = fitting.fit_all(flat, "presence", {"flat": fitting.Fit(("u",)), "none": fitting.Fit(("v",), "empty")}, {"empty": F.lit(False)})
    assert m["flat"].linear["u"][0] == 0 and m["none"].fitted["rows"] == 0 and m["none"].linear["v"][0] == 0
    assert fitting.fit_all(rows.limit(0), "presence", {"x": fitting.Fit(("u",))})["x"].linear["u"][0] == 0


def test_more_row_sets_than_a_long_has_bits(spark, rows):
    sets = {str(k): F.col("key") % 70 != k for k in range(70)}
    models = fitting.fit_all(rows, "presence", {s: fitting.Fit(("u",), s, classes="L") for s in sets}, sets)
    for s in ("0", "61", "62", "69"):
        assert models[s].fitted["rows"] == rows.where(sets[s]).count()
    got = {r.fold: r for r in arms.fold_aucs(rows.withColumn("fold", F.col("key") % 70), "fold", "presence", ["u"], "key").collect()}
    assert len(got) == 70 and got["69"].n_test + got["69"].n_train == 900


def test_grid_and_jackknife(spark, rows):
    grid = arms.aicc_grid(rows, "presence", ["u", "v"], (0.5, 1.0), ("L", "LQ")).collect()
    assert len(grid) == 4 and grid[0].delta == 0 and {r.n for r in grid} == {rows.where("presence = 1 and v is not null").count()}
    train, test = rows.where("fold > 0"), rows.where("fold = 0")
    got = {r.arm: r.auc for r in arms.jackknife(train, test, "presence", ["u", "v"]).collect()}
    assert set(got) == {"all", "without_u", "without_v", "only_u", "only_v"} and got["without_u"] == pytest.approx(got["only_v"], abs=1e-6)


def test_equal_rows_are_counted(spark):
    rows = [(i % 3 == 0 or i % 7 == 1, float(i % 5), float(i % 4)) for i in range(2000)]
    df = spark.createDataFrame([(int(y), a, b) for y, a, b in rows], "y int, a double, b double")
    of = fitting.counted(df, {c: F.col(c) for c in df.columns})
    assert of.count() <= 40 and of.agg(F.sum(fitting.ROWS)).first()[0] == 2000
    fit = {"f": fitting.Fit(("a", "b"))}
    whole, few = fitting.fit_all(df, "y", fit)["f"], fitting.fit_all(of, "y", fit, rows=fitting.ROWS)["f"]
    assert whole.fitted["rows"] == few.fitted["rows"] == 2000 and whole.fitted["presences"] == sum(y for y, _, _ in rows)
    assert whole.linear == few.linear and whole.quadratic == few.quadratic
    arms = {"f": (whole, ["a", "b"], None)}
    one, two = fitting.scored(df, "y", arms).first(), fitting.scored(of, "y", arms, rows=fitting.ROWS).first()
    assert one == two and one.n_pos + one.n_neg == 2000
    one, two = fitting.likelihoods(df, "y", arms)["f"], fitting.likelihoods(of, "y", arms, fitting.ROWS)["f"]
    assert one[0] == two[0] and abs(one[1] - two[1]) < 1e-6
    of.unpersist()
