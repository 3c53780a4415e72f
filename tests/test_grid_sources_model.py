import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.functions import scalars
from siltmark.operators import grid, model, sampling, zonal
from siltmark.sources import surveys, tables


def cells(spark, f, n=6, m=6):
    return spark.createDataFrame([(r, c, float(f(r, c))) for r in range(n) for c in range(m)], "row long, col long, value double")


def test_plane_has_no_curvature(spark):
    got = {(r.row, r.col): r for r in grid.slope_curvature(cells(spark, lambda r, c: 3 * c), 1.0).collect()}
    assert got[2, 2].slope == pytest.approx(math.degrees(math.atan(3))) and got[2, 2].curvature == pytest.approx(0)
    assert got[0, 0].slope is None


def test_focal_density_pads_with_zero(spark):
    d = {(r.row, r.col): r.density for r in grid.focal_density(cells(spark, lambda r, c: 1), 1, 1.0).collect()}
    assert d[2, 2] == pytest.approx(1) and d[0, 0] == pytest.approx(4 / 9)


def test_quantile_classes(spark):
    import numpy as np

    values = [float(k * k % 23) for k in range(37)]
    df = spark.createDataFrame([(0, c, v) for c, v in enumerate(values)], "row long, col long, value double")
    got = grid.quantile_classes(df, classes=4).orderBy("class").collect()
    edges = np.quantile(values, [0, 0.25, 0.5, 0.75, 1])
    assert [r.low for r in got] + [got[-1].high] == pytest.approx(list(edges))
    assert [r.n for r in got] == np.histogram(values, edges)[0].tolist()


def test_distance_without_sources_is_null(spark):
    df = cells(spark, lambda r, c: 0, 3, 3).withColumn("s", F.lit(False))
    assert grid.distance_to_source(df, "s").where("distance is not null").count() == 0


def test_valley_collects_flow(spark):
    df = cells(spark, lambda r, c: 10 * r + 5 * abs(c - 2), 8, 5)
    top = grid.flow_accumulation(df).orderBy(F.desc("accumulation")).first()
    assert (top.row, top.col, top.accumulation) == (0, 2, 40)


def test_polygon_and_zonal_mean(spark):
    ring = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]
    zones = spark.createDataFrame([(7, [{"x": x, "y": y} for x, y in ring])], "zone int, ring array<struct<x:double,y:double>>")
    put = grid.assign_zones(cells(spark, lambda r, c: r), zones, "zone", "ring", 1.0, 2.0)
    assert put.count() == 9
    assert zonal.zonal_mean(put, "zone", "value", 9).first().mean == pytest.approx(1.0)
    assert zonal.zonal_mean(put, "zone", "value", 10).first().mean is None


def squares_within(values, edges):
    at = np.clip(np.searchsorted(edges[1:-1], values, "left"), 0, len(edges) - 2)
    return sum(((values[at == k] - values[at == k].mean()) ** 2).sum() for k in set(at.tolist()))


def test_natural_breaks_are_the_best(spark):
    rng = np.random.default_rng(3)
    values = np.round(np.concatenate([rng.normal(0, 1, 30), rng.normal(9, 2, 20), rng.normal(30, 1, 9)]), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "value double")
    for classes in (2, 3, 4):
        edges, over = grid.natural_breaks(df, classes=classes)
        assert over == 0 and edges[0] == values.min() and edges[-1] == values.max() and len(edges) == classes + 1
        distinct = np.unique(values)
        best = min(squares_within(values, [distinct[0], *c, distinct[-1]]) for c in itertools.combinations(distinct[:-1], classes - 1))
        assert squares_within(values, edges) == pytest.approx(best)
    # between ranges of values: not better than the best, and not worse than the bound
    edges, over = grid.natural_breaks(df, classes=3, most=25)
    best = min(squares_within(values, [distinct[0], *c, distinct[-1]]) for c in itertools.combinations(distinct[:-1], 2))
    assert best - 1e-9 <= squares_within(values, edges) <= best + over
    assert grid.natural_breaks(df.limit(0)) == ([], 0.0) and grid.natural_breaks(spark.createDataFrame([(2.0,), (2.0,)], "value double"))[0] == [2.0, 2.0]


def test_classed_maps_by_either_method(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 50, 51, 52, 100, 101]], "value double")
    rows = grid.classed_map(df, classes=3, method="natural_breaks").orderBy("class").collect()
    assert [(r.low, r.high) for r in rows] == [(1, 3), (3, 52), (52, 101)] and [r.label for r in rows] == ["Class 1", "Class 2", "Class 3"]
    assert sum(r.n for r in grid.classed_map(df).collect()) == 8
    with pytest.raises(ValueError):
        grid.classed_map(df, method="equal")


def test_transforms(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (None,)], "v double")
    assert [r[0] for r in df.select(scalars.modelled("flow_accumulation", F.col("v"))).collect()] == [2.0, None, None]
    assert df.select(scalars.modelled("spi", F.col("v"))).first()[0] == pytest.approx(math.log1p(100))
    assert df.select(scalars.clamp01(F.col("v"), F.lit(5.0), F.lit(5.0))).first()[0] == 0


def test_curve_number(spark):
    df = spark.createDataFrame([(11, None, None), (41, 2, 0.0), (22, 1, 50.0), (99, 1, 0.0)], "cover int, soil int, imp double")
    got = [r[0] for r in df.select(scalars.curve_number(F.col("cover"), F.col("soil"), F.col("imp"))).collect()]
    assert got == [100.0, 55.0, 68.5, None]


def test_raw_log_looks_ahead(spark, tmp_path):
    folder = tmp_path / "2015_5_4"
    folder.mkdir()
    (folder / "a.rw5").write_text("--GS,PN12,N 10.5,E 20.5,EL7.25,--HW\n--x\n--HSDV:1,STATUS:FIXED\n--GS,PN13,N 1,E 2,EL3,--WH 2\nGPS,PN\nSTATUS:FIXED\n--GS,PN14,N 1,E 2,EL3,--EOW/L\nSTATUS:FLOAT\n--GS,PN15,N a,E 2,EL3,--HW\nSTATUS:FIXED\n")
    got = surveys.parse(surveys.read_lines(spark, str(folder)), "RW5").collect()
    assert [(r.pt_id, r.northing_ft, r.elevation_ft, r.type, r.event) for r in got] == [("12", 10.5, 7.25, "HW", "2015_5_4")]
    with pytest.raises(ValueError):
        surveys.parse(surveys.read_lines(spark, str(folder)), "Z")


def test_coefficients_and_attributions(spark):
    lines = ["a, 2.0, 0.0, 10.0", "a^2, -1.0, 0.0, 100.0", "(k=3.0), 0.5, 0.0, 1.0", "linearPredictorNormalizer, 1.5", "entropy, 9"]
    rows = tables.coefficients(spark.createDataFrame([(x,) for x in lines], "value string"), "value")
    assert tables.parameters(rows).first().k == 3
    m = model.Additive.of(rows)
    df = spark.createDataFrame([(0.0, 3), (10.0, 1)], "a double, k int")
    phi = model.attributions(df, m, ["a", "k"]).orderBy("a").collect()
    assert [r.phi_a for r in phi] == pytest.approx([-0.5, 0.5]) and [r.phi_k for r in phi] == pytest.approx([0.25, -0.25])
    with pytest.raises(ValueError):
        model.Additive.of(tables.coefficients(spark.createDataFrame([("a*b, 1, 0, 1",)], "value string"), "value"))


def test_text_grid_round_trip(spark):
    df = spark.createDataFrame([(0, 0, 1.5), (0, 2, -2.25), (1, 1, 1234567.0)], "row long, col long, value double")
    body = {r.row: r.line for r in tables.grid_lines(df, "value", 3).collect()}
    head = tables.text_grid_header(2, 3, 0, 0, 10).strip().split("\n")
    lines = spark.createDataFrame(list(enumerate([*head, body[0], body[1]])), "pos int, line string")
    back = {(r.row, r.col): r.value for r in tables.read_text_grid(lines).collect()}
    assert back == {(0, 0): 1.5, (0, 1): None, (0, 2): -2.25, (1, 0): None, (1, 1): 1234570.0, (1, 2): None}


def test_thinning_keeps_one_of_each_cell(spark):
    df = spark.createDataFrame([(i, float(i % 7) * 10, float(i % 5) * 10) for i in range(200)], "id int, x double, y double")
    assert sampling.thin(df, "x", "y", "id", 30.0).count() == 3 * 2


def test_cached_result(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), {"seed": 1}, make).count() == 3
    assert len(made) == 1


def test_stream_of_windows(spark, tmp_path):
    from siltmark.streaming import windows

    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0 value union all select timestamp'2024-01-01 05:00:00', 'a', 2.0").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    windows.run_to_table(windows.tumbling(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1


def test_comparators_are_whole_and_balanced(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    made = model.comparators()
    forest, boosted = made["random_forest"], made["boosted_trees"]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getWeightCol()) == (500, 30, model.WEIGHT)
    assert (boosted.getMaxIter(), boosted.getStepSize(), boosted.getValidationIndicatorCol()) == (500, 0.05, model.VALIDATION)
    df = spark.createDataFrame([(i, float(i % 50), float(i % 7), int(i % 50 > 46)) for i in range(1000)], "key long, a double, b double, y int")
    seen = []
    for cls, size in ((RandomForestClassifier, "numTrees"), (GBTClassifier, "maxIter")):
        fit = cls._fit
        monkeypatch.setattr(cls, "_fit", lambda self, rows, fit=fit: (seen.append(rows), fit(self, rows))[1])
        small = {RandomForestClassifier: forest, GBTClassifier: boosted}[cls]
        small = small.copy({small.getParam(size): 2})
        fitted = model.fit_comparator(df, "y", ["a", "b"], small)
        used = seen[-1].where(~F.col(model.VALIDATION)) if model.VALIDATION in seen[-1].columns else seen[-1]
        of = {r.y: r.w for r in used.groupBy("y").agg(F.sum(model.WEIGHT).alias("w")).collect()}
        assert of[0] == pytest.approx(of[1])
    assert 80 < seen[-1].where(model.VALIDATION).count() < 220
    dealt, permuted = [], model.permuted
    monkeypatch.setattr(model, "permuted", lambda *a: (dealt.append(a[1:]), permuted(*a))[1])
    model.permutation_importance(fitted, df, "y", ["a"], "key")
    assert len(set(dealt)) == 10


def test_study_arms_are_registered_whole(spark, monkeypatch):
    from siltmark import plans
    from siltmark.operators import arms

    seen = []

    def fit_all(df, presence, fits, sets=None, categorical=(), background_weight=100.0, iterations=100, tolerance=0.0):
        seen.append(({(f.beta, f.classes) for f in fits.values()}, len(fits), iterations))
        return {n: model.Additive(linear={c: (0.1, 0.0, 1.0) for c in f.layers}) for n, f in fits.items()}

    monkeypatch.setattr(arms, "fit_all", fit_all)
    assert plans.QUERIES["aicc_grid"](spark, "/root/testdata/sf0.001").count() == 15
    assert seen == [({(b, c) for b in (0.25, 0.5, 1.0, 2.0, 4.0) for c in ("L", "Q", "LQ")}, 15, 50)]
    for name, n in (("leave_one_group_out", 3), ("ablation_groups", 3), ("masked_background_arm", 2), ("jackknife_gains", 7)):
        seen.clear()
        plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert seen == [({(0.5, "LQ")}, n, 100)], name


def test_too_many_codes_are_an_error(spark):
    df = spark.range(model.CODES + 1).select(F.col("id").alias("c"), (F.col("id") % 2).alias("y"))
    with pytest.raises(ValueError):
        model.fit_presence_background(df, "y", ["y", "c"], ["c"])


def test_equal_rows_of_permuted_copies_are_scored_once(spark, monkeypatch):
    from siltmark.operators import metrics

    df = spark.createDataFrame([(i, float(i % 5), float(i % 7), int(i % 5 > 2 or i % 11 == 0)) for i in range(1500)], "key long, a double, b double, y int")
    fitted = model.fit_comparator(df, "y", ["a", "b"], model.comparators()["logistic_regression"])
    expected = {}
    whole = metrics.auc(model.probability(fitted, df), "y", "y_score").first().auc
    for i, c in enumerate(["a", "b"] * 2):
        expected.setdefault(c, []).append(whole - metrics.auc(model.probability(fitted, model.permuted(df, c, "key", 42 + i)), "y", "y_score").first().auc)
    seen, probability = [], model.probability
    monkeypatch.setattr(model, "probability", lambda m, rows: (seen.append(rows.count()), probability(m, rows))[1])
    got = {r["layer"]: r["drop"] for r in model.permutation_importance(fitted, df, "y", ["a", "b"], "key", repeats=2).collect()}
    assert seen[0] <= 5 * 7 * 2
    assert all(got[c] == pytest.approx(sum(v) / len(v)) for c, v in expected.items())


def test_permuted_copies_are_dealt_in_rounds(spark, monkeypatch):
    from siltmark.operators import rounds

    df = spark.createDataFrame([(i, float(i % 5), float(i % 7), int(i % 5 > 2 or i % 11 == 0)) for i in range(1500)], "key long, a double, b double, y int")
    fitted = model.fit_comparator(df, "y", ["a", "b"], model.comparators()["logistic_regression"])
    made, settled = [], rounds.settled
    monkeypatch.setattr(rounds, "settled", lambda *a: (made.append(settled(*a)), made[-1])[1])
    one = model.permutation_importance(fitted, df, "y", ["a", "b"], "key", repeats=2).collect()
    assert len(made) == 1
    got = model.permutation_importance(fitted, df, "y", ["a", "b"], "key", repeats=2, dealt_rows=3000).collect()
    assert len(made) == 1 + 3
    assert {r["layer"]: r["drop"] for r in got} == pytest.approx({r["layer"]: r["drop"] for r in one})
